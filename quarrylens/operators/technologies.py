"""Technologies: signature joins over headers, meta tags, URLs and globals; versions; categories.

Signatures are literals of the plan: tables of a few dozen rows, whose size doesn't depend on the data.
A match is a projection to an array, so there is no nested-loop join and no shuffle before the dedupe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls, values

#: Parts of a server header and what they stand for.
SERVER = {"cloudflare": "Cloudflare", "nginx": "nginx", "apache": "Apache", "vercel": "Vercel", "netlify": "Netlify", "flyio": "Fly.io", "deno": "Deno Deploy", "caddy": "Caddy", "microsoft-iis": "IIS", "openresty": "OpenResty", "envoy": "Envoy", "cowboy": "Cowboy", "gunicorn": "Gunicorn", "uvicorn": "Uvicorn", "kestrel": "Kestrel", "lighttpd": "lighttpd", "litespeed": "LiteSpeed", "axum": "Axum", "actix": "Actix", "warp": "Warp", "hyper": "Hyper", "werkzeug": "Werkzeug", "tornado": "Tornado", "puma": "Puma", "thin": "Thin", "unicorn": "Unicorn"}
#: Parts of x-powered-by.
POWERED_BY = {"express": "Express", "asp.net": "ASP.NET", "php": "PHP", "next.js": "Next.js", "nuxt": "Nuxt.js", "flask": "Flask", "django": "Django", "rails": "Ruby on Rails", "fastify": "Fastify", "hapi": "Hapi", "koa": "Koa", "laravel": "Laravel", "symfony": "Symfony", "spring": "Spring", "phoenix": "Phoenix", "gin": "Gin", "fiber": "Fiber", "echo": "Echo", "nestjs": "NestJS", "adonisjs": "AdonisJS", "sails": "Sails.js"}
#: Parts of a generator meta tag.
GENERATOR = {"astro": "Astro", "wordpress": "WordPress", "drupal": "Drupal", "hugo": "Hugo", "jekyll": "Jekyll", "gatsby": "Gatsby", "next.js": "Next.js", "nuxt": "Nuxt.js", "ghost": "Ghost", "eleventy": "Eleventy", "hexo": "Hexo", "docusaurus": "Docusaurus", "vuepress": "VuePress", "mkdocs": "MkDocs", "pelican": "Pelican", "joomla": "Joomla", "wix.com": "Wix", "squarespace": "Squarespace", "shopify": "Shopify", "webflow": "Webflow", "svelte": "SvelteKit", "remix": "Remix", "typo3": "TYPO3", "craft cms": "Craft CMS", "strapi": "Strapi"}
#: Parts of a script's or call's URL.
URL = {"/_next/static/": "Next.js", "/_nuxt/": "Nuxt.js", "/page-data/": "Gatsby", "/__remix/": "Remix", "clerk.com/npm/@clerk/": "Clerk", "clerk.accounts.dev": "Clerk", "googletagmanager.com": "GTM", "google-analytics.com": "Google Analytics", "segment.com/analytics.js": "Segment", "cdn.amplitude.com": "Amplitude", "cdn.heapanalytics.com": "Heap", "static.hotjar.com": "Hotjar", "cdn.mxpnl.com": "Mixpanel", "widget.intercom.io": "Intercom", "js.stripe.com": "Stripe", "js.sentry-cdn.com": "Sentry", "cloudflareinsights.com": "Cloudflare", "/_vercel/": "Vercel", "swagger-ui": "Swagger UI", "redoc.standalone": "ReDoc", "rapidoc-min": "RapiDoc", "accounts.google.com/gsi/": "Google Sign-In", "appleid.cdn-apple.com": "Apple Sign-In", "connect.facebook.net": "Facebook Login", "accounts.google.com/o/oauth2": "Google OAuth", "unpkg.com/htmx": "HTMX", "unpkg.com/alpinejs": "Alpine.js", "cdn.jsdelivr.net/npm/alpinejs": "Alpine.js"}
#: Window globals.
GLOBALS = {"__REACT_DEVTOOLS_GLOBAL_HOOK__": "React", "__VUE_DEVTOOLS_GLOBAL_HOOK__": "Vue.js", "ng": "Angular", "__svelte": "Svelte", "__NEXT_DATA__": "Next.js", "__NUXT__": "Nuxt.js", "__sveltekit_data": "SvelteKit", "__remixContext": "Remix", "_$HY": "Solid.js", "firebase": "Firebase", "Stripe": "Stripe", "__supabase": "Supabase", "auth0": "Auth0", "Clerk": "Clerk", "__clerk_frontend_api": "Clerk", "Amplify": "AWS Amplify", "dataLayer": "GTM", "gtag": "Google Analytics", "ga": "Google Analytics", "analytics": "Segment", "Intercom": "Intercom", "hj": "Hotjar", "mixpanel": "Mixpanel", "__REDUX_DEVTOOLS_EXTENSION__": "Redux", "__APOLLO_STATE__": "Apollo Client", "__APOLLO_CLIENT__": "Apollo Client", "__REACT_QUERY_DEVTOOLS_GLOBAL_HOOK__": "React Query", "__REACT_QUERY_STATE__": "React Query", "__TSR__": "TanStack Router", "__TSR_DEHYDRATED__": "TanStack Router", "__ZUSTAND_DEVTOOLS__": "Zustand", "htmx": "HTMX", "Alpine": "Alpine.js", "Livewire": "Livewire"}
#: Keywords of a technology's name in order, and their categories; the first that is in the name decides.
CATEGORIES = {
    "react": "Frameworks", "vue": "Frameworks", "angular": "Frameworks", "svelte": "Frameworks", "next": "Frameworks", "nuxt": "Frameworks", "remix": "Frameworks", "gatsby": "Frameworks", "ember": "Frameworks", "backbone": "Frameworks",
    "astro": "Static Site Generators", "hugo": "Static Site Generators", "jekyll": "Static Site Generators", "eleventy": "Static Site Generators", "hexo": "Static Site Generators", "docusaurus": "Static Site Generators", "vuepress": "Static Site Generators", "mkdocs": "Static Site Generators", "pelican": "Static Site Generators",
    "express": "Backend", "asp.net": "Backend", "php": "Backend", "flask": "Backend", "django": "Backend", "rails": "Backend", "fastify": "Backend", "koa": "Backend", "hapi": "Backend", "cowboy": "Backend",
    "cloudflare": "Infrastructure", "nginx": "Infrastructure", "apache": "Infrastructure", "vercel": "Infrastructure", "netlify": "Infrastructure", "fly.io": "Infrastructure", "caddy": "Infrastructure", "iis": "Infrastructure", "envoy": "Infrastructure", "openresty": "Infrastructure", "gunicorn": "Infrastructure", "deno deploy": "Infrastructure",
    "auth0": "Authentication", "clerk": "Authentication", "okta": "Authentication",
    "stripe": "Payment", "paypal": "Payment", "braintree": "Payment", "square": "Payment",
    "google analytics": "Analytics", "gtag": "Analytics", "gtm": "Analytics", "mixpanel": "Analytics", "segment": "Analytics", "amplitude": "Analytics", "hotjar": "Analytics", "heap": "Analytics", "fullstory": "Analytics", "plausible": "Analytics",
    "wordpress": "CMS/Platforms", "drupal": "CMS/Platforms", "joomla": "CMS/Platforms", "ghost": "CMS/Platforms", "wix": "CMS/Platforms", "squarespace": "CMS/Platforms", "shopify": "CMS/Platforms", "webflow": "CMS/Platforms", "contentful": "CMS/Platforms", "strapi": "CMS/Platforms",
    "supabase": "Cloud/BaaS", "firebase": "Cloud/BaaS", "appwrite": "Cloud/BaaS", "aws": "Cloud/BaaS", "azure": "Cloud/BaaS", "gcp": "Cloud/BaaS",
    "jquery": "Libraries", "lodash": "Libraries", "axios": "Libraries", "moment": "Libraries", "tailwind": "Libraries", "bootstrap": "Libraries",
    "redux": "State Management", "mobx": "State Management", "zustand": "State Management", "pinia": "State Management", "recoil": "State Management",
    "sentry": "Monitoring", "datadog": "Monitoring", "newrelic": "Monitoring", "logr": "Monitoring",
}
VITE = r"/assets/.*-[A-Za-z0-9]{6,10}\.(?:js|css)$"


def signatures(text: Column, table: dict[str, str]) -> Column:
    """The names whose part is in the lower-cased text."""
    low = F.lower(text)
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), v) for k, v in table.items()])))


def from_headers(headers: Column) -> Column:
    """By the headers ``server`` and ``x-powered-by``, spelled exactly so."""
    one = lambda name, table: F.coalesce(signatures(F.try_element_at(headers, F.lit(name)), table), F.array().cast("array<string>"))
    return F.array_union(one("server", SERVER), one("x-powered-by", POWERED_BY))


def from_url(url: Column) -> Column:
    low = F.lower(url)
    rules = [F.when(F.contains(low, F.lit("/assets/")) & F.rlike(F.element_at(F.split(url, "/"), -1), F.lit(r"-[A-Za-z0-9]{6,10}\.(?:js|css)$")), "Vite"), F.when(F.rlike(low, F.lit(r"[?&]_rsc=")), "Next.js (App Router)"), F.when(F.rlike(low, F.lit(r"[?&]dpl=dpl_")), "Vercel")]
    return F.array_union(signatures(url, URL), F.array_compact(F.array(*rules)))


def from_global(key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in GLOBALS.items() for x in kv])[key]


def detected(*found: DataFrame) -> DataFrame:
    """(page_id, technologies), sorted and distinct, of tables (page_id, names)."""
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    return rows.select("page_id", F.explode("names").alias("name")).groupBy("page_id").agg(F.array_sort(F.collect_set("name")).alias("technologies"))


def category(name: Column) -> Column:
    low, out = F.lower(name), F.lit("Other")
    for word, kind in reversed(CATEGORIES.items()):
        out = F.when(F.contains(low, F.lit(word)), kind).otherwise(out)
    return out


def asset_versions(assets: DataFrame) -> DataFrame:
    """(page_id, version, n): the version that most distinct WordPress assets of a page ask for, at least two; the larger of equals."""
    own = assets.where(urls.any_of(F.lower("url"), urls.WORDPRESS_PARTS)).select("page_id", "url").distinct()
    first = F.get(F.filter(urls.query_pairs(F.col("url")), lambda p: p["key"] == "ver"), F.lit(0))["value"]
    own = own.select("page_id", F.trim(first).alias("version")).where(values.version_struct(F.col("version")).isNotNull())
    count = own.groupBy("page_id", "version").agg(F.count("*").alias("n")).where("n >= 2")
    best = count.groupBy("page_id").agg(F.max(F.struct("n", "version")).alias("best"))
    return best.select("page_id", "best.version", "best.n")


def generator_version(content: Column) -> Column:
    """Of a generator's text or URL; a version with a suffix isn't one."""
    said = F.regexp_extract(content, r"(?i)\bwordpress\s+([0-9]+(?:\.[0-9]+){1,2})\b(?![-+])", 1)
    asked = F.get(F.filter(urls.query_pairs(content), lambda p: p["key"] == "v"), F.lit(0))["value"]
    asked = F.when(values.version_struct(asked).isNotNull(), F.trim(asked))
    return F.coalesce(asked, F.when(values.version_struct(said).isNotNull(), said))


def versions_of(technologies: DataFrame, versions: DataFrame) -> DataFrame:
    """Technologies with their versions by name, whatever the case, and versions of technologies not listed."""
    t = technologies.select("page_id", "name", F.lower("name").alias("k"))
    v = versions.select("page_id", F.lower("name").alias("k"), F.col("name").alias("v_name"), "version")
    both = t.join(v, ["page_id", "k"], "full")
    return both.select("page_id", F.coalesce("name", "v_name").alias("name"), "version", category(F.coalesce("name", "v_name")).alias("category"))
