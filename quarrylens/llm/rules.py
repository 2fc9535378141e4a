"""Line-first quality rules, in DataFrame functions only.

Every line is judged by itself: terminal punctuation, share of signs, navigation, boilerplate.  Lines
that fail are removed, and a document that loses too much of its text is rejected.  The counts that
reject a document outright (very short, or mostly repeated five-word windows) come from the same words.

All of it is one projection over the scan: no shuffle, no Python.  Repeated windows are found by sorting
a document's own window hashes, and only in documents that have any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_of

GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: What marks a line as boilerplate or as a menu.
BOILERPLATE = r"(?i)all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|enable javascript|lorem ipsum|click here|subscribe to|sign up now|skip to content|powered by"
MENU = r"[\x20\x09-\x0D][|»›•·][\x20\x09-\x0D]"
END = r"[.!?…:;\"'”’»)\]][\x20\x09-\x0D]*$"
SIGNS = r"[#*$%&|<>!?={}\[\]\\~^_@]"
#: The share of a line's characters that may be signs, and of a text's words' characters that must stay.
MOST_SIGNS, LEAST_KEPT = 0.2, 0.5
MIN_WORDS = 10
#: Lines of at least so many words count as prose even where the terminal mark is missing.
PROSE = 12


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def bare_length(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.regexp_replace(text, GAP, "")).cast("long")


def line_passes(line: Column) -> Column:
    size = F.length(line)
    signs = size - F.length(F.regexp_replace(line, SIGNS, ""))
    prose = F.rlike(line, F.lit(END)) | (F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")) >= PROSE)
    return (signs <= MOST_SIGNS * size) & prose & ~F.rlike(line, F.lit(BOILERPLATE)) & (F.regexp_count(line, F.lit(MENU)) < 3)


def _measured(docs: DataFrame, text: str, names: dict[str, str]) -> DataFrame:
    n = names
    whole = docs.withColumn(n["whole"], text_of(docs, text))
    words = whole.withColumn(n["hash"], F.transform(words_of(F.col(n["whole"])), lambda w: F.xxhash64(w)))
    h = F.col(n["hash"])
    at = lambda i, k: F.get(h, i + k)
    window = F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])))
    words = words.withColumn(n["window"], window).withColumn(n["n_words"], F.size(h).cast("long"))
    w = F.col(n["window"])
    order = F.when(F.size(F.array_distinct(w)) < F.size(w), F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    sorted_ = words.withColumn(n["order"], order)
    o = F.col(n["order"])
    twice = F.filter(o, lambda x, k: x["h"].eqNullSafe(F.get(o, k - 1)["h"]) | x["h"].eqNullSafe(F.get(o, k + 1)["h"]))
    marked = sorted_.withColumn(n["place"], F.sort_array(F.transform(twice, lambda x: x["i"])))
    p = F.col(n["place"])
    cover = F.aggregate(F.transform(p, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - v, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, v: a + v)
    lines = F.filter(F.split(F.col(n["whole"]), "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    marked = marked.withColumn(n["n_repeat_words"], F.coalesce(cover, F.lit(0).cast("long"))).withColumn(n["lines"], lines)
    text_, line = F.col(n["whole"]), F.col(n["lines"])
    marked = marked.withColumn(n["n_dup_lines"], (F.size(line) - F.size(F.array_distinct(line))).cast("long"))
    marked = marked.withColumn(n["good"], F.filter(line, line_passes))
    marked = marked.withColumn(n["word_chars"], bare_length(text_)).withColumn(n["n_symbols"], (F.length(text_) - F.length(F.regexp_replace(text_, SYMBOLS, ""))).cast("long"))
    marked = marked.withColumn(n["kept_chars"], bare_length(F.array_join(n["good"], "\n")))
    failed = (F.col(n["n_words"]) < MIN_WORDS) | (100 * F.col(n["n_repeat_words"]) > 20 * F.col(n["n_words"]))
    marked = marked.withColumn(n["base_failed"], failed)
    return marked.withColumn(n["kept"], ~failed & (F.col(n["kept_chars"]) >= LEAST_KEPT * F.col(n["word_chars"])))


_COLUMNS = ("whole", "hash", "window", "order", "place", "lines", "good", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_chars", "base_failed", "kept")


def line_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_chars.

    ``base_failed``: fewer than 10 words, or over a fifth of the words in five-word windows that the text
    has twice.  ``kept``: not failed, and at least half of the words' characters stand in lines that pass.
    A null text counts as empty and fails.  Repeated rows each get a row; a null key stays null; other
    columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    own = docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text"))
    made = _measured(own, "text", {c: c for c in _COLUMNS})
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars")


def clean_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Kept rows of ``docs`` with the failing lines removed from their texts; columns unchanged."""
    names = {c: fresh(docs, c) for c in _COLUMNS}
    made = _measured(docs, text, names).where(F.col(names["kept"]))
    return made.select(*[F.array_join(names["good"], "\n").alias(c) if c == text else docs[c] for c in docs.columns])


#: DuckDB's SQL for ``line_rules`` over ``documents``.
SQL = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
p as (select r, unnest(range(len(ws) - 4)) as i from w where len(ws) >= 5),
g as (select p.r, p.i, array_to_string(ws[p.i + 1 : p.i + 5], ' ') as g from p join w using (r)),
t as (select r, i from (select r, i, count(*) over (partition by r, g) as n from g) where n > 1),
v as (select r, sum(least(5, coalesce(j - i, 5)))::bigint as n from (select r, i, lead(i) over (partition by r order by i) as j from t) group by r),
k as (select r, coalesce(sum(length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g'))), 0)::bigint as kept_chars from (select r, unnest(ls) as l from w)
  where length(l) - length(regexp_replace(l, '[#*$%&|<>!?={{}}\[\]\\~^_@]', '', 'g')) <= 0.2 * length(l)
  and (regexp_matches(l, '[.!?…:;"''”’»)\]][\x20\x09-\x0D]*$') or len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) >= 12)
  and not regexp_matches(l, '{BOILERPLATE}') and len(regexp_extract_all(l, '{MENU}')) < 3 group by r),
m as (select doc_id, len(ws)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(v.n, 0)::bigint as n_repeat_words, coalesce(k.kept_chars, 0)::bigint as kept_chars
  from w left join v using (r) left join k using (r)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and kept_chars >= 0.5 * word_chars as kept, kept_chars from b
"""
