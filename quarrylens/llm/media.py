"""Media columns: interleaved sequences of text and media references, resolved by digest.

``parse_html`` turns a page into an ordered list of structs, text runs and media references with their
captions.  ``resolve`` joins the references with a media table by digest: payload columns are computed
once for each distinct digest and reach every position that refers to it; order, positions and captions
stay as parsed.  A payload is stored losslessly as a grey image of 8-bit samples, 24 to a row, with a
portable header and its samples deflated, and is read back from the stored bytes.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialize

UNIT, ACROSS = 576, 24
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEMS = "array<struct<position:int,kind:string,text:string,media:string,caption:string>>"
_ITEM = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("media", pa.string()), ("caption", pa.string())]))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def padded(text: bytes) -> bytes:
    """The text with bytes 255 behind it, up to a positive multiple of the unit."""
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def store(payload: bytes) -> bytes:
    """A grey PNG image of the payload's bytes, row by row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ACROSS)
    lines = np.zeros((len(rows), ACROSS + 1), np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ACROSS, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def load(media: bytes) -> np.ndarray:
    """The samples of a stored image, as rows; raises ValueError if it is damaged."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not an image of this kind")
    at, size, body = 8, None, []
    while at + 12 <= len(media):
        n = struct.unpack(">I", media[at : at + 4])[0]
        kind, part = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + part):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8-bit grey without interlace")
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:]


def feature(rows: np.ndarray) -> str:
    """Mean, spread and the share of each of eight value bands, of all samples."""
    flat = rows.ravel()
    bands = np.bincount(flat >> 5, minlength=8) / max(1, len(flat))
    return ",".join(f"{v:.4f}" for v in (flat.mean() if len(flat) else 0.0, flat.std() if len(flat) else 0.0, *bands))


class _Parser(HTMLParser):
    """Text runs and media references in order.

    A figure's caption goes to all its references, wherever it stands in it; without a caption they have their alt
    text.  The caption of a figure without references is a text run, as is one outside of any figure.
    """

    MEDIA = ("img", "video", "audio", "source", "embed")
    SKIP = ("script", "style", "noscript", "template")
    BREAK = ("p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "figure", "figcaption", "blockquote", "nav", "footer", "header", "title")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.skip = 0
        self.figures: list[dict] = []  # the open ones: their references and captions
        self.caption = False

    def add(self, kind: str, text: str | None = None, media: str | None = None, caption: str | None = None):
        self.items.append({"position": len(self.items), "kind": kind, "text": text, "media": media, "caption": caption})

    def flush(self):
        text = " ".join("".join(self.run).split())
        self.run = []
        if text and self.caption and self.figures:
            self.figures[-1]["said"].append(text)
        elif text:
            self.add("text", text)

    def end_caption(self):
        self.flush()
        self.caption = False

    def end_figure(self):
        self.end_caption()
        if self.figures:
            f = self.figures.pop()
            said = " ".join(f["said"])
            for i in f["media"] if said else ():
                self.items[i]["caption"] = said
            if said and not f["media"]:
                self.add("text", said)

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        if tag in self.BREAK or tag in self.MEDIA:
            self.flush()
        if tag == "figure":
            self.caption = False
            self.figures.append({"media": [], "said": []})
        if tag == "figcaption":
            self.caption = True
        if tag in self.MEDIA:
            at = dict(attrs)
            ref = at.get("data-digest") or at.get("src")
            if ref:
                self.add("media", media=ref, caption=at.get("alt") or at.get("title"))
                if self.figures:
                    self.figures[-1]["media"].append(len(self.items) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in self.MEDIA:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.SKIP and self.skip:
            self.skip -= 1
        if tag == "figcaption":
            self.end_caption()
        if tag == "figure":
            self.end_figure()
        if tag in self.BREAK:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.run.append(data)

    def finish(self):
        self.close()
        while self.figures:
            self.end_figure()
        self.end_caption()


def parse(page: str | None) -> list[dict]:
    """A page's items in order; a null or empty page has none."""
    p = _Parser()
    p.feed(page or "")
    p.finish()
    return p.items


def parse_html(page: Column) -> Column:
    """The items of a column of pages."""

    @F.arrow_udf(ITEMS)
    def of(column: pa.Array) -> pa.Array:
        return pa.array([parse(x) for x in column.to_pylist()], _ITEM)

    return of(page)


def media_table(texts: DataFrame) -> DataFrame:
    """(digest, n_bytes, media, n) of ``texts(text)``, one row for each distinct text, n rows of which there are; digest is its SHA-256.

    What travels is the stored form, which is smaller than the text.
    """

    def run(batches):
        for b in batches:
            seen: dict[str, list] = {}
            for t in b.column(0).to_pylist():
                raw = (t or "").encode()
                d = hashlib.sha256(raw).hexdigest()
                if d in seen:
                    seen[d][2] += 1
                else:
                    seen[d] = [len(raw), store(padded(raw)), 1]
            kinds = (pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), *(pa.array([v[k] for v in seen.values()], t) for k, t in enumerate(kinds))], ["digest", "n_bytes", "media", "n"])

    made = texts.select(texts["text"].cast("string").alias("text")).mapInArrow(run, "digest string, n_bytes long, media binary, n long")
    return made.groupBy("digest").agg(F.first("n_bytes").alias("n_bytes"), F.first("media").alias("media"), F.sum("n").alias("n"))


def features(media: DataFrame) -> DataFrame:
    """digest, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature: all read back from ``media``; and n."""
    columns = ["digest", "n_bytes", "n", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            out = []
            for digest, size, n, m in zip(*(b.column(k).to_pylist() for k in range(4))):
                rows = load(m)
                back = rows.tobytes()
                out.append((digest, size, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(rows)))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], columns)

    return media.select("digest", "n_bytes", "n", "media").mapInArrow(run, "digest string, n_bytes long, n long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _resolved(items: DataFrame, media: DataFrame, prefix: str) -> DataFrame:
    """Rows of ``items`` (with a column ``i``, one item) and the columns of ``media`` that the item's digest finds."""
    ref = F.when(F.col("i.media").startswith(prefix), F.expr(f"substring(i.media, {len(prefix) + 1})")).otherwise(F.col("i.media"))
    flat = items.select("*", "i.position", "i.kind", "i.text", ref.alias("digest"), "i.caption").drop("i")
    if "n" not in media.columns:
        return flat.join(media, "digest", "left")
    return lookup(flat, media, "digest", media.agg(F.sum("n")).first()[0] or 0, how="left")


def resolve(pages: DataFrame, media: DataFrame, key: str = "page_id", page: str = "html", prefix: str = "sha256:") -> DataFrame:
    """Every item of every page, in its position, with the columns of ``media`` that its digest resolves to.

    Result: digest, key, position, kind, text, caption and ``media``'s further columns.  Text items and
    references that nothing resolves have nulls there.  ``media`` has one row for each digest; if it has a column n,
    the number of rows that refer to it, frequent digests are looked up in a broadcast of bounded size.  Null
    and empty pages have no items; repeated pages each have theirs; a null key stays null; other columns are ignored.
    """
    return _resolved(pages.select(pages[key].alias("key"), F.explode(parse_html(pages[page])).alias("i")), media, prefix)


def document_page(docs: DataFrame, key: str, text: str) -> Column:
    """A page about each document: a heading, half of its lines, its text's image with a caption, the other lines, its source's image."""
    whole = F.coalesce(docs[text].cast("string"), F.lit(""))
    safe = F.replace(F.replace(F.replace(whole, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.transform(F.split(safe, "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>")))
    half = F.floor(F.size(lines) / 2).cast("int")
    named = F.coalesce(docs[key].cast("string"), F.lit("no key"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    figure = F.concat(F.lit("<figure><figcaption>Text of "), named, F.lit('</figcaption><img data-digest="sha256:'), digest(whole), F.lit('"></figure>'))
    return F.concat(F.lit("<article><h1>Document</h1>"), F.array_join(F.slice(lines, F.lit(1), half), ""), figure, F.array_join(F.slice(lines, half + 1, F.size(lines)), ""), F.lit('<img src="logo.png" alt="source"></article>'))


def document_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, caption, position, n_texts, n_media.

    Each document becomes a page that holds its lines and shows its text's image among them; the reference is
    resolved by digest, ``position`` is its place among the page's items, ``n_texts`` of which are texts.
    Equal texts share one stored image.  A null text is empty.  Repeated rows each get a row; a null key
    stays null; other columns are ignored; an empty table gives an empty result.
    """
    whole = F.coalesce(docs[text].cast("string"), F.lit(""))
    stored = materialize(features(media_table(docs.select(whole.alias("text")))), "media")
    items = docs.select(docs[key].alias("key"), parse_html(document_page(docs, key, text)).alias("items"))
    count = lambda kind: F.size(F.filter("items", lambda x: x["kind"] == kind)).alias(f"n_{kind}s" if kind == "text" else f"n_{kind}")
    own = F.get(F.filter("items", lambda x: x["media"].startswith("sha256:")), F.lit(0))
    each = materialize(items.select("key", count("text"), count("media"), own.alias("i")), "items")
    found = _resolved(each, stored, "sha256:")
    return found.select(F.col("key").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "caption", "position", "n_texts", "n_media")


def page_of(items: list[dict]) -> str:
    """A page that parses to these items."""
    out = []
    for i in items:
        if i["kind"] == "text":
            out.append(f"<p>{html.escape(i['text'])}</p>")
        else:
            out.append(f'<figure><img src="{html.escape(i["media"])}"><figcaption>{html.escape(i["caption"] or "")}</figcaption></figure>')
    return "".join(out)
