"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Sources weigh 5, 2, 1 in turn.  The budget is shared by weight; a source whose share exceeds the most
epochs it may be repeated is clamped there and its excess goes to the others by weight, until none is
above.  A source's documents are then all taken the whole number of times that its target holds, and
the rest of the target is sampled without replacement in the order of a seeded hash; of the document at
the border a part counts, so that targets are met to the word (see ``mix`` for what becomes of it).

The sampling order is kept in slices of a source, of a few thousand rows by hash: each has its part of
the source's remainder in proportion to its words.  So no task ever holds a source, however hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HEAVY, WORD, fresh, lookup, materialize, text_of

WEIGHTS = (5, 2, 1)
#: Rows in a slice of a source, on average.
SLICE = 2048


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def water_fill(sources: DataFrame, budget: float, epochs: float, weights: tuple = WEIGHTS) -> DataFrame:
    """``sources(source, source_size, rows)`` with ``target``.  Weights go by code point, null last.

    Each round sums the sources that are still below their cap, a few numbers; only these reach the
    driver.  The rows of a round are the sources, whatever their number.
    """
    spark = sources.sparkSession
    # the rank: sorted in ranges, numbered inside, with the counts of the ranges before added
    ranged = materialize(sources.repartitionByRange(8, F.col("source").isNull(), "source").withColumn("range", F.spark_partition_id()), "sources")
    before = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.count("*").alias("n")).collect()}
    starts, at = {}, 0
    for k in sorted(before):
        starts[k] = at
        at += before[k]
    rank = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    offset = F.coalesce(*[F.when(F.col("range") == k, F.lit(v)) for k, v in starts.items()], F.lit(0)) if starts else F.lit(0)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank + offset) % len(weights)).cast("int") + 1)
    table = materialize(ranged.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(epochs))), "weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    for _ in range(10_000):
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        row = table.agg(F.sum(F.when(full, F.col("cap"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        new = (budget * total - (row["held"] or 0.0)) / row["open"]
        if new <= level * (1 + 1e-15):
            break
        level = new
    else:
        raise RuntimeError("water-filling didn't settle")
    return table.select("source", "source_size", "rows", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def _planned(docs: DataFrame, size: str, mark: str, source: str, key: str, budget: float, epochs: float, seed: int) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its source's size and target, and the words taken; and the new columns' names.  ``mark`` is the text's hash."""
    name = {k: fresh(docs, k) for k in ("source_size", "target", "taken", "slice", "order", "cum", "all", "whole", "rest", "rows", "mixed")}
    own = docs.withColumn(name["mixed"], F.coalesce(F.concat(F.lit("="), docs[source].cast("string")), F.lit("")))
    sources = own.groupBy(docs[source].cast("string").alias("source")).agg(F.coalesce(F.sum(size), F.lit(0)).alias("source_size"), F.count("*").alias("rows"))
    plan = materialize(water_fill(materialize(sources, "sizes"), budget, epochs), "targets")
    plan = plan.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias(name["mixed"]), *[F.col(c).alias(name[c]) for c in ("source_size", "target", "rows")])
    n = plan.agg(F.count("*"), F.sum(name["rows"])).first()
    if n[0] <= HEAVY:
        both = own.join(F.broadcast(plan), name["mixed"])
    else:
        both = lookup(own, plan.withColumn(name["cum"], F.col(name["rows"])), name["mixed"], n[1], name["cum"])
    order = F.xxhash64(F.lit(seed), F.coalesce(docs[key].cast("string"), F.lit("")), F.col(mark))
    both = both.withColumn(name["order"], order).withColumn(name["slice"], F.pmod(F.xxhash64(F.lit(seed + 1), name["order"]), F.ceil(F.col(name["rows"]) / SLICE).cast("long")))
    whole = F.when(F.col(name["source_size"]) > 0, F.floor(F.col(name["target"]) / F.col(name["source_size"]) + 1e-12)).otherwise(F.lit(0)).cast("long")
    rest = F.when(F.col(name["source_size"]) > 0, F.col(name["target"]) / F.col(name["source_size"]) - whole).otherwise(F.lit(0.0))
    group = Window.partitionBy(name["mixed"], name["slice"])
    both = both.withColumn(name["whole"], whole).withColumn(name["rest"], F.greatest(F.lit(0.0), rest))
    both = both.withColumn(name["all"], F.sum(size).over(group)).withColumn(name["cum"], F.sum(size).over(group.orderBy(name["order"], size).rowsBetween(Window.unboundedPreceding, -1)))
    room = F.round(F.col(name["rest"]) * F.col(name["all"])).cast("long") - F.coalesce(F.col(name["cum"]), F.lit(0))
    taken = F.col(name["whole"]) * F.col(size) + F.greatest(F.lit(0).cast("long"), F.least(F.col(size), room))
    return both.withColumn(name["taken"], taken), name


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", budget: float = 1.5, epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken.

    ``size`` counts words (runs without ASCII white space; null has none); ``target`` is the source's
    share of ``budget`` times all words, at most ``epochs`` times its own; ``taken`` the words that the mix
    takes of this document, repeats counted, at most ``epochs`` times its size.  Null is a source of its own.
    A source without words has target 0.  Reruns agree: the order is a hash of key and text, and
    rows that tie in it are equal.  Other columns are ignored; an empty table gives an empty result.
    """
    own = docs.select(docs[key].alias("doc_id"), docs[source].cast("string").alias("source"), F.xxhash64(docs[text]).alias("print"), n_words(text_of(docs, text)).alias("size"))
    plan, n = _planned(own, "size", "print", "source", "doc_id", budget, epochs, seed)
    return plan.select("doc_id", "size", F.col(n["source_size"]).alias("source_size"), F.col(n["target"]).alias("target"), F.col(n["taken"]).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    pieces = F.regexp_extract_all(text, F.concat(F.lit(r"(?s)\G([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)")), 1)
    return F.array_join(F.slice(pieces, F.lit(1), n), "")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", length: str | None = "n_chars", budget: float = 1.5, epochs: float = 2.0, seed: int = 17, whole: bool = True) -> DataFrame:
    """The mixed corpus: rows of ``docs`` as often as taken.

    The document at a slice's border, of which the mix takes a part, is taken whole or not at all by a seeded draw
    with that part as its chance; with ``whole`` off it is cut to its first words, so that targets are met to the word.
    Columns are those of ``docs``, under any names; where a text is cut, the column ``length``, if there, has its new
    length.  Rows that the mix takes nothing of go: those of null and wordless texts always.  A null source is one of
    its own; a null key counts as the empty text in the order; equal rows are taken like any others; an empty table stays empty.
    """
    size, mark = fresh(docs, "size"), fresh(docs, "print")
    plan, n = _planned(docs.withColumns({size: n_words(text_of(docs, text)), mark: F.xxhash64(docs[text])}), size, mark, source, key, budget, epochs, seed)
    words, taken = F.col(size), F.col(n["taken"])
    times = F.when(words > 0, F.expr(f"{n['taken']} div {size}")).otherwise(F.lit(0))
    part = F.when(words > 0, taken - times * words).otherwise(F.lit(0))
    draw = F.pmod(F.xxhash64(F.lit(seed + 2), F.col(n["order"])), F.lit(1 << 32)) / F.lit(float(1 << 32))
    last = F.when(draw * words < part, F.array(words)) if whole else F.when(part > 0, F.array(part))
    lengths = F.concat(F.array_repeat(words, times.cast("int")), F.coalesce(last, F.array().cast("array<bigint>")))
    many = plan.withColumn(n["cum"], F.explode(lengths))
    if whole:
        return many.select(*[docs[c] for c in docs.columns])
    cut = F.col(n["cum"]) < words
    out = []
    for c in docs.columns:
        if c == text:
            out.append(F.when(cut, first_words(docs[text], F.col(n["cum"]).cast("int"))).otherwise(docs[text]).alias(c))
        elif c == length:
            out.append(F.when(cut, F.length(first_words(docs[text], F.col(n["cum"]).cast("int")))).otherwise(docs[c]).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(docs[c])
    return many.select(*out)
