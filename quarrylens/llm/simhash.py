"""SimHash near copies by the generalised pigeonhole principle.

A fingerprint has 64 bits: each is set if over half the document's shingle hashes have it set.  Two
fingerprints link at ``radius`` or fewer differing bits.

1. Documents become fingerprints; equal ones are one class from here on, whatever their number.
2. The bits are grouped into m partitions, correlated bits together, from a sample of fingerprints.  Partition i has a
   threshold t_i, and the thresholds sum to radius - m + 1: by the generalised pigeonhole principle, linked fingerprints
   differ in at most t_i bits of some partition i (one with t_i = -1 needs no index).  For each m dynamic programming finds
   the thresholds with the least estimated cost of entries and candidates, and the cheapest m is taken.  A bad
   estimate costs time and never a link.
3. Each fingerprint is entered under its part's value, and probes all values within t_i of it: half the distance is left to
   either side where that is cheaper.  What meets under a key is verified in sorted streams; of a key's links only
   a spanning forest goes on.
4. A key with very many fingerprints isn't searched by pairs: its fingerprints enter all points within radius / 2 bits, and
   two of them share a point just when they link, so linking all of a point to its smallest is exact and linear.
5. The links' components give each document the smallest key that it can reach.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialize, parts
from .components import components

BITS, RADIUS = 64, 4
#: Shingles hashed at a time; fingerprints sampled for the partitions; fingerprints of a key that are compared in pairs at most.
RUN, SAMPLE, LARGE = 16_384, 4096, 8192
#: What an entry costs, in candidates.
ENTRY = 24.0
U64 = np.uint64
#: Bytes of a text that are split into words at a time.
STRETCH, SEPARATOR = 1 << 20, re.compile(rb"[\x20\x09-\x0d]")


def _runs(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, A-Z folded, for about a megabyte at a time."""
    at = 0
    while at < len(text):
        gap = SEPARATOR.search(text, at + STRETCH)
        end = gap.start() if gap else len(text)
        yield text[at:end].lower().split()  # of bytes, both know ASCII only
        at = end


def fingerprint(text: bytes, size: int = 4) -> int:
    """SimHash of a UTF-8 text: A-Z folded, words without ASCII white space, ``size``-word shingles joined by spaces, repeats included."""
    digest, total, n, words = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), 0, []
    for more in _runs(text):
        words = words + more
        body, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words], dtype=np.int64)
        start, stop = [0, *ends[: max(0, len(words) - size)].tolist()], (ends[size - 1 :] - 1).tolist()
        for i in range(0, len(stop), RUN):
            h = np.array([digest(body[a:b], 42) for a, b in zip(start[i : i + RUN], stop[i : i + RUN])], U64)
            total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(stop)
        words = words[max(0, len(words) - size + 1) :]
    if not n:
        return int(digest(b" ".join(words), 42)) if words else 0
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.fromiter((fingerprint(t or b"", size) for t in batch.column(1).cast(pa.large_binary()).to_pylist()), U64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.view(np.int64))], ["doc_id", "print"])

    return run


def partition_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """All bits in ``m`` groups of about one size; each grows by the bits that correlate most with what it has."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(axis=0)
    norm = np.sqrt((bits**2).sum(axis=0))
    like = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-9)
    left, out = set(range(BITS)), []
    for k in range(m):
        width = BITS * (k + 1) // m - BITS * k // m
        own = [max(left, key=lambda b: (like[b, sorted(left)].sum(), -b))]
        left -= {own[0]}
        while len(own) < width:
            own.append(max(left, key=lambda b: (like[b, own].sum(), -b)))
            left -= {own[-1]}
        out.append(sorted(own))
    return out


def gathered(x: np.ndarray, bits: list[int]) -> np.ndarray:
    """The values of ``bits``, side by side from the lowest."""
    out = np.zeros(len(x), U64)
    for k, b in enumerate(bits):
        out |= ((x >> U64(b)) & U64(1)) << U64(k)
    return out


def balls(width: int, radius: int) -> np.ndarray:
    """All masks of ``width`` bits with at most ``radius`` set, the empty one first."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in itertools.combinations(range(width), r)], U64)


def _volume(width: int, radius: int) -> int:
    return sum(math.comb(width, r) for r in range(radius + 1))


def sides(threshold: int) -> tuple[int, int]:
    """How far a fingerprint is entered and how far it probes: together the threshold."""
    return threshold // 2, threshold - threshold // 2


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds with the given sum and the least cost; ``costs[i][t + 1]`` is that of partition i with t, from -1."""
    best = {0: (0.0, ())}
    for own in costs:
        found: dict = {}
        for (spent, (cost, taken)), (t, more) in itertools.product(best.items(), enumerate(own, -1)):
            new = (cost + more, (*taken, t))
            found[spent + t] = min(found.get(spent + t, new), new)
        best = found
    return list(best[total][1])


def planned(sample: np.ndarray, n: int, radius: int = RADIUS) -> tuple[list[list[int]], list[int]]:
    """Partitions and thresholds for ``n`` fingerprints like the sample's."""
    best = None
    for m in range(1, radius + 2):
        groups = partition_bits(sample, m)
        costs = []
        for bits in groups:
            part = gathered(sample, bits)
            far = np.zeros(len(bits) + 1)
            for i in range(0, len(part), 512):  # every pair of the sample, in blocks
                d = np.bitwise_count(part[i : i + 512, None] ^ part[None, :])
                far += np.bincount(d.ravel(), minlength=len(far))
            far[0] -= len(part)
            share = np.maximum(np.cumsum(far) / max(1, len(part) * (len(part) - 1)), np.cumsum([math.comb(len(bits), r) for r in range(len(bits) + 1)]) / 2.0 ** len(bits))
            costs.append([0.0] + [ENTRY * _volume(len(bits), sides(t)[1]) + n * share[t] for t in range(min(radius, len(bits)) + 1)])
        thresholds = allocate(costs, radius - m + 1)
        cost = sum(c[t + 1] for c, t in zip(costs, thresholds))
        if best is None or cost < best[0]:
            best = (cost, groups, thresholds)
    return best[1], best[2]


def _entries(groups: list[list[int]], thresholds: list[int]):
    """(key, print, entered): under each part's value the fingerprint itself, and its probes.  The key has the partition in its top bits."""
    plan = []
    for i, (bits, t) in enumerate(zip(groups, thresholds)):
        if t >= 0:
            near, far = sides(t)
            masks = balls(len(bits), far)
            plan.append((i, bits, masks, np.bitwise_count(masks) <= near))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(U64)
            for start in range(0, len(every), 4096):
                x = every[start : start + 4096]
                for i, bits, masks, near in plan:
                    value = (gathered(x, bits)[:, None] ^ masks[None, :]).ravel()
                    if len(bits) > 60:  # one partition alone: its value fills the key
                        key = value
                    else:
                        key = value | U64(i) << U64(60)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(x, len(masks)).view(np.int64)), pa.array(np.tile(near, len(x)))], ["key", "print", "entered"])

    return run


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of stars of the links between ``a`` and ``b``, which are below ``n``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


def _verified(key: np.ndarray, x: np.ndarray, entered: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a stretch of whole keys, in order: of each key's entered fingerprints with all of the key's."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    first, n = edge[:-1], np.diff(edge)
    us, vs = [], []
    small = np.flatnonzero((n > 1) & (n <= 64))
    for many in np.split(small, np.flatnonzero(np.diff(np.cumsum(n[small].astype(np.int64) ** 2) // 4_000_000)) + 1) if len(small) else []:
        at = np.repeat(first[many], n[many]) + _within(n[many])
        a = np.repeat(at, np.repeat(n[many], n[many]))
        b = np.repeat(first[many], n[many] ** 2) + _within(np.repeat(n[many], n[many]))
        ok = entered[a] & (x[a] != x[b])
        a, b = a[ok], b[ok]
        ok = np.bitwise_count(x[a] ^ x[b]) <= radius
        names, flat = np.unique(np.concatenate([a[ok], b[ok]]), return_inverse=True)
        u, v = forest(len(names), flat[: len(flat) // 2], flat[len(flat) // 2 :])
        us.append(x[names[u]])
        vs.append(x[names[v]])
    for k in np.flatnonzero(n > 64).tolist():
        own, mark = x[first[k] : first[k] + n[k]], entered[first[k] : first[k] + n[k]]
        base, a, b = np.flatnonzero(mark), [], []
        for i in range(0, len(base), 256):
            p, q = np.nonzero(np.bitwise_count(own[base[i : i + 256], None] ^ own[None, :]) <= radius)
            u, v = forest(len(own), base[i + p], q)
            a.append(u)
            b.append(v)
        u, v = forest(len(own), np.concatenate([*a, base[:0]]), np.concatenate([*b, base[:0]]))
        us.append(own[u])
        vs.append(own[v])
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, U64), np.zeros(0, U64))


def _within(n: np.ndarray) -> np.ndarray:
    """0 .. n[0] - 1, 0 .. n[1] - 1, and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _links(radius: int):
    """Links of entries sorted by key; a key may go on in the next batch, never in another task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, bool)]

        def out(u, v):
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            new = [batch.column(0).to_numpy(zero_copy_only=False).view(U64), batch.column(1).to_numpy(zero_copy_only=False).view(U64), batch.column(2).to_numpy(zero_copy_only=False)]
            held = [np.concatenate(p) for p in zip(held, new)]
            cut = int(np.flatnonzero(np.concatenate(([True], held[0][1:] != held[0][:-1])))[-1]) if len(held[0]) else 0
            if cut:
                yield out(*_verified(*(h[:cut] for h in held), radius))
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield out(*_verified(*held, radius))

    return run


def _points(radius: int):
    """(point, print): all points within ``radius`` / 2 bits, for an even radius; a pair within it shares one."""
    masks = balls(BITS, radius // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(U64)
            for start in range(0, len(every), 32):
                x = every[start : start + 32]
                yield pa.RecordBatch.from_arrays([pa.array((x[:, None] ^ masks[None, :]).ravel().view(np.int64)), pa.array(np.repeat(x, len(masks)).view(np.int64))], ["point", "print"])

    return run


def linked_prints(own: DataFrame, n: int, radius: int = RADIUS, sample: int = SAMPLE, large: int = LARGE) -> DataFrame:
    """(vertex, root) of the distinct ``own(print)`` that links connect; ``n`` is their number."""
    spark = own.sparkSession
    if radius % 2:
        raise ValueError("the radius must be even")
    if n < 2:
        return spark.createDataFrame([], "vertex long, root long")
    some = own.orderBy(F.xxhash64(F.lit(7), "print"), "print").limit(sample).toArrow().column(0).to_numpy().view(U64)
    groups, thresholds = planned(some, n, radius)
    entries = own.mapInArrow(_entries(groups, thresholds), "key long, print long, entered boolean")
    tasks = parts(spark)
    count = materialize(entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > large), "large-keys")
    if count.limit(1).count():  # never searched by pairs
        total = n * sum(_volume(len(b), sides(t)[1]) for b, t in zip(groups, thresholds) if t >= 0)
        told = materialize(lookup(entries, count.withColumn("many", F.lit(True)), "key", total, how="left").select("key", "print", "entered", "many"), "entries")
        entries = told.where("many IS NULL").drop("many")
        point = told.where("many").select("print").distinct().mapInArrow(_points(radius), "point long, print long")
        point = materialize(point, "points")
        least = materialize(point.groupBy("point").agg(F.min("print").alias("low"), F.count("*").alias("n")).where("n > 1"), "least-points")
        stars = lookup(point, least, "point", point.count()).where("print <> low").select(F.col("print").alias("u"), F.col("low").alias("v"))
    else:
        stars = None
    links = entries.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_links(radius), "u long, v long")
    return components(materialize(links if stars is None else links.union(stars), "print-links"), "prints")


def near_prints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, radius: int = RADIUS, sample: int = SAMPLE, large: int = LARGE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 lower-case hexadecimal digits), component_id.

    Null, empty and wordless texts have fingerprint zero and link like any other.  ``component_id`` is the smallest key that
    links reach, the row's own among them; a null key is never the smallest unless all of its component are null (then
    null).  Repeated rows each get a row; other columns, whatever their names, are ignored; an empty table gives an empty
    result.  All pairs within ``radius`` bits count, without a bound on their number.
    """
    own = docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text"))
    found = materialize(own.mapInArrow(_fingerprints(size), f"doc_id {docs.schema[key].dataType.simpleString()}, print long"), "prints")
    classes = materialize(found.groupBy("print").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "print-classes")
    sums = classes.agg(F.count("*"), F.sum("n")).first()
    roots = linked_prints(classes.select("print"), sums[0], radius, sample, large)
    named = materialize(classes.join(roots, classes["print"] == roots["vertex"], "left").select("print", "low", "n", F.coalesce("root", "print").alias("root")), "named-prints")
    least = materialize(named.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n")), "least-prints")
    answer = materialize(lookup(named.select("print", "root", F.col("n").alias("rows")), least, "root", sums[0]).select("print", "component_id", F.col("rows").alias("n")), "print-answers")
    out = lookup(found, answer, "print", sums[1] or 0)
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
