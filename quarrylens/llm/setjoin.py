"""Jaccard self-join of shingle sets by T-occurrence search, and the groups of near copies that follow.

Two sets x and y with |x ∩ y| >= 0.85 |x ∪ y| share at least T = ceil(0.85 max(|x|, |y|)) shingles.

1. Every document becomes its set's size and 64-bit fingerprint; equal sets are one class from here on.
2. The shingles go to buckets of the hash space, packed as binary rows of seven bytes a shingle.  In a
   bucket the inverted lists are formed; lists of one class can never matter and go (most of all
   shingles).  What is left returns to its class, packed again, with the list's length.
   Shingles of very many documents are known beforehand from a count over a few of them.  Their lists, the
   longest, are never formed: they go straight to their classes.  Which way a list goes changes no result.
3. A class that keeps fewer than T shingles has no partner.  For the others the T - 1 longest lists are
   the "long" ones of DivideSkip, so a partner must turn up in one of the remaining short lists (whose
   single-class members are gone already).  The short lists are linked as stars, not as pairs.
4. The components of those stars are the candidate clusters.  Small ones are searched whole.  A large one is
   dealt by size into bins so wide that linked sets are at most one bin apart, and a bin into blocks; blocks
   meet only inside a bin and with the next bin's.  See ``t_occurrence_links`` for the search, which is exact.
5. Verified links form the components.

No step emits the pairs of a group; a group of n copies costs n rows, and n near copies cost blocks.
Frequent keys (a class of very many copies, a hub, a large cluster) are looked up in a broadcast of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import WORD, discard, fresh, lookup, materialize, parts, written
from .components import components

#: Bits of a shingle's hash that travel; the bucket isn't derived from others.
BITS = 56
LOW = np.uint64((1 << BITS) - 1)
#: Shingles in a bucket, sets in a block, on average.
BUCKET, BLOCK = 2_500_000, 1024
#: Shingles that a map task gathers before it packs them.
FLUSH = 1_500_000
#: Shingles that are counted at most to find the frequent ones, how often one of those occurs there at least, and in all.
COUNTED, TIMES, FREQUENT = 32_000_000, 16, 20_000
#: The level of a frequent shingle, above that of any list.
TOP = 255


def fingerprint(own: np.ndarray) -> int:
    """Of a set of 56-bit hashes; 0 for the empty one."""
    if not len(own):
        return 0
    h = tv.mix(np.array([tv.mix(own).sum(dtype=np.uint64) ^ np.uint64(len(own) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)], np.uint64))
    return int(h.astype(np.int64)[0])


def _sets(column: pa.Array, size: int, some: int = 500) -> Iterator[np.ndarray]:
    """The set of each text, for ``some`` texts at a time."""
    for i in range(0, len(column), some):
        word, at = tv.words(*tv.raw(column.slice(i, some)))
        for own in tv.shingles(word, at, size):
            own &= LOW
            if len(own) > 1:
                own.sort()
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            yield own


def _pack7(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _unpack7(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(b, np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel()


def _frame(parts: list[bytes]) -> bytes:
    return np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)


def _unframe(b: bytes, n: int) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(b, "<u4", n)) + 4 * n
    return [b[e - s : e] for e, s in zip(ends.tolist(), np.frombuffer(b, "<u4", n).tolist())]


def _runs(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        yield int(bucket[a]), a, b


def _out(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "payload"])


def _spread(keys: np.ndarray, sizes: np.ndarray, counts: np.ndarray, tokens: np.ndarray, extra: np.ndarray | None, bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Packed rows (bucket, payload) of tokens that belong to the documents ``keys`` by ``counts``."""
    doc = np.repeat(np.arange(len(keys), dtype=np.int32), counts)
    order = np.argsort(bucket, kind="stable").astype(np.int32)
    doc, tokens, bucket = doc[order], tokens[order], bucket[order]
    extra = extra[order] if extra is not None else None
    for b, i, j in _runs(bucket):
        own, at = np.unique(doc[i:j], return_index=True)
        n = np.diff(np.append(at, j - i))
        parts = [keys[own].astype("<i8").tobytes(), sizes[own].astype("<u4").tobytes(), n.astype("<u4").tobytes(), _pack7(tokens[i:j])]
        yield b, _frame(parts + ([extra[i:j].tobytes()] if extra is not None else []))


def _gather(payloads, n: int) -> list[np.ndarray]:
    """keys, sizes, document of each token, tokens (and the rest) of all packed rows."""
    kinds, found = ("<i8", "<u4", "<u4", None, np.uint8)[:n], [[] for _ in range(n)]
    for p in payloads:
        for k, part in enumerate(_unframe(p, n)):
            found[k].append(part)
    made = []
    for k, kind in enumerate(kinds):  # one after the other, so that the packed parts go as they are used
        body = b"".join(found[k])
        found[k] = []
        made.append(_unpack7(body) if kind is None else np.frombuffer(body, kind))
    keys, sizes, counts, tokens = made[:4]
    return [keys, sizes, np.repeat(np.arange(len(keys), dtype=np.int32), counts), tokens, *made[4:]]


def _size_of(size: int):
    def run(batches):
        for batch in batches:
            n, key = [], []
            for own in _sets(batch.column(1), size):
                n.append(len(own))
                key.append(fingerprint(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.int64()), batch.column(2)], ["doc_id", "n_shingles", "class", "print"])

    return run


def _tally(size: int):
    """(shingle, n) of a task's sets; equal ones count once in a batch."""

    def run(batches):
        for batch in batches:
            held = {fingerprint(own): own for own in _sets(batch.column(0), size) if len(own)}
            if held:
                shingle, n = np.unique(np.concatenate(list(held.values())), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(shingle.astype(np.int64)), pa.array(n)], ["shingle", "n"])

    return run


def frequent(docs: DataFrame, total: int, text: str = "text", size: int = 4, counted: int = COUNTED, least: int = FREQUENT) -> np.ndarray:
    """Shingles that are in more than about ``least`` sets, from a count over some texts; at most ``counted`` / TIMES, in order."""
    rate = max(16, total // counted)
    if total < least:
        return np.zeros(0, np.uint64)
    some = docs.select(docs[text].cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(rate)) == 0)
    n = some.mapInArrow(_tally(size), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = n.where(F.col("n") >= max(TIMES, least // rate)).select("shingle").toArrow()
    return np.sort(rows.column(0).to_numpy().astype(np.uint64))


def _among(x: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the ordered ``names``."""
    if not len(names):
        return np.zeros(len(x), bool)
    return names[np.minimum(np.searchsorted(names, x), len(names) - 1)] == x


def _index(size: int, buckets: int, often):
    """Packed shingles of all distinct sets; the frequent ones go to further buckets, by class."""

    def run(batches):
        keys, sizes, sets, held = [], [], [], 0

        def flush():
            tokens, key, counts = np.concatenate(sets), np.array(keys, np.int64), np.array(sizes, np.int64)
            bucket = (tv.mix(tokens) % np.uint64(buckets)).astype(np.int32)
            many = _among(tokens, often.value)
            if many.any():
                own = np.repeat((tv.mix(key.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32), counts)
                bucket[many] = buckets + own[many]
            return _out(list(_spread(key, counts, counts, tokens, None, bucket)))

        for batch in batches:
            seen = set(keys)
            for own in _sets(batch.column(0), size):
                if len(own) and (key := fingerprint(own)) not in seen:
                    seen.add(key)
                    keys.append(key)
                    sizes.append(len(own))
                    sets.append(own)
                    held += len(own)
                if held > FLUSH:
                    yield flush()
                    keys, sizes, sets, held = [], [], [], 0
        if held:
            yield flush()

    return run


def _level(n: np.ndarray) -> np.ndarray:
    """A list's length as a byte that grows with it."""
    return np.minimum(TOP - 1, 6 * np.log2(n)).astype(np.uint8)


def _back(key: np.ndarray, size: np.ndarray, token: np.ndarray, level: np.ndarray, buckets: int) -> pa.Table:
    """Tokens returned to their classes' buckets, with their lists' levels."""
    order = np.argsort(key, kind="stable")
    token, key, size, level = token[order], key[order], size[order], level[order]
    own, at, counts = np.unique(key, return_index=True, return_counts=True)
    bucket = np.repeat((tv.mix(own.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32), counts)
    return _table(list(_spread(own, size[at], counts, token, level, bucket)))


def _formed(keys: np.ndarray, sizes: np.ndarray, doc: np.ndarray, tokens: np.ndarray, whole: bool) -> list[np.ndarray]:
    """token, class, set size and list length of the postings, once for each class; lists of one class only with ``whole``."""
    order = np.argsort(tokens).astype(np.int32)
    t = tokens[order]
    if not whole and len(t):
        new = np.concatenate(([True], t[1:] != t[:-1]))
        many = ~(new & np.append(new[1:], True))
        order, t = order[many], t[many]
    key = keys[doc[order]]
    size = sizes[doc[order]]
    order = np.lexsort((key, t))  # a class that several tasks have seen counts once
    t, key, size = t[order], key[order], size[order]
    once = np.ones(len(t), bool)
    once[1:] = (t[1:] != t[:-1]) | (key[1:] != key[:-1])
    t, key, size = t[once], key[once], size[once]
    first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, int)
    n = np.diff(np.append(first, len(t)))
    n = np.repeat(n, n)
    keep = np.ones(len(t), bool) if whole else n > 1
    return [t[keep], key[keep], size[keep], n[keep]]


def _lists(buckets: int):
    """In one bucket: inverted lists of two classes or more, sent back to their classes; frequent shingles as they are.

    A bucket's tokens are taken in eight ranges, one after the other, for memory's sake.
    """

    def run(table: pa.Table) -> pa.Table:
        passing = table.column("bucket")[0].as_py() >= buckets
        keys, sizes, doc, tokens = _gather((p.as_py() for p in table.column("payload")), 4)
        made = []
        for k in range(8):
            own = np.flatnonzero(tokens >> np.uint64(BITS - 3) == k)
            made.append(_formed(keys, sizes, doc[own], tokens[own], passing))
        del doc, tokens
        t, key, size, n = (np.concatenate(x) for x in zip(*made))
        if not len(t):
            return _table([])
        return _back(key, size, t, np.full(len(t), TOP, np.uint8) if passing else _level(n), buckets)

    return run


def _table(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([_out(rows)])


def _survivors(percent: int):
    """In one bucket of classes: those that keep T shingles, with all of these and the short lists' ones."""

    def run(table: pa.Table) -> pa.Table:
        keys, sizes, doc, tokens, level = _gather((p.as_py() for p in table.column("payload")), 5)
        key = keys[doc]
        order = np.lexsort((tokens, level, key))
        key, tokens, size = key[order], tokens[order], sizes[doc][order].astype(np.int64)
        out = []
        for i, j in _edges(key):
            s, m = int(size[i]), j - i
            need = -(-percent * s // 100)
            if m >= need:
                out.append((int(key[i]), s, tokens[i : i + m - need + 1].astype(np.int64), np.sort(tokens[i:j]).astype("<u8").tobytes()))
        return pa.table({"class": pa.array([o[0] for o in out], pa.int64()), "size": pa.array([o[1] for o in out], pa.int64()), "short": pa.array([o[2] for o in out], pa.list_(pa.int64())), "shingles": pa.array([o[3] for o in out], pa.binary())})

    return run


def _edges(x: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))).tolist() if len(x) else []
    yield from zip(edge[:-1], edge[1:])


def t_occurrence_links(sizes: list[int], sets: list[np.ndarray], percent: int = 85, mu: float = 0.01, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest among ``sets``: sorted arrays of the shingles that occur elsewhere, with the whole sets' ``sizes``.

    With ``sides``, only links between sets of different sides are looked for.

    DivideSkip.  Sets come in order of size and each queries the lists of those before it.  Of its lists
    the L longest are set aside, L = T / (mu log2 M + 1) as the method proposes; the others are merged
    (they are sorted runs, so a stable sort of their concatenation is the multi-way merge) and ids that
    occur at least T - L times are candidates.  The long lists are then probed by binary search, best
    candidates first, and one that can't reach T any more is dropped.  Candidates that a link has joined
    with the query already are skipped: they can't change the components.
    """
    n = len(sets)
    order = sorted(range(n), key=lambda i: (sizes[i], i))
    flat = np.concatenate([sets[i] for i in order]) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(sets[i]) for i in order])
    by = np.argsort(flat, kind="stable")
    token, lists = flat[by], owner[by]
    first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, int)
    ends = np.append(first[1:], len(token))
    name = token[first] if len(token) else token
    size = np.array([sizes[i] for i in order], np.int64)
    side = np.array([sides[i] for i in order]) if sides is not None else np.arange(n)
    root = np.arange(n)
    out = []
    for q in range(n):
        own = np.searchsorted(name, sets[order[q]])
        need = -(-percent * int(size[q]) // 100)
        if len(own) < need or q == 0:
            continue
        lo = first[own]
        hi = lo + np.array([np.searchsorted(lists[a:b], q) for a, b in zip(lo.tolist(), ends[own].tolist())]) if len(own) < 64 else _before(lists, lo, ends[own], q)
        length = hi - lo
        some = length > 0
        lo, hi, length = lo[some], hi[some], length[some]
        if len(lo) < need:
            continue
        rank = np.argsort(length, kind="stable")
        longest = int(length[rank[-1]])
        skip = min(need - 1, len(lo) - 1, int(need / (mu * math.log2(longest + 1) + 1)))
        short, far = rank[: len(rank) - skip], rank[len(rank) - skip :]
        merged = np.sort(np.concatenate([lists[a:b] for a, b in zip(lo[short].tolist(), hi[short].tolist())]), kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1])))
        ids, seen = merged[edge], np.diff(np.append(edge, len(merged)))
        good = (seen >= need - skip) & (100 * size[ids] >= percent * size[q]) & (side[ids] != side[q])
        ids, seen = ids[good], seen[good]
        for k, f in enumerate(far.tolist()):
            if not len(ids):
                break
            run = lists[lo[f] : hi[f]]
            at = np.searchsorted(run, ids)
            seen = seen + (run[np.minimum(at, len(run) - 1)] == ids)
            if k % 8 == 7:
                good = seen + (skip - k - 1) >= need
                ids, seen = ids[good], seen[good]
        good = 100 * seen >= percent * (size[q] + size[ids] - seen)
        for c in np.unique(root[ids[good]]).tolist():
            out.append((order[q], order[int(ids[good][root[ids[good]] == c][0])]))
            root[root == c] = root[q]
    return out


def _before(lists: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: int) -> np.ndarray:
    """The first place in each sorted run lists[lo:hi] whose id isn't below q, by one binary search over all runs."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        less = open_ & (lists[np.minimum(mid, len(lists) - 1)] < q)
        lo = np.where(less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)


def _search(percent: int):
    def run(table: pa.Table) -> pa.Table:
        keys, side = table.column("class").to_pylist(), table.column("side").to_pylist()
        sets = [np.frombuffer(b, "<u8") for b in table.column("shingles").to_pylist()]
        links = t_occurrence_links(table.column("size").to_pylist(), sets, percent, sides=side if len(set(side)) > 1 else None)
        return pa.table({"u": pa.array([keys[a] for a, _ in links], pa.int64()), "v": pa.array([keys[b] for _, b in links], pa.int64())})

    return run


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """(doc_id, n_shingles, class, print) for every row; equal sets have equal classes, the empty set has class 0; print is the text's hash."""
    own = docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text"), _print(docs, text).alias("print"))
    return own.mapInArrow(_size_of(size), f"doc_id {docs.schema[key].dataType.simpleString()}, n_shingles long, class long, print long")


def _print(docs: DataFrame, text: str):
    return F.xxhash64(docs[text].cast("string"))


def _cells(cluster: DataFrame, percent: int, block: int) -> DataFrame:
    """(root, bin, n, all, here, below, above): how many sets a cluster has in a bin of sizes and in all, and the blocks of the bin and of its neighbours."""
    n = cluster.groupBy("root", "bin").agg(F.count("*").alias("n"))
    order = Window.partitionBy("root").orderBy("bin")  # a root has as many bins as sizes have powers of 100 / percent
    blocks = F.ceil(F.col("n") / block).cast("long")
    n = n.withColumn("here", blocks).withColumn("all", F.sum("n").over(Window.partitionBy("root")))
    near = lambda f, step: F.when(f("bin").over(order) == F.col("bin") + step, f("here").over(order)).otherwise(F.lit(0).cast("long"))
    return n.withColumn("below", near(F.lag, -1)).withColumn("above", near(F.lead, 1))


def _dealt(members: DataFrame, cells: DataFrame, total: int, small: int, block: int) -> DataFrame:
    """``members`` in each block pair that they must be searched in: block, side, class, size, shingles."""
    each = lookup(members, cells, ["root", "bin"], total)
    own = F.floor(F.xxhash64("class").bitwiseAND(F.lit((1 << 62) - 1)) % F.col("here"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<long>"))
    cell = lambda bin_, i, step, j, side: F.struct(F.xxhash64(F.col("root"), bin_, i, F.lit(step), j).bitwiseOR(F.lit(1 << 62)).alias("block"), side.cast("long").alias("side"))
    mine = F.col("own")
    inside = F.transform(upto("here"), lambda k: cell(F.col("bin"), F.least(k, mine), 0, F.greatest(k, mine), k > mine))
    higher = F.transform(upto("above"), lambda k: cell(F.col("bin"), mine, 1, k, F.lit(0)))
    lower = F.transform(upto("below"), lambda k: cell(F.col("bin") - 1, k, 1, mine, F.lit(1)))
    whole = F.array(F.struct(F.pmod(F.xxhash64("root"), F.lit(small)).alias("block"), F.lit(0).cast("long").alias("side")))
    where = F.when(F.col("all") <= block, whole).otherwise(F.concat(inside, higher, lower))
    return each.withColumn("own", own).withColumn("cell", F.explode(where)).select("cell.block", "cell.side", "class", "size", "shingles")


def similar_classes(docs: DataFrame, total: int, text: str = "text", size: int = 4, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """(vertex, root): classes of ``docs`` that links connect.  ``total``: shingles of all sets."""
    spark = docs.sparkSession
    buckets = max(1, -(-total // BUCKET))
    often = spark.sparkContext.broadcast(frequent(docs, total, text, size))
    packed = docs.select(docs[text].cast("string").alias("text")).mapInArrow(_index(size, buckets, often), "bucket int, payload binary")
    lists = packed.repartition(2 * buckets, "bucket").groupBy("bucket").applyInArrow(_lists(buckets), "bucket int, payload binary")
    kept = materialize(lists.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_survivors(percent), "class long, size long, short array<long>, shingles binary"), "survivors")
    entry = kept.select("class", F.explode("short").alias("shingle"))
    hub = materialize(entry.groupBy("shingle").agg(F.min("class").alias("hub"), F.count("*").alias("n")).where("n > 1"), "hubs")
    star = lookup(entry, hub, "shingle", hub.agg(F.sum("n")).first()[0] or 0).where("class <> hub").select(F.col("class").alias("u"), F.col("hub").alias("v"))
    step = 1.0001 * math.log(100 / percent)  # a little wider, so that rounding can't part linked sets
    cluster = components(star, "candidates").join(kept.select("class", "size"), F.col("vertex") == F.col("class"))
    cluster = materialize(cluster.select("class", "root", F.floor(F.log(F.col("size")) / step).cast("long").alias("bin")), "clusters")
    members = kept.drop("short").join(cluster, "class")
    n = cluster.count()
    blocks = _dealt(members, materialize(_cells(cluster, percent, block), "cells"), n, max(1, total // (400 * BLOCK)), block)
    tasks = min(20_000, max(parts(spark), n // (2 * block)))
    links = blocks.repartition(tasks, "block").groupBy("block").applyInArrow(_search(percent), "u long, v long")
    return components(materialize(links, "links"), "groups")


def _grouped(docs: DataFrame, key: str, text: str, size: int, percent: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The ``classes`` of all rows, and (class, root, low, print, n) of the distinct sets: component, smallest key, its text's hash, number of rows."""
    begin = written()
    found = materialize(classes(docs, key, text, size), "classes")
    own = materialize(found.where("n_shingles > 0").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("first"), F.count("*").alias("n"), F.max("n_shingles").alias("size")), "sets")
    roots = similar_classes(docs, own.agg(F.sum("size")).first()[0] or 0, text, size, percent, block)
    named = materialize(own.join(roots, own["class"] == roots["vertex"], "left").select("class", F.coalesce("root", "class").alias("root"), F.col("first.doc_id").alias("low"), "first.print", "n"), "named")
    discard(docs.sparkSession, begin + 1, 1)
    return found, named


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Words are runs without ASCII white space, A-Z folded.  A set holds the distinct ``size``-word
    shingles; the whole sequence if there are fewer words.  Two rows link when
    100 |x ∩ y| >= percent |x ∪ y|.  ``component_id`` is the smallest key reachable by links, the row's own
    if nothing links.  Null or wordless texts have no shingles and link with nothing.  A null key never
    is the smallest unless all keys of its component are null (then null).  Repeated rows each get a row;
    other columns, whatever their names, are ignored; an empty table gives an empty result.
    Shingles are told apart by 56 bits of their hash, classes by 64.
    """
    found, named = _grouped(docs, key, text, size, percent, block)
    sums = named.agg(F.count("*"), F.sum("n")).first()
    least = materialize(named.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n")), "least")
    named = materialize(lookup(named.withColumnRenamed("n", "rows"), least, "root", sums[0]).select("class", "component_id", F.col("rows").alias("n")), "answers")
    some = lookup(found.where("n_shingles > 0"), named, "class", sums[1] or 0)
    none = found.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    return some.select(*columns).union(none.select(*columns))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component one row with the smallest key stays.

    Of equal rows one stays, too; rows without words link with nothing and all stay.  A null key counts
    as the largest.  Columns are those of ``docs``, under any names.
    """
    found, named = _grouped(docs, key, text, size, percent)
    least = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "class", "print")).alias("first")
    own, row = fresh(docs, "print"), fresh(docs, "row")
    kept = named.groupBy("root").agg(least).select(F.xxhash64("first.low").alias(row), F.col("first.print").alias(own))
    again = found.where("n_shingles > 0").groupBy("doc_id", "print").agg(F.count("*").alias("n")).where("n > 1")
    again = materialize(again.select(F.xxhash64("doc_id").alias(row), F.col("print").alias(own)), "again")
    some = F.coalesce(F.rlike(docs[text].cast("string"), F.lit(WORD)), F.lit(False))
    mark = docs.where(some).withColumns({own: _print(docs, text), row: F.xxhash64(docs[key])})
    one = mark.join(kept.hint("shuffle_hash"), [row, own], "left_semi")  # the texts are dealt once and never sorted
    if again.limit(1).count():  # of equal rows one; they are combined before the shuffle
        first = one.join(again.hint("shuffle_hash"), [row, own], "left_semi").dropDuplicates([row, own])
        one = one.join(again.hint("shuffle_hash"), [row, own], "left_anti").unionByName(first)
    return one.select(*docs.columns).union(docs.where(~some))
