"""Hard negatives of embeddings by dual-tree search: a tree over the anchors, a tree over the candidates.

A node of either tree is a ball.  The inner products of two balls' rows lie in an interval,
``<c, d> ± (|c| s + |d| r + r s)`` for centres c, d and radii r, s; where the interval misses what a group of
anchors still looks for, the whole pair of nodes is done.

1. Vectors become integers, so that scores and ties are exact.  Of equal vectors with one label only the first
   ``keep`` + 1 by key can ever be an answer, and the others go before anything is shuffled by vector.
2. Each tree's upper levels are split from a bounded sample, and every row descends to a leaf.  The rows of a
   leaf are dealt into blocks of bounded size, and a block's rows are sorted by further splits.  The balls' radii are taken over all rows.
3. The driver walks pairs of upper nodes, of which there are boundedly many, and keeps the leaf pairs that may matter.
   For positives an anchor looks for scores that reach its ``keep``-th best among the sample; for negatives
   for the window that its positives span.
4. A group of anchors meets the blocks of the kept leaves in streams, best bound first, one block in memory at a time; block
   and leaf pairs are pruned with the group's current thresholds, the others are scored exactly by matrix products.
5. The streams' first few are merged by windows with a limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parts

#: Leaves of the upper trees at most, rows sampled to split them.
LEAVES, ANCHOR_LEAVES, SAMPLE = 256, 64, 4096
#: Candidates in a block, anchors in a group, rows in a leaf inside of them, blocks in a stream; all on average or at most.
BLOCK, GROUP, PIECE, STREAM = 4096, 512, 256, 16
KEEP = 5
LOW = np.iinfo(np.int64).min + 1


class Tree:
    """A binary tree of ``depth`` levels in an array: node i has the children 2i + 1 and 2i + 2; rows go right above ``cut``."""

    def __init__(self, rows: np.ndarray, depth: int) -> None:
        nodes, dim = 2 ** (depth + 1) - 1, rows.shape[1]
        self.depth, self.centre = depth, np.zeros((nodes, dim))
        self.way, self.cut = np.zeros((nodes, dim)), np.full(nodes, np.inf)
        own = {0: rows}
        for i in range(nodes):
            x = own.pop(i, rows[:0])
            self.centre[i] = x.mean(axis=0) if len(x) else 0.0
            if 2 * i + 1 < nodes:
                self.way[i], self.cut[i], right = split(x)
                own[2 * i + 1], own[2 * i + 2] = x[~right], x[right]

    def leaf(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (np.einsum("ij,ij->i", rows, self.way[at]) > self.cut[at])
        return at

    @property
    def first(self) -> int:
        """The first leaf's number."""
        return 2**self.depth - 1


def split(x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Direction, cut and the rows to the right: halves along the line between two far rows; equal rows stay together."""
    if len(x) < 2:
        return np.zeros(x.shape[1]), np.inf, np.zeros(len(x), bool)
    a = x[np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1))]
    b = x[np.argmax(((x - a) ** 2).sum(axis=1))]
    way = b - a
    p = x @ way
    cut = float(np.median(p))
    right = p > cut
    if not right.any():
        cut = float((p.min() + p.max()) / 2)
        right = p > cut
    if not right.any():
        return np.zeros(x.shape[1]), np.inf, right
    return way, cut, right


def sorted_by_splits(x: np.ndarray, size: int) -> np.ndarray:
    """An order of the rows in which every ``size`` come from one small ball, where there are such."""
    out, stack = [], [np.arange(len(x))]
    while stack:
        own = stack.pop()
        if len(own) <= size:
            out.append(own)
            continue
        right = split(x[own])[2]
        if not right.any():
            out.append(own)
        else:
            stack += [own[right], own[~right]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def balls(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[slice]]:
    """Centres and radii of each ``size`` rows in turn."""
    at = [slice(i, min(i + size, len(x))) for i in range(0, len(x), size)]
    centre = np.array([x[s].mean(axis=0) for s in at])
    return centre, np.array([np.sqrt(((x[s] - c) ** 2).sum(axis=1).max()) for s, c in zip(at, centre)]), at


def interval(c: np.ndarray, r: np.ndarray, d: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of rows in balls, for each pair; a little wide for rounding."""
    middle = c @ d.T
    half = np.linalg.norm(c, axis=1)[:, None] * s[None, :] + np.linalg.norm(d, axis=1)[None, :] * r[:, None] + r[:, None] * s[None, :]
    half = half * (1 + 1e-9) + 1e-9 * np.abs(middle) + 1e-3
    return middle - half, middle + half


def dual_walk(anchors: Tree, radius: dict[int, float], wanted: dict[int, tuple[float, float]], candidates: Tree, reach: dict[int, float]) -> list[tuple[int, int, float]]:
    """(anchor leaf, candidate leaf, largest score) of the leaf pairs that may have wanted scores.

    ``radius`` and ``reach`` are the leaves' radii, ``wanted`` the (least, largest) score that an anchor leaf looks for.
    """

    def grown(tree: Tree, leaves: dict[int, float]) -> dict[int, float]:
        out = dict(leaves)
        for i in range(tree.first - 1, -1, -1):
            below = [np.linalg.norm(tree.centre[i] - tree.centre[k]) + out[k] for k in (2 * i + 1, 2 * i + 2) if k in out]
            if below:
                out[i] = float(max(below))
        return out

    r, s, want = grown(anchors, {k: v for k, v in radius.items() if k in wanted}), grown(candidates, reach), dict(wanted)
    for i in range(anchors.first - 1, -1, -1):
        own = [want[k] for k in (2 * i + 1, 2 * i + 2) if k in want]
        if own:
            want[i] = (min(w[0] for w in own), max(w[1] for w in own))
    out, stack = [], [(0, 0)] if r and s else []
    while stack:
        a, c = stack.pop()
        lo, hi = interval(anchors.centre[[a]], np.array([r[a]]), candidates.centre[[c]], np.array([s[c]]))
        if hi[0, 0] < want[a][0] or lo[0, 0] > want[a][1]:
            continue
        if a >= anchors.first and c >= candidates.first:
            out.append((a, c, float(hi[0, 0])))
        elif c >= candidates.first or a < anchors.first and r[a] >= s[c]:
            stack += [(k, c) for k in (2 * a + 1, 2 * a + 2) if k in r]
        else:
            stack += [(a, k) for k in (2 * c + 1, 2 * c + 2) if k in s]
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The lists as rows of ``dim`` numbers; shorter ones end in zeros."""
    flat, n = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.value_lengths())
    if len(n) and n.min() == dim:
        return flat.reshape(-1, dim).astype(np.float64)
    out = np.zeros((len(n), dim))
    at = np.repeat(np.arange(len(n)), n)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def prepared(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, with integer components."""
    v = rows[vector]
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    moved = F.when(rows[key] % 7 == 0, (rows[label].cast("long") + 1) % 10).otherwise(rows[label].cast("long"))
    return rows.where(rows[label].isNotNull() & v.isNotNull() & fine).select(rows[key].cast("long").alias("vec_id"), moved.alias("label"), F.transform(v, lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("v"))


def _placed(tree: Tree, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaf(_matrix(batch.column(2), dim)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["vec_id", "label", "v", "cell"])

    return run


def _packed(tree: Tree, dim: int, known: tuple[np.ndarray, np.ndarray] | None):
    """A block: its leaf and number, radius around the leaf's centre, keys, labels and vectors; for anchors the scores to reach, too."""

    def run(table: pa.Table) -> pa.Table:
        cell, chunk = table.column("cell")[0].as_py(), table.column("chunk")[0].as_py()
        x = _matrix(table.column("v").combine_chunks(), dim)
        order = sorted_by_splits(x, PIECE if known is None else PIECE // 4)
        x, ids, labels = x[order], table.column("vec_id").combine_chunks().take(pa.array(order)), table.column("label").to_numpy()[order]
        least = np.full(len(x), -np.inf)
        if known is not None and len(known[0]) > KEEP:
            score = np.where(labels[:, None] == known[0][None, :], x @ known[1].T, -np.inf)
            least = -np.partition(-score, KEEP, axis=1)[:, KEEP]  # one more, for the anchor itself
        far = float(np.sqrt(((x - tree.centre[cell]) ** 2).sum(axis=1).max()))
        narrow = np.abs(x).max(initial=0) < 32_000
        body = x.astype(np.int16 if narrow else np.float64).tobytes()
        columns = [[cell], [chunk], [far], [float(least.min())], [body], [bool(narrow)]]
        names = ["cell", "chunk", "radius", "least", "body", "narrow"]
        return pa.table([pa.array(c) for c in columns] + [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.int64())), pa.array([least if known is not None else least[:0]], pa.list_(pa.float64()))], [*names, "ids", "labels", "floors"])

    return run


_BLOCK = "cell long, chunk long, radius double, least double, body binary, narrow boolean, ids array<long>, labels array<long>, floors array<double>"


def _blocks(rows: DataFrame, tree: Tree, dim: int, size: int, known: tuple | None, name: str) -> DataFrame:
    """``rows(vec_id, label, v)`` in written blocks of about ``size``."""
    spark = rows.sparkSession
    placed = materialize(rows.mapInArrow(_placed(tree, dim), "vec_id long, label long, v array<long>, cell long"), f"{name}-cells")
    count = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most as many as leaves
    chunks = F.lit(1).cast("long")
    for cell, n in count.items():
        if n > size:
            chunks = F.when(F.col("cell") == cell, F.lit(-(-n // size)).cast("long")).otherwise(chunks)
    dealt = placed.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "v"), chunks))
    made = dealt.repartition(max(parts(spark), sum(-(-n // size) for n in count.values()) // 8), "cell", "chunk").groupBy("cell", "chunk").applyInArrow(_packed(tree, dim, known), _BLOCK)
    return materialize(made, name)


def _unpacked(row: dict, dim: int) -> np.ndarray:
    return np.frombuffer(row["body"], np.int16 if row["narrow"] else np.float64).reshape(-1, dim).astype(np.float64)


def _best(score: np.ndarray, ok: np.ndarray, rank: np.ndarray, keep: int) -> np.ndarray:
    """For each line the places of its first ``keep`` allowed scores, ties by rank; -1 where there are fewer."""
    n = score.shape[1]
    if not n:
        return np.full((len(score), keep), -1)
    if np.abs(score).max(initial=0) * n < 2**62:
        whole = np.where(ok, score.astype(np.int64) * n + (n - 1 - rank)[None, :], LOW)
        k = min(keep, n)
        at = np.argpartition(-whole, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(score), 1))
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(whole, at, 1), axis=1), 1)
        at = np.where(np.take_along_axis(whole, at, 1) == LOW, -1, at)
    else:
        at = np.argsort(rank)[None, :].repeat(len(score), 0)
        at = np.take_along_axis(at, np.argsort(-np.where(np.take_along_axis(ok, at, 1), np.take_along_axis(score, at, 1), -np.inf), axis=1, kind="stable"), 1)[:, :keep]
        at = np.where(np.take_along_axis(ok, at, 1), at, -1)
    return np.pad(at, ((0, 0), (0, keep - at.shape[1])), constant_values=-1)


class _Found:
    """The first ``keep`` of each line so far: scores (-inf: none), keys, and whether a key is null."""

    def __init__(self, shape: tuple) -> None:
        self.score, self.id, self.null = np.full((*shape, KEEP), -np.inf), np.zeros((*shape, KEEP), np.int64), np.zeros((*shape, KEEP), bool)

    def add(self, at, score: np.ndarray, ok: np.ndarray, ids: np.ndarray, null: np.ndarray, rank: np.ndarray) -> None:
        pick = _best(score, ok, rank, KEEP)
        s = np.where(pick >= 0, np.take_along_axis(score, np.maximum(pick, 0), 1), -np.inf)
        s, i, z = np.concatenate([self.score[at], s], 1), np.concatenate([self.id[at], ids[pick]], 1), np.concatenate([self.null[at], null[pick]], 1)
        order = np.lexsort((i, z, -s), axis=1)[:, :KEEP]
        self.score[at], self.id[at], self.null[at] = (np.take_along_axis(x, order, 1) for x in (s, i, z))


def _streams(dim: int, negatives: bool):
    """Rows of a stream in order: the group of anchors, then blocks by their bound.  Each stream gives its first few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names if n not in ("ids", "labels", "floors", "scores", "positives")}
                row |= {n: batch.column(n)[k].values for n in ("ids", "labels", "floors", "scores", "positives") if batch.column(n)[k].is_valid}
                if row["kind"] == 0:
                    if state is not None:
                        yield state.rows()
                    now, state = (row["group"], row["salt"]), _Group(row, dim, negatives)
                elif now == (row["group"], row["salt"]):
                    state.meet(row)
        if state is not None:
            yield state.rows()

    return run


class _Group:
    """A group of anchors with what it has found in its stream."""

    def __init__(self, row: dict, dim: int, negatives: bool) -> None:
        self.dim, self.negatives, self.row = dim, negatives, row
        self.x = _unpacked(row, dim)
        self.ids, self.labels, self.norm = row["ids"].to_numpy(), row["labels"].to_numpy(), (self.x**2).sum(axis=1)
        self.centre, self.radius, self.at = balls(self.x, PIECE // 4)
        if negatives:
            self.top = row["scores"].to_numpy().reshape(-1, KEEP)  # NaN where an anchor has fewer positives
            self.found = _Found(self.top.shape)
        else:
            self.floor = row["floors"].to_numpy()
            self.found = _Found((len(self.x),))

    def wanted(self, s: slice) -> tuple[float, float]:
        """The least and largest score that some anchor of a leaf still looks for."""
        if not self.negatives:
            return float(np.maximum(self.floor[s], self.found.score[s, -1]).min()), np.inf
        top = self.top[s]
        least = np.where(top >= 0, np.maximum(0.8 * top - 1e-6 * np.abs(top), self.found.score[s][:, :, -1]), np.inf)
        return float(np.where(np.isnan(least), np.inf, least).min()), float(np.where(np.isnan(top), -np.inf, top).max())

    def meet(self, block: dict) -> None:
        # the bound on the block holds for its leaf; a group that is done with it never unpacks it
        want = [self.wanted(s) for s in self.at]
        if block["bound"] < min(w[0] for w in want):
            return
        x, labels = _unpacked(block, self.dim), block["labels"].to_numpy()
        null = np.asarray(block["ids"].is_null())
        ids = block["ids"].fill_null(0).to_numpy()
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((ids, null))] = np.arange(len(ids))
        centre, radius, pieces = balls(x, PIECE)
        lo, hi = interval(self.centre, self.radius, centre, radius)
        norm = (x**2).sum(axis=1)
        for i, s in enumerate(self.at):
            open_ = [p for j, p in enumerate(pieces) if hi[i, j] >= want[i][0] and lo[i, j] <= want[i][1]]
            if not open_:
                continue
            own = np.concatenate([np.arange(p.start, p.stop) for p in open_])
            score = self.x[s] @ x[own].T
            if np.abs(score).max(initial=0) >= 2**53:
                score = (self.x[s].astype(object) @ x[own].T.astype(object)).astype(np.float64)
            same = self.labels[s][:, None] == labels[own][None, :]
            place = np.argsort(np.argsort(rank[own]))
            if self.negatives:
                for k in range(KEEP):
                    top = self.top[s, k][:, None]
                    ok = ~same & (score <= top) & (100 * score >= 80 * top)  # no positive: NaN, never true
                    if ok.any():
                        self.found.add((s, k), score, ok, ids[own], null[own], place)
            else:
                self_ = same & (ids[own][None, :] == self.ids[s][:, None]) & ~null[own][None, :] & (score == self.norm[s][:, None]) & (norm[own][None, :] == self.norm[s][:, None])
                once = self_ & (np.cumsum(self_, axis=1) == 1)  # a repeated row counts as another
                self.found.add(s, score, same & ~once, ids[own], null[own], place)

    def rows(self) -> pa.RecordBatch:
        at = np.nonzero(self.found.score > -np.inf)
        place = at[0]
        columns = [pa.array(np.full(len(place), self.row["group"])), pa.array(place.astype(np.int64)), pa.array(self.ids[place])]
        names = ["group", "place", "anchor_id"]
        if self.negatives:
            whose = self.row["positives"]
            flat = place * KEEP + at[1]
            columns += [pa.array(at[1].astype(np.int64)), whose.take(pa.array(flat)), pa.array(self.top[place, at[1]].astype(np.int64))]
            names += ["which", "positive_id", "positive_score"]
        columns += [pa.array(self.found.id[at], mask=self.found.null[at]), pa.array(self.found.score[at].astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, [*names, "other_id", "score"])


def _searched(groups: DataFrame, blocks: DataFrame, pairs: list[tuple[int, int, float]], counts: dict[int, int], n_blocks: int, dim: int, negatives: bool) -> DataFrame:
    """All streams' finds: each group of anchors with the blocks of the leaves it was paired with."""
    spark = groups.sparkSession
    salts = max(1, -(-n_blocks // STREAM))
    # at most LEAVES * ANCHOR_LEAVES rows
    pair = F.broadcast(spark.createDataFrame([(a, c, b, counts[a]) for a, c, b in pairs], "anchor_cell long, cell long, bound double, chunks long"))
    name = lambda cell, chunk: cell * F.lit(1 << 32) + chunk
    nothing = [F.lit(None).cast("array<double>").alias("scores"), F.lit(None).cast("array<long>").alias("positives")]
    carried = ["body", "narrow", "ids", "labels", "floors"]
    own = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    own = own.select(name(F.col("cell"), F.col("chunk")).alias("group"), "salt", F.lit(0).alias("kind"), F.lit(0.0).alias("bound"), *carried, *(["scores", "positives"] if negatives else nothing))
    met = blocks.join(pair, "cell").withColumn("target", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    salt = F.pmod(F.xxhash64("cell", "chunk"), F.lit(salts))
    met = met.select(name(F.col("anchor_cell"), F.col("target")).alias("group"), salt.alias("salt"), F.lit(1).alias("kind"), "bound", *carried, *nothing)
    both = own.unionByName(met).repartition(max(parts(spark), min(20_000, salts * sum(counts.values()))), "group", "salt").sortWithinPartitions("group", "salt", "kind", F.col("bound").desc())
    schema = "group long, place long, anchor_id long, " + ("which long, positive_id long, positive_score long, " if negatives else "") + "other_id long, score long"
    return both.mapInArrow(_streams(dim, negatives), schema)


def _first(found: DataFrame, keys: list[str], alias: str) -> DataFrame:
    """The first KEEP of each anchor's finds."""
    order: list[Column] = [F.col("score").desc(), F.col("other_id").asc_nulls_last()]
    return found.withColumn(alias, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(alias) <= KEEP)


def hard_negatives(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """Per anchor and positive the first five hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose key is divisible by ``every``.  Rows with a null label or vector, or a null or infinite
    component, take no part; a null key is no anchor and comes last among ties.  Shorter vectors
    count as if they ended in zeros.  A repeated row is another row, and each repeated anchor has its own rows.  Columns other than the three
    are ignored, whatever their names; empty tables, and tables without anchors or positives, give an empty result.  Scores are exact below 2^53.
    """
    spark = rows.sparkSession
    all_ = materialize(prepared(rows, key, vector, label), "vectors")
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    # the limit is applied before the shuffle, too, so copies of one vector never meet in one task
    copy = F.row_number().over(Window.partitionBy("v", "label").orderBy(F.col("vec_id").asc_nulls_last()))
    some = materialize(all_.withColumn("copy", copy).where(F.col("copy") <= KEEP + 1).drop("copy"), "candidates")
    anchors = all_.where(F.col("vec_id") % every == 0)
    n, dim = some.agg(F.count("*"), F.max(F.size("v"))).first()
    n_anchors = anchors.count()
    if not n or not n_anchors:
        return empty
    dim = max(1, dim)

    def head(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = table.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).select("label", "v").toArrow().combine_chunks()
        return got.column(0).to_numpy(), _matrix(got.column(1).combine_chunks(), dim)

    depth = lambda leaves, n, size: max(0, min(leaves, n // size).bit_length() - 1)
    known = head(some)
    tree, over = Tree(known[1], depth(LEAVES, n, block)), Tree(head(anchors)[1], depth(ANCHOR_LEAVES, n_anchors, group))
    blocks = _blocks(some, tree, dim, block, None, "blocks")
    groups = _blocks(anchors, over, dim, group, known, "anchors")
    n_blocks = blocks.count()
    reach = {r["cell"]: r["radius"] for r in blocks.groupBy("cell").agg(F.max("radius").alias("radius")).collect()}
    told = groups.groupBy("cell").agg(F.max("radius").alias("radius"), F.min("least").alias("least"), (F.max("chunk") + 1).alias("chunks")).collect()
    radius, counts = {r["cell"]: r["radius"] for r in told}, {r["cell"]: r["chunks"] for r in told}
    pairs = dual_walk(over, radius, {r["cell"]: (r["least"], np.inf) for r in told}, tree, reach)
    found = _first(_searched(groups, blocks, pairs, counts, n_blocks, dim, False), ["group", "place"], "which")
    positives = materialize(found.select("group", "place", (F.col("which") - 1).alias("which"), F.col("other_id").alias("positive_id"), "score"), "positives")
    # back to the groups, whose anchors are boundedly many
    listed = positives.groupBy("group").agg(F.collect_list(F.struct("place", "which", "positive_id", "score")).alias("list"))
    slots = F.sequence(F.lit(0), F.size("ids") * KEEP - 1)
    by = F.map_from_entries(F.transform("list", lambda p: F.struct((p["place"] * KEEP + p["which"]).cast("int"), F.struct(p["positive_id"].alias("id"), p["score"].cast("double").alias("score")))))
    joined = groups.withColumn("group", F.col("cell") * F.lit(1 << 32) + F.col("chunk")).join(listed, "group").drop("group").withColumn("by", by)
    scores = F.transform(slots, lambda k: F.coalesce(F.try_element_at("by", k)["score"], F.lit(float("nan"))))
    joined = joined.withColumn("scores", scores).withColumn("positives", F.transform(slots, lambda k: F.try_element_at("by", k)["id"])).drop("by", "list")
    joined = materialize(joined, "anchors-told")
    best = F.array_max(F.filter("scores", lambda s: ~F.isnan(s)))
    least = F.array_min(F.filter("scores", lambda s: ~F.isnan(s) & (s >= 0)))
    window = joined.select("cell", (least * 0.8 - 1e-3).alias("lo"), best.alias("hi")).where("lo IS NOT NULL").groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    pairs = dual_walk(over, radius, {r["cell"]: (r["lo"], r["hi"]) for r in window}, tree, reach)
    if not pairs:
        return empty
    found = _first(_searched(joined, blocks, pairs, counts, n_blocks, dim, True), ["group", "place", "which"], "rank")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
WITH valid AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM valid a JOIN valid b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INT AS rank, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 5
"""
