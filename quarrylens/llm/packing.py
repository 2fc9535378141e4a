"""Best-fit packing of tokenised documents, hierarchically by residual.

Tasks tokenise their part of the documents, cut what is longer than a sequence, and pack the pieces best
fit, longest first, into local bins.  Nearly full bins are done.  Underfull ones become items of their
own for the next round, where groups of several tasks' bins are packed best fit again, and so on up a
tree; a round has fewer groups than the last.  A piece's place is its place in the local bin plus that
bin's place in the bins above it.

Tokens come from a vocabulary file of the ``tokenizers`` library; see ``tokens``.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of
from .tokens import coder

LENGTH = 2048
#: A bin that lacks at most so many tokens is done.
SLACK = 8
#: Pieces that a task packs at a time, and bins that a group of a later round holds on average.
BATCH, GROUP = 20_000, 20_000
#: Texts that are encoded at once, in number and in characters.
TEXTS, CHARACTERS = 400, 2_000_000


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def best_fit(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its place there, fill of each bin); longest first, each into the fullest bin with room."""
    order = np.argsort(-sizes, kind="stable")
    which, place, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    room: defaultdict[int, list[int]] = defaultdict(list)  # bins by the room they have
    rooms: list[int] = []  # rooms that some bin has, in order
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        k = bisect.bisect_left(rooms, s)
        if k == len(rooms):
            b, left = len(fill), length
            fill.append(0)
        else:
            left = rooms[k]
            own = room[left]
            b = own.pop()
            if not own:
                del rooms[k]
                del room[left]
        which[i], place[i] = b, fill[b]
        fill[b] += s
        left -= s
        if left:
            if left not in room:
                bisect.insort(rooms, left)
            room[left].append(b)
    return which, place, np.array(fill, np.int64)


def _some(column: pa.Array):
    """(first row, texts) of stretches of a column."""
    held, size, first = [], 0, 0
    for i, t in enumerate(column):
        t = t.as_py()
        if held and (len(held) == TEXTS or size + len(t) > CHARACTERS):
            yield first, held
            held, size, first = [], 0, i
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def _pieces(path: str, length: int, end: int, batch: int):
    kinds = (("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()))

    def run(batches):
        code, task, turn = coder(path).encode, TaskContext.get().partitionId(), 0
        held: list = []

        def out():
            which, place, fill = best_fit(np.array([h[3] for h in held]), length)
            bins = (np.int64(task) << 32) + np.int64(turn) + which
            own = [pa.array([h[0] for h in held], kind), *(pa.array([h[k] for h in held], t) for k, (_, t) in enumerate(kinds, 1))]
            return pa.RecordBatch.from_arrays([*own, pa.array(bins), pa.array(place), pa.array(fill[which])], ["doc_id", *(n for n, _ in kinds), "bin", "place", "fill"]), len(fill)

        for b in batches:
            kind = b.column(0).type
            keys = b.column(0).to_pylist()
            for i, texts in _some(b.column(1)):
                for key, ids in zip(keys[i : i + len(texts)], code(texts)):
                    wide = np.append(ids, end).astype("<u4").tobytes()
                    for k, a in enumerate(range(0, len(wide), 4 * length)):
                        own = wide[a : a + 4 * length]
                        held.append((key, k, a // 4, len(own) // 4, zlib.crc32(own)))
                if len(held) >= batch:
                    made, n = out()
                    yield made
                    held, turn = [], turn + n
        if held:
            yield out()[0]

    return run


def _again(length: int, turn: int):
    """A group's bins, packed as items: (bin, its parent, its place there, the parent's fill)."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("bin").to_numpy())
        bins, fill = table.column("bin").to_numpy()[order], table.column("fill").to_numpy()[order]
        which, place, full = best_fit(fill, length)
        name = np.zeros(len(full), np.int64)
        name[which[::-1]] = bins[::-1]  # a bin is called after the first of its items
        return pa.table({"bin": bins, "parent": name[which], "at": place, "parent_fill": full[which]})

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = 0, key: str = "doc_id", text: str = "text", batch: int = BATCH, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Rounds end when one group is left, or when one after the fourth closes less than a tenth of the open bins:
    what is packed by then is whole, only a little looser.  A document's ids are its text's, without special tokens, then ``end``.  Only documents longer than
    ``length`` are cut, into pieces of ``length``; sequences hold at most ``length`` ids and have no gaps.  A null
    text is empty: one piece with the end alone.  Null keys stay null; repeated rows are packed each;
    other columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(docs[key].alias("doc_id"), text_of(docs, text).alias("text"))
    pieces = materialize(own.mapInArrow(_pieces(path or vocabulary(), length, end, batch), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, bin long, place long, fill long"), "pieces")
    # each round maps open bins to bins of a wider group; the last one leaves a group's worth of them
    left = pieces.where(F.col("fill") < length - SLACK).groupBy("bin").agg(F.max("fill").alias("fill"))
    paths = None
    n = left.count()
    turn = 0
    while n > 1:
        groups = -(-n // group)
        cell = F.pmod(F.xxhash64(F.lit(turn), "bin"), F.lit(groups))
        step = materialize(left.withColumn("cell", cell).groupBy("cell").applyInArrow(_again(length, turn), "bin long, parent long, at long, parent_fill long"), "round")
        if paths is None:
            paths = step
        else:
            up = step.select(F.col("bin").alias("mid"), F.col("parent").alias("top"), F.col("at").alias("rise"), F.col("parent_fill").alias("top_fill"))
            paths = paths.join(up, paths["parent"] == up["mid"], "left").select("bin", F.coalesce("top", "parent").alias("parent"), (F.col("at") + F.coalesce("rise", F.lit(0))).alias("at"), F.coalesce("top_fill", "parent_fill").alias("parent_fill"))
        left = step.where(F.col("parent_fill") < length - SLACK).groupBy(F.col("parent").alias("bin")).agg(F.max("parent_fill").alias("fill"))
        fewer = left.count()
        turn += 1
        if groups == 1 or fewer > 0.9 * n and turn > 3:
            break
        n = fewer
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if paths is None:
        return pieces.select(*out, F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    return pieces.join(paths.select("bin", "parent", "at"), "bin", "left").select(*out, F.coalesce("parent", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("at", F.lit(0))).alias("offset"))
