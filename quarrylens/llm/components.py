"""Connected components of an edge table, by alternating stars.

Every round points each vertex at the smallest neighbour it knows, first for its larger neighbours
and then for its smaller ones.  A round is two aggregations (with map-side combining) and two look-ups
by vertex; no neighbour list is ever gathered, and the edges of a hub are looked up where they are, against
a broadcast of the few hubs.  Rounds grow with the logarithm of the longest path.  Each round is written to
the shared folder, which also bounds recomputation; what the round before wrote is deleted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lookup, materialize, written

#: A round at least halves the longest path, so so many are enough for any number of vertices.
ROUNDS = 64


def _forest(batches):
    """A partition's edges reduced to a spanning forest whose trees are stars around their smallest vertex."""
    for batch in batches:
        u, v = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        names, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = np.arange(len(names))
        a, b = flat[: len(u)], flat[len(u) :]
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        own = label != np.arange(len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(names[label[own]])], ["u", "v"])


def _state(edges: DataFrame) -> tuple:
    """Number and sum of hashes of the edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, name: str = "links", rounds: int = ROUNDS) -> DataFrame:
    """(vertex, root) for every vertex of ``edges(u long, v long)``; the root is the component's smallest vertex.

    Self-loops are ignored, an empty table gives an empty result, and repeated edges don't matter.
    RuntimeError if ``rounds`` aren't enough.
    """
    spark = edges.sparkSession
    begin = written()
    now = materialize(edges.where("u <> v").mapInArrow(_forest, "u long, v long"), f"{name}-forest")
    state = _state(now)
    for turn in range(rounds):
        if not state[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count("*").alias("n")), f"{name}-least")
        large = lookup(both.where("v > u"), least, "u", 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = materialize(large.where("u <> v").distinct(), f"{name}-down")
        least = materialize(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), f"{name}-least")
        small = lookup(down, least, "u", state[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), f"{name}-{turn}")
        discard(spark, begin, 1)
        last, state = state, _state(now)
        if state == last:
            break
    else:
        raise RuntimeError(f"components: {rounds} rounds weren't enough")
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("vertex"), "root").union(now.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
