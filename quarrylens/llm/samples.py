"""Bounded samples of labelled rows, for the classifiers, and the frame of a text scorer."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold

#: Labelled rows of each class that a classifier learns from at most.
PER_CLASS = 1500


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """(label, share, text) of at most ``per_class`` labelled keys of either class, never of the held-out fold.

    Keys that ``docs`` has are taken in the order of their hash, so reruns agree; texts are whole.  ``share`` is
    the class's part of all such keys.  The chosen keys are broadcast: they are 2 * per_class at most.  Null
    labels count as unlabelled; a key labelled twice has the larger label; a key that ``docs`` has
    several times gives its smallest text, so the sample has one row a key.
    """
    known = labels.where(~fold(labels, modulus, remainder, key)).select(labels[key].alias("key"), labels[label].cast("int").alias("label")).where("label in (0, 1) and key is not null")
    own = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    known = known.groupBy("key").agg(F.max("label").alias("label")).join(own.where("text is not null").select("key"), "key", "left_semi")
    count = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = max(1, sum(count.values()))
    order = (F.xxhash64("key"), F.col("key"))
    chosen = None
    for c in (0, 1):
        some = known.where(F.col("label") == c).orderBy(*order).limit(per_class).withColumn("share", F.lit(count.get(c, 0) / total))
        chosen = some if chosen is None else chosen.union(some)
    return own.where("text is not null").join(F.broadcast(chosen), "key").groupBy("key", "label", "share").agg(F.min("text").alias("text")).select("label", "share", "text")


def spread(n: int, most: int) -> np.ndarray:
    """At most ``most`` of n places, evenly spread, in order."""
    return np.arange(n) if n <= most else (np.arange(most) * n) // most


def fetch(sample: DataFrame, encode: Callable[[pa.Array], list[bytes]]) -> list[tuple[int, float, bytes]]:
    """(label, share, encoded text) of a sample, encoded by the executors; in an order that reruns repeat."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(encode(b.column(2)), pa.binary())], ["label", "share", "code"])

    rows = sample.mapInArrow(run, "label int, share double, code binary").collect()
    return sorted((int(r["label"]), float(r["share"]), bytes(r["code"])) for r in rows)


def scored(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], held_out: Column, threshold: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``; other columns are ignored."""

    def run(batches):
        for b in batches:
            s = np.clip(score(b.column(2)).astype(np.float64), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(docs[key].alias("doc_id"), held_out.alias("held_out"), docs[text].cast("string").alias("text"))
    return own.mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, held_out boolean, score double, predicted int")


def score_column(score: Callable[[pa.Array], np.ndarray], text: Column) -> Column:
    """The score as a column expression."""

    @F.arrow_udf("double")
    def of(column: pa.Array) -> pa.Array:
        return pa.array(np.clip(score(column).astype(np.float64), 0.0, 1.0))

    return of(text)


class Adam:
    """Adam for a dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01, decay: float = 0.0):
        self.p, self.rate, self.decay, self.t = params, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            g = g + self.decay * self.p[k]
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
