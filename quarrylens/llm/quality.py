"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of 64 words.  Each passage is encoded (pairs of adjacent byte classes,
hashed words, share of distinct words, lengths; then one tanh layer).  Gated attention,
softmax over w . (tanh(V h) * sigmoid(U h)), weighs the passages; the weighted sum goes to a logistic
output.  All layers learn together from document labels alone, in numpy on the driver, from a bounded
sample of labelled rows; executors do the encoding and the scoring, over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import fold, fresh
from .samples import PER_CLASS, Adam, fetch, labelled, score_column, scored, sigmoid, spread

WORDS = 64
HASHED = 96
CLASSES = 8
WIDTH = CLASSES * CLASSES + HASHED + 3
HIDDEN, GATE = 24, 12
#: Passages of a document that are learned from at most, evenly spread over the whole text; all are scored.
LEARNED = 128

_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
_CLASS[[ord(c) for c in ".,!?;:'\"()-"]] = 5
_CLASS[128:] = 7


def passages(column: pa.Array):
    """Blocks (features of passages, row of each).  Rows without words have no passage here."""
    data, at = tv.raw(column)
    for a, b, s, _, h in tv.blocks(data, at):
        doc = np.searchsorted(at, s, "right") - 1
        new = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        place = np.arange(len(s)) - np.repeat(new, np.diff(np.append(new, len(s))))
        first = np.flatnonzero(place % WORDS == 0)
        count = np.diff(np.append(first, len(s)))
        n = len(first)
        owner = doc[first]
        ends = np.append(s[first[1:]], b)
        ends = np.minimum(ends, at[owner + 1])
        span = ends - s[first]
        body = _CLASS[data[a:b]].astype(np.int32)
        pair = body * CLASSES
        pair[:-1] += body[1:]
        last = ends - 1 - a
        pair[last] = body[last] * CLASSES + _CLASS[32]  # what follows a passage doesn't count
        index = np.repeat(s[first] - a - np.concatenate(([0], np.cumsum(span)[:-1])), span) + np.arange(int(span.sum()))
        which = np.repeat(np.arange(n, dtype=np.int32), span)
        x = np.zeros((n, WIDTH), np.float32)
        x[:, : CLASSES**2] = np.bincount(which * CLASSES**2 + pair[index], minlength=n * CLASSES**2).reshape(n, -1) / span[:, None]
        which = np.repeat(np.arange(n), count)
        slot = (h >> np.uint64(40)) % np.uint64(HASHED)
        x[:, CLASSES**2 : -3] = np.bincount(which * HASHED + slot.astype(np.int64), minlength=n * HASHED).reshape(n, -1) / count[:, None]
        np.sqrt(x, out=x)
        key = np.sort((which.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        distinct = np.bincount((key[np.concatenate(([True], key[1:] != key[:-1]))] >> np.uint64(40)).astype(np.int64), minlength=n)
        x[:, -3] = distinct / count
        x[:, -2] = np.log1p(count) / 4
        x[:, -1] = np.log1p(span / count) / 3
        yield x, owner


def _bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages and their rows in order; a row without words has one passage of zeros."""
    made = list(passages(column))
    n = len(column)
    empty = np.setdiff1d(np.arange(n), np.concatenate([o for _, o in made])) if made else np.arange(n)
    x = np.concatenate([m[0] for m in made] + [np.zeros((len(empty), WIDTH), np.float32)])
    owner = np.concatenate([m[1] for m in made] + [empty])
    order = np.argsort(owner, kind="stable")
    return x[order], owner[order]


@dataclass
class Model:
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        """start: the first passage of each bag."""
        p, size = self.p, np.diff(np.append(start, len(x)))
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, start), size))
        a /= np.repeat(np.add.reduceat(a, start), size)
        z = np.add.reduceat(a[:, None] * h, start, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "size": size, "y": sigmoid(z @ p["c"] + p["d"])}

    def score(self, column: pa.Array) -> np.ndarray:
        """Scores of a column's texts; passages are encoded block by block and dropped, but for h and e."""
        n, p = len(column), self.p
        if not n:
            return np.zeros(0)
        hs, es, os = [np.zeros((0, HIDDEN), np.float32)], [np.zeros(0, np.float32)], [np.zeros(0, np.int64)]
        for x, owner in passages(column):
            h = np.tanh(x @ p["W"] + p["b"])
            hs.append(h)
            es.append((np.tanh(h @ p["V"]) * sigmoid(h @ p["U"])) @ p["w"])
            os.append(owner)
        owner = np.concatenate(os)
        empty = np.setdiff1d(np.arange(n), owner)
        h0 = np.tanh(np.zeros((len(empty), WIDTH), np.float32) @ p["W"] + p["b"])
        owner = np.concatenate([owner, empty])
        h, e = np.concatenate([*hs, h0]), np.concatenate([*es, np.zeros(len(empty), np.float32)])
        order = np.argsort(owner, kind="stable")
        h, e, owner = h[order], e[order], owner[order]
        start = np.searchsorted(owner, np.arange(n))
        size = np.diff(np.append(start, len(owner)))
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, start), size))
        z = np.add.reduceat(a[:, None] * h, start, axis=0) / np.add.reduceat(a, start)[:, None]
        return sigmoid(z @ p["c"] + p["d"])


def train(bags: list[tuple[int, float, np.ndarray]], epochs: int = 25, batch: int = 48, seed: int = 7) -> Model:
    """Learns from (label, the class's share of all rows, passages).  One class only, or none, gives a constant score."""
    rng = np.random.default_rng(seed)
    r = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"W": r(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": r(HIDDEN, GATE), "U": r(HIDDEN, GATE), "w": r(GATE), "c": r(HIDDEN), "d": np.zeros(1, np.float32)}
    model = Model(p)
    seen = {y for y, _, _ in bags}
    if len(seen) < 2:
        p["c"][:] = 0
        p["d"][:] = 4.0 if seen == {1} else -4.0 if seen == {0} else 0.0
        return model
    y = np.array([b[0] for b in bags], np.float32)
    many = np.bincount(y.astype(int), minlength=2)
    weight = np.array([b[1] * len(bags) / many[b[0]] for b in bags], np.float32)
    adam = Adam(p, 0.01, 1e-5)
    for epoch in range(epochs):
        adam.rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(bags))
        for k in range(0, len(order), batch):
            ids = order[k : k + batch]
            x = np.concatenate([bags[i][2] for i in ids])
            size = np.array([len(bags[i][2]) for i in ids])
            f = model.forward(x, np.cumsum(size) - size)
            dz0 = (f["y"] - y[ids]) * weight[ids] / len(ids)
            rep = np.repeat(np.arange(len(ids)), size)
            grad = {"c": f["z"].T @ dz0, "d": dz0.sum(keepdims=True)}
            dz = dz0[:, None] * p["c"]
            da = (dz[rep] * f["h"]).sum(1)
            de = f["a"] * (da - np.add.reduceat(f["a"] * da, np.cumsum(size) - size)[rep])
            dh = f["a"][:, None] * dz[rep]
            dt = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
            dg = de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
            grad |= {"w": (f["t"] * f["g"]).T @ de, "V": f["h"].T @ dt, "U": f["h"].T @ dg}
            dh = (dh + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
            grad |= {"W": x.T @ dh, "b": dh.sum(0)}
            adam.step({n: g.astype(np.float32) for n, g in grad.items()})
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, remainder: int = 1, key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> Model:
    def encode(column: pa.Array) -> list[bytes]:
        x, owner = _bags(column)
        at = np.searchsorted(owner, np.arange(len(column) + 1))
        return [x[a + spread(b - a, LEARNED)].astype(np.float16).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    rows = fetch(labelled(docs, labels, label, modulus, remainder, key, text, per_class), encode)
    return train([(y, s, np.frombuffer(c, np.float16).reshape(-1, WIDTH).astype(np.float32)) for y, s, c in rows])


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, remainder: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= 0.5).

    Only labels outside the fold crc32(key as text) mod ``modulus`` = ``remainder`` are learned from, at most
    ``samples.PER_CLASS`` keys of either class and ``LEARNED`` passages of each; every text is scored whole.
    Null and wordless texts are scored as one empty passage.  A null key counts as the empty text in the
    fold and stays null.  Repeated rows get equal scores; other columns are ignored; an empty table, or one
    without labels, gives an empty result or constant scores.
    """
    model = fit(docs, labels, label, modulus, remainder, key, text)
    return scored(docs, model.score, fold(docs, modulus, remainder, key), 0.5, key, text)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, columns unchanged, that score at least 0.5; see ``quality_scores``.

    Null and wordless texts score as one empty passage and stay or go all alike.  Repeated rows stay or go
    together; extra columns, whatever their names, are kept; an empty table stays empty; without labels all rows stay.
    """
    model, name = fit(docs, labels, key=key, text=text), fresh(docs, "score")
    return docs.withColumn(name, score_column(model.score, docs[text].cast("string"))).where(F.col(name) >= 0.5).drop(name)
