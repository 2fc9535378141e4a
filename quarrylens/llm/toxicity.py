"""Toxicity classifier: a convolutional network over hashed word embeddings, trained in numpy.

Words (runs of letters and digits, A-Z folded) are hashed to 2**22 buckets; a bucket that occurs in
enough texts of the training sample has an embedding, all others share one.  Filters one, two and three
words wide slide over the text, each is max-pooled over all positions, and a logistic output reads the
maxima.  For scoring, embeddings and filters are multiplied out once, so a text costs table look-ups.

Thresholds are calibrated by language.  The language is told from the text itself, by counting a few
function words; the column ``lang`` is never read.  A score is shifted in the log-odds so that the
language's threshold comes to lie at 0.3.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import fold, fresh
from .samples import PER_CLASS, Adam, fetch, labelled, score_column, scored, sigmoid, spread

SLOTS = 1 << 22
DIM, FILTERS, SPANS = 12, 10, (1, 2, 3)
PAD = 2
THRESHOLD = 0.3
#: Words of a stretch, and stretches of a document that are learned from at most, evenly spread over the whole text; all words are scored.
STRETCH, LEARNED = 256, 32
#: Function words that tell a text's language.
LANGUAGES = {
    "en": "the of and to in is that it was for with",
    "de": "der die und das ist nicht ein zu mit von dem",
    "fr": "le la les des et est dans qui une du par",
    "es": "el los que las una con por del se su para",
}


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of bare words and the n + 1 offsets of rows."""
    return tv.words(*tv.raw(column), separator=tv.BARE)


def _names() -> tuple[np.ndarray, np.ndarray]:
    h, at = hashed(pa.array(list(LANGUAGES.values())))
    which = np.repeat(np.arange(len(LANGUAGES)), np.diff(at))
    order = np.argsort(h)
    return h[order], which[order]


_KNOWN, _WHICH = _names()
#: Of a hash's top 16 bits: whether any function word has them.
_MAYBE = np.zeros(1 << 16, bool)
_MAYBE[(_KNOWN >> np.uint64(48)).astype(np.int64)] = True


def languages(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The language of each row by its function words; len(LANGUAGES) if it has none."""
    n, m = len(at) - 1, len(LANGUAGES)
    where = np.flatnonzero(_MAYBE[(h >> np.uint64(48)).astype(np.int64)])
    place = np.minimum(np.searchsorted(_KNOWN, h[where]), len(_KNOWN) - 1)
    hit = _KNOWN[place] == h[where]
    row = np.searchsorted(at, where[hit], "right") - 1
    count = np.bincount(row * m + _WHICH[place[hit]], minlength=n * m).reshape(n, m)
    return np.where(count.max(1) > 0, count.argmax(1), m)


@dataclass
class Model:
    slots: np.ndarray  # of the embeddings' rows from the third on, sorted
    p: dict[str, np.ndarray]
    threshold: np.ndarray = field(default_factory=lambda: np.full(len(LANGUAGES) + 1, THRESHOLD))
    tables: list | None = None
    row_of: np.ndarray | None = None

    def rows(self, h: np.ndarray) -> np.ndarray:
        """Embedding rows: 0 pads, 1 is shared by all words without their own."""
        if self.row_of is None:
            self.row_of = np.ones(SLOTS, np.int32)
            self.row_of[self.slots] = np.arange(2, len(self.slots) + 2)
        return self.row_of[(h >> np.uint64(42)).astype(np.int64)]

    def __getstate__(self):
        return self.__dict__ | {"tables": None, "row_of": None}

    def padded(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of all words with pads behind each text; where texts start and end.  A text without words is one pad."""
        n = np.diff(at)
        size = np.maximum(n, 1)
        start = np.concatenate(([0], np.cumsum(size + PAD)[:-1])) if len(n) else np.zeros(0, int)
        ids = np.zeros(int((size + PAD).sum()), np.int32)
        ids[np.repeat(start - at[:-1], n) + np.arange(at[-1])] = self.rows(h)
        return ids, start, start + size

    def logits(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.tables is None:
            e = self.p["E"].copy()
            e[0] = 0
            self.tables = [[np.ascontiguousarray(e @ self.p[f"F{w}"][j * DIM : (j + 1) * DIM]) for j in range(w)] for w in SPANS]
        out = np.zeros(len(at) - 1, np.float64) + self.p["d"][0]
        step = 4000
        for i in range(0, len(at) - 1, step):
            part = at[i : i + step + 1]
            ids, start, end = self.padded(h[part[0] : part[-1]], part - part[0])
            bounds = np.stack([start, end], 1).ravel()
            for k, w in enumerate(SPANS):
                n = len(ids) - w + 1
                v = self.tables[k][0][ids[:n]]
                for j in range(1, w):
                    v += self.tables[k][j][ids[j : j + n]]
                top = np.maximum.reduceat(v, np.minimum(bounds, n - 1), axis=0)[::2]
                out[i : i + step] += np.maximum(top + self.p[f"b{w}"], 0) @ self.p["c"][k * FILTERS : (k + 1) * FILTERS]
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.zeros(0)
        out = []
        for i in range(0, len(column), 1000):
            h, at = hashed(column.slice(i, 1000))
            shift = self.threshold[languages(h, at)]
            out.append(sigmoid(self.logits(h, at) - np.log(shift / (1 - shift)) + np.log(THRESHOLD / (1 - THRESHOLD))))
        return np.concatenate(out)


def train(texts: list[tuple[int, float, np.ndarray]], epochs: int = 12, batch: int = 32, least: int = 4, seed: int = 11) -> Model:
    """Learns from (label, the class's share of all rows, word hashes).  A fifth of the sample only calibrates.

    Embeddings start from the words' log-odds in the sample, which the first filter of each width reads.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    calibrate, learn = order[: len(order) // 5], order[len(order) // 5 :]
    y = np.array([t[0] for t in texts], np.float32)
    own = [np.unique(texts[i][2] >> np.uint64(42)).astype(np.int64) for i in learn]
    slots, at, count = np.unique(np.concatenate(own) if own else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    bad = np.bincount(at, weights=np.repeat(y[learn], [len(o) for o in own]), minlength=len(slots)) if len(slots) else np.zeros(0)
    keep = count >= least
    slots, count, bad = slots[keep], count[keep], bad[keep]
    positive = max(1.0, float(y[learn].sum()))
    negative = max(1.0, len(learn) - positive)
    odds = np.log((bad + 0.5) / (positive + 1)) - np.log((count - bad + 0.5) / (negative + 1))
    p = {"E": (rng.standard_normal((len(slots) + 2, DIM)) * 0.05).astype(np.float32), "c": np.full(len(SPANS) * FILTERS, 0.1, np.float32), "d": np.full(1, -1.0, np.float32)}
    p["E"][:2] = 0
    p["E"][2:, 0] = np.clip(odds / 3, -0.3, 1.5)
    for w in SPANS:
        p[f"F{w}"] = (rng.standard_normal((w * DIM, FILTERS)) * 0.2).astype(np.float32)
        p[f"F{w}"][::DIM, 0] = 1.0 / w
        p[f"b{w}"] = np.full(FILTERS, -0.1, np.float32)
    p["c"][::FILTERS] = 2.0
    model = Model(slots, p)
    if len(set(y.tolist())) < 2:
        p["c"][:] = 0
        p["d"][:] = 4.0 if len(y) and y[0] == 1 else -4.0
        return model
    many = np.bincount(y.astype(int), minlength=2)
    weight = np.array([t[1] * len(texts) / many[t[0]] for t in texts], np.float32)
    weight = np.sqrt(weight)  # between the sample's balance and the table's
    adam = Adam(p, 0.005, 1e-4)
    for epoch in range(epochs):
        adam.rate = 0.005 * (1 - epoch / epochs) + 0.0005
        rng.shuffle(learn)
        for k in range(0, len(learn), batch):
            ids = learn[k : k + batch]
            h = np.concatenate([texts[i][2] for i in ids])
            ends = np.concatenate(([0], np.cumsum([len(texts[i][2]) for i in ids])))
            row, start, end = model.padded(h, ends)
            emb = p["E"][row]
            grad = {}
            tops, args = [], []
            for w in SPANS:
                n = len(row) - w + 1
                window = np.concatenate([emb[j : j + n] for j in range(w)], 1)
                v = window @ p[f"F{w}"]
                arg = np.stack([a + v[a:b].argmax(0) for a, b in zip(start.tolist(), np.minimum(end, n).tolist())])
                tops.append(np.take_along_axis(v, arg, 0) + p[f"b{w}"])
                args.append(arg)
            z = np.concatenate(tops, 1)
            a = np.maximum(z, 0)
            d0 = (sigmoid(a @ p["c"] + p["d"]) - y[ids]) * weight[ids] / len(ids)
            grad["c"], grad["d"] = a.T @ d0, d0.sum(keepdims=True)
            dz = d0[:, None] * p["c"] * (z > 0)
            ge = np.zeros_like(p["E"])
            for k2, w in enumerate(SPANS):
                g = dz[:, k2 * FILTERS : (k2 + 1) * FILTERS]
                grad[f"b{w}"] = g.sum(0)
                gf = np.zeros_like(p[f"F{w}"])
                for j in range(w):
                    r = row[args[k2] + j]
                    gf[j * DIM : (j + 1) * DIM] = np.einsum("nfd,nf->df", p["E"][r], g)
                    np.add.at(ge, r.ravel(), (g[:, :, None] * p[f"F{w}"][j * DIM : (j + 1) * DIM].T[None]).reshape(-1, DIM))
                grad[f"F{w}"] = gf
            ge[:2] = 0
            grad["E"] = ge
            adam.step({n: g.astype(np.float32) for n, g in grad.items()})
    if len(calibrate):
        _calibrate(model, [texts[i] for i in np.concatenate([calibrate, learn])], y[np.concatenate([calibrate, learn])], weight[np.concatenate([calibrate, learn])] ** 2, len(calibrate))
    return model


def _calibrate(model: Model, texts: list, y: np.ndarray, weight: np.ndarray, held: int) -> None:
    """The threshold of each language with the best F1 on rows not learned from; one with few such rows takes the common one."""
    h = np.concatenate([t[2] for t in texts[:held]])
    at = np.concatenate(([0], np.cumsum([len(t[2]) for t in texts[:held]])))
    s, lang, y, weight = sigmoid(model.logits(h, at)), languages(h, at), y[:held], weight[:held]

    def best(mask: np.ndarray) -> float:
        cuts = np.unique(np.concatenate([np.linspace(0.05, 0.95, 91)]))
        f1 = []
        for c in cuts:
            hit = s[mask] >= c
            tp = (weight[mask] * y[mask] * hit).sum()
            f1.append(2 * tp / max(1e-9, (weight[mask] * hit).sum() + (weight[mask] * y[mask]).sum()))
        good = cuts[np.array(f1) >= max(f1) - 1e-9]
        return float(good[len(good) // 2])

    common = best(np.ones(held, bool))
    for k in range(len(model.threshold)):
        own = lang == k
        model.threshold[k] = best(own) if y[own].sum() >= 20 and (1 - y[own]).sum() >= 20 else common


def _stretches(h: np.ndarray) -> np.ndarray:
    """A text's word hashes, or those of evenly spread stretches of a long one."""
    n = -(-len(h) // STRETCH)
    if n <= LEARNED:
        return h
    return np.concatenate([h[k * STRETCH : (k + 1) * STRETCH] for k in spread(n, LEARNED).tolist()])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, remainder: int = 2, key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> Model:
    def encode(column: pa.Array) -> list[bytes]:
        h, at = hashed(column)
        return [_stretches(h[a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    rows = fetch(labelled(docs, labels, label, modulus, remainder, key, text, per_class), encode)
    return train([(y, s, np.frombuffer(c, np.uint64)) for y, s, c in rows])


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, remainder: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= 0.3).

    Only labels outside the fold crc32(key as text) mod ``modulus`` = ``remainder`` are learned from, at most
    ``samples.PER_CLASS`` keys of either class and ``LEARNED`` stretches of each; every text is scored whole.  Null and
    wordless texts are scored as one pad.  A null key counts as the empty text in the fold and stays
    null.  Repeated rows get equal scores; other columns are ignored; an empty table, or one without
    labels, gives an empty result or constant scores.
    """
    model = fit(docs, labels, label, modulus, remainder, key, text)
    return scored(docs, model.score, fold(docs, modulus, remainder, key), THRESHOLD, key, text)


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, columns unchanged, that score below the threshold; see ``toxicity_scores``.

    Null and wordless texts score as one pad and stay or go all alike.  Repeated rows stay or go together;
    extra columns, whatever their names, are kept; an empty table stays empty.
    """
    model, name = fit(docs, labels, key=key, text=text), fresh(docs, "score")
    return docs.withColumn(name, score_column(model.score, docs[text].cast("string"))).where(F.col(name) < THRESHOLD).drop(name)
