"""Language-model scoring: a log-bilinear neural model trained by noise-contrastive estimation.

Counts of all training tokens are gathered by hash.  The most frequent words have a class and vectors
each; their number grows with the cube root of the corpus' distinct words.  Less frequent ones share a class
with all words of their frequency's power of two, as far as the executors hold them; the rest is one class.  Texts are coded as classes once.
The model predicts the next class from the two before it: q = r_a C_1 + r_b C_2, s(w) = q . r_w + b_w.
Executors learn from every triple of the training corpus against noise classes from the unigram
distribution, some millions of triples a task, and their weights are averaged after each round.
Scores are normalised: the sum over all classes is a batched matrix product, once for a pair of context
classes; e ** (q . r_w) is a product of what the two contexts give, so a table of sums is one matrix by another.  A word in a shared class costs its class and, given that, its own add-one estimate among such words.

Words are told apart by 64 bits of their hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import fold, materialize
from .samples import Adam, sigmoid

#: The least number of word classes with START, END, OTHER: 0 stands before a text, 1 is the end, 2 any word that the executors don't hold.
VOCAB = 150
START, END, OTHER = 0, 1, 2
#: So many of the most frequent words are looked up in the executors' memory (16 bytes each); rarer ones are joined.
HEAD = 1 << 16
DIM, NOISE = 20, 128
#: Triples of a minibatch, and the least a round learns from (small corpora are repeated) and a task is given.
BATCH, LEAST, TASK = 1024, 1_500_000, 4_000_000
ROUNDS = 2
#: The most frequent classes whose pairs' normalising sums a worker reckons at once (4 bytes each), and how many others it remembers (12 bytes each).
DENSE, ROOM = 4096, 1 << 22
#: Bytes worked on at a time, of texts and of what they are coded as.
PIECE, CODED = 1 << 22, 1 << 22


def own_classes(distinct: int) -> int:
    """Classes up to the last word that has one of its own, in a corpus of so many distinct words."""
    return max(VOCAB, 3 + round(16 * distinct ** (1 / 3)))


def classes_of(c: np.ndarray, own: int) -> tuple[np.ndarray, int]:
    """The class of each of the most frequent words by their falling counts, and the number of all classes."""
    cls = np.arange(3, 3 + len(c), dtype=np.int32)
    shared = np.log2(np.maximum(c[own - 3 :], 1)).astype(np.int32)
    cls[own - 3 :] = own + shared
    return cls, own + (int(shared.max()) + 1 if len(shared) else 0)


@dataclass
class Head:
    """The most frequent words: hashes in order, counts, classes."""

    h: np.ndarray
    c: np.ndarray
    cls: np.ndarray
    first: np.ndarray | None = None
    longest: int = 0

    def __post_init__(self):
        order = np.argsort(self.h)
        self.h, self.c, self.cls = self.h[order], self.c[order], self.cls[order]
        slot = (self.h >> np.uint64(44)).astype(np.int64)
        self.first = np.searchsorted(slot, np.arange((1 << 20) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.first).max()) if len(self.h) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if it isn't here."""
        out = np.full(len(h), -1, np.int32)
        if not len(self.h):
            return out
        slot = (h >> np.uint64(44)).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        open_ = np.flatnonzero(at < end)
        at = at[open_]
        for _ in range(self.longest):
            hit = self.h[at] == h[open_]
            out[open_[hit]] = at[hit]
            at = at + 1
            rest = ~hit & (at < end[open_])
            open_, at = open_[rest], at[rest]
            if not len(open_):
                break
        return out


def _counts(flush: int = 3_000_000):
    def run(batches):
        held, n = [], 0

        def out():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], ["h", "c"])

        for b in batches:
            w, _ = tv.words(*tv.raw(b.column(0)))
            held.append(w)
            n += len(w)
            if n > flush:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return run


def _classes(head: Head, w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of words, and the classes of each text's words and end, with the n + 1 offsets of these."""
    place = head.find(w)
    ends = at + np.arange(len(at))
    cls = np.full(int(ends[-1]), END, np.int32)
    cls[np.arange(len(w)) + np.repeat(np.arange(len(at) - 1), np.diff(at))] = np.where(place >= 0, head.cls[np.maximum(place, 0)], OTHER) if len(head.h) else OTHER
    return place, cls, ends


def _pieces(batches, column: int, most: int):
    """Slices of batches that have at most so many bytes in a column each; a longer value is one."""
    for b in batches:
        at, i = tv.raw(b.column(column))[1], 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield b.slice(i, j - i)
            i = j


def _unit(k: int) -> np.dtype:
    """What a class is stored as."""
    return np.dtype("<u2" if k <= 1 << 16 else "<i4")


def _binary(a: np.ndarray, at: np.ndarray) -> pa.Array:
    """The stretches of an array between offsets."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at * a.itemsize, np.int64)), pa.py_buffer(a.tobytes())])


def _coded(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes of texts and their n + 1 offsets."""
    data, at = tv.raw(column)
    return data.view(_unit(k)).astype(np.int32), at // _unit(k).itemsize


def _encode(head, first_shared: int, k: int):
    """Of each text: its classes, how many words the head has, sums of log10(count + 1) over these and over those in shared classes, and the other words' hashes."""

    def run(batches):
        hd = head.value
        own = np.log10(hd.c + 1.0)
        for b in _pieces(batches, 3, PIECE):
            w, at = tv.words(*tv.raw(b.column(3)))
            n = len(at) - 1
            place, cls, ends = _classes(hd, w, at)
            found, row = np.flatnonzero(place >= 0), np.repeat(np.arange(n), np.diff(at))
            of, place = row[found], place[found]
            sums = [np.bincount(of, weights=x, minlength=n) for x in (own[place], np.where(hd.cls[place] >= first_shared, own[place], 0.0))]
            known = np.bincount(of, minlength=n)
            rare = np.delete(w, found)
            rest = np.concatenate(([0], np.cumsum(np.diff(at) - known)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), _binary(cls.astype(_unit(k)), ends).cast(pa.binary()), pa.array(known), *map(pa.array, sums), _binary(rare, rest).cast(pa.binary())], ["key", "doc_id", "held_out", "cls", "known", "base", "shared", "rare"])

    return run


def _triples(cls: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class two before, the class before and the class of every token."""
    one = np.concatenate(([START], cls[:-1])).astype(np.int32)
    two = np.concatenate(([START, START], cls[:-2]))[: len(cls)].astype(np.int32)
    begin = ends[:-1]
    one[begin] = START
    two[begin] = START
    second = begin + 1
    two[second[second < ends[1:]]] = START
    return two, one, cls


class Groups:
    """Equal numbers among ``at``, all below ``k``: ``own`` are the distinct ones, ``back`` says which of them each is."""

    def __init__(self, at: np.ndarray, k: int):
        order = np.argsort(at.astype(np.uint16) if k <= 1 << 16 else at, kind="stable")
        of = at.take(order)
        fresh = np.concatenate(([True], of[1:] != of[:-1]))
        self.own, self.back = of[fresh], np.empty(len(at), np.int64)
        self.back[order] = np.cumsum(fresh) - 1

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """The sums of the rows of equal numbers."""
        d = rows.shape[1]
        out = np.zeros(len(self.own) * d, rows.dtype)
        np.add.at(out, (self.back[:, None] * d + np.arange(d)).ravel(), rows.ravel())
        return out.reshape(-1, d)


class Rows:
    """Adam for a matrix of which each step has gradients for few rows; the others cost it nothing.

    What momentum goes on to do to a row without gradients is made up for when it is next read: its steps
    fall by 0.9 / 0.99 ** 0.5 each, so their sum is closed, but for the changes of rate and bias meanwhile.
    """

    FALL, LONG = 0.9 / 0.99**0.5, 4000

    def __init__(self, p: np.ndarray):
        self.p, self.m, self.v = p, np.zeros_like(p), np.zeros_like(p)
        self.last, self.size, self.t = np.zeros(len(p), np.int64), np.zeros(len(p), np.float32), 0

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct rows as they are after all steps so far, and their moments for ``step``."""
        p, m, v = self.p.take(at, 0), self.m.take(at, 0), self.v.take(at, 0)
        missed = np.minimum(self.t - self.last.take(at), self.LONG).astype(np.float32)
        fall, slow = np.float32(0.9) ** missed, np.float32(0.99) ** missed
        drift = self.size.take(at) * (1 - fall / np.sqrt(slow)) * np.float32(self.FALL / (1 - self.FALL))
        root = np.sqrt(v)
        root += np.float32(1e-12)
        np.divide(m, root, out=root)
        root *= drift[:, None]
        p -= root
        m *= fall[:, None]
        v *= slow[:, None]
        return p, m, v

    def step(self, at: np.ndarray, read: tuple[np.ndarray, np.ndarray, np.ndarray], g: np.ndarray, rate: float) -> None:
        """One step with gradients of rows just read."""
        self.t += 1
        p, m, v = read
        g *= np.float32(0.1)
        m *= np.float32(0.9)
        m += g
        g *= g
        v *= np.float32(0.99)
        v += g
        bias = (1 - 0.99**self.t) ** 0.5
        np.sqrt(v, out=g)
        g += np.float32(1e-8 * bias)
        np.divide(m, g, out=g)
        g *= np.float32(rate * bias / (1 - 0.9**self.t))
        p -= g
        self.p[at], self.m[at], self.v[at], self.last[at] = p, m, v, self.t
        self.size[at] = rate * (1 - 0.99 ** (self.t + 1)) ** 0.5 / (1 - 0.9 ** (self.t + 1))

    def all(self) -> np.ndarray:
        return self.read(np.arange(len(self.last)))[0]


class Model:
    """The model of ``len(uni)`` classes; ``uni`` is the noise distribution."""

    NAMES = ("R", "C1", "C2", "Q", "b")

    def __init__(self, uni: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        k = len(uni)
        small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.uni, self.k, self.room = uni, k, None
        self.p = {"R": small(k, DIM), "C1": small(DIM, DIM), "C2": small(DIM, DIM), "Q": small(k, DIM), "b": np.log(np.maximum(uni, 1e-9)).astype(np.float32)}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[n].ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for n in self.NAMES:
            size = self.p[n].size
            self.p[n] = flat[at : at + size].astype(np.float32).reshape(self.p[n].shape)
            at += size
        return self

    def learner(self, seed: int):
        """step(x, y, w, rate): one minibatch; all its triples share the noise, of which equal classes are reckoned once.  end(): the model has the weights learned."""
        p, k, rng = self.p, self.k, np.random.default_rng(seed)
        lift, ucum = np.log(NOISE * np.maximum(self.uni, 1e-12)).astype(np.float32), np.cumsum(self.uni)
        ins, outs, adam = Rows(p["Q"]), Rows(np.column_stack((p["R"], p["b"]))), Adam({n: p[n] for n in ("C1", "C2")}, 0.01)

        def step(x, y, w, rate):
            n = len(w)
            z, times = np.unique(np.minimum(np.searchsorted(ucum, rng.random(NOISE)), k - 1), return_counts=True)
            seen, said = Groups(np.concatenate((x, y)), k), Groups(np.concatenate((w, z)), k)
            into_rows, out_rows = ins.read(seen.own), outs.read(said.own)
            row, col = into_rows[0], out_rows[0]
            q, first, second = np.ones((n, DIM + 1), np.float32), seen.back[:n], seen.back[n:]  # the last column goes with the bias
            np.add((row @ p["C1"]).take(first, 0), (row @ p["C2"]).take(second, 0), out=q[:, :DIM])
            r, rz = col.take(said.back[:n], 0), col.take(said.back[n:], 0)
            g = ((sigmoid(np.einsum("bd,bd->b", q, r) - lift[w]) - 1) / n).astype(np.float32)
            minus = -rz
            minus[:, DIM] += lift[z]
            gz = q @ minus.T
            with np.errstate(over="ignore"):
                np.exp(gz, out=gz)
            gz += 1
            np.divide((times / n).astype(np.float32), gz, out=gz)
            dq = gz @ rz[:, :DIM]
            dq += g[:, None] * r[:, :DIM]
            out, into = np.empty((n + len(z), DIM + 1), np.float32), np.empty((2 * n, DIM), np.float32)
            np.multiply(g[:, None], q, out=out[:n])
            np.matmul(gz.T, q, out=out[n:])
            np.matmul(dq, p["C1"].T, out=into[:n])
            np.matmul(dq, p["C2"].T, out=into[n:])
            turn = {"C1": row.take(first, 0).T @ dq, "C2": row.take(second, 0).T @ dq}
            outs.step(said.own, out_rows, said.sums(out), rate)
            ins.step(seen.own, into_rows, seen.sums(into), rate)
            adam.rate = rate
            adam.step(turn)

        def end():
            col = outs.all()
            p["R"], p["b"], p["Q"] = col[:, :DIM].copy(), col[:, DIM].copy(), ins.all().copy()

        return step, end

    def _halves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each class as first and as second context and of each target without START: rows whose products are the halves of the scores."""
        none, one = np.zeros((self.k, 1), np.float32), np.ones((self.k, 1), np.float32)
        return (
            np.hstack((self.p["Q"] @ self.p["C1"], none)),
            np.hstack((self.p["Q"] @ self.p["C2"], one)),
            np.delete(np.hstack((self.p["R"], self.p["b"][:, None])), START, 0),
        )

    def _factors(self, x: np.ndarray, y: np.ndarray, width: int = 256):
        """The sum after first x[i] and second y[j] is the product of rows i and j, which come by so many targets, times e ** (tx[i] + ty[j]): (tx, ty, (rows, rows)...)."""
        first, second, targets = self._halves()

        def scaled(rows):
            top = np.concatenate([(rows[i : i + width] @ targets.T).max(1) for i in range(0, len(rows), width)])
            return np.hstack((rows, -top[:, None])), top

        (a, tx), (b, ty) = scaled(first[x]), scaled(second[y])
        targets = np.hstack((targets, np.ones((len(targets), 1), np.float32)))
        return tx, ty, ((np.exp(a @ t.T), np.exp(b @ t.T)) for t in (targets[i : i + width] for i in range(0, len(targets), width)))

    def _each(self, pair: np.ndarray) -> np.ndarray:
        """``sums`` by all targets' exponentials for each pair."""
        first, second, targets = self._halves()
        rows = np.ascontiguousarray(targets.T)
        out, n, ones = np.empty(len(pair), np.float32), max(1, (1 << 19) // self.k), np.ones(self.k - 1, np.float32)
        for i in range(0, len(pair), n):
            s = (first[pair[i : i + n] // self.k] + second[pair[i : i + n] % self.k]) @ rows
            m = s.max(1)
            s -= m[:, None]
            out[i : i + n] = m + np.log(np.exp(s, out=s) @ ones)
        return out

    def sums(self, pair: np.ndarray) -> np.ndarray:
        """The logarithm of the normalising sum after each pair of classes (first * k + second)."""
        if len(pair) < 4 * self.k:
            return self._each(pair)
        (x, at), (y, by) = (np.unique(v, return_inverse=True) for v in (pair // self.k, pair % self.k))
        tx, ty, factors = self._factors(x, y)
        out, n = np.zeros(len(pair), np.float32), 1024
        for a, b in factors:
            for i in range(0, len(pair), n):
                out[i : i + n] += np.einsum("bd,bd->b", a.take(at[i : i + n], 0), b.take(by[i : i + n], 0))
        return self._logs(out, tx[at] + ty[by], pair)

    def _logs(self, sums: np.ndarray, top: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Logarithms of scaled sums; those too small for their factors' precision are reckoned apart."""
        small = np.flatnonzero(sums < 1e-20)
        out = np.log(np.maximum(sums, 1e-30)) + top
        if len(small):
            out[small] = self._each(pair[small])
        return out

    def _dense(self, classes: np.ndarray) -> np.ndarray:
        """``sums`` after all pairs of some classes."""
        tx, ty, factors = self._factors(classes, classes)
        out, n = np.zeros((len(classes), len(classes)), np.float32), 512
        for a, b in factors:
            for i in range(0, len(out), n):
                out[i : i + n] += a[i : i + n] @ b.T
        for i in range(len(out)):
            out[i] = self._logs(out[i], tx[i] + ty, classes[i].astype(np.int64) * self.k + classes)
        return out

    def recall(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``sums``, which a worker keeps as long as it has this model: those between frequent classes in a table, others as far as there is room."""
        if self.room is None:
            often, place = np.argsort(-self.uni, kind="stable")[:DENSE], np.full(self.k, -1, np.int32)
            if START not in often:
                often[-1] = START
            place[often] = np.arange(len(often))
            self.room = place, self._dense(often), np.full(ROOM if self.k > DENSE else 0, -1, np.int64), np.empty(ROOM if self.k > DENSE else 0, np.float32)
        place, table, pairs, sums = self.room
        a, b = place[x], place[y]
        out, rest = table[a, b], np.flatnonzero((a < 0) | (b < 0))
        if len(rest):
            slot = lambda p: (p.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % len(pairs)
            pair = x[rest].astype(np.int64) * self.k + y[rest]
            at = slot(pair)
            out[rest], new = sums[at], np.flatnonzero(pairs[at] != pair)
            u, back = np.unique(pair[new], return_inverse=True)
            found, at = self.sums(u), slot(u)
            out[rest[new]] = found[back]
            pairs[at], sums[at] = u, found
        return out

    def log10(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, recall: bool = False) -> np.ndarray:
        """log10 P(w | x, y); ``recall`` is for a model that doesn't change any more."""
        first, second = self.p["Q"] @ self.p["C1"], self.p["Q"] @ self.p["C2"]
        out = np.empty(len(w))
        if recall:
            z = self.recall(x, y)
        else:
            u, back = np.unique(x.astype(np.int64) * self.k + y, return_inverse=True)
            z = self.sums(u)[back]
        for i in range(0, len(w), 1 << 16):
            s = slice(i, i + (1 << 16))
            out[s] = np.einsum("bd,bd->b", first[x[s]] + second[y[s]], self.p["R"][w[s]]) + self.p["b"][w[s]] - z[s]
        return out / np.log(10)


def noise(n: np.ndarray) -> np.ndarray:
    """The unigram distribution of classes from their counts."""
    uni = n + 1e-3
    uni[START] = 0
    return uni / uni.sum()


def train(code: np.ndarray, n: np.ndarray, steps: int = 3000, batch: int = 512, seed: int = 5) -> np.ndarray:
    """log10 P(class | two classes) as a K x K x K table for K = VOCAB, from the counts of class triples."""
    k, rng = VOCAB, np.random.default_rng(seed)
    a, b, w = code // (k * k), code // k % k, code % k
    model = Model(noise(np.bincount(w, weights=n, minlength=k)), seed)
    (step, end), cum = model.learner(seed), np.cumsum(n / n.sum())
    for i in range(steps):
        pick = np.minimum(np.searchsorted(cum, rng.random(batch)), len(code) - 1)
        step(a[pick], b[pick], w[pick], 0.01 * (1 - i / steps) + 0.0003)
    end()
    x, y, z = (v.ravel() for v in np.meshgrid(*[np.arange(k)] * 3, indexing="ij"))
    out = model.log10(x, y, z)
    out[z == START] = -np.inf
    return out.astype(np.float32)


def _learn(model, epochs: int, expected: int, begin: float, end: float, block: int = 4096, hold: int = 2_000_000):
    """(block, n, weights): the model after all triples of a task; the rate falls from ``begin`` to ``end`` over the expected ones."""

    def run(batches):
        own = Model(model.value.uni).load(model.value.flat())
        (step, end_of), rng, seen, held, waiting = own.learner(7), np.random.default_rng(11), 0, [], 0

        def learn():
            rows = np.concatenate(held)
            done = seen
            for _ in range(epochs):
                order = rng.permutation(np.arange(len(rows), dtype=np.int32))
                for i in range(0, len(rows), BATCH):
                    x, y, z = np.ascontiguousarray(rows.take(order[i : i + BATCH], 0).T)
                    step(x, y, z, begin + (end - begin) * min(1.0, done / expected))
                    done += len(z)
            return done

        for b in batches:
            if not b.num_rows:
                continue
            held.append(np.column_stack(_triples(*_coded(b.column(0), own.k))))
            waiting += len(held[-1])
            if waiting > hold:
                seen, held, waiting = learn(), [], 0
        if held:
            seen = learn()
        if seen:
            end_of()
            flat = own.flat()
            parts = [flat[i : i + block].tobytes() for i in range(0, len(flat), block)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["block", "n", "v"])

    return run


def _mean(rows: pa.Table) -> pa.Table:
    """The mean of a block's weights over tasks, by their triples."""
    n = rows.column("n").to_pylist()
    total = sum(np.frombuffer(v, np.float32).astype(np.float64) * c for v, c in zip(rows.column("v").to_pylist(), n, strict=True)) / sum(n)
    return pa.table({"block": pa.array([rows.column("block")[0].as_py()], pa.int32()), "v": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def fit(corpus: DataFrame, uni: np.ndarray, total: int) -> Model:
    """The model of a corpus of ``total`` tokens, given as texts' classes: each round learns from all its triples."""
    spark, model = corpus.sparkSession, Model(uni)
    if not total:
        return model
    tasks, epochs = max(1, total // TASK), max(1, -(-LEAST // total))
    expected = max(1, total * epochs // tasks)
    for r in range(ROUNDS):
        rate = lambda i: 0.01 * (1 - i / ROUNDS) + 0.0003
        shared = spark.sparkContext.broadcast(model)
        learned = corpus.coalesce(tasks).mapInArrow(_learn(shared, epochs, expected, rate(r), rate(r + 1)), "block int, n long, v binary")
        rows = learned.groupBy("block").applyInArrow(_mean, "block int, v binary").collect()
        model = Model(uni).load(np.concatenate([np.frombuffer(x["v"], np.float32) for x in sorted(rows, key=lambda x: x["block"])]))
    return model


def _tail(batches):
    """(row, hash, times) of words that the head doesn't have."""
    for b in _pieces(batches, 1, PIECE):
        key = b.column(0).to_numpy(zero_copy_only=False)
        w, at = tv.raw(b.column(1))
        w = w.view(np.uint64)
        row = np.repeat(np.arange(len(key)), np.diff(at) // 8)
        order = np.lexsort((w, row))
        h, row = w[order], row[order]
        new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))) if len(h) else np.zeros(0, int)
        yield pa.RecordBatch.from_arrays([pa.array(key[row[new]], pa.int64()), pa.array(h[new].view(np.int64)), pa.array(np.diff(np.append(new, len(h))).astype(np.int32))], ["key", "h", "n"])


def _score(head, model, first_shared: int, end: int, total: int, distinct: int):
    """Of each text: tokens, known ones, and the sums that don't need rare words' counts."""
    base_at = np.log10(total + distinct + 1)

    def run(batches):
        hd, m = head.value, model.value
        mass = np.bincount(hd.cls, weights=hd.c, minlength=m.k)
        kinds = np.bincount(hd.cls, minlength=m.k)
        mass[OTHER] = total - end - int(hd.c.sum())
        kinds[OTHER] = max(0, distinct - (1 if end else 0) - len(hd.h)) + 1
        shared_at = np.log10(np.maximum(mass + kinds, 1))
        shared_at[START], shared_at[END], shared_at[3:first_shared] = 0, 0, 0
        for b in _pieces(batches, 3, CODED):
            cls, ends = _coded(b.column(3), m.k)
            tokens = np.diff(ends)
            known = b.column(4).to_numpy() + (1 if end else 0)
            base = b.column(5).to_numpy() + np.log10(end + 1.0) - tokens * base_at
            seq = np.add.reduceat(m.log10(*_triples(cls, ends), recall=True) - shared_at[cls], ends[:-1]) + b.column(6).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(tokens), pa.array(known), pa.array(base), pa.array(seq)], ["key", "doc_id", "held_out", "n_tokens", "known", "base", "seq"])

    return run


def lm_scores(docs: DataFrame, modulus: int = 7, remainder: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows outside the fold crc32(key as text) mod ``modulus`` = ``remainder`` are the training corpus, all of
    it.  Tokens are words, A-Z folded, and an end.  ``base_score`` is the add-one unigram log10 probability,
    ``score`` the model's.  A null text is empty and has its end only.  A null key counts as the
    empty text in the fold and stays null.  Repeated rows all get their row; other columns are ignored; an
    empty table gives an empty result, a table without training rows an untrained model.
    """
    spark = docs.sparkSession
    whole = F.coalesce(docs[text].cast("string"), F.lit(""))
    own = docs.select(F.xxhash64(docs[key], whole).alias("key"), docs[key].alias("doc_id"), fold(docs, modulus, remainder, key).alias("held_out"), whole.alias("text"))
    corpus = own.where("not held_out").select("text")
    counts = materialize(corpus.mapInArrow(_counts(), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts")
    end = corpus.count()
    seen = counts.agg(F.sum("c"), F.count("*")).first()
    total, distinct = (seen[0] or 0) + end, seen[1] + (1 if end else 0)
    first_shared = own_classes(distinct)
    top = counts.orderBy(F.col("c").desc(), "h").limit(max(HEAD, first_shared - 3)).toArrow()
    h, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy().astype(np.int64)
    cls, k = classes_of(c, first_shared)
    n = np.bincount(cls, weights=c, minlength=k)
    n[END], n[OTHER] = end, total - end - c.sum()
    head = spark.sparkContext.broadcast(Head(h, c, cls))
    kept = f"key long, doc_id {docs.schema[key].dataType.simpleString()}, held_out boolean"
    coded = materialize(own.mapInArrow(_encode(head, first_shared, k), f"{kept}, cls binary, known long, base double, shared double, rare binary"), "classes")
    model = spark.sparkContext.broadcast(fit(coded.where("not held_out").select("cls"), noise(n), total))
    pairs = coded.select("key", "rare").mapInArrow(_tail, "key long, h long, n int")
    rare = pairs.join(counts, "h").groupBy("key").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("add"), F.sum("n").alias("hits"))
    rows = coded.select("key", "doc_id", "held_out", "cls", "known", "base", "shared").mapInArrow(_score(head, model, first_shared, end, total, distinct), f"{kept}, n_tokens long, known long, base double, seq double")
    rows = rows.withColumn("copies", F.count("*").over(Window.partitionBy("key")))  # equal rows have sent their words as often
    add, hits = F.coalesce(F.col("add") / F.col("copies"), F.lit(0.0)), F.coalesce(F.expr("hits div copies"), F.lit(0))
    return rows.join(rare, "key", "left").select("doc_id", "held_out", "n_tokens", (F.col("known") + hits).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + add).alias("base_score"), (F.col("seq") + add).alias("score"))
