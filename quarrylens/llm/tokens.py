"""Token ids of texts under a public vocabulary of byte pairs with word ends, several texts at a time.

Texts are laid end to end as code points; classes of characters cut them into words, and a word's ids are
looked up by its hash in a table of fixed size, in which a new word takes the place of an old one.  Words that
aren't there are merged together, each round joining every word's pair of the lowest rank.  A text with
anything unusual in it takes the library's own path, and so does a word of very many bytes.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cached_property, lru_cache

import numpy as np

from . import textvec as tv

#: Code points below this have table entries; the last entry stands for all others.
POINTS = 0x2100
SPACE, LETTER, NUMBER, SIGN = range(4)
#: After an apostrophe that follows no sign, these end the word.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Words in the table, and ids that one entry holds; words of more ids are merged again.
SLOTS, HELD = 1 << 19, 6
#: Longer words go to the library.
LONGEST = 64
WIDTHS = (4, 8, 12, 16, 24, 32, LONGEST)


def _plain(point: int) -> bool:
    """Characters that are in normal form whatever stands around them."""
    ascii_ = 9 <= point <= 13 or 0x20 <= point <= 0x7E
    latin = 0xA1 <= point < 0x250 and point != 0x130  # the dotted capital I has two code points in lower case
    signs = 0x2010 <= point <= 0x2027 or 0x2030 <= point <= 0x205E or point == 0x20AC
    return ascii_ or latin or signs


def _class(point: int) -> int:
    kind = unicodedata.category(chr(point))[0]
    return SPACE if chr(point).isspace() else LETTER if kind == "L" else NUMBER if kind == "N" else SIGN


def _byte_letters() -> list[str]:
    """The letter that stands for each byte value: printable ones for themselves, the others from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Ranks:
    """Ranks of pairs of ids, by hashing; ``none`` for a pair that is never joined."""

    def __init__(self, pairs: np.ndarray):
        self.none = len(pairs)
        bits = max(4, int(len(pairs) * 5).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.none, np.int32)
        wait = np.arange(len(pairs))
        slot = self._slot(pairs)
        while len(wait):
            free = wait[self.keys[slot] == -1]
            at = slot[self.keys[slot] == -1]
            at, one = np.unique(at, return_index=True)
            self.keys[at], self.rank[at] = pairs[free[one]], free[one]
            left = self.keys[slot] != pairs[wait]
            wait, slot = wait[left], (slot[left] + 1) & self.mask

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, pairs: np.ndarray) -> np.ndarray:
        slot = self._slot(pairs)
        there = self.keys[slot]
        out = np.where(there == pairs, self.rank[slot], self.none)
        far = np.flatnonzero((there != pairs) & (there != -1))
        slot = slot[far]
        while len(far):
            slot = (slot + 1) & self.mask
            there = self.keys[slot]
            hit = there == pairs[far]
            out[far[hit]] = self.rank[slot[hit]]
            on = ~hit & (there != -1)
            far, slot = far[on], slot[on]
        return out


class Coder:
    """Ids of texts, without special tokens, exactly as the ``tokenizers`` library gives them.

    Takes a byte-pair vocabulary with word ends that folds case and splits at classes of characters; any other
    raises ValueError.  ``slots``: a power of two.
    """

    def __init__(self, path: str, slots: int = SLOTS):
        self.path = path
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        model, steps = raw["model"], (raw.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or len(steps) != 2 or model.get("dropout") or not steps[0].get("pattern", {}).get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"):
            raise ValueError(f"{path}: not a vocabulary of this kind")
        vocab = model["vocab"]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.base = len(vocab)
        self.ranks = Ranks(np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64))
        self.joined = np.array([vocab[a + b] for a, b in pairs] + [0], np.int32)
        letters = _byte_letters()
        points = [chr(p) for p in range(POINTS)]
        self.odd = np.array([not _plain(p) for p in range(POINTS)])
        self.odd[-1] = True
        lower = [c if self.odd[p] else c.lower() for p, c in enumerate(points)]
        self.lower = np.array([ord(c) if len(c) == 1 else p for p, c in enumerate(lower)], np.uint16)
        self.odd |= np.array([len(c) != 1 or ord(c) >= POINTS for c in lower])
        self.kind = np.array([_class(p) for p in range(POINTS)], np.uint8)
        coded = [c.encode("utf-8") for c in points]
        self.bytes_of = np.array([len(c) for c in coded], np.int64)
        self.first = np.array([[vocab[letters[b]] for b in c.ljust(3, b" ")] for c in coded], np.int32)
        self.last = np.zeros(self.base, np.int32)  # of a byte's id: its id at a word's end
        for x in letters:
            self.last[vocab[x]] = vocab[x + "</w>"]
        self.value = np.random.default_rng(71).integers(1, 1 << 62, POINTS, dtype=np.int64).astype(np.uint64)
        self.mask = np.uint64(slots - 1)
        self.keys, self.n, self.ids = np.zeros(slots, np.uint64), np.zeros(slots, np.uint8), np.zeros((slots, HELD), np.int32)

    @cached_property
    def library(self):
        """The library's own coder; made only for texts that need it, because a worker keeps it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def bare(self):
        """The library's coder of single words in normal form; made only for very long ones."""
        from tokenizers import Tokenizer

        with open(self.path, encoding="utf-8") as f:
            raw = json.load(f)
        return Tokenizer.from_str(json.dumps(raw | {"normalizer": None, "pre_tokenizer": raw["pre_tokenizer"]["pretokenizers"][1], "added_tokens": []}))

    def _borders(self, p: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of words."""
        inside = kind != SPACE
        start = inside.copy()
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        quote = np.flatnonzero((p[:-1] == ord("'")) & start[:-1])
        if len(quote):
            after = p[quote + 1]
            then = np.where(quote + 2 < len(p), p[np.minimum(quote + 2, len(p) - 1)], 0)
            for e in ENDINGS:
                hit = quote[(after == ord(e[0])) & (then == ord(e[1]) if len(e) > 1 else True)]
                start[hit + 1] = False
                behind = hit + 1 + len(e)
                behind = behind[behind < len(p)]
                start[behind] = inside[behind]
        end = inside.copy()
        end[:-1] &= start[1:] | ~inside[1:]
        return np.flatnonzero(start), np.flatnonzero(end) + 1

    def _merge(self, rows: np.ndarray) -> np.ndarray:
        """Rows of ids, -1 behind them, with every pair joined that a rank joins."""
        out, live = rows.copy(), np.arange(len(rows))
        w = rows.shape[1]
        col = np.arange(w)
        rank = np.full((len(rows), w), self.ranks.none, np.int32)  # of the pair that begins in each column
        a, b = rows[:, :-1], rows[:, 1:]
        full = b >= 0
        rank[:, :-1][full] = self.ranks.find(a[full].astype(np.int64) * self.base + b[full])
        while True:
            at = rank.argmin(1)
            every = np.arange(len(rows))
            on = rank[every, at] < self.ranks.none
            if not on.all():
                out[live[~on]] = rows[~on]
                live, rows, rank, at = live[on], rows[on], rank[on], at[on]
                every = np.arange(len(rows))
            if not len(live):
                return out
            rows[every, at] = self.joined[rank[every, at]]
            take = np.minimum(col + (col > at[:, None]), w - 1)
            rows, rank = np.take_along_axis(rows, take, 1), np.take_along_axis(rank, take, 1)
            rows[:, -1], rank[:, -1] = -1, self.ranks.none
            for left in (at - 1, at):
                c = np.maximum(left, 0)
                x, y = rows[every, c], rows[every, np.minimum(c + 1, w - 1)]
                ok = np.flatnonzero((left >= 0) & (c + 1 < w) & (y >= 0))
                new = np.full(len(rows), self.ranks.none, np.int32)
                new[ok] = self.ranks.find(x[ok].astype(np.int64) * self.base + y[ok])
                there = left >= 0
                rank[every[there], c[there]] = new[there]

    def _words(self, p: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words p[s:e], and how many each has."""
        size = e - s
        index = np.repeat(s - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
        point = p[index]
        many = self.bytes_of[point]
        ends = np.cumsum(many)
        flat = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for k in range(3):
            own = many > k
            flat[(ends - many)[own] + k] = self.first[point[own], k]
        stop = ends[np.cumsum(size) - 1]
        n = np.diff(np.concatenate(([0], stop)))
        flat[stop - 1] = self.last[flat[stop - 1]]
        begin = stop - n
        out = np.full((len(s), HELD), -1, np.int32)
        count = np.ones(len(s), np.int64)
        longer: dict[int, np.ndarray] = {}
        low = 0
        for w in (1, *WIDTHS):
            own = np.flatnonzero((n > low) & (n <= w))
            low = w
            if not len(own):
                continue
            grid = begin[own][:, None] + np.arange(w)
            rows = np.where(np.arange(w) < n[own][:, None], flat[np.minimum(grid, len(flat) - 1)], -1)
            if w > 1:
                rows = self._merge(rows)
            count[own] = (rows >= 0).sum(1)
            out[own, : min(w, HELD)] = rows[:, :HELD]
            for k in np.flatnonzero(count[own] > HELD):
                longer[int(own[k])] = rows[k][: count[own[k]]]
        for k in np.flatnonzero(n > LONGEST).tolist():
            word = p[s[k] : e[k]].astype("<u4").tobytes().decode("utf-32-le")
            ids = np.array(self.bare.encode([word], is_pretokenized=True, add_special_tokens=False).ids, np.int32)
            count[k] = len(ids)
            out[k, : min(HELD, len(ids))] = ids[:HELD]
            if len(ids) > HELD:
                longer[k] = ids
        ends = np.cumsum(count)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        short = count <= HELD
        for k in range(HELD):
            own = short & (count > k)
            ids[(ends - count)[own] + k] = out[own, k]
        for k, v in longer.items():
            ids[ends[k] - count[k] : ends[k]] = v
        return ids, count

    def _block(self, p: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of words, how many ids each has, and all ids in order."""
        s, e = self._borders(p, kind)
        if not len(s):
            return s, s, np.zeros(0, np.int32)
        total = np.zeros(len(p) + 1, np.uint64)
        np.cumsum(self.value[p] * tv.powers(len(p)), out=total[1:])
        h = tv.mix((total[e] - total[s]) * tv.inverses(s) ^ (e - s).astype(np.uint64))
        slot = (h & self.mask).astype(np.int64)
        n = self.n[slot].astype(np.int64)
        hit = (self.keys[slot] == h) & (n > 0)
        lost = np.flatnonzero(~hit)
        if len(lost):
            name, one, back = np.unique(h[lost], return_index=True, return_inverse=True)
            own, count = self._words(p, s[lost[one]], e[lost[one]])
            n[lost] = count[back]
            begin = np.cumsum(count) - count
        end = np.cumsum(n)
        ids = np.empty(int(end[-1]), np.int32)
        at = end - n
        for k in range(HELD):
            w = np.flatnonzero(hit & (n > k))
            if not len(w):
                break
            ids[at[w] + k] = self.ids[slot[w], k]
        if len(lost):
            m = n[lost]
            step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            ids[np.repeat(at[lost], m) + step] = own[np.repeat(begin[back], m) + step]
            fits = np.flatnonzero(count <= HELD)
            put, last = np.unique((name[fits] & self.mask).astype(np.int64), return_index=True)
            fits = fits[last]
            self.keys[put], self.n[put] = name[fits], count[fits]
            for k in range(HELD):
                w = count[fits] > k
                self.ids[put[w], k] = own[begin[fits[w]] + k]
        return s, n, ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as 32-bit numbers."""
        if not texts:
            return []
        raw = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        p = np.minimum(raw, POINTS - 1)
        strange = np.flatnonzero(self.odd[p])
        special = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
        own_way = set((np.searchsorted(begin, np.concatenate([strange, special]), "right") - 1).tolist())
        p = self.lower[p]
        kind = self.kind[p]
        gap = np.flatnonzero(kind == SPACE)
        wide = np.flatnonzero(np.diff(np.concatenate(([-1], gap, [len(p)]))) > tv.BLOCK)
        own_way |= set((np.searchsorted(begin, np.concatenate(([-1], gap))[wide] + 1, "right") - 1).tolist())
        for i in own_way:
            kind[begin[i] : begin[i + 1]] = SPACE
        starts, counts, found, a = [], [], [], 0
        while a < len(p):
            b = min(a + tv.BLOCK, len(p))
            if b < len(p):
                back = np.flatnonzero(kind[a:b] == SPACE)
                b = a + int(back[-1]) + 1
            s, n, ids = self._block(p[a:b], kind[a:b])
            starts.append(s + a)
            counts.append(n)
            found.append(ids)
            a = b
        ids, ends = np.concatenate([np.zeros(0, np.int32), *found]), np.concatenate([[0], *counts]).cumsum()
        cut = ends[np.searchsorted(np.concatenate([np.zeros(0, np.int64), *starts]), begin)].tolist()
        out = [ids[x:y] for x, y in zip(cut[:-1], cut[1:])]
        for i in own_way:
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.int32)
        return out


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One for each process and vocabulary: tasks of a worker share its table."""
    return Coder(path)
