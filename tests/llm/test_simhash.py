"""SimHash near copies against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrylens.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, print long, key long, fingerprint string, component_id long, Low long, n long"


def plain(text, size=4):
    w = WORD.findall((text or "").translate(FOLD))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, radius):
    x = np.array(prints, np.uint64)
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[:i]) <= radius).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(x))]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x", 3, 4, 5) for i, t in rows], SCHEMA)


def texts(rng, n):
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.4:
            words = (rng.choice(out) or "x").split()
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 40, 200, 400]))]
        out.append(" ".join(words))
    return out


def test_fingerprints(spark):
    rng = random.Random(3)
    odd = [None, "", " \t\n", "A b", "a\x0bB\x0cc d E", "É È naïve ﬁ Σς x", "x" * 5000, "    a b c d"]
    many = odd + texts(rng, 60)
    for t in many:
        assert simhash.fingerprint((t or "").encode()) == plain(t)
    long = " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(60_000)) + " " + "y" * 3_000_000 + " " + " ".join(str(i) for i in range(300_000))
    assert simhash.fingerprint(long.encode()) == plain(long)
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.near_prints(table(spark, list(enumerate(many)))).collect()}
    assert got == {i: f"{plain(t):016x}" for i, t in enumerate(many)}
    word = [r[0] for r in spark.createDataFrame([("a b c d",)], "t string").select(F.lower(F.hex(F.xxhash64("t")))).collect()]
    assert word == [f"{plain('a b c d'):016x}"]


@pytest.mark.parametrize("large", [8192, 8])
def test_components_equal_all_pairs(spark, large):
    """Once by keys alone, once with keys of more than 8 fingerprints left to shared points."""
    rng = random.Random(4)
    many = texts(rng, 500) + ["same words in every row of these"] * 30 + [None, ""]
    docs = table(spark, list(enumerate(many))).repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_prints(docs, large=large, sample=300).collect()}
    want = groups([plain(t) for t in many], 4)
    assert got == dict(enumerate(want))
    assert 50 < len(set(want)) < len(want) - 60


@pytest.mark.parametrize("large,sample", [(8192, 4096), (64, 200)])
def test_dense_clusters_of_fingerprints(spark, large, sample):
    rng = np.random.default_rng(8)
    centre = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    far = rng.integers(0, 9, 4000)
    x = np.array([centre[rng.integers(3 if k % 2 else 40)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, max(1, f)).astype(np.uint64)) for k, f in enumerate(far)], np.uint64)
    x = np.unique(x)
    own = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "print long").repartition(5)
    got = {r["vertex"]: r["root"] for r in simhash.linked_prints(own, len(x), 4, sample, large).collect()}
    want = groups(x, 4)
    signed = x.view(np.int64).tolist()
    least: dict = {}
    for v, g in zip(signed, want):
        least[g] = min(least.get(g, v), v)
    assert {v: got.get(v, v) for v in signed} == {v: least[g] for v, g in zip(signed, want)}


def test_thresholds_hold_for_every_split():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    x |= (x & np.uint64(0xFF)) << np.uint64(8)  # correlated bits
    for n in (10, 10**5, 10**8, 10**11):
        bits, thresholds = simhash.planned(x, n)
        assert sorted(sum(bits, [])) == list(range(64)) and sum(thresholds) == 4 - len(bits) + 1
        for _ in range(300):  # any pair within the radius is within some part's threshold
            flips = rng.choice(64, 4, replace=False)
            assert any(len(set(b) & set(flips.tolist())) <= t for b, t in zip(bits, thresholds))
    assert simhash.allocate([[0, 5, 9, 30], [0, 1, 2, 3], [0, 50, 90, 99]], 2 - 3 + 1) == [-1, 2, -1]
    assert len(simhash.planned(x, 10**11)[0]) < len(simhash.planned(x, 10**5)[0])


def test_odd_rows(spark):
    rows = [(3, "a b c d e"), (None, "a b c d e"), (2, None), (1, ""), (None, None), (3, "a b c d e"), (None, "only with null keys"), (None, "only with null keys")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_prints(table(spark, rows)).collect()), key=str)
    assert got == sorted([(3, 3), (None, 3), (2, 1), (1, 1), (None, 1), (3, 3), (None, None), (None, None)], key=str)
    assert simhash.near_prints(table(spark, rows).limit(0)).collect() == []
    assert [tuple(r) for r in simhash.near_prints(table(spark, rows[:1])).select("doc_id", "component_id").collect()] == [(3, 3)]
