"""The corpus pipeline, stage by stage and as a whole, against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .test_corpus import brute_components, plain_pii, prose, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good and bad documents, with near and exact copies, personal data, nulls and repeated rows."""
    rng = random.Random(17)
    rows, labels = [], []
    for i in range(240):
        bad = rng.random() < 0.25
        t = prose(rng, rng.randint(20, 120))
        if i % 9 == 0 and not bad:
            t += " mail a.b@c.example.org or +1 (212) 555-7777 now"
        t = t.upper().replace(" ", "!! ") if bad else t
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, int(not bad), 0))
    for i in range(240, 280):
        k, t, _, s, _ = rows[i - 240]
        t = t if i % 2 else t + " tail end"
        rows.append((i, t, "en", s, len(t)))
    rows += [rows[0], rows[0], (500, None, None, None, None), (501, "", "en", "s0", 0), (None, rows[5][1], "en", None, len(rows[5][1])), (None, None, None, None, None)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), {k: q for k, q, _ in labels}


def test_stages_one_after_the_other(spark, folder):
    path, good = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_copies", "personal_data", "mixture", "packing"]

    kept = stages["quality"](spark, docs, path).cache()
    assert kept.schema == docs.schema
    ids = {r["doc_id"] for r in kept.collect()}
    assert sum(k in ids for k, q in good.items() if q) >= 0.97 * sum(good.values()) and sum(k in ids for k, q in good.items() if not q) <= 0.05 * len(good)

    single = stages["near_copies"](spark, kept, path).cache()
    assert single.schema == docs.schema
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    groups = brute_components(rows, 5, 80)
    want = {low for _, n, low in groups if n}
    got = Counter(r["doc_id"] for r in single.where(F.rlike("text", F.lit(r"\S"))).collect())
    assert set(got) == want and max(got.values()) == 1
    assert single.where("text is null or text = ''").count() == kept.where("text is null or text = ''").count()

    clean = stages["personal_data"](spark, single, path).cache()
    assert clean.schema == docs.schema and clean.count() == single.count()
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in clean.collect():
        assert not plain_pii(r["text"]) and (r["text"] is None or r["n_chars"] == len(r["text"]))
        assert r["text"] == before[r["doc_id"]] or plain_pii(before[r["doc_id"]])

    mixed = stages["mixture"](spark, clean, path).cache()
    assert mixed.schema == docs.schema
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    times = Counter()
    for r in mixed.collect():
        assert r["text"] == texts[r["doc_id"]]
        times[r["doc_id"]] += 1
    assert max(times.values()) <= 2
    size = sum(len(words(t)) for t in texts.values())
    assert abs(sum(len(words(r["text"])) for r in mixed.collect()) - 1.5 * size) < 0.15 * size

    packed = stages["packing"](spark, mixed, path)
    assert packed.groupBy("doc_id").count().count() == len(times)
    whole = corpus_pipeline.run(spark, path)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, whole.select(*columns).collect())) == sorted(map(str, packed.select(*columns).collect()))
    places = {}
    for r in whole.collect():
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_of_odd_tables(spark, folder):
    """Empty tables, and further columns whose names clash with the stages' own."""
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    own = {c: F.lit(1) for c in ("score", "class", "row", "found", "redacted", "Size", "target", "taken", "order", "slice", "n", "bin")}
    odd = docs.limit(30).withColumns(own)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).collect() == []
        made = stage(spark, odd, path)
        assert name == "packing" or made.columns == odd.columns
        assert made.count() > 0
