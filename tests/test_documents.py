"""Documents are written whole or not at all."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quarrylens.sources import documents, sinks


def _shown(spark, path):
    return sorted(tuple(r) for r in documents.read(spark, path).collect())


def _files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def test_a_run_is_read_as_written_and_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = [("a-example-com", f"{i}-decision.md", f"line\n{i} é \r\n") for i in range(50)] + [("b-net", "1-evidence.json", "{}"), ("b-net", "empty", ""), ("c", "null", None)]
    docs = spark.createDataFrame(rows, "folder string, name string, body string").repartition(4)
    documents.write(docs, path)
    want = sorted(r for r in rows if r[2])
    assert _shown(spark, path) == want
    first = documents.current(path)
    documents.write(docs.repartition(2), path)  # a re-run equals the first
    assert _shown(spark, path) == want and documents.current(path) != first
    assert len(_files(tmp_path / "out")) == len(rows) + 1
    documents.write(docs.where("folder = 'b-net'"), path)
    assert [r[:2] for r in _shown(spark, path)] == [("b-net", "1-evidence.json")]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    docs = spark.range(40).repartition(4).select(F.lit("h").alias("folder"), F.concat("id", F.lit(".md")).alias("name"), F.col("id").cast("string").alias("body"))
    bad = docs.withColumn("body", F.when(F.col("name") == "33.md", F.raise_error(F.lit("broken"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="broken"):
        documents.write(bad, path)
    assert documents.current(path) is None
    with pytest.raises(ValueError):
        documents.read(spark, path)
    documents.write(docs, path)
    before, run = _shown(spark, path), documents.current(path)
    with pytest.raises(Exception, match="broken"):
        documents.write(bad, path)
    assert documents.current(path) == run and _shown(spark, path) == before and len(before) == 40
    time.sleep(2)  # for tasks that were killed
    documents.write(docs, path)
    assert len(_files(path)) == 41


def test_abort_deletes_what_tasks_wrote(tmp_path):
    writer = documents.DocumentWriter(f"file://{tmp_path}/out", True)
    told = writer.write(iter([{"folder": "h", "name": f"{i}.md", "body": "é"} for i in range(3)]))
    assert (told.documents, told.size) == (3, 6) and len(_files(tmp_path / "out")) == 3
    writer.abort([told, None])
    assert _files(tmp_path / "out") == []


def test_names_stay_inside_their_folder():
    assert documents._safe("../../etc") == "-..-etc" and documents._safe("..") == "unknown" and documents._safe(None) == "unknown" and documents._safe("a b/c.md") == "a-b-c.md"


def test_two_documents_a_page(spark):
    decisions = spark.createDataFrame([(1, "h", "t")], "page_id long, folder string, text string")
    evidence = spark.createDataFrame([(1, "h", "{}"), (2, "h", "{}")], "page_id long, folder string, json string")
    assert sorted(tuple(r) for r in sinks.documents(decisions, evidence).collect()) == [("h", "1-decision.md", "t"), ("h", "1-evidence.json", "{}"), ("h", "2-evidence.json", "{}")]
    with pytest.raises(ValueError):
        sinks.documents(None, None)


def test_packed_documents_take_no_file_each(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/out"
    rows = [("a-example-com", f"{i}-decision.md", f"line\n{i} é \r\n" * 40) for i in range(3000)] + [("b-net", "x" * 150, "{}"), ("b-net", "empty", ""), ("c", "null", None)]
    docs = spark.createDataFrame(rows, "folder string, name string, body string").repartition(3)
    documents.write(docs, path, packed=True)
    assert _shown(spark, path) == sorted(r for r in rows if r[2])
    assert len(_files(tmp_path / "out")) == 3 + 2  # archives, their list and the pointer
    assert sum(os.path.getsize(tmp_path / "out" / f) for f in _files(tmp_path / "out")) < 200_000  # a block each would be 12 MB
    documents.write(docs.where("folder = 'b-net'"), path)
    assert [r[1] for r in _shown(spark, path)] == ["x" * 150]
    documents.write(docs.where("false"), path, packed=True)
    assert _shown(spark, path) == []


def test_archives_of_failed_attempts_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "ARCHIVE", 100)
    path = f"file://{tmp_path}/out"
    writer = documents.DocumentWriter(path, True, True)
    row = lambda i: {"folder": "h", "name": f"{i}.md", "body": "é" * 30}
    writer.write(iter([row(i) for i in range(5)]))  # an attempt that nobody heard of
    told = writer.write(iter([row(i) for i in range(9)]))
    assert told.documents == 9 and len(told.archives) == 5 and writer.write(iter([])).archives == ()
    writer.commit([told])
    assert [r[1] for r in _shown(spark, path)] == [f"{i}.md" for i in range(9)]
