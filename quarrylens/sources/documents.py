"""Documents on disk: a data source that writes one file a document, and whole runs or nothing.

``df.write.format("quarrylens_documents").mode("overwrite").option("path", ...)`` takes rows (folder, name, body).  A run's
tasks write files into a folder of the run's own, each first under a name of the attempt's; only when all tasks are done
does the pointer ``_CURRENT`` name that folder, and all others go.  A run that fails deletes its folder and leaves the pointer; what a task of it
still writes before it is killed is in no run that is read, and goes with the next commit.  One run writes to a path at a time.

With ``packed`` a task's documents are members folder/name of compressed tar archives instead, because a file takes a block of the
disk and an entry in its folder however short it is.  The run's ``_ARCHIVES`` names those that its tasks have told; others, of attempts that
failed, are not read.
"""

from __future__ import annotations

import io
import posixpath
import re
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME, POINTER, ARCHIVES, PACKED = "quarrylens_documents", "_CURRENT", "_ARCHIVES", "-packed"
#: Bytes of documents after which a task begins another archive, and of documents that a reader gives out at once.
ARCHIVE, GIVEN = 32 << 20, 1 << 20


def _files(path: str):
    """The file system and the path in it; any that Arrow knows, so tasks need no Spark to reach it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def _put(system, at: str, data: bytes) -> None:
    """A whole file or none: written under another name first."""
    system.create_dir(posixpath.dirname(at), recursive=True)
    own = f"{posixpath.dirname(at)}/.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(data)
    system.move(own, at)


def _safe(name: str | None) -> str:
    """One path segment: everything else than letters, digits, dots, dashes and underscores as dashes; never hidden or empty."""
    return re.sub(r"^\.+", "", re.sub(r"[^\w.-]+", "-", name or "")) or "unknown"


@dataclass
class Written(WriterCommitMessage):
    documents: int
    size: int
    archives: tuple[str, ...] = ()


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, packed: bool = False) -> None:
        self.path, self.overwrite, self.packed = path.rstrip("/"), overwrite, packed
        self.run = f"run-{uuid.uuid4().hex}{PACKED if packed else ''}"

    def _pack(self, iterator: Iterator) -> Written:
        system, base = _files(self.path)
        folder, names, n, size, row = f"{base}/{self.run}", [], 0, 0, next(iterator, None)
        system.create_dir(folder, recursive=True)
        while row is not None:
            names.append(f"{uuid.uuid4().hex}.tar.gz")
            held = 0
            with system.open_output_stream(f"{folder}/.{names[-1]}", compression=None) as out, tarfile.open(fileobj=out, mode="w|gz") as tar:
                while row is not None and held < ARCHIVE:
                    data = (row["body"] or "").encode("utf-8", "surrogatepass")
                    member = tarfile.TarInfo(f"{_safe(row['folder'])}/{_safe(row['name'])}")
                    member.size = len(data)
                    tar.addfile(member, io.BytesIO(data))
                    n, held, row = n + 1, held + len(data), next(iterator, None)
            system.move(f"{folder}/.{names[-1]}", f"{folder}/{names[-1]}")
            size += held
        return Written(n, size, tuple(names))

    def write(self, iterator: Iterator) -> Written:
        if self.packed:
            return self._pack(iterator)
        system, base = _files(self.path)
        n = size = 0
        for row in iterator:
            data = (row["body"] or "").encode("utf-8", "surrogatepass")
            _put(system, f"{base}/{self.run}/{_safe(row['folder'])}/{_safe(row['name'])}", data)
            n, size = n + 1, size + len(data)
        return Written(n, size)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, base = _files(self.path)
        before = current(self.path)
        if before and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.path} holds documents already")
        system.create_dir(f"{base}/{self.run}", recursive=True)
        if self.packed:
            _put(system, f"{base}/{self.run}/{ARCHIVES}", "\n".join(a for m in messages if m is not None for a in m.archives).encode())
        _put(system, f"{base}/{POINTER}", self.run.encode())
        for other in system.get_file_info(fs.FileSelector(base)):
            if other.base_name.startswith("run-") and other.base_name != self.run:
                system.delete_dir(other.path)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system, base = _files(self.path)
        if system.get_file_info(f"{base}/{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.run}")


class Documents(DataSource):
    """Rows (folder, name, body); options ``path`` and ``packed``.  Equal folders and names must not occur twice in a run."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        lacking = {"folder", "name", "body"} - set(schema.names)
        if lacking:
            raise ValueError(f"no column {', '.join(sorted(lacking))}")
        return DocumentWriter(self.options["path"], overwrite, self.options.get("packed", "false").lower() == "true")


def current(path: str) -> str | None:
    """The folder of the last whole run; null if there is none."""
    from pyarrow import fs

    system, base = _files(path.rstrip("/"))
    if system.get_file_info(f"{base}/{POINTER}").type != fs.FileType.File:
        return None
    with system.open_input_stream(f"{base}/{POINTER}") as f:
        return f.read().decode()


def write(docs: DataFrame, path: str, packed: bool = False) -> None:
    """``docs(folder, name, body)`` as files, or ``packed`` into archives, in place of those that a run before has left."""
    docs.sparkSession.dataSource.register(Documents)
    docs.select("folder", "name", "body").write.format(NAME).mode("overwrite").option("path", path).option("packed", str(packed).lower()).save()


def _unpacked(files: DataFrame) -> DataFrame:
    """(folder, name, body) of the members of archives (content); empty ones are passed over as loose files are."""
    import pyarrow as pa

    names = ["folder", "name", "body"]

    def given(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.binary()))], names)

    def run(batches):
        for content in (x.as_buffer() for b in batches for x in b.column(0)):
            rows, held = [], 0
            with tarfile.open(fileobj=pa.BufferReader(content), mode="r|gz") as tar:
                for member in tar:
                    if member.size:
                        rows.append((*member.name.rsplit("/", 1), tar.extractfile(member).read()))
                        held += member.size
                    if held >= GIVEN:
                        yield given(rows)
                        rows, held = [], 0
            if rows:
                yield given(rows)

    made = files.select("content").mapInArrow(run, "folder string, name string, body binary")
    return made.select("folder", "name", F.decode("body", "utf-8").alias("body"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(folder, name, body) of the last whole run; Spark's file sources pass over empty files."""
    run = current(path)
    if run is None:
        raise ValueError(f"no documents in {path}")
    if run.endswith(PACKED):
        system, base = _files(path.rstrip("/"))
        with system.open_input_stream(f"{base}/{run}/{ARCHIVES}") as f:
            told = f.read().decode().split()
        if not told:
            return spark.createDataFrame([], "folder string, name string, body string")
        return _unpacked(spark.read.format("binaryFile").load([f"{path.rstrip('/')}/{run}/{a}" for a in told]))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path.rstrip('/')}/{run}")
    at = F.split(F.col("path"), "/")
    return files.select(F.element_at(at, -2).alias("folder"), F.element_at(at, -1).alias("name"), F.decode("content", "utf-8").alias("body"))
