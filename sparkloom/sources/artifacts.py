"""A data source of content-addressed artifacts, to write and to read: ``df.write.format("sparkloom_artifacts")`` (SNK12, SRC16).

Layout: root / batch_id / artifact_type / first 16 hex digits of the content's SHA-256, with the type's suffix. Tasks hash contents and write files into a
folder of the job, with a list of them; the driver's commit reads one list after the other, moves those that aren't there yet, and removes the folder; so does an abort. So a rerun writes nothing, and a failed
task or a job that dies leaves nothing among the artifacts. Equal contents of a batch and type are one artifact.

Reading: options batch_id, artifact_type and artifact_id name folders and files, so that a fetch by id opens one file; contents are read only if the schema has `content`.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from sparkloom.sources.elements import open_folder

SCHEMA = "batch_id string, artifact_type string, artifact_id string, size long, content binary"
#: Suffixes of the types of the store; other types have none.
SUFFIX = {"TABLE_IMAGE": ".png", "TABLE_DATAFRAME": ".parquet", "FIGURE_IMAGE": ".png"}
STAGING = "_staging"
#: Partitions of a folder that is read, by the first digit of ids, while there are no more than FOLDERS folders; threads that move files, and files that they are given at a time.
DIGITS, FOLDERS, MOVERS, MOVED = "0123456789abcdef", 8, 16, 10_000


@dataclass
class Staged(WriterCommitMessage):
    #: The file that lists what a task has staged; none where that is nothing.
    listed: str | None
    again: int


def artifact_id(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()[:16]


class ArtifactWriter(DataSourceWriter):
    def __init__(self, options, schema: StructType):
        self.root, self.job, self.names = options["path"], uuid.uuid4().hex, schema.fieldNames()
        for c in ("batch_id", "artifact_type", "content"):
            if c not in self.names:
                raise ValueError(f"no column {c}")

    def write(self, rows: Iterator) -> Staged:
        store, root = open_folder(self.root)
        staged, again = {}, 0
        mine = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}"
        for row in rows:
            content = bytes(row["content"] or b"")
            to = f"{root}/{row['batch_id']}/{row['artifact_type']}/{artifact_id(content)}{SUFFIX.get(row['artifact_type'], '')}"
            if to in staged or store.get_file_info(to).type.name == "File":
                again += 1
                continue
            staged[to] = f"{mine}/{len(staged)}"
            store.create_dir(mine)
            with store.open_output_stream(staged[to]) as out:
                out.write(content)
        if not staged:
            return Staged(None, again)
        with store.open_output_stream(f"{mine}/listed") as out:
            for to, at in staged.items():
                out.write((json.dumps([to, at]) + "\n").encode())
        return Staged(f"{mine}/listed", again)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = open_folder(self.root)
        folders: set[str] = set()

        def move(item):
            to, at = item
            if store.get_file_info(to).type.name != "File":
                store.move(at, to)

        with ThreadPoolExecutor(MOVERS) as pool:
            for m in messages:
                if not m or not m.listed:
                    continue
                with store.open_input_stream(m.listed) as stream:
                    lines = io.TextIOWrapper(stream, encoding="utf-8")
                    while some := [json.loads(x) for x in islice(lines, MOVED)]:
                        for folder in {to.rpartition("/")[0] for to, _ in some} - folders:
                            store.create_dir(folder)
                            folders.add(folder)
                        list(pool.map(move, some))
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = open_folder(self.root)
        mine = f"{root}/{STAGING}/{self.job}"
        if store.get_file_info(mine).type.name == "Directory":
            store.delete_dir(mine)


@dataclass
class Part(InputPartition):
    """A folder of a batch and type, and with which digits the ids begin; tasks list it, so that the driver knows folders only. For an id, its files."""

    folder: str = ""
    digits: str = ""
    files: list[tuple[str, int]] | None = None


def _folders(store, path: str) -> list[str]:
    if store.get_file_info(path).type.name != "Directory":
        return []
    some = store.get_file_info(fs.FileSelector(path, recursive=False))
    return sorted(f.path for f in some if f.type.name == "Directory" and f.base_name[:1] not in "._")


def _files(store, folder: str, digits: str) -> Iterator[tuple[str, int]]:
    """Path and size of a folder's files whose names begin with one of `digits`, one by one where the folder is local."""
    if not folder:
        return
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as some:
            yield from ((f.path, f.stat().st_size) for f in some if f.name[:1] in digits and f.is_file())
    else:
        yield from ((f.path, f.size) for f in store.get_file_info(fs.FileSelector(folder, recursive=False)) if f.base_name[:1] in digits and f.type.name == "File")


class ArtifactReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.root, self.names = options["path"], schema.fieldNames()
        self.batch, self.type, self.id = (options.get(c) for c in ("batch_id", "artifact_type", "artifact_id"))

    def partitions(self) -> list[Part]:
        store, root = open_folder(self.root)
        start = root if self.batch is None else f"{root}/{self.batch}" + (f"/{self.type}" if self.type else "")
        batches = [start] if self.batch is not None else _folders(store, root)
        kinds = [x for b in batches for x in ([b] if self.batch is not None and self.type else _folders(store, b))]
        wanted = [x for x in kinds if (self.type is None or x.rpartition("/")[2] == self.type) and store.get_file_info(x).type.name == "Directory"]
        if self.id is not None:
            found = (store.get_file_info(f"{x}/{self.id}{SUFFIX.get(x.rpartition('/')[2], '')}") for x in wanted)
            return [Part(files=[(f.path, f.size)]) for f in found if f.type.name == "File"] or [Part(files=[])]
        ways = list(DIGITS) if len(wanted) <= FOLDERS else [DIGITS]
        return [Part(x, digits) for x in wanted for digits in ways] or [Part()]

    def _split(self, path: str) -> tuple[str, str, str]:
        batch, kind, name = path.split("/")[-3:]
        return batch, kind, name.partition(".")[0]

    def read(self, part: Part) -> Iterator[tuple]:
        store, _ = open_folder(self.root)
        for path, size in _files(store, part.folder, part.digits) if part.files is None else part.files:
            row = dict(zip(("batch_id", "artifact_type", "artifact_id"), self._split(path))) | {"size": size}
            if "content" in self.names:
                with store.open_input_stream(path) as stream:
                    row["content"] = stream.read()
            yield tuple(row.get(c) for c in self.names)


class ArtifactSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparkloom_artifacts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArtifactReader:
        return ArtifactReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> ArtifactWriter:
        if overwrite:
            raise ValueError("artifacts are only added")
        return ArtifactWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArtifactSource)


def store(rows: DataFrame, path: str) -> None:
    """rows: batch_id, artifact_type, content (SNK12)."""
    register(rows.sparkSession)
    rows.select("batch_id", "artifact_type", "content").write.format("sparkloom_artifacts").mode("append").save(path)


def listing(spark: SparkSession, path: str, **where: str) -> DataFrame:
    """batch_id, artifact_type, artifact_id, size; no content is read (SRC16)."""
    register(spark)
    return spark.read.format("sparkloom_artifacts").options(**where).schema("batch_id string, artifact_type string, artifact_id string, size long").load(path)


def fetch(spark: SparkSession, path: str, batch_id: str, id: str) -> DataFrame:
    """The artifact of a batch with an id, of whichever type; no row where there is none (SRC16)."""
    register(spark)
    return spark.read.format("sparkloom_artifacts").options(batch_id=batch_id, artifact_id=id).load(path)
