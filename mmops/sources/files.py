"""A data source of many small text files: read in partitions of about equal bytes, and written a file a row, all or none.

``spark.read.format("small_files").load(folder)`` and ``df.write.format("small_files").mode("overwrite").save(folder)`` after :func:`register`.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of content in a batch of rows, beyond its last file.
BATCH_BYTES = 4 << 20
SCHEMA = "name string, stem string, suffix string, size long, mtime long, content string"
PART_BYTES = 16 << 20
#: Folders of very many files are read in larger partitions, so that their number stays near PARTS, as far as these bytes go.
MOST_BYTES, PARTS = 128 << 20, 1000
#: What opening a file costs, in bytes, so that a partition has no end of tiny files.
OPEN_BYTES = 64 << 10
MARK = "_SUCCESS"
_NAME = re.compile(r"[^/\\\x00]+")


def _folder(path: str):
    """(file system, path) of a URI or a local path."""
    from pyarrow import fs

    found, at = fs.FileSystem.from_uri(path if re.match(r"[a-z0-9+.-]+:/", path) else "file://" + path)
    return found, at.rstrip("/")


def _parts(name: str) -> tuple[str, str]:
    stem, dot, suffix = name.rpartition(".")
    return (stem, dot + suffix.lower()) if stem else (name, "")


@dataclass
class FilePartition(InputPartition):
    """Files as compressed blocks: a few bytes each, as all partitions pass through the driver."""

    blocks: list

    @property
    def files(self):
        """(name, size, mtime) one by one."""
        for block in self.blocks:
            for row in zlib.decompress(block).decode("utf-8", "surrogateescape").split("/"):
                name, size, mtime = row.split("\0")
                yield name, int(size), int(mtime)


def _block(files: list) -> bytes:
    """No name holds a slash or a null."""
    return zlib.compress("/".join(f"{name}\0{size}\0{mtime}" for name, size, mtime in sorted(files)).encode("utf-8", "surrogateescape"))


def _listed(system, at: str):
    """(name, size, mtime in ms) of a folder's files. A local folder is read entry by entry, whatever its size; Arrow lists others whole."""
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(at) as entries:
            for e in entries:
                if e.is_file():
                    stat = e.stat()
                    yield e.name, stat.st_size, stat.st_mtime_ns // 1_000_000
    else:
        for f in system.get_file_info(fs.FileSelector(at)):
            if f.type == fs.FileType.File:
                yield f.base_name, f.size, f.mtime_ns // 1_000_000


def _delete(system, at: str) -> None:
    """A folder in which tasks that were told to stop may still make a file."""
    from pyarrow import fs

    for left in range(9, -1, -1):
        try:
            if system.get_file_info(at).type != fs.FileType.NotFound:
                system.delete_dir(at)
            return
        except OSError:
            if not left:
                raise
            time.sleep(0.2)


class SmallFileReader(DataSourceReader):
    """Lists once, and holds no more of it than compressed blocks of names; files of other stems and suffixes than asked for are neither opened nor planned."""

    def __init__(self, path: str):
        self.path = path
        self.only: dict[str, set[str]] = {}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) else None
            if column in ("stem", "suffix", "name"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[column] = self.only.get(column, values) & values
            else:
                yield f

    def partitions(self):
        blocks, own, size = [], [], 0
        for f in _listed(*_folder(self.path)):
            stem, suffix = _parts(f[0])
            if f[0][0] in "_." or any({"name": f[0], "stem": stem, "suffix": suffix}[c] not in v for c, v in self.only.items()):
                continue
            own.append(f)
            size += f[1] + OPEN_BYTES
            if size >= PART_BYTES:
                blocks.append((_block(own), size))
                own, size = [], 0
        if own:
            blocks.append((_block(own), size))
        most = min(MOST_BYTES, max(PART_BYTES, sum(b[1] for b in blocks) // PARTS))
        own, size, out = [], 0, []
        for block, n in blocks:
            own.append(block)
            size += n
            if size >= most:
                out.append(FilePartition(own))
                own, size = [], 0
        return [*out, *[FilePartition(own)] * bool(own)]

    def read(self, partition):
        """Arrow batches of files: a row takes no conversion of its own."""
        import pyarrow as pa

        system, at = _folder(self.path)
        kind = pa.schema([("name", pa.string()), ("stem", pa.string()), ("suffix", pa.string()), ("size", pa.int64()), ("mtime", pa.int64()), ("content", pa.string())])
        rows, held = [], 0
        for name, size, mtime in partition.files if partition is not None else ():
            with system.open_input_stream(f"{at}/{name}") as stream:
                content = stream.read()
            rows.append((name, *_parts(name), size, mtime, content.decode("utf-8", "replace")))
            held += len(content)
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class SmallFileWriter(DataSourceArrowWriter):
    """Files go to a staging folder beside the target, moved there from a folder of their task's own once they are whole: tasks that make files in one
    folder wait for each other. The staging folder is renamed once all tasks are done, and removed if one fails, so that a failed export leaves nothing."""

    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.name, self.content = names.index("name"), names.index("content")  # places, since batches may come without names
        self.staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
        self.parts = f"{self.staging}.parts"
        system, at = _folder(self.staging)
        system.create_dir(at)
        system.create_dir(_folder(self.parts)[1])

    def write(self, iterator):
        system, at = _folder(self.staging)
        own = f"{_folder(self.parts)[1]}/{uuid.uuid4().hex}"
        system.create_dir(own, recursive=False)  # fails once the export was given up
        files = size = 0
        for name, content in (r for b in iterator for r in zip(b.column(self.name).to_pylist(), b.column(self.content).to_pylist(), strict=True)):
            content = (content or "").encode()
            if not name or not _NAME.fullmatch(name):
                raise ValueError(f"no file name: {name!r}")
            part = f"{own}/{name}"
            with system.open_output_stream(part) as stream:
                stream.write(content)
            system.move(part, f"{at}/{name}")
            files, size = files + 1, size + len(content)
        return Written(files, size)

    def commit(self, messages):
        from pyarrow import fs

        system, at = _folder(self.staging)
        _, target = _folder(self.path)
        _delete(system, _folder(self.parts)[1])
        done = [m for m in messages if m is not None]
        with system.open_output_stream(f"{at}/{MARK}") as stream:
            stream.write(json.dumps({"files": sum(m.files for m in done), "bytes": sum(m.size for m in done)}).encode())
        if system.get_file_info(target).type != fs.FileType.NotFound:
            if not self.overwrite:
                system.delete_dir(at)
                raise FileExistsError(target)
            system.delete_dir(target)
        system.move(at, target)

    def abort(self, messages):
        system, at = _folder(self.staging)
        _delete(system, _folder(self.parts)[1])
        _delete(system, at)


class SmallFiles(DataSource):
    @classmethod
    def name(cls):
        return "small_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return SmallFileReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool):
        return SmallFileWriter(self.options["path"], schema.names, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SmallFiles)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """name, stem, suffix, size, mtime (ms) and content of a folder's files, hidden ones left out; filters on the first three are pushed to the listing."""
    register(spark)
    return spark.read.format("small_files").load(folder)


def export_files(rows: DataFrame, folder: str, limit: int | None = None) -> int:
    """O-OUT-09 and O-OUT-10: writes (name, content) rows as files, of the first ``limit`` names only if asked, and returns how many.

    Names must differ: of equal ones one stays, and the count tells. An earlier export is replaced once the new one is whole. Only names are sorted for a limit.
    """
    register(rows.sparkSession)
    rows = rows.select("name", "content")
    if limit is not None:
        first = rows.select("name").distinct().orderBy("name").limit(limit)
        rows = rows.join(F.broadcast(first) if limit <= 1_000_000 else first, "name")
    rows.write.format("small_files").mode("overwrite").save(folder)
    system, at = _folder(folder)
    with system.open_input_stream(f"{at}/{MARK}") as stream:
        return json.loads(stream.read())["files"]
