"""Archives of arrays (.npz) as a data source of Spark, for reading and writing.

Two layouts. `vectors`: arrays named `<key>__<kind>`, one vector a key and kind; either kind may be missing. `series`: one
array a column, all of one length, with scalars beside them; `frame` is the number of a row.

    spark.dataSource.register(npz.NpzSource)
    spark.read.format("npz").option("kinds", "hsv,cnn").load(folder)
    spark.read.format("npz").option("layout", "series").option("target_fps", 10).schema(...).load(folder)
    df.write.format("npz").option("kinds", "hsv,cnn").save(folder)

Reading is planned from the archives' directories alone: members are dealt to partitions of about `partition_bytes`, so that
one large archive is many tasks and small ones share a task. A series with `target_fps` keeps every stride-th frame, with
stride = max(1, round(fps / target)) from the archive's own `fps`; equality and range filters on `frame`, or on the key, drop
members and rows before they become rows of Spark. A folder that isn't there has no rows.

Folders are paths or URIs that pyarrow's file systems open (local, hdfs, s3, gs); where only Spark opens a store,
tables.read_vectors reads archives through Spark's own binary files. Writing streams: a worker holds one vector, begins a new
archive after `archive_members` members or when a key comes again, and its archives appear when the whole job has succeeded.
"""

from __future__ import annotations

import io
import math
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PARTITION_BYTES, ARCHIVE_MEMBERS, BATCH_ROWS = 32 << 20, 20_000, 2_000


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _archives(store: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    """Archives at a path, in the order of their names; none if it isn't there."""
    here = store.get_file_info(path)
    if here.type == fs.FileType.File:
        return [here]
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f for f in found if f.path.endswith(".npz")), key=lambda f: f.path)


def _zip(root: str, path: str) -> zipfile.ZipFile:
    return zipfile.ZipFile(_opened(root)[0].open_input_file(path))


def _array(archive: zipfile.ZipFile, name: str) -> np.ndarray:
    return np.load(io.BytesIO(archive.read(f"{name}.npy")), allow_pickle=False)


def _rows(archive: zipfile.ZipFile, name: str) -> int:
    """The length of a member, from the head of its bytes."""
    with archive.open(f"{name}.npy") as f:
        version = np.lib.format.read_magic(f)
        shape = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)[0]
    return shape[0] if shape else 0


@dataclass
class Members(InputPartition):
    """Keys of archives that one task reads."""

    parts: list[tuple[str, list[str]]]


@dataclass
class Stretch(InputPartition):
    """Every stride-th of an archive's rows from `start` to `stop`."""

    path: str
    start: int
    stop: int
    stride: int


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self._options, self._types = options, to_arrow_schema(schema)
        self._root, self._size = options["path"], int(options.get("partition_bytes", PARTITION_BYTES))
        self._tests: list[tuple[str, object]] = []
        self._column = "frame" if self._series else self._types.names[0]

    @property
    def _series(self) -> bool:
        return self._options.get("layout") == "series"

    def pushFilters(self, filters):
        """Takes comparisons of the key or frame with numbers; all others stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == (self._column,):
                self._tests.append((type(f).__name__, f.value))
            else:
                yield f

    def _wanted(self, x):
        """Whether numbers pass the filters; takes arrays too."""
        out = np.ones(np.shape(x), bool)
        for kind, v in self._tests:
            out &= {"EqualTo": lambda: x == v, "In": lambda: np.isin(x, v), "GreaterThan": lambda: x > v, "GreaterThanOrEqual": lambda: x >= v, "LessThan": lambda: x < v, "LessThanOrEqual": lambda: x <= v}[kind]()
        return out

    def partitions(self) -> list[InputPartition]:
        store, path = _opened(self._root)
        out, held, size = [], [], 0
        for f in _archives(store, path):
            with zipfile.ZipFile(store.open_input_file(f.path)) as archive:
                if self._series:
                    out += self._stretches(f, archive)
                    continue
                keys: dict[str, int] = {}
                for m in archive.infolist():
                    key = m.filename.removesuffix(".npy").split("__")[0]
                    keys[key] = keys.get(key, 0) + m.compress_size
                mine: list[str] = []
                for key in sorted(keys, key=int):
                    if not self._wanted(int(key)):
                        continue
                    mine.append(key)
                    size += keys[key]
                    if size >= self._size:
                        out.append(Members([*held, (f.path, mine)]))
                        held, mine, size = [], [], 0
                held += [(f.path, mine)] if mine else []
        return [*out, Members(held)] if held or not out else out

    def _stretches(self, f: fs.FileInfo, archive: zipfile.ZipFile) -> list[Stretch]:
        target, stride = self._options.get("target_fps"), 1
        if target:
            stride = max(1, round(float(_array(archive, "fps")) / float(target)))
        n = _rows(archive, "frame")
        step = math.ceil(n / max(1, math.ceil(f.size / self._size)))
        return [Stretch(f.path, at, min(n, at + step), stride) for at in range(0, n, max(1, step))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Stretch):
            yield from self._read_series(partition)
            return
        kinds = self._types.names[1:]
        for path, keys in partition.parts:
            archive = _zip(self._root, path)
            there = set(archive.namelist())
            get = lambda key, kind: _array(archive, f"{key}__{kind}") if f"{key}__{kind}.npy" in there else None  # noqa: B023, E731
            for at in range(0, len(keys), BATCH_ROWS):
                some = keys[at : at + BATCH_ROWS]
                columns = [pa.array([int(k) for k in some], self._types.field(0).type)]
                columns += [pa.array([get(k, kind) for k in some], self._types.field(i + 1).type) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, schema=self._types)

    def _read_series(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        archive = _zip(self._root, part.path)
        frame = _array(archive, "frame")[part.start : part.stop]
        keep = np.flatnonzero((frame % part.stride == 0) & self._wanted(frame))
        if not len(keep):
            return
        columns = []
        for f in self._types:
            member = _array(archive, f.name)
            values = frame[keep] if f.name == "frame" else np.full(len(keep), member[()]) if member.ndim == 0 else member[part.start : part.stop][keep]
            columns.append(pa.array(values.tolist() if values.ndim > 1 else values).cast(f.type))
        yield from pa.Table.from_arrays(columns, schema=self._types).to_batches(BATCH_ROWS)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool):
        self._options, self._overwrite, self._names = options, overwrite, schema.names
        self._root, self._run = options["path"], uuid.uuid4().hex

    def _temporary(self) -> tuple[fs.FileSystem, str, str]:
        store, path = _opened(self._root)
        path = path.rstrip("/")
        return store, path, f"{path}/_temporary-{self._run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, _, where = self._temporary()
        store.create_dir(where, recursive=True)
        most, files, archive, seen = int(self._options.get("archive_members", ARCHIVE_MEMBERS)), [], None, set()
        task = TaskContext.get()
        tag = f"{task.partitionId():05d}-{task.taskAttemptId()}"

        def begin() -> zipfile.ZipFile:
            files.append(f"part-{tag}-{len(files)}.npz")
            seen.clear()
            return zipfile.ZipFile(store.open_output_stream(f"{where}/{files[-1]}"), "w", zipfile.ZIP_STORED)

        def put(name: str, value) -> None:
            with archive.open(f"{name}.npy", "w", force_zip64=True) as f:
                np.lib.format.write_array(f, np.asanyarray(value), allow_pickle=False)

        def end() -> None:
            if archive is not None:
                raw = archive.fp
                archive.close()
                raw.close()

        series = self._options.get("layout") == "series"
        for batch in iterator:
            if series:  # rows of one rate that come together are an archive of their own
                columns = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in self._names}
                rates = columns.get("fps", np.zeros(len(batch)))
                edges = [0] if not len(batch) else [0, *(np.flatnonzero(rates[1:] != rates[:-1]) + 1).tolist(), len(batch)]
                for lo, hi in zip(edges, edges[1:], strict=False):
                    archive = begin()
                    for name, values in columns.items():
                        put(name, values[lo] if name == "fps" else values[lo:hi])
                    end()
                archive = None
                continue
            for i, key in enumerate(batch.column(0).to_pylist()):
                if archive is None or len(seen) * len(self._names) >= most or key in seen:
                    end()
                    archive = begin()
                seen.add(key)
                for kind in self._names[1:]:
                    value = batch.column(kind)[i]
                    if value.is_valid:
                        put(f"{key}__{kind}", value.values.to_numpy(zero_copy_only=False))
        end()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, path, where = self._temporary()
        if self._overwrite:
            for f in _archives(store, path):
                store.delete_file(f.path)
        for m in messages:
            for name in m.files if m else []:
                store.move(f"{where}/{name}", f"{path}/{self._run[:8]}-{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, _, where = self._temporary()
        if store.get_file_info(where).type != fs.FileType.NotFound:
            store.delete_dir(where)


class NpzSource(DataSource):
    """format("npz"); see the module."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        if self.options.get("layout") == "series":
            raise ValueError("a series of arrays needs a schema with the columns to read")
        kinds = [k.strip() for k in self.options.get("kinds", "hsv,cnn").split(",")]
        return ", ".join([f"{self.options.get('key', 'track')} long", *(f"{k} array<float>" for k in kinds)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(schema, dict(self.options), overwrite)


def register(spark) -> None:
    """Makes format("npz") known to the session, with its filters pushed into the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NpzSource)
