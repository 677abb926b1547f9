"""``.npy`` array files as a Spark data source: ``spark.read.format("npy").load(path)``.

An array of rows x entries is a table (layer, row, v); one of layers x rows x entries has its first axis as layer.  Tasks read row ranges straight from the file,
filters on ``layer`` drop the other layers before any task is made, and the writer makes one file for each unbroken run of rows, named by its layer and first row.
A path is a file or a folder, on any file system that Arrow opens.
"""

from __future__ import annotations

import io
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: Bytes of an array that one task reads, and rows of a batch.
TASK_BYTES, BATCH = 32 << 20, 4096
#: What a file's name says about its place: written files hold one run of rows of one layer.
_PLACE = re.compile(r"layer-(\d+)\.row-(\d+)\.[0-9a-f]+\.npy$")
_SCHEMA = pa.schema([("layer", pa.int32()), ("row", pa.int64()), ("v", pa.list_(pa.float64()))])


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)


def _header(raw: bytes) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and the first byte of the numbers of a ``.npy`` file that begins with ``raw``."""
    head = io.BytesIO(raw)
    version = np.lib.format.read_magic(head)
    shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if by_column or kind.hasobject or kind.kind not in "biuf":
        raise ValueError("only arrays of numbers in row order can be read")
    return shape, kind, head.tell()


@dataclass
class _Range(InputPartition):
    """Rows of one layer of one file: where they begin and how they are numbered."""

    file: str
    layer: int
    row: int
    rows: int
    entries: int
    kind: str
    offset: int


_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


class _Reader(DataSourceReader):
    def __init__(self, path: str, layered: str | None, task_bytes: int):
        self.path, self.layered, self.task_bytes, self.tests = path, layered, task_bytes, []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("layer",):
                self.tests.append((type(f).__name__, f.value))
            else:
                yield f

    def _wanted(self, layer: int) -> bool:
        known = {kind.__name__: test for kind, test in _TESTS.items()}
        return all(known[name](layer, value) for name, value in self.tests)

    def partitions(self):
        system, path = _opened(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [i for i in system.get_file_info(fs.FileSelector(path, recursive=True)) if i.is_file and i.base_name.endswith(".npy")]
        out = []
        for file in sorted(found, key=lambda i: i.path):
            place = _PLACE.search(file.base_name)
            if place and not self._wanted(int(place[1])):
                continue
            with system.open_input_file(file.path) as stream:
                shape, kind, start = _header(stream.read(min(file.size, 4096)))
            layered = not place and (len(shape) == 3 if self.layered is None else self.layered == "true")
            layers, *rest = shape if layered else (1, *shape)
            n, entries = rest[0] if rest else 1, int(np.prod(rest[1:], dtype=int))
            step = max(1, self.task_bytes // max(1, entries * kind.itemsize))
            for layer in range(layers):
                number = int(place[1]) if place else layer
                if self._wanted(number):
                    first = int(place[2]) if place else 0
                    out += [_Range(file.path, number, first + a, min(step, n - a), entries, kind.str, start + (layer * n + a) * entries * kind.itemsize) for a in range(0, n, step)]
        return out

    def read(self, partition):
        if partition is None:  # no layer is wanted
            return
        kind, size = np.dtype(partition.kind), partition.entries * np.dtype(partition.kind).itemsize
        with _opened(self.path)[0].open_input_file(partition.file) as stream:
            for a in range(0, partition.rows, BATCH):
                n = min(BATCH, partition.rows - a)
                raw = stream.read_at(n * size, partition.offset + a * size)
                if len(raw) < n * size:
                    raise ValueError(f"{partition.file} ends before its rows do")
                numbers = np.frombuffer(raw, kind).astype(float)
                v = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * partition.entries, pa.int32()), pa.array(numbers))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, partition.layer, np.int32)), pa.array(np.arange(n) + partition.row + a), v], schema=_SCHEMA)


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    """Runs of rows with the same layer and rising numbers, in the order in which they come, are one file each; files get their names when all tasks are done."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator):
        system, path = _opened(self.path)
        system.create_dir(path, recursive=True)
        files, run = [], None  # the run: layer, first row, next row, entries, parts

        def closed():
            numbers = np.concatenate(run[4])
            name = f"{path}/layer-{run[0]}.row-{run[1]}.{uuid.uuid4().hex}.npy"
            buffer = io.BytesIO()
            np.lib.format.write_array(buffer, numbers, allow_pickle=False)
            with system.open_output_stream(name + ".part") as stream:
                stream.write(buffer.getvalue())
            files.append(name)

        for batch in iterator:
            layers, rows = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("layer", "row"))
            vectors = batch.column(batch.schema.get_field_index("v"))
            sizes = np.asarray(vectors.value_lengths())
            new = np.flatnonzero((np.diff(layers) != 0) | (np.diff(rows) != 1) | (np.diff(sizes) != 0)) + 1
            for a, b in zip([0, *new], [*new, len(rows)], strict=True):
                if a == b:
                    continue
                part = vectors.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b - a, sizes[a])
                if run and (run[0], run[2], run[3]) == (layers[a], rows[a], sizes[a]) and sum(p.nbytes for p in run[4]) < 4 * TASK_BYTES:
                    run[2] += b - a
                    run[4].append(part)
                else:
                    if run:
                        closed()
                    run = [int(layers[a]), int(rows[a]), int(rows[b - 1]) + 1, int(sizes[a]), [part]]
        if run:
            closed()
        return _Written(files)

    def commit(self, messages):
        system, path = _opened(self.path)
        system.create_dir(path, recursive=True)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(path, recursive=True)):
                if info.is_file and info.base_name.endswith(".npy"):
                    system.delete_file(info.path)
        for message in messages:
            for name in message.files if message else ():
                system.move(name + ".part", name)

    def abort(self, messages):
        system, _ = _opened(self.path)
        for message in messages:
            for name in message.files if message else ():
                system.delete_file(name + ".part")


class ArrayFiles(DataSource):
    """Options: ``layered`` (whether the first axis is a layer; by default if there are three) and ``taskBytes``."""

    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return "layer int, row bigint, v array<double>"

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("layered"), int(self.options.get("taskBytes", TASK_BYTES)))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """``spark`` with the source known and filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrayFiles)
    return spark


def read_arrays(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(layer, row, v) of an array file or a folder of them."""
    return registered(spark).read.format("npy").options(**options).load(path)


def write_arrays(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``df`` (layer, row, v) as array files, ordered by layer and row, so tasks write long runs."""
    registered(df.sparkSession)
    ordered = df.select(F.col("layer").cast("int").alias("layer"), F.col("row").cast("long").alias("row"), F.col("v").cast("array<double>").alias("v")).repartitionByRange("layer", "row").sortWithinPartitions("layer", "row")
    ordered.write.format("npy").mode(mode).save(path)
