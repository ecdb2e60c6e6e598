"""Arrays in .npy files as a data source: spark.read.format("npy") and df.write.format("npy").

Files are reached through pyarrow's file systems (local, HDFS, S3, GCS), so executors need no mount. The
driver lists files and reads headers; a partition is a range of rows of one file, of which a task reads
only its own bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Rows (of the last axis) that a partition has, and that a batch has.
ROWS, BATCH = 65_536, 1024
#: Text that a header may have; its own length field would allow 4 GB.
HEADER = 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def header(file) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """Shape, whether columns come first, type and the first byte of the numbers of an open .npy file."""
    version = np.lib.format.read_magic(file)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, columns_first, kind = read(file, max_header_size=HEADER)
    if kind.hasobject or kind.fields is not None or kind.kind not in "biuf":
        raise ValueError(f"only plain numbers can be read, not {kind}")
    return shape, columns_first and len(shape) > 1, kind, file.tell()


@dataclass
class Rows(InputPartition):
    """Rows `first` to `end` of an array of `shape` whose numbers begin at byte `at`."""

    path: str
    shape: tuple[int, ...]
    columns_first: bool
    kind: str
    at: int
    first: int
    end: int


class NpyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.rows = options["path"], int(options.get("rows", ROWS))

    def partitions(self) -> list[Rows]:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        files = [path] if info.type == fs.FileType.File else sorted(f.path for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(".npy"))
        out = []
        for one in files:
            with system.open_input_file(one) as f:
                shape, columns_first, kind, at = header(f)
            many = int(np.prod(shape[:-1])) if shape else 1
            # an array with columns first has no contiguous rows, so one task reads it
            step = many if columns_first else self.rows
            out += [Rows(one, shape, columns_first, kind.str, at, a, min(a + step, many)) for a in range(0, many, max(step, 1))]
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        p, kind = partition, np.dtype(partition.kind)
        wide = p.shape[-1] if p.shape else 1
        system, _ = opened(self.path)
        with system.open_input_file(p.path) as f:
            step = p.end - p.first if p.columns_first else BATCH
            for a in range(p.first, p.end, step):
                b = min(a + step, p.end)
                f.seek(p.at + a * wide * kind.itemsize)
                data = np.frombuffer(f.read((b - a) * wide * kind.itemsize), kind)
                table = data.reshape(p.shape, order="F").reshape(-1, wide) if p.columns_first else data.reshape(b - a, wide)
                place = np.stack(np.unravel_index(np.arange(a, b), p.shape[:-1]), axis=1) if len(p.shape) > 1 else np.zeros((b - a, 0), int)
                yield pa.RecordBatch.from_arrays([pa.array([p.path] * (b - a)), pa.array(list(place.astype(np.int64)), pa.list_(pa.int64())), pa.array(list(table.astype(np.float64)), pa.list_(pa.float64()))], names=["file", "place", "values"])


class NpyWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.kind, self.overwrite = options["path"], np.dtype(options.get("dtype", "<f4")), overwrite

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        """A file for each row; it gets its name when it is whole, so that a task may be run again."""
        system, path = opened(self.path)
        system.create_dir(path, recursive=True)
        for row in iterator:
            data = np.asarray(row["values"], self.kind).reshape([int(n) for n in row["shape"]])
            own = f"{path}/.{uuid.uuid4().hex}"
            with system.open_output_stream(own) as f:
                np.lib.format.write_array_header_1_0(f, np.lib.format.header_data_from_array_1_0(data))
                f.write(data.tobytes())
            system.move(own, f"{path}/{row['name']}.npy")
        return WriterCommitMessage()


class Npy(DataSource):
    """Reads (file, place, values): a row for each index of all axes but the last, and the last as values.
    Writes rows (name, shape, values) as <name>.npy. Options: path; rows, of a partition; dtype, of what is
    written. Arrays of objects or records raise an error; 0-dimensional arrays are one row of one value."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "file string, place array<long>, values array<double>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Npy)
