"""Binary files of equal records, read by byte ranges: Spark's Python data source with one partition a range.

The driver lists files and reads headers, nothing else. Records are numbered through all files, in the order of their
paths, from the headers or sizes and the place in the file, so numbers don't depend on how ranges are cut. A task opens
its file at its range's offset and passes on batches of bounded bytes, so a file of any size has bounded tasks.

Formats: ``points`` (int32 n, int32 d, n * d float32), ``records`` (a label byte and depth * height * width bytes),
``floats`` (rows of float32) and ``idx`` (big-endian magic, n, height and width, then n * height * width bytes). A file
that is shorter than its header says is an error; bytes behind the last whole record are left out. No files or no
records give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kernelweave.session import prepare

RANGE = 64 << 20  # bytes of a partition
BATCH = 4 << 20  # bytes of a batch


@dataclass
class Layout:
    """Where a file's records begin, how long one is, and how many there are."""

    offset: int
    size: int
    count: int
    shape: tuple[int, ...] = ()


def _layout(kind: str, head: bytes, length: int, options: dict) -> Layout:
    if kind == "points":
        n, d = (int(v) for v in np.frombuffer(head[:8], "<i4"))
        out = Layout(8, 4 * d, n if d > 0 else 0, (d,))
    elif kind == "idx":
        n, h, w = (int(v) for v in np.frombuffer(head[4:16], ">i4"))
        out = Layout(16, h * w, n, (h, w))
    else:
        shape = tuple(int(options[k]) for k in ("depth", "height", "width")) if kind == "records" else (int(options["width"]),)
        size = 1 + int(np.prod(shape)) if kind == "records" else 4 * shape[0]
        return Layout(0, size, length // size, shape)
    if out.count < 0 or out.offset + out.size * out.count > length:
        raise ValueError(f"a file of {length} bytes is too short for {out.count} records of {out.size} bytes")
    return out


def _batch(kind: str, data: bytes, first: int, layout: Layout, options: dict) -> pa.RecordBatch:
    x = np.frombuffer(data, np.uint8).reshape(-1, layout.size)
    ids = pa.array(np.arange(first, first + len(x)))
    if kind == "points" or kind == "floats":
        return _arrays(("id", "coords") if kind == "points" else ("row", "v"), [ids], np.frombuffer(data, "<f4").reshape(-1, layout.size // 4).astype(float))
    if kind == "records":
        depth, height, width = layout.shape
        pixels = x[:, 1:].reshape(-1, depth, height, width).transpose(0, 2, 3, 1).reshape(-1, layout.size - 1).astype(float)
        return _arrays(("id", "label", "pixels"), [ids, pa.array(x[:, 0].astype(np.int32))], pixels)
    pad = int(options.get("pad", 0))
    pixels = np.pad(x.reshape(-1, *layout.shape) / 127.5 - 1, ((0, 0), (pad, pad), (pad, pad)), constant_values=-1.0)
    return _arrays(("img", "pixels"), [ids], pixels.reshape(-1, int(np.prod(pixels.shape[1:]))))


def _arrays(names: tuple[str, ...], first: list[pa.Array], values: np.ndarray) -> pa.RecordBatch:
    at = pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32())
    return pa.RecordBatch.from_arrays([*first, pa.ListArray.from_arrays(at, pa.array(values.ravel()))], names=list(names))


SCHEMAS = {"points": "id long, coords array<double>", "records": "id long, label int, pixels array<double>", "floats": "row long, v array<double>", "idx": "img long, pixels array<double>"}


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.removeprefix("file:"))


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files that aren't hidden, in the order of their paths."""
    fs, own = _opened(path)
    info = fs.get_file_info(own)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(own, recursive=True))
    prefix = path[: path.index("://") + 3] if "://" in path and not path.startswith("file:") else ""
    return sorted((prefix + f.path, f.size) for f in found if f.is_file and not f.base_name.startswith((".", "_")))


@dataclass
class Range(InputPartition):
    path: str
    start: int  # first record of the file's
    count: int
    number: int  # of that record among all files
    layout: Layout


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.kind = self.options["kind"]

    def partitions(self) -> list[Range]:
        out, number, most = [], 0, int(self.options.get("range_bytes", RANGE))
        for path, length in files_of(self.options["path"]):
            fs, own = _opened(path)
            with fs.open_input_file(own) as f:
                layout = _layout(self.kind, f.read(16), length, self.options)
            step = max(1, most // max(1, layout.size))
            out += [Range(path, s, min(step, layout.count - s), number + s, layout) for s in range(0, layout.count, step)]
            number += layout.count
        return out or [Range("", 0, 0, 0, Layout(0, 1, 0))]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        fs, own = _opened(partition.path)
        layout, step = partition.layout, max(1, BATCH // max(1, partition.layout.size))
        with fs.open_input_file(own) as f:
            for s in range(0, partition.count, step):
                n = min(step, partition.count - s)
                data = f.read_at(n * layout.size, layout.offset + (partition.start + s) * layout.size)
                if len(data) != n * layout.size:
                    raise ValueError(f"{partition.path} has become shorter")
                yield _batch(self.kind, data, partition.number + s, layout, self.options)


class RecordSource(DataSource):
    """Options: path, kind, range_bytes, and those of the kind (depth, height, width; pad)."""

    @classmethod
    def name(cls) -> str:
        return "kernelweave_records"

    def schema(self) -> str:
        return SCHEMAS[self.options["kind"]]

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)


def read_records(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """A table of ``SCHEMAS[kind]``; ``path`` is one that Arrow's file systems open (local, s3, gs, hdfs)."""
    prepare(spark)
    spark.dataSource.register(RecordSource)
    reader = spark.read.format("kernelweave_records").option("kind", kind)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path)


def readable(path: str) -> bool:
    """Whether Arrow's file systems open the path at all; others are left to Spark's own readers."""
    try:
        _opened(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True
