"""Byte ranges of binary files, and the last start carried through blocks."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelweave.operators import stats
from kernelweave.sources import ranges, readers


def put(folder, name, data):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data)
    return str(folder)


@pytest.fixture(scope="module")
def points(tmp_path_factory):
    r = np.random.default_rng(1)
    folder = tmp_path_factory.mktemp("points") / "p"
    x = [r.normal(size=(n, 3)).astype("<f4") for n in (700, 0, 41)]
    for i, own in enumerate(x):
        put(folder, f"part-{i}", np.array(own.shape, "<i4").tobytes() + own.tobytes() + b"rest")
    put(folder, "_SUCCESS", b"")
    return str(folder), np.concatenate(x)


@pytest.mark.parametrize("range_bytes", [1, 500, 1 << 20])
def test_points(spark, points, range_bytes):
    path, x = points
    got = readers.points_binary(spark, path, range_bytes=range_bytes)
    rows = got.orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(741)) and np.array([r["coords"] for r in rows]).astype("<f4").tolist() == x.tolist()
    assert got.rdd.getNumPartitions() == {1: 741, 500: 19, 1 << 20: 2}[range_bytes]


def test_as_the_whole_file_reader(spark, points, monkeypatch):
    """Where a path is one that Arrow can't open, Spark's own reader gives the same rows."""
    path, _ = points
    want = sorted(map(tuple, readers.points_binary(spark, path).collect()))
    monkeypatch.setattr(ranges, "readable", lambda path: False)
    assert sorted(map(tuple, readers.points_binary(spark, path).collect())) == want
    monkeypatch.undo()
    assert not ranges.readable("viewfs://x/y")


def test_other_kinds(spark, tmp_path):
    r = np.random.default_rng(2)
    own = r.integers(0, 256, (50, 1 + 3 * 4 * 2), np.uint8)
    path = put(tmp_path / "r", "data", own.tobytes() + b"xy")
    rows = readers.records(spark, path, 4, 2, 3, range_bytes=100).orderBy("id").collect()
    assert [r["label"] for r in rows] == own[:, 0].tolist()
    assert [r["pixels"] for r in rows] == own[:, 1:].reshape(-1, 3, 4, 2).transpose(0, 2, 3, 1).reshape(50, -1).tolist()
    flat = r.normal(size=(30, 5)).astype("<f4")
    path = put(tmp_path / "f", "data", flat.tobytes())
    assert np.array([v["v"] for v in readers.floats(spark, path, 5, range_bytes=64).orderBy("row").collect()]).astype("<f4").tolist() == flat.tolist()
    image = r.integers(0, 256, (9, 2, 3), np.uint8)
    path = put(tmp_path / "i", "data", np.array([2051, 9, 2, 3], ">i4").tobytes() + image.tobytes())
    rows = readers.idx_images(spark, path, 1, range_bytes=7).orderBy("img").collect()
    want = np.pad(image / 127.5 - 1, ((0, 0), (1, 1), (1, 1)), constant_values=-1.0)
    assert [v["pixels"] for v in rows] == want.reshape(9, -1).tolist()


def test_bad_files(spark, tmp_path):
    path = put(tmp_path / "short", "data", np.array([5, 3], "<i4").tobytes() + b"\0" * 40)
    with pytest.raises(Exception, match="too short"):
        readers.points_binary(spark, path).count()
    (tmp_path / "none").mkdir()
    assert readers.points_binary(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception):
        readers.points_binary(spark, str(tmp_path / "nowhere")).count()


def test_large_file(tmp_path):
    """A file beyond 2 GB (with a hole) has bounded ranges, and its last records keep their numbers."""
    n, d = 40_000_000, 20
    path = tmp_path / "large"
    with open(path, "wb") as f:
        f.write(np.array([n, d], "<i4").tobytes())
        f.truncate(8 + 4 * n * d)
        f.seek(8 + 4 * (n - 1) * d)
        f.write(np.arange(d, dtype="<f4").tobytes())
    assert os.path.getsize(path) > 3_000_000_000
    reader = ranges.RecordReader({"path": str(path), "kind": "points"})
    parts = reader.partitions()
    assert len(parts) == 48 and sum(p.count for p in parts) == n and all(p.count * 4 * d <= ranges.RANGE for p in parts)
    *_, last = reader.read(parts[-1])
    assert last.column(0)[-1].as_py() == n - 1 and last.column(1)[-1].as_py() == list(range(d)) and last.nbytes < 3 * ranges.BATCH


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_assign_ranges(spark, block):
    r = random.Random(block)
    starts = sorted((r.choice("ab"), r.randrange(100), r.randrange(1000)) for _ in range(30)) + [("a", 5, 7), ("a", 5, 9), ("b", None, 1), ("b", 3, None)]
    points = [(r.choice("ab"), r.randrange(-5, 120)) for _ in range(300)] + [("a", None), ("c", 4)]
    got = stats.assign_ranges(spark.createDataFrame(points, "g string, k long").withColumns({"_s": F.lit(0), "own": F.lit(1)}), spark.createDataFrame(starts, "g string, k long, row long"), "k", "row", ("g",), block)
    want = []
    for g, k in points:
        fit = [(a, b) for h, a, b in starts if h == g and a is not None and b is not None and k is not None and a <= k]
        want.append((g, k, 1, max(fit)[1] if fit else None))
    assert sorted(map(repr, ((x["g"], x["k"], x["own"], x["row"]) for x in got.collect()))) == sorted(map(repr, want))


def test_hub_of_a_graph(spark, tmp_path):
    """A row of many neighbours, empty rows and n + 1 pointers."""
    n, hub = 6, 200_000
    starts = [0, 0, 3, 3, 3 + hub, 3 + hub]
    ids = [i % 7 for i in range(3 + hub + 2)]
    text = f"{n} {len(ids)}\n" + " ".join(map(str, [*starts, len(ids)])) + "\n" + "\n".join(" ".join(map(str, ids[s : s + 1000])) for s in range(0, len(ids), 1000))
    (tmp_path / "g").write_text(text)
    got = {r["src"]: r["n"] for r in readers.csr_graph(spark, str(tmp_path / "g")).groupBy("src").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 3, 3: hub, 5: 2}
    (tmp_path / "e").write_text("")
    assert readers.csr_graph(spark, str(tmp_path / "e")).count() == 0
