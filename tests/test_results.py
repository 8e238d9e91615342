"""Folders of measurements to one summary, and files with headers among their data to one table."""

import re
import statistics

import pytest

from kernelweave.plans import results


@pytest.fixture
def folder(tmp_path):
    def put(**files):
        for name, text in files.items():
            (tmp_path / (name.rsplit("_", 1)[0] + "_" + name.rsplit("_", 1)[1] + ".csv")).write_text(text)
        return str(tmp_path)

    return put


def run_of(d, p, r, a, b):
    n = f"Out_{d}_{p}_{r}"
    return {f"{n}_header": "p0, p1\n", f"{n}_data": f"1,10,2,1,20,2\n2,{10 + a},4,2,{20 + b},5\n", f"{n}_time": f"0.5,{r}\n"}


def test_measurements(spark, folder):
    path = folder(**run_of(0, 0, 0, 20, 30), **run_of(0, 0, 1, 22, 33), **run_of(0, 1, 0, 1, 0))
    got = {tuple(r)[:4]: r["Value"] for r in results.measurements(spark, path).collect()}
    assert got[0, 0, 0, "p0"] == 10 and got[0, 0, 1, "p1"] == 11 and got[0, 1, 0, "p1"] == 0 and got[0, 0, 1, "TIME_WALL"] == 1 and got[0, 1, 0, "TIME_CLOCK"] == 0.5 and len(got) == 12
    s = {(r["pIdx"], r["Sensor"]): (r["n"], r["mean"], r["dev"]) for r in results.measurement_summary(spark, path).collect()}
    assert s[0, "p0"] == (2, 10.5, statistics.stdev([10, 11])) and s[1, "p0"] == (1, 0.5, None) and len(s) == 8


@pytest.mark.parametrize(
    ("change", "what"),
    [
        ({"Out_0_0_0_data": "1,10,2,1,20,2\n"}, "two lines"),
        ({"Out_0_0_0_data": "1,10,2\n2,20,4\n"}, "three fields"),
        ({"Out_0_0_0_data": "1,10,2,1,20,2\n2,9,4,2,30,5\n"}, "counter falls"),
        ({"Out_0_0_1_header": "p0\n", "Out_0_0_1_data": "1,10,2\n2,20,4\n", "Out_0_0_1_time": "1,2\n"}, "differ"),
    ],
)
def test_bad_measurements(spark, folder, change, what):
    with pytest.raises(Exception, match=what):
        results.measurements(spark, folder(**(run_of(0, 0, 0, 20, 30) | change))).collect()


def test_no_update_has_no_value(spark, folder):
    path = folder(**(run_of(0, 0, 0, 1, 1) | {"Out_0_0_0_data": "1,10,2,1,20,2\n2,10,2,2,30,5\n"}))
    assert {r["Sensor"]: r["Value"] for r in results.measurements(spark, path).collect()}["p0"] is None


def plain(text):
    header, fields, sticky, out = [], [], {}, []
    for k, line in enumerate(text.split("\n")):
        line = line.strip()
        if line.startswith("#"):
            line = line[1:].strip()
            found = re.match(r"^(.*?)\s*:\s*(.*?)$", line)
            names = [found.group(1)] if found else re.split(r"\s*,\s*", line)
            if found:
                sticky[found.group(1)] = found.group(2)
            else:
                header = names
            fields += [f for f in names if f not in fields]
        elif line:
            out.append((k, dict([*sticky.items(), *zip(header, re.split(r"\s*,\s*", line))])))
    return fields, out


def test_tabularise(spark, tmp_path):
    text = "# size: 4\n# a, b\n1, 2\n\n3,4,5\n# size : 8\n# mode: x: y\n7\n# b , c,size\n9,10,own\n" + "".join(f"{i},{i + 1}\n" for i in range(500)) + "# last\n0\n"
    (tmp_path / "a.csv").write_text(text)
    fields, want = plain(text)
    got = results.tabularise(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["file", "line", *fields]
    assert [(r["line"], {f: r[f] for f in fields if r[f] is not None}) for r in got.orderBy("line").collect()] == want
    (tmp_path / "b.csv").write_text("1,2\n")
    assert results.tabularise(spark, str(tmp_path / "b.csv")).columns == ["file", "line"]
    (tmp_path / "c.csv").write_text("# k: v\nz\n")
    assert [tuple(r)[1:] for r in results.tabularise(spark, str(tmp_path / "c.csv")).collect()] == [(1, "v")]
