"""Large quoted files read in blocks next to whole-file reads."""

import csv
import io
import json
import random

import pytest

from opinara.sources import files, splits


@pytest.fixture(params=["150", "128m"])
def blocks(spark, request):
    """Files are read in blocks of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, request.param)
    yield int(request.param) if request.param.isdigit() else None
    for n, v in before.items():
        spark.conf.set(n, v)


def _rows(seed, n=40):
    rng = random.Random(seed)
    parts = ["plain", "two\nlines", 'say "hi"', ",", "a,\n\"b\",\n", "", "é中", "[{", "]}", "\\", "x" * 150, "\n\n", '"', " lead", 'in"side']
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 4))), rng.choice(["p", "q r", "5\"x\ny"])) for i in range(n)]


def _csv(rows):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["id", "text", "last one"])
    writer.writerows(rows)
    return out.getvalue()


def _plain(spark, path, schema=None):
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


@pytest.mark.parametrize("end", ["\n", ""])
def test_quoted_csv_equals_the_whole_file_read(spark, tmp_path, blocks, end):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.csv").write_text(_csv(_rows(k)).rstrip("\n") + end, encoding="utf-8")
    (folder / "none.csv").write_text("id,text,last one\n", encoding="utf-8")
    got = files.read_csv(spark, str(folder))
    want = _plain(spark, str(folder))
    assert got.schema == want.schema and got.columns == ["id", "text", "last one"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    typed = files.read_csv(spark, str(folder), want.schema)
    assert typed.count() == 80
    if blocks:
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 8


def test_bare_quotes_and_crlf(spark, tmp_path, blocks):
    lines = ["id,text", '1,5" disk', '2,"a ""b"" c"', '3,"x\r\ny"', '4,say "no"', '5,"open, then closed" after', "6,end"]
    path = tmp_path / "a.csv"
    path.write_bytes("\r\n".join(lines).encode() + b"\r\n")
    got = sorted(map(tuple, files.read_csv(spark, str(path)).collect()))
    assert got == sorted(map(tuple, _plain(spark, str(path)).collect())) and len(got) == 6


def test_open_quotes_are_an_error(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,text\n1,a\n2,"never closed, 3\n4,b\n', encoding="utf-8")
    header = tmp_path / "h.csv"
    header.write_text("id,text\n", encoding="utf-8")
    assert files.read_csv(spark, str(header)).collect() == [] and files.read_csv(spark, str(header)).columns == ["id", "text"]
    assert files.read_csv(spark, str(path)).count() == _plain(spark, str(path)).count()


@pytest.mark.parametrize("indent", [None, 1, 4])
def test_json_arrays_equal_the_whole_file_read(spark, tmp_path, blocks, indent):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(2):
        items = [{"id": i, "text": t, "more": {"x": [1, 2], "y": [{"y": t}, {}], "z": z}} for i, t, z in _rows(k + 7, 30)]
        (folder / f"{k}.json").write_text(json.dumps(items, indent=indent, ensure_ascii=bool(k)), encoding="utf-8")
    (folder / "none.json").write_text(" [ ]\n", encoding="utf-8")
    got = files.read_json(spark, str(folder))
    want = spark.read.option("multiLine", True).json(str(folder))
    assert got.schema == want.schema
    assert sorted(r.asDict(True).__str__() for r in got.collect()) == sorted(r.asDict(True).__str__() for r in want.collect())
    assert files.read_json(spark, str(folder), want.schema, "array").count() == 60
    with pytest.raises(ValueError):
        files.read_json(spark, str(folder), form="xml")


def test_forms_by_their_heads():
    cases = {"[1": "array", " \n[": "array", '{"a": 1}\n{"a": 2}': "lines", '{"a": 1}': "lines", '{"a": 1,\n "b": 2}': "object", "{\n": "lines", '{"a":\n1}': "object", "": "lines", "x": "lines"}
    for head, form in cases.items():
        assert files.json_form(head) == form, head


def test_scanners():
    assert [splits.scan_csv(x, False)[0] for x in ('a"b', '"a', '"a"', '"a""', 'x,"a', '"a"b",c', '""', '"', ',"')] == [False, True, False, True, True, False, False, True, True]
    assert [splits.scan_csv(x, True)[0] for x in ("a", 'a"', 'a""', '",b', '","', '"","')] == [True, False, True, False, True, False]
    assert splits.scan_json('{"a\\"[": [', False) == (False, 2) and splits.scan_json('x\\\\" }', True) == (False, -1) and splits.scan_json('x\\"', True) == (True, 0)
