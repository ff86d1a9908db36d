"""CSV records against Python's reader, however files are cut."""

import csv as plain
import io
import random

import pytest

from placewright.sources import csv, records

TEXT = 'serial,city,note\r\n1,"Pune\nCity",ok\n2,Nasik,"say ""hi"", then\r\n go"\n\n3,5" pipe,"x"\n4,"a,b","""quoted"""\n5,"a"b"c,\n"6\n\n\n7",Mumbai,"é\n"\n8,last,one\n'


def expected(text):
    rows = list(plain.reader(io.StringIO(text, newline="")))
    return sorted(r for r in rows[1:] if r)


def got(spark, path, encodings=csv.ENCODINGS):
    found = records.survey(spark, [path], encodings)
    return sorted(r.cells for r in records.records(spark, [path], found).collect())


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 8, 11, 13, 17, 29, 64, 1000])
def test_records_do_not_depend_on_the_cut(spark, tmp_path, size):
    path = tmp_path / "a b.csv"
    path.write_bytes(TEXT.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", f"{size}b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        assert got(spark, str(path)) == expected(TEXT)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_open_values_are_those_of_the_reader():
    """After every beginning of a random text, a quoted value is open exactly if the reader goes on to the next line."""
    r = random.Random(3)
    for _ in range(3000):
        line = "".join(r.choice('",ab ') for _ in range(r.randint(0, 12)))
        for inside in (False, True):
            rows = list(plain.reader(io.StringIO(('"' if inside else "") + line + "\nzz\n", newline="")))
            assert records.inside_after(line.encode(), inside) == (len(rows) == 1), (line, inside)


def test_random_files_are_those_of_the_reader(spark, tmp_path):
    r = random.Random(9)
    (tmp_path / "in").mkdir()
    texts = {}
    for i in range(12):
        cells = lambda: r.choice(["", "x", "a b", '"q"', '"li\nne"', '"c,d"', '"do""ub"', '"' + "long\r\n" * 9 + '"', 'm"id'])
        texts[f"f{i}.csv"] = "pincode,city,statename\n" + "".join(f"{k},{cells()},{cells()}{r.choice([chr(10), chr(13) + chr(10)])}" for k in range(40))
        (tmp_path / "in" / f"f{i}.csv").write_bytes(texts[f"f{i}.csv"].encode())
    paths = csv.discover(spark, str(tmp_path / "in"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "333b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        found = records.survey(spark, paths, csv.ENCODINGS)
        rows = {}
        for row in records.records(spark, paths, found).collect():
            rows.setdefault(row.path.rsplit("/", 1)[-1], []).append(row.cells)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {k: sorted(v) for k, v in rows.items()} == {k: expected(v) for k, v in texts.items()}


def test_old_line_ends_and_encodings(spark, tmp_path):
    (tmp_path / "mac.csv").write_bytes(b"pincode,city\r411001,Pune\r411002,\"Na\rsik\"\r")
    assert got(spark, str(tmp_path / "mac.csv")) == [["411001", "Pune"], ["411002", "Na\rsik"]]
    (tmp_path / "win.csv").write_bytes('pincode,city\n411001,"“Orl\néans”"\n'.encode("cp1252"))
    assert got(spark, str(tmp_path / "win.csv"), ("UTF-8", "windows-1252")) == [["411001", "“Orl\néans”"]]
    (tmp_path / "open.csv").write_bytes(b'pincode,city\n1,"never closed\n2,x')
    assert [c[0] for c in got(spark, str(tmp_path / "open.csv"))] == ["1"]


def test_folder_of_files_of_different_shapes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('officename,pincode,district\n"X\nY",411001,Pune\n,,\n', encoding="utf-8")
    (tmp_path / "b.csv").write_bytes(b"\xef\xbb\xbfList,,\n\nPIN Code,City,bldgname,buildingname\n411002,Nasik,,Rose\n411003,Pune,Lily,Rose\n")
    (tmp_path / "c.csv").write_bytes(b"")
    (tmp_path / "d.csv").write_bytes("city\nOrléans\n".encode("latin-1"))
    df, reports = csv.ingest_folder(spark, str(tmp_path), count=True)
    by_name = {r.path.rsplit("/", 1)[-1]: r for r in reports}
    assert [(by_name[n].status, by_name[n].rows, by_name[n].header_row) for n in ("a.csv", "b.csv", "c.csv", "d.csv")] == [("success", 1, 0), ("success", 2, 2), ("failed", None, 0), ("success", 1, 0)]
    rows = sorted((r.source_file, r.office_name or "", r.pincode or "", r.city_name or "", r.building_name or "") for r in df.collect())
    assert rows == [("a.csv", "X Y", "411001", "", ""), ("b.csv", "", "411002", "Nasik", "Rose"), ("b.csv", "", "411003", "Pune", "Lily"), ("d.csv", "", "", "Orléans", "")]
    assert by_name["d.csv"].encoding == "ISO-8859-1" and by_name["c.csv"].errors == ["empty file"]
    df, reports = csv.ingest_folder(spark, str(tmp_path), encodings=("UTF-8",))
    assert {r.path.rsplit("/", 1)[-1]: r.status for r in reports}["d.csv"] == "failed" and df.count() == 3
