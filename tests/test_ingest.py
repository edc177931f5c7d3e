"""From archives and CSV files to observations."""

from __future__ import annotations

import io
import tarfile
from collections import Counter
from contextlib import redirect_stdout

import pytest
from conftest import DAY, HEADER, station_file, write_archive
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stationdays.functions import parse_date, parse_number, percent, scan_price, tail_code
from stationdays.schema import EVENT_FLAGS, OBSERVATIONS, SENTINELS
from stationdays.sources import archive, ingest, station_csv


def ingest_archive(spark, folder, *days, name="01001099999.csv", year=2024):
    write_archive(folder / f"{year}.tar.gz", {name: station_file(*days)})
    return ingest.to_observations(archive.read_archives(spark, str(folder)))


def only(frame) -> dict:
    (row,) = frame.collect()
    return row.asDict()


def flags_of(row: dict) -> list[str]:
    return [f for f in EVENT_FLAGS if row[f]]


def test_a_comma_inside_a_quoted_name_shifts_nothing(spark, tmp_path):
    row = only(ingest_archive(spark, tmp_path, {}))
    assert row["name"] == DAY["NAME"]
    assert flags_of(row) == ["rain_drizzle", "thunder"]
    assert row["station"] == DAY["STATION"]
    assert str(row["date"]) == "2024-01-02"
    assert row["temp_f"] == 51.7 and row["prcp_in"] == 0.2 and row["visib_mi"] == 6.0
    assert (row["latitude"], row["longitude"], row["elevation"]) == (-3.25, 101.5, 412.0)


def test_schema_is_the_stored_one(spark, tmp_path):
    frame = ingest_archive(spark, tmp_path, {})
    assert [(f.name, f.dataType) for f in frame.schema] == [
        (f.name, f.dataType) for f in OBSERVATIONS
    ]


def test_flags_by_position(spark, tmp_path):
    packed = ["100000", "010000", "001000", "000100", "000010", "000001",
              "111111", "", "11111", "1111111", "abcdef"]
    days = [{"STATION": str(i), "FRSHTT": f} for i, f in enumerate(packed)]
    got = {r["station"]: flags_of(r.asDict())
           for r in ingest_archive(spark, tmp_path, *days).collect()}
    expected = [[f] for f in EVENT_FLAGS] + [EVENT_FLAGS, [], [], [], []]
    assert got == {str(i): e for i, e in enumerate(expected)}


def test_each_column_has_its_own_sentinel(spark):
    rows = spark.createDataFrame([(c, str(s)) for c, s in SENTINELS.items()], "c string, v string")
    for column, sentinel in SENTINELS.items():
        own = rows.where(F.col("c") == column).select(parse_number(F.col("v"), sentinel).alias("x"))
        assert only(own)["x"] is None
    text = spark.createDataFrame([("99.99",)], "v string")
    got = only(text.select(parse_number(F.col("v"), SENTINELS["PRCP"]).alias("prcp"),
                           parse_number(F.col("v"), SENTINELS["TEMP"]).alias("temp")))
    assert got == {"prcp": None, "temp": 99.99}


def test_missing_temperature_stays_missing_in_celsius(spark, tmp_path):
    row = only(ingest_archive(spark, tmp_path, {"TEMP": "9999.9"}))
    assert row["temp_f"] is None and row["temp_c"] is None


@pytest.mark.parametrize(
    "text,number",
    [("  33.3", 33.3), ("5.", 5.0), ("-.5", -0.5), ("+1e2", 100.0), ("\t7\r", 7.0), ("", None),
     (None, None), ("nan", None), ("inf", None), ("1.0d", None), ("1_0", None), (".", None),
     ("0x1p3", None), ("1 2", None), ("--1", None)],
)
def test_lenient_numbers(spark, text, number):
    frame = spark.createDataFrame([(text,)], "v string")
    assert only(frame.select(parse_number(F.col("v")).alias("x")))["x"] == number


@pytest.mark.parametrize("text,day", [("2024-02-29", "2024-02-29"), (" 2024-01-02 ", "2024-01-02"),
                                      ("2024", None), ("bad", None), ("", None),
                                      ("2023-02-29", None)])
def test_lenient_dates(spark, text, day):
    frame = spark.createDataFrame([(text,)], "v string")
    got = only(frame.select(parse_date(F.col("v")).cast("string").alias("x")))["x"]
    assert got == day


def test_celsius(spark, tmp_path):
    days = [{"STATION": t, "TEMP": t, "MAX": t, "MIN": t} for t in ("32.0", "212.0")]
    got = {r["station"]: (r["temp_c"], r["max_c"], r["min_c"])
           for r in ingest_archive(spark, tmp_path, *days).collect()}
    assert got == {"32.0": (0.0, 0.0, 0.0), "212.0": (100.0, 100.0, 100.0)}


def test_the_year_is_the_archives(spark, tmp_path):
    row = only(ingest_archive(spark, tmp_path, {"DATE": "2023-12-31"}))
    assert row["year"] == 2024 and str(row["date"]) == "2023-12-31"


def test_a_bad_date_keeps_the_row(spark, tmp_path):
    row = only(ingest_archive(spark, tmp_path, {"DATE": "not a day"}))
    assert row["date"] is None and row["temp_f"] == 51.7


def test_members_that_are_no_csv_files_are_ignored(spark, tmp_path):
    write_archive(tmp_path / "2024.tar.gz", {"readme.txt": b"no", "a.csv": station_file({}),
                                            "empty.csv": b""})
    write_archive(tmp_path / "other.tar.gz", {"b.csv": station_file({})})
    assert archive.read_archives(spark, str(tmp_path)).count() == 1


@pytest.mark.parametrize("days", [1, 400])
@pytest.mark.parametrize("before", [b"", b"\n\r\n", b"\xef\xbb\xbf", b"\xef\xbb\xbf\n"])
def test_the_size_of_a_member_changes_no_header(spark, tmp_path, days, before):
    header = [*HEADER, "STATION"]  # of two columns with one name the last counts
    content = station_file(*[{"STATION": "x"}] * days, header=header)
    write_archive(tmp_path / "2024.tar.gz", {"a.csv": before + content,
                                            "b.csv": before + station_file(*[{"STATION": "x"}] * days)})
    rows = ingest.to_observations(archive.read_archives(spark, str(tmp_path)))
    assert {(r["station"], r["name"], r["count"]) for r in rows.groupBy("station", "name").count().collect()} == {
        ("x", DAY["NAME"], 2 * days)}


def test_columns_are_found_by_name(spark, tmp_path):
    swapped = [c for c in reversed(HEADER) if c != "WDSP"]
    write_archive(tmp_path / "2024.tar.gz", {
        "a.csv": station_file({"STATION": "a"}),
        "b.csv": station_file({"STATION": "b"}, header=swapped),
    })
    a, b = ingest.to_observations(archive.read_archives(spark, str(tmp_path))).orderBy(
        "station").collect()
    assert b["wdsp_kn"] is None and a["wdsp_kn"] == 2.5
    assert [a[c] for c in OBSERVATIONS.names if c not in ("station", "wdsp_kn")] == [
        b[c] for c in OBSERVATIONS.names if c not in ("station", "wdsp_kn")]


def test_short_records_and_bad_bytes(spark, tmp_path):
    text = station_file({"NAME": "X"}).replace(b'"X"', b'"\xff, NO"') + b'"9","2024-01-03"\n\n'
    write_archive(tmp_path / "2024.tar.gz", {"a.csv": text})
    long_row, short_row = ingest.to_observations(
        archive.read_archives(spark, str(tmp_path))).orderBy("date").collect()
    assert long_row["name"] == "�, NO"
    assert short_row["station"] == "9" and short_row["name"] == ""
    assert short_row["temp_f"] is None and not short_row["fog"]


def test_quoted_line_breaks_and_quotes(spark, tmp_path):
    name = 'A "B"\nC, NO'
    assert only(ingest_archive(spark, tmp_path, {"NAME": name}))["name"] == name


def test_years_prune_archives_and_slices_cover_all_members(spark, tmp_path):
    for year in (2023, 2024):
        write_archive(tmp_path / "deep" / f"{year}.tar.gz", {
            f"{s}.csv": station_file(*[{"STATION": str(s), "DATE": f"{year}-01-{d:02d}"}
                                       for d in range(1, 4)]) for s in range(50)})
    whole = archive.read_archives(spark, str(tmp_path))
    sliced = archive.read_archives(spark, str(tmp_path), slice_bytes=100)
    assert whole.rdd.getNumPartitions() == 2
    assert sliced.rdd.getNumPartitions() == 2 * archive.MOST_SLICES
    assert whole.count() == 300 and whole.exceptAll(sliced).isEmpty()
    assert sliced.exceptAll(whole).isEmpty()
    one = archive.read_archives(spark, str(tmp_path), years=[2023])
    assert one.rdd.getNumPartitions() == 1
    assert [r["year"] for r in one.select("year").distinct().collect()] == [2023]


def test_large_archives_are_cut_most(tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "LEAST_SLICE_BYTES", 1 << 20)
    for year, size in ((2020, 1 << 20), (2021, 3 << 20), (2022, 8 << 20)):
        (tmp_path / f"{year}.tar.gz").write_bytes(bytes(size))

    def slices(tasks):
        reader = archive.ArchiveReader(str(tmp_path), None, COLUMNS, tasks)
        return Counter(part.year for part in reader.partitions())

    assert slices(12) == {2020: 1, 2021: 3, 2022: 8}
    assert slices(4) == {2020: 1, 2021: 1, 2022: 3}
    assert slices(1) == {2020: 1, 2021: 1, 2022: 1}
    assert slices(10_000)[2022] == archive.MOST_SLICES


def test_batches_do_not_end_with_members(spark, tmp_path):
    days = [{"STATION": str(i)} for i in range(archive.RECORDS_PER_BATCH + 5)]
    assert ingest_archive(spark, tmp_path, *days).count() == len(days)


COLUMNS = ["STATION", "NAME", "TEMP", "FRSHTT"]


@pytest.mark.parametrize(
    "text",
    [
        "STATION,NAME,TEMP,FRSHTT\n1,a,2.0,111111\n2,,,\n",
        "FRSHTT,X,STATION\n0,x,1\n",
        '"STATION","NAME"\n"1","a ""b"", c"\n"2","d\ne"\n',
        "STATION,NAME\r\n1,a\r\n\r\n2,b",
        "STATION,NAME\n1\n2,b,c\n",
        "STATION,STATION\n1,2\n",
        "STATION,NAME\n1,a",
        "STATION,NAME\n",
        "",
        "\ufeffSTATION,NAME\n1,\u00e9\n",
        'STATION,NAME\n1,a"b"c\n2,"unclosed\n',
    ],
)
@pytest.mark.parametrize("broken_bytes", [False, True])
def test_both_parsers_read_the_same(tmp_path, monkeypatch, text, broken_bytes):
    content = text.encode() + (b"3,\xff\n" if broken_bytes and text.endswith("\n") else b"")
    path = write_archive(tmp_path / "2024.tar.gz", {"a.csv": content})

    def rows():
        reader = archive.ArchiveReader(str(tmp_path), None, COLUMNS)
        (part,) = reader.partitions()
        return [{k: v or "" for k, v in row.items()}
                for batch in reader.read(part) for row in batch.to_pylist()]

    few = rows()
    monkeypatch.setattr(archive, "FEW_LINES_BYTES", -1)
    usual = rows()
    monkeypatch.setattr(archive, "WHOLE_MEMBER_BYTES", -1)
    assert few == usual == rows()
    assert path.exists() and (usual or text.count("\n") < 2)


def write_csv(folder, name, content):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(content)


def test_csv_folder_gives_the_same_rows_as_the_archive(spark, tmp_path):
    files = {f"{s}.csv": station_file({"STATION": f"0{s}"}, {"STATION": f"0{s}", "TEMP": "9999.9"})
             for s in range(5)}
    write_archive(tmp_path / "packed" / "2024.tar.gz", files)
    for name, content in files.items():
        write_csv(tmp_path / "open files" / "2024", name, content)
    packed = archive.read_archives(spark, str(tmp_path / "packed"))
    unpacked = station_csv.read_station_csv(spark, str(tmp_path / "open files"))
    assert unpacked.count() == 10
    assert ingest.to_observations(packed).exceptAll(ingest.to_observations(unpacked)).isEmpty()


@pytest.mark.parametrize("broadcast_bytes", ["-1", "10485760"])
def test_csv_files_with_different_headers(spark, tmp_path, request, broadcast_bytes):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, broadcast_bytes)
    request.addfinalizer(lambda: spark.conf.unset(threshold))
    swapped = [c for c in reversed(HEADER) if c != "WDSP"]
    write_csv(tmp_path / "2024", "a b.csv", station_file({"STATION": "a"}))
    write_csv(tmp_path / "2024", "b.csv", station_file({"STATION": "b"}, header=swapped))
    write_csv(tmp_path / "2023", "c.csv",
              "﻿".encode() + station_file({"STATION": "c"}).replace(b"\n", b"\r\n"))
    write_csv(tmp_path / "2023", "empty.csv", b"")
    write_csv(tmp_path / "2023", "notes.txt", b"x,y\n1,2\n")
    rows = ingest.to_observations(station_csv.read_station_csv(spark, str(tmp_path)))
    got = {r["station"]: r.asDict() for r in rows.collect()}
    assert sorted(got) == ["a", "b", "c"]
    assert [got[s]["year"] for s in "abc"] == [2024, 2024, 2023]
    assert [got[s]["wdsp_kn"] for s in "abc"] == [2.5, None, 2.5]
    for s in "abc":
        assert got[s]["name"] == DAY["NAME"] and got[s]["temp_f"] == 51.7
        assert flags_of(got[s]) == ["rain_drizzle", "thunder"]


def test_csv_blank_lines_before_a_header_and_line_breaks_in_fields(spark, tmp_path):
    swapped = [c for c in reversed(HEADER) if c != "WDSP"]
    name = 'A "B"\nC, NO'
    write_csv(tmp_path / "2024", "a.csv", b"\n\n" + station_file({"STATION": "a", "NAME": name}))
    write_csv(tmp_path / "2024", "d.csv",
              (b"\n" + station_file({"STATION": "d"})).replace(b"\n", b"\r\n"))
    write_csv(tmp_path / "2024", "b.csv", station_file({"STATION": "b"}, header=swapped))
    write_csv(tmp_path / "2024", "c.csv", station_file(
        {"STATION": "c"}, header=[*HEADER, "STATION"]))
    rows = ingest.to_observations(station_csv.read_station_csv(spark, str(tmp_path)))
    assert {r["station"]: r["name"] for r in rows.collect()} == {
        "a": name, "b": DAY["NAME"], "c": DAY["NAME"], "d": DAY["NAME"]}


def test_csv_blank_lines_that_would_hide_a_header(spark, tmp_path):
    write_csv(tmp_path / "2024", "mixed.csv", b"\n\r\n" + station_file({"STATION": "a"}))
    with pytest.raises(Exception, match="mixed.csv"):
        station_csv.read_station_csv(spark, str(tmp_path))
    rows = station_csv.read_station_csv(spark, str(tmp_path), line_breaks_in_fields=False)
    assert [r["STATION"] for r in rows.collect()] == ["a"]


def test_csv_headers_are_read_once(spark, tmp_path):
    for s in range(3):
        write_csv(tmp_path / "2024", f"{s}.csv", station_file({}, header=HEADER[s:]))
    rows = station_csv.read_station_csv(spark, str(tmp_path))
    out = io.StringIO()
    with redirect_stdout(out):
        rows.explain()
    assert "MapInPandas" not in out.getvalue() and rows.count() == 3


def test_headers_quoted_differently_are_one_layout(spark, tmp_path):
    content = station_file({})
    header, body = content.split(b"\n", 1)
    write_csv(tmp_path / "2024", "a.csv", content)
    write_csv(tmp_path / "2024", "b.csv", header.replace(b'"', b"") + b"\n" + body)
    rows = station_csv.read_station_csv(spark, str(tmp_path))
    assert rows.distinct().count() == 1 and rows.count() == 2
    out = io.StringIO()
    with redirect_stdout(out):
        rows.explain()
    assert "Join" not in out.getvalue()


def test_csv_short_rows_and_bad_bytes(spark, tmp_path):
    text = station_file({"NAME": "X"}).replace(b'"X"', b'"\xff, NO"') + b'"9","2024-01-03"\n'
    write_csv(tmp_path / "2024", "a.csv", text)
    long_row, short_row = ingest.to_observations(
        station_csv.read_station_csv(spark, str(tmp_path))).orderBy("date").collect()
    assert long_row["name"] == "�, NO"
    assert short_row["station"] == "9" and short_row["name"] == "" and not short_row["fog"]


def test_csv_folder_without_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        station_csv.read_station_csv(spark, str(tmp_path))


def test_three_flag_encodings_agree(spark):
    rows = spark.createDataFrame([("101010",), ("000001",), ("",)], "FRSHTT string")
    packed = rows.select(*ingest.flag_columns("packed"))
    text = packed.select(*[F.col(f).cast("int").cast("string").alias(f) for f in EVENT_FLAGS])
    expected = packed.collect()
    assert text.select(*ingest.flag_columns("text")).collect() == expected
    assert packed.select(*ingest.flag_columns("boolean")).collect() == expected
    missing = spark.createDataFrame([(None,)], "fog boolean")
    assert only(missing.select(ingest.flag_as_boolean(F.col("fog"), "boolean").alias("f"))) == {
        "f": False}


def test_small_expressions(spark):
    one = spark.range(1)
    got = only(one.select(
        tail_code(F.lit("  OSLO, NO ")).alias("code"),
        percent(F.lit(3), F.lit(4), 2).alias("pct"),
        percent(F.lit(3), F.lit(0), 2).alias("undefined"),
        scan_price(F.lit(float(1 << 40)), 6.25).alias("whole"),
        scan_price(F.lit(float(1 << 39)), 6.25).alias("half"),
        scan_price(F.lit(0.0), 6.25).alias("free"),
    ))
    assert got == {"code": "NO", "pct": 75.0, "undefined": None, "whole": 6.25, "half": 3.125,
                   "free": 0.0}


# ------------------------------------------------- both readers of archive members

PIECES = [b",", b",", b'"', b'""', b"\n", b"\r\n", b"\r", b"A", b"B", b"x", b" ", b"\xef\xbb\xbf",
          b"\x00", b"\xff", "é".encode(), b"NA", b"'", b"\\"]
FIELDS = st.sampled_from([b"x", b"", b'"q,r"', b'"a""b"', b'"l\nm"', b" y ", b"1.5", b"\xff"])
BEFORE = st.lists(
    st.sampled_from([b",,\n", b"\n", b'"",""\n', b"\r\n", b"\xef\xbb\xbf", b",\r\n"]), max_size=3
)
HEADERS = st.sampled_from(
    [b"A,B,C\n", b'"A","B"\r\n', b"B,A,B\n", b"A\n", b"C,Z,Q\n", b'"A\nx",B\n', b"x\n", b""]
)


@st.composite
def member_bytes(draw):
    content = b"".join(draw(BEFORE)) + (header := draw(HEADERS))
    for _ in range(draw(st.integers(0, 4))):
        fields = [draw(FIELDS) for _ in range(header.count(b",") + 1)]
        content += b",".join(fields) + draw(st.sampled_from([b"\n", b"\r\n", b"\n\n", b""]))
    return content + b"".join(draw(st.lists(st.sampled_from(PIECES), max_size=6)))


@given(member_bytes())
@settings(max_examples=3000, deadline=None)
def test_both_readers_of_members_give_the_same_rows(content):
    columns = ["A", "B", "C", "Z"]
    table = archive.regular_table(content, columns)
    if table is not None:
        expected = list(archive.member_records(archive.as_text(io.BytesIO(content)), columns))
        assert list(zip(*(table.column(c).to_pylist() for c in columns))) == expected


@pytest.mark.parametrize("before", [b"", b",,\n", b'"","",""\r\n', b"\n", b"\xef\xbb\xbf", b"\xef\xbb\xbf,\n\r\n"])
@pytest.mark.parametrize("header", [HEADER, HEADER[::-1], ["TEMP", *HEADER]])
def test_no_size_of_member_changes_its_rows(spark, tmp_path, monkeypatch, before, header):
    days = [{"STATION": f"s{i}", "TEMP": f" {i}.5"} for i in range(200)]
    content = before + station_file(*days, header=header)
    found = []
    for few, whole in ((0, 1 << 26), (1 << 26, 1 << 26), (0, 0)):
        monkeypatch.setattr(archive, "FEW_LINES_BYTES", few)
        monkeypatch.setattr(archive, "WHOLE_MEMBER_BYTES", whole)
        archived = write_archive(tmp_path / f"{few}-{whole}" / "2024.tar.gz", {"a.csv": content})
        with tarfile.open(archived) as opened:
            tables = archive.member_tables(opened, opened.getmembers(), ["STATION", "TEMP", "NAME"])
            found.append([r for t in tables for r in t.to_pylist()])
    assert found[0] == found[1] == found[2]
    assert [(r["STATION"], r["TEMP"]) for r in found[0]] == [(d["STATION"], d["TEMP"]) for d in days]
    # the usual size does go through the fast reader
    assert archive.regular_table(content, ["STATION"]).num_rows == 200
