"""Ranges of CSV files: the same rows whatever the ranges are."""

from __future__ import annotations

import csv
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stationdays.sources import archive, csv_ranges

FIELD = st.text(alphabet=st.sampled_from('ab, "\n\r'), max_size=5)


def parts_of(content: bytes, size: int) -> list[bytes]:
    """The file cut as the two passes cut it, for one file and in plain Python."""
    scans = [
        csv_ranges.scan_range(iter([content[i : i + size]])) for i in range(0, len(content), size)
    ]
    starts, quotes = [0], 0
    for i, (n, first, _) in enumerate(scans):
        place = first[quotes % 2]
        if i and place is not None and i * size + place < len(content):
            starts.append(i * size + place)
        quotes += n
    assert not any(stray for _, _, stray in scans) and quotes % 2 == 0
    return [content[a:b] for a, b in zip(starts, [*starts[1:], len(content)])]


@given(st.lists(st.lists(FIELD, min_size=2, max_size=2), max_size=12), st.integers(1, 40))
@settings(max_examples=300, deadline=None)
def test_parts_hold_whole_records(records, size):
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows(records)
    content = text.getvalue().encode()
    found = [
        r for part in parts_of(content, size)
        for r in csv.reader(io.StringIO(part.decode(), newline=""))
    ]
    assert found == list(csv.reader(io.StringIO(text.getvalue(), newline="")))


def test_blocks_of_a_range_count_together():
    content = b'a,"b\n""c"\nd,e\n' * 20
    whole = csv_ranges.scan_range(iter([content]))
    for size in (1, 2, 7):
        blocks = (content[i : i + size] for i in range(0, len(content), size))
        assert csv_ranges.scan_range(blocks) == whole
    assert csv_ranges.scan_range(iter([b'x"y']))[2] and csv_ranges.scan_range(iter([b"x", b'"y']))[2]


HEADER = b'\xef\xbb\xbf,,\n"B","A","B"\n'


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "2024").mkdir()
    rows = "".join(f'"x{i}","a{i}\nmore, ""quoted""\r\nend",{i}\r\n' for i in range(3000))
    (tmp_path / "2024" / "large.csv").write_bytes(HEADER + rows.encode())
    (tmp_path / "2024" / "small.csv").write_bytes(b"A,C\n1,2\n")
    (tmp_path / "2024" / "empty.csv").write_bytes(b"")
    (tmp_path / "2024" / "header.csv").write_bytes(b"A,B\n")
    # quotes as data, bytes that are no text, records that end early
    odd = b"A,B\n" + b'5" pipe,6" pipe\nx\n\xff,"q"\n' * 300
    (tmp_path / "2024" / "odd.csv").write_bytes(odd)
    return tmp_path


@pytest.mark.parametrize("range_bytes", [64 << 20, 10_000, 777])
def test_rows_of_ranges(spark, folder, range_bytes):
    got = csv_ranges.read_csv_by_ranges(
        spark, str(folder), columns=["A", "B", "D"], range_bytes=range_bytes
    )
    expected = []
    for file in sorted((folder / "2024").glob("*.csv")):
        stream = archive.as_text(io.BytesIO(file.read_bytes()))
        expected += [(*r, 2024) for r in archive.member_records(stream, ["A", "B", "D"])]
    def order(row):
        return tuple(str(v) for v in row)

    assert sorted(map(tuple, got.collect()), key=order) == sorted(expected, key=order)


def test_a_large_file_is_many_tasks(spark, folder):
    files = spark.createDataFrame(
        [(f"file:{f}", f.stat().st_size) for f in (folder / "2024").glob("*.csv")],
        "path string, length long",
    )
    ranges = [r for r in csv_ranges.record_ranges(files, 10_000).collect()]
    large = sorted((r["start"], r["end"]) for r in ranges if r["path"].endswith("large.csv"))
    size = (folder / "2024" / "large.csv").stat().st_size
    assert len(large) >= size // 10_000 - 1
    assert large[0][0] == 0 and large[-1][1] == size
    assert all(a[1] == b[0] for a, b in zip(large, large[1:]))
    assert max(b - a for a, b in large) < 2 * 10_000
    assert [(r["start"]) for r in ranges if r["path"].endswith("odd.csv")] == [0]


def test_ranges_too_large_to_hold_are_read_record_by_record(folder, monkeypatch):
    path = str(folder / "2024" / "large.csv")
    size = (folder / "2024" / "large.csv").stat().st_size
    whole = [t.to_pylist() for t in csv_ranges.range_tables(path, 0, size, ["A", "B"])]
    monkeypatch.setattr(archive, "WHOLE_MEMBER_BYTES", 10)
    monkeypatch.setattr(csv_ranges, "BLOCK_BYTES", 100)
    slow = [t.to_pylist() for t in csv_ranges.range_tables(path, 0, size, ["A", "B"])]
    assert [r for t in slow for r in t] == [r for t in whole for r in t]
    assert sum(map(len, whole)) == 3000
