"""Archives: exact round trip, selected records through the index, damage."""

from __future__ import annotations

import gzip
import hashlib
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from stayrate.llm import archive
from stayrate.session import work_path

BIG, OTHER = "é" * 60 + "\r\n\r\nWARC/1.1\r\n", "<html>" + "x" * 300_000 + "</html>"
PAGES = [
    (5, "http://a/", BIG),
    (3, "http://b/\r\nX: y", BIG),
    (9, None, BIG),
    (1, "http://c/", "short"),
    (2, "http://d/", "short"),
    (4, "http://e/", None),
    (6, "", ""),
    (None, "http://f/", BIG),
    (7, "http://g/", OTHER),
    (8, "http://h/", "z" * 99),
    (10, "http://i/", "z" * 99),
    (11, "http://j/", "y" * 100),
    (12, "http://k/", "y" * 100),
    (12, "http://k/", "y" * 100),
    (11, "http://j/", "y" * 100),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, 1, "d") for p in PAGES], "page_id long, url string, html string, length int, digest string")


def test_round_trip_equals_brute_force(pages):
    bodies = [(i, (h or "").encode()) for i, _, h in PAGES]
    first = {}
    for i, b in bodies:
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    wanted = []
    for i, b in bodies:
        again = b in first and (i is None or first[b] < i)
        wanted.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    got = [tuple(r) for r in archive.archive_round_trip(pages).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)


def test_selected_records_come_back_whole(spark, pages):
    folder = work_path(spark, "warc")
    index = archive.write_archives(pages.repartition(3), folder, file_bytes=400)
    assert index.select("file").distinct().count() > 3
    some = archive.read_records(index.where(F.col("record_id").isin("3", "7", "4")), folder, gap_bytes=10, range_bytes=1000)
    got = {r["record_id"]: r for r in some.collect()}
    assert {i: bytes(r["payload"]).decode() for i, r in got.items()} == {"3": BIG, "7": OTHER, "4": ""}
    assert got["3"]["url"] == "http://b/%0D%0AX: y"
    path = Path(urlparse(folder).path)
    rows = index.collect()
    for row in rows:  # the file is a sequence of gzip members at the offsets of the index
        data = (path / row["file"]).read_bytes()[row["offset"] : row["offset"] + row["length"]]
        text = gzip.decompress(data)
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
    for name in {r["file"] for r in rows}:
        own = sorted((r["offset"], r["length"]) for r in rows if r["file"] == name)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
        assert sum(own[-1]) == (path / name).stat().st_size


def test_ranges_join_what_lies_close(spark):
    rows = [("f", 0, 10), ("f", 10, 10), ("f", 25, 5), ("f", 200, 10), ("f", 990, 20), ("f", 1010, 5), ("g", 0, 7)]
    index = spark.createDataFrame(rows, "file string, offset long, length long")
    got = sorted((r["file"], r["low"], r["high"], len(r["records"])) for r in archive.ranges(index, 50, 1000).collect())
    assert got == [("f", 0, 30, 3), ("f", 200, 210, 1), ("f", 990, 1010, 1), ("f", 1010, 1015, 1), ("g", 0, 7, 1)]


def test_damage_is_an_error():
    data = archive.record("1", "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert archive.parse(data)["payload"] == b"payload"
    with pytest.raises(ValueError, match="damaged"):
        archive.parse(data.replace(b"payload", b"paXload"))


def test_empty_table(spark, pages):
    assert archive.archive_round_trip(pages.where("false")).collect() == []
