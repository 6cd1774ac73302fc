"""WARC archives read through their index.

Each task writes its pages as one archive file in the shared folder, every record a gzip
member of its own, and returns an index row per record: file, offset, length, URL and
digest. The index is the commit record: files of a task attempt that failed are named by
no row of it. To read, the selected index rows are sorted by file and offset, ranges that
lie close together are joined to one read, and every record is cut out of its range and
checked against its digest. Files are opened with ``pyarrow.fs``, which knows the shared
folder by its URI.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayrate.session import spread, stage, work_path

LEAST_REVISIT = 100
RANGE_BYTES = 4 << 20
GAP_BYTES = 64 << 10
FILE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, record_id string, url string, digest string, type string"
BREAK = b"\r\n\r\n"


def _line(text: str) -> str:
    """A header value on one line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text)


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str = DATE) -> bytes:
    """One response record, or a revisit record without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}".encode() + BREAK
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{_line(page_id or '')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_line(url or '')}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <urn:page:{_line(refers_to)}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + BREAK + block + BREAK


def parse(data: bytes) -> dict:
    """Headers, HTTP headers and payload of one record; the payload is checked."""
    head, _, rest = data.partition(BREAK)
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(BREAK)
    sent = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    name = lambda key: fields[key].removeprefix("<urn:page:").removesuffix(">") if key in fields else None
    return {
        "record_id": name("WARC-Record-ID") or None,
        "url": fields["WARC-Target-URI"],
        "type": fields["WARC-Type"],
        "digest": digest,
        "payload_bytes": int(sent["Content-Length"]),
        "refers_to": name("WARC-Refers-To"),
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def _packed(data: bytes) -> bytes:
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def first_of_copies(pages: DataFrame, id_col: str, html_col: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Digests of payloads stored more than once and the smallest id: (digest, first_id)."""
    facts = pages.select(F.sha2(F.coalesce(F.col(html_col), F.lit("")), 256).alias("__digest"), F.col(id_col).alias("__id"), F.octet_length(html_col).alias("__n"))
    copies = facts.where(F.col("__n") >= least).groupBy("__digest").agg(F.min("__id").alias("__first"), F.count("*").alias("__copies"))
    return stage(copies.where("__copies > 1").select("__digest", "__first"), "copies")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write every page as a record under ``folder``; return the index, stored as Parquet.

    Of pages with equal payloads of at least ``least`` bytes those with the smallest id
    are responses and the others revisit it; a NULL id comes last. NULL html is empty.
    """
    digest = F.sha2(F.coalesce(F.col(html_col), F.lit("")), 256)
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("__url"), F.coalesce(F.col(html_col), F.lit("")).alias("__html"), digest.alias("__digest"))
    later = (F.col("__first") < F.col("__id")) | (F.col("__first").isNotNull() & F.col("__id").isNull())
    marked = rows.join(first_of_copies(pages, id_col, html_col, least), "__digest", "left").select(
        F.col("__id").cast("string").alias("id"), F.col("__url").alias("url"), F.col("__html").alias("html"), F.col("__digest").alias("digest"),
        F.when(later, F.col("__first").cast("string")).alias("refers_to"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, sink, at = "", None, 0
        for batch in batches:
            found = []
            html = batch.column("html").cast(pa.binary())
            others = [batch.column(c) for c in ("id", "url", "digest", "refers_to")]
            for row in range(batch.num_rows):
                page_id, url, own, refers_to = (c[row].as_py() for c in others)
                if sink is None or at >= file_bytes:
                    if sink is not None:
                        sink.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    sink = store.open_output_stream(f"{root}/{name}", compression=None)
                data = _packed(record(page_id, url, html[row].as_py(), own, refers_to))
                sink.write(data)
                found.append((name, at, len(data), page_id, url, own, "response" if refers_to is None else "revisit"))
                at += len(data)
            names = [x.split()[0] for x in INDEX.split(", ")]
            types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4]
            columns = list(zip(*found)) if found else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
        if sink is not None:
            sink.close()

    return stage(marked.mapInArrow(run, INDEX), "warc-index")


def ranges(index: DataFrame, gap_bytes: int = GAP_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Selected records as joined byte ranges: (file, low, high, records).

    A range ends where the next record starts more than ``gap_bytes`` later or in another
    stretch of ``range_bytes``, so it stays below that and one record.
    """
    by_place = Window.partitionBy("file").orderBy("offset")
    end = F.lag(F.col("offset") + F.col("length")).over(by_place)
    stretch = F.floor(F.col("offset") / range_bytes)
    fresh = end.isNull() | (F.col("offset") - end > gap_bytes) | (stretch != F.lag(stretch).over(by_place))
    numbered = index.withColumn("__fresh", fresh.cast("int")).withColumn("__range", F.sum("__fresh").over(by_place))
    return numbered.groupBy("file", "__range").agg(
        F.min("offset").alias("low"),
        F.max(F.col("offset") + F.col("length")).alias("high"),
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"),
    )


def read_records(index: DataFrame, folder: str, payload: bool = True, gap_bytes: int = GAP_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the given index rows: record_id, url, type, digest, payload_bytes,
    refers_to and, if wanted, payload (NULL for revisits). A damaged record is an error."""
    kinds = {"record_id": "string", "url": "string", "type": "string", "digest": "string", "payload_bytes": "long", "refers_to": "string"}
    kinds |= {"payload": "binary"} if payload else {}
    arrow = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['file']}") as source:
                    data = source.read_at(row["high"] - row["low"], row["low"])
                cut = ((x["offset"] - row["low"], x["length"]) for x in row["records"])
                found = [parse(zlib.decompress(data[a : a + n], 31)) for a, n in cut]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], arrow[k]) for c, k in kinds.items()], list(kinds))

    wanted = spread(ranges(index, gap_bytes, range_bytes).drop("__range"), "file", "low")
    return wanted.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds.items()))


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages, read the archives back: page_id, payload_bytes, payload_digest,
    record_type, refers_to. Rows with one id and payload are each a response; a NULL id
    comes back as NULL; an empty table gives no rows; other columns are ignored."""
    folder = work_path(pages.sparkSession, "warc")
    index = write_archives(pages, folder, id_col, url_col, html_col)
    kind = pages.schema[id_col].dataType
    return read_records(index, folder, payload=False).select(
        F.col("record_id").cast(kind).alias(id_col),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


ROUND_TRIP_SQL = """
WITH facts AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT digest, min(page_id) AS first_id FROM facts WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, f.digest AS payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM facts f LEFT JOIN firsts s ON f.digest = s.digest AND n >= 100"""
