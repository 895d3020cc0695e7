"""WARC archives with revisit records and a merged capture index (operator 7).

Writing: of records with equal payloads of at least REVISIT_BYTES the one with the largest page_id is a
`response`; the others are `revisit` records without the payload. A record ends with CR LF CR LF, which
is just the line separator of Spark's text writer: each row is one record, each file a WARC file, and
Spark's commit protocol keeps half-written files of lost executors out.

Reading: every file is parsed by Content-Length, payload digests are checked, and its captures become a
run sorted by (URL key, timestamp, page_id). The runs are dealt out by ranges of that key, and each
range is merged from its runs by a loser tree. So the index is in global order, however hot one URL is.

Defined results: null html is an empty payload; null url has an empty key and no target header; a null
page_id comes after all others. Pages with equal or null ids are records of their own; of equal
payloads with equal page_ids the first one read is the response. Other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, new_folder, numbered
from .url_filters import split_url

REVISIT_BYTES = 1000
#: Most records in one file.
RECORDS_PER_FILE = 4000
#: Pages have no capture time; theirs is so many seconds after this moment as their id says.
FIRST_CAPTURE = 1_704_067_200
_END = "\r\n\r\n"
_INDEX = (
    "url_key string, captured_at string, page_id long, file string, at long, payload_bytes long, "
    "payload_digest string, record_type string, refers_to long"
)


def url_key(url: Column) -> Column:
    """Labels of the host in reverse, then `)`, then what follows the host."""
    host, _ = split_url(url)
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), lower_ascii(rest))


def header_value(text: Column) -> Column:
    """A value on one line of a header: control characters percent-encoded."""
    return F.regexp_replace(F.regexp_replace(text, "\r", "%0D"), "\n", "%0A")


def with_types(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) → the same with row, digest, payload_bytes, record_type, refers_to."""
    body = F.coalesce("html", F.lit(""))
    rows = numbered(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("html")), "row")
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long"))
    place = F.struct(F.col("page_id").isNotNull(), "page_id", -F.col("row"))
    best = (
        rows.where(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy("digest", "payload_bytes")
        .agg(F.max(place).alias("best"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "payload_bytes", F.col("best.page_id").alias("keep_id"), (-F.col("best.col3")).alias("keep"))
    )
    again = F.col("keep").isNotNull() & (F.col("keep") != F.col("row"))
    return rows.join(best, ["digest", "payload_bytes"], "left").select(
        "row",
        "page_id",
        "url",
        F.when(again, F.lit("")).otherwise(F.col("html")).alias("html"),
        "digest",
        "payload_bytes",
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(again, F.col("keep_id")).alias("refers_to"),
    )


def as_record(typed: DataFrame) -> Column:
    """A whole record but for its closing line ends."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    given = lambda name, value: F.when(value.isNotNull(), line(name, value)).otherwise(F.lit(""))
    second = (F.lit(FIRST_CAPTURE) + F.coalesce("page_id", F.lit(0)) % F.lit(3_000_000_000)).cast("timestamp")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:capture:"), F.col("row").cast("string"), F.lit(">"))),
        given("WARC-Target-URI", header_value(F.col("url"))),
        given("Capture-Key", header_value(url_key(F.col("url")))),
        line("WARC-Date", F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        given("Page-ID", F.col("page_id").cast("string")),
        line("Payload-Length", F.col("payload_bytes").cast("string")),
        given("Refers-To-Page", F.col("refers_to").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length("html").cast("string")),
        F.lit("\r\n"),
        F.col("html"),
    )


def write_archives(pages: DataFrame, folder: str) -> None:
    """One record per page, in gzipped WARC files below `folder`."""
    typed = with_types(pages)
    writer = typed.select(as_record(typed).alias("record")).write.option("lineSep", _END)
    writer.option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records of a file."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        stop = start + int(headers["Content-Length"])
        if content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} has another length than it says")
        yield at, headers, content[start:stop]
        at = stop + 4


def capture(file: str, at: int, headers: dict[str, str], block: bytes) -> tuple:
    """A row of the index. The payload of a response is measured and held against its digest."""
    digest, length = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["Payload-Length"])
    if headers["WARC-Type"] == "response":
        if hashlib.sha1(block).hexdigest() != digest or len(block) != length:
            raise ValueError(f"{file}: payload at byte {at} does not match its digest")
    number = lambda name: int(headers[name]) if name in headers else None
    return (
        headers.get("Capture-Key", ")"),
        headers["WARC-Date"],
        number("Page-ID"),
        file,
        at,
        length,
        digest,
        headers["WARC-Type"],
        number("Refers-To-Page"),
    )


def order_of(row: tuple) -> tuple:
    """Place in the index: URL key, timestamp, page_id (null last), then file and offset."""
    return row[0].encode(), row[1], row[2] is None, row[2] or 0, row[3], row[4]


def read_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The captures of each file as a sorted run."""
    for batch in batches:
        for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            raw = content.as_py()
            body = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
            run = sorted((capture(file, *found) for found in records(body)), key=order_of)
            if run:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*run), _types())], names=_names())


def _names() -> list[str]:
    return [x.split()[0] for x in _INDEX.split(", ")]


def _types() -> list[pa.DataType]:
    return [pa.int64() if x.endswith("long") else pa.string() for x in _INDEX.split(", ")]


def loser_tree(runs: list[Iterator], key: Callable) -> Iterator:
    """k-way merge of sorted runs: inner nodes hold the loser of the match below, the winner stands above."""
    k = len(runs)
    heads: list = []
    for run in runs:
        first = next(run, None)
        heads.append(None if first is None else (key(first), first))

    def beats(a: int, b: int) -> bool:
        if heads[a] is None or heads[b] is None:
            return heads[b] is None and heads[a] is not None
        return heads[a][0] < heads[b][0] or (heads[a][0] == heads[b][0] and a < b)

    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    while k and heads[best] is not None:
        yield heads[best][1]
        following = next(runs[best], None)
        heads[best] = None if following is None else (key(following), following)
        node = (best + k) // 2
        while node >= 1:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The captures of one range of keys, merged from the pieces of the runs that reach into it."""
    whole = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if whole is None or not whole.num_rows:
        return
    pieces: dict[str, list[int]] = {}
    for place, file in enumerate(whole.column("file").to_pylist()):
        pieces.setdefault(file, []).append(place)

    def run(places: list[int]) -> Iterator[tuple]:
        rows = whole.take(places)
        rows = list(zip(*(c.to_pylist() for c in rows.columns)))
        rows.sort(key=order_of)  # already sorted but for the order in which shuffle blocks arrived
        return iter(rows)

    held = []
    for row in loser_tree([run(p) for p in pieces.values()], order_of):
        held.append(row)
        if len(held) == 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _types())], names=_names())
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _types())], names=_names())


def read_index(spark, folder: str) -> DataFrame:
    """The captures of all WARC files below `folder`, in global order of URL key, timestamp and page_id."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    runs = files.mapInArrow(read_run, _INDEX)
    dealt = runs.repartitionByRange("url_key", "captured_at", "page_id", "file", "at")
    return dealt.mapInArrow(merged, _INDEX)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the archives, read them back; the capture index as a DataFrame."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    write_archives(pages, folder)
    return read_index(spark, folder)
