"""WARC archives of pages, and their capture histories by an external merge of index runs.

Pages are written as WARC/1.1 files of a bounded number of records, with payloads that repeat as revisit records. Each
archive read back, record by record, gives an index run sorted by URL key and timestamp; runs are written out. Spark deals
them out by ranges of that order, each of about `range_rows` rows however many there are, and hands each range the runs'
stretches one after the other, in their own order. The range merges them with a loser tree, so that the ranges in turn are
the ordered history of all captures. A range ends anywhere among equal keys, so that no URL fills a task.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import shared_folder, written
from tidewire.llm.url_filter import host_of

_END = "\r\n\r\n"
_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")
INDEX = "url_key string, captured string, page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, archive string, position long"
_COLUMNS = [c.split(" ")[0] for c in INDEX.split(", ")]


def url_key(url: Column) -> Column:
    """Host labels from last to first, then path and query: captures of a host, and of its subdomains, lie together."""
    after = F.substr(url, F.length(F.substring_index(url, "://", 1)) + 4)
    path = F.regexp_extract(after, r"^[^/?#]*([^#]*)", 1)
    return F.when(
        F.contains(url, F.lit("://")), F.concat(F.array_join(F.reverse(F.split(host_of(url), r"\.")), ","), F.lit(")"), path)
    ).otherwise(F.coalesce(url, F.lit("")))


def base32(digest: Column) -> Column:
    """Upper-case base32 of a 20-byte digest given in hex."""
    bits = F.concat(*(F.lpad(F.conv(F.substring(digest, i, 10), 16, 2), 40, "0") for i in range(1, 41, 10)))
    letter = lambda i: F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.conv(F.substr(bits, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def _one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x1f\x7f]", " ")


def _records(pages: DataFrame) -> DataFrame:
    """The text of a WARC record for each page; revisits carry the HTTP head alone."""
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(_END))
    block = F.concat(head, F.when(F.col("refers_to").isNull(), F.col("html")).otherwise(""))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce("page_id", F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.col("captured")),
        F.concat(F.lit("WARC-Target-URI: "), _one_line(F.coalesce("url", F.lit("")))),
        F.concat(F.lit("WARC-Target-Key: "), _one_line(F.col("url_key"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to"), F.lit(">"))),
        F.when(F.col("refers_to").isNotNull(), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return pages.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(_END), block).alias("value"))


def write_archives(
    pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, records: int = 1000
) -> None:
    """Write a record per row under path, gzipped, at most `records` to a file.

    Rows with equal payloads of at least least_bytes bytes share one response, that of the smallest id; the others are
    revisits of it. A null html is empty. Rows with a null id are responses, and so are rows that repeat the response's id.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    ).withColumn("sha1", F.unhex(F.sha1(F.col("html").cast("binary"))))
    first = rows.where(f"id is not null and octet_length(html) >= {least_bytes}").groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    first = written(first.where("n > 1").select("sha1", "first"), "first-captures")
    captured = F.date_format(F.timestamp_seconds(F.lit(946684800) + F.pmod(F.coalesce("id", F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    refers = F.when((F.col("id") != F.col("first")) & (F.octet_length("html") >= least_bytes), F.col("first").cast("string"))
    rows = rows.join(first, "sha1", "left").select(
        F.col("id").cast("string").alias("page_id"), "url", "html", captured.alias("captured"), base32(F.hex("sha1")).alias("payload_digest"),
        url_key(F.col("url")).alias("url_key"), refers.alias("refers_to"),
    )
    # Records end with two line ends; the writer puts them between and after its rows.
    _records(rows).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def unpacked(data: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """A gzip file's content in pieces of bounded size; members may follow each other."""
    stream = None
    for i in range(0, len(data), 1 << 16):
        chunk = data[i : i + (1 << 16)]
        while chunk:
            stream = stream or zlib.decompressobj(wbits=31)
            if piece := stream.decompress(chunk, most):
                yield piece
            chunk, stream = (stream.unused_data, None) if stream.eof else (stream.unconsumed_tail, stream)
    while stream and not stream.eof:
        piece = stream.decompress(b"", most)
        if not piece and not stream.eof:
            raise ValueError("archive is cut off")
        yield piece


def parse_archive(pieces: Iterable[bytes]) -> Iterator[tuple[int, dict[bytes, bytes], bytes]]:
    """Position, headers and payload of each record of a WARC file, one record held at a time; ValueError where it is broken."""
    rest, at, source = bytearray(), 0, iter(pieces)

    def more() -> None:
        piece = next(source, None)
        if piece is None:
            raise ValueError(f"record at {at} is cut off")
        rest.extend(piece)

    while True:
        while not rest:
            piece = next(source, None)
            if piece is None:
                return
            rest.extend(piece)
        while (end := rest.find(b"\r\n\r\n")) < 0:
            more()
        if not rest.startswith(b"WARC/1.1\r\n"):
            raise ValueError(f"no record at {at}")
        headers = {bytes(k).lower(): bytes(v) for k, v in _HEADER.findall(rest[10 : end + 2])}
        size = int(headers[b"content-length"])
        while len(rest) < end + 8 + size:
            more()
        block = bytes(rest[end + 4 : end + 4 + size])
        if rest[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at {at} is cut off")
        head, _, payload = block.partition(b"\r\n\r\n")
        headers[b"http-length"] = next((v for k, v in _HEADER.findall(head) if k.lower() == b"content-length"), b"0")
        yield at, headers, payload
        at += end + 8 + size
        del rest[: end + 8 + size]


def loser_tree(runs: list[list[tuple]]) -> Iterator[tuple]:
    """The rows of sorted runs in order: inner nodes keep the loser of each match, the winner goes on to the root."""
    k = len(runs)
    if not k:
        return
    places = [0] * k
    heads: list[tuple | None] = [r[0] if r else None for r in runs]

    def before(a: int, b: int) -> bool:
        if heads[a] is None or heads[b] is None:
            return heads[b] is None and (heads[a] is not None or a < b)
        return (heads[a], a) < (heads[b], b)

    losers = [-1] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        winner, losers[node] = (a, b) if before(a, b) else (b, a)
        return winner

    winner = play(1) if k > 1 else 0
    while heads[winner] is not None:
        yield heads[winner]
        places[winner] += 1
        run = runs[winner]
        heads[winner] = run[places[winner]] if places[winner] < len(run) else None
        node = (winner + k) // 2
        while node:
            if not before(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node //= 2


def index_runs(df: DataFrame) -> DataFrame:
    """An index row for each record of binary files (path, content), sorted within each file by URL key and time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip = lambda v: None if v is None else v.decode()[len("<urn:page:") : -1]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for at, headers, payload in parse_archive(unpacked(content.as_py())):
                    kind = headers[b"warc-type"].decode()
                    digest = headers[b"warc-payload-digest"].decode().removeprefix("sha1:")
                    size = int(headers[b"http-length"])
                    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"payload at {at} of {path} does not match its digest")
                    key, date = headers[b"warc-target-key"].decode(), headers[b"warc-date"].decode()
                    rows.append((key, date, strip(headers[b"warc-record-id"]), size, digest, kind, strip(headers.get(b"warc-refers-to")), path, at))
                rows.sort(key=lambda r: (r[0].encode(), r[1], r[8]))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i in (3, 8) else pa.string()) for i in range(9)], _COLUMNS)

    return df.mapInArrow(read, INDEX)


def merged(runs: DataFrame, range_rows: int = 100_000) -> DataFrame:
    """All index rows in order of URL key, timestamp and position, in ranges that follow each other by partition.

    runs holds each archive's rows; a range has about range_rows of them, which is what a task holds.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches: list[list[tuple]] = []
        archive = None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(9)]
            for row in zip(*columns, strict=True):
                if row[7] != archive:
                    archive = row[7]
                    stretches.append([])
                stretches[-1].append(((row[0].encode(), row[1], row[7], row[8]), row))
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i in (3, 8) else pa.string()) for i in range(9)], _COLUMNS)

        for _, row in loser_tree(stretches):
            rows.append(row)
            if len(rows) >= 10_000:
                yield out()
                rows = []
        yield out()

    ranges = max(1, -(-runs.count() // range_rows))
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", "archive", "position")
    return dealt.sortWithinPartitions("archive", "url_key", "captured", "position").mapInArrow(merge, INDEX)


def capture_history(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write pages as archives in the shared folder, read them back, and return their index in order.

    Columns: url_key, captured, page_id (as text; empty for null), payload_bytes and payload_digest of the full payload,
    record_type, refers_to (the response's page_id for revisits), archive and position. Responses are read back and
    checked against length and digest. A null html is empty; a null url has an empty key; repeated rows have a record
    each. An empty table gives no rows. Other columns are ignored. Times follow from ids: pages have none.
    """
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(pages, path, id_col=id_col, url_col=url_col, html_col=html_col, least_bytes=least_bytes)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return merged(written(index_runs(files), "index-runs"))
