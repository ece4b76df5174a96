"""WARC archives as tables of chunks: written by Spark's text writer, read back as a stream of chunk rows.

An archive is a gzip file of one write task: WARC records one after the other, each a block of header lines and
a payload. A payload over ``CHUNK`` is written as segments (the format's
continuation records), so no row or record is larger than a chunk. A task reads a file as a stream of lines and yields a row for
each chunk, by record and chunk number, with the digest of the payload so far; a record's whole
payload is never put together. The last chunk's digest is the payload's, and is held against the one declared.

A payload of at least ``LEAST`` bytes that another record of a smaller page_id has too is a revisit of the smallest one: it
names that record and carries no payload.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.session import new_path

#: Payload bytes from which on equal payloads are revisits.
LEAST = 100
#: Characters of one chunk; a character has four bytes at most.
CHUNK = 1 << 18
#: Ways that the records of one payload are dealt out to find its first page.
SALTS = 16
_END = "\r\n"


def record_roles(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, payload_bytes, payload_digest, record_type and refers_to.

    First pages are found from digests only, counted before the shuffle. The pages of one payload are dealt out in
    ``SALTS`` ways for the join, so a payload that a third of all pages have isn't one task's.
    """
    payload = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", "url", payload.alias("payload")).withColumns({
        "payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2(F.col("payload").cast("binary"), 256),
        "_salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS))})
    twice = own.filter(F.col("payload_bytes") >= LEAST).groupBy("payload_digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select(
        "payload_digest", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return own.join(twice, ["payload_digest", "_salt"], "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def _urn(page: F.Column) -> F.Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def chunk_records(roles: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(record): the text of each WARC record, one row for each chunk of a payload."""
    sent = F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")
    count = F.greatest(F.lit(1), F.ceil(F.char_length("sent") / chunk)).cast("int")
    rows = roles.withColumn("sent", sent).withColumn("chunks", count).withColumn("no", F.explode(F.sequence(F.lit(1), F.col("chunks"))))
    rows = rows.withColumn("part", F.substring("sent", (F.col("no") - 1) * chunk + 1, F.lit(chunk)))
    first, split = F.col("no") == 1, F.col("chunks") > 1
    # A header value must stay on its line.
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")

    def line(name: str, value: F.Column, when: F.Column | None = None) -> F.Column:
        text = F.concat(F.lit(name + ": "), value.cast("string"))
        return text if when is None else F.when(when, text)

    head = F.concat_ws(
        _END, F.lit("WARC/1.1"),
        line("WARC-Type", F.when(first, F.col("record_type")).otherwise("continuation")),
        line("WARC-Record-ID", F.when(first, _urn(F.col("page_id"))).otherwise(
            F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.col("no"), F.lit(">")))),
        line("WARC-Target-URI", uri, first),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest")), first),
        line("X-Payload-Length", F.col("payload_bytes"), first),
        line("WARC-Refers-To", _urn(F.col("refers_to")), first & F.col("refers_to").isNotNull()),
        line("WARC-Segment-Number", F.col("no"), split),
        line("WARC-Segment-Origin-ID", _urn(F.col("page_id")), ~first),
        line("WARC-Segment-Total-Length", F.col("payload_bytes"), split & (F.col("no") == F.col("chunks"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        line("Content-Length", F.octet_length("part")))
    return rows.select(F.concat(head, F.lit(_END * 2), F.col("part"), F.lit(_END)).alias("record"))


def write_archives(pages: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Archives of all rows of ``pages`` in the folder ``path``, one from each task; a failed task's file is not kept.

    Null html is an empty payload, a null url an empty target. Chunks of a record follow each other within a file.
    """
    chunk_records(record_roles(pages), chunk).write.option("lineSep", _END).option("compression", "gzip").text(path)


class _Reader:
    """Turns the lines of archives, in order, into chunk rows."""

    def __init__(self) -> None:
        self.file: str | None = None
        self.head: dict[str, str] | None = None
        self.lines: list[str] = []
        self.left = -1
        self.state: dict[str, str] = {}
        self.digest = hashlib.sha256()
        self.no, self.bytes = 0, 0

    def line(self, file: str, value: bytes) -> dict | None:
        if file != self.file:
            self.end()
            self.file, self.head, self.left = file, None, -1
        if self.head is None:
            if not value:
                return None
            if not value.startswith(b"WARC/"):
                raise ValueError(f"{file}: a record should begin here, not {value[:40]!r}")
            self.head = {}
            return None
        if self.left < 0:
            if value:
                name, _, text = value.decode().partition(": ")
                self.head[name] = text
                return None
            self.left = int(self.head["Content-Length"])
            if self.head["WARC-Type"] != "continuation":
                self._whole()
                self.state, self.digest, self.no, self.bytes = self.head, hashlib.sha256(), 0, 0
            elif self.head["WARC-Segment-Origin-ID"] != self.state.get("WARC-Record-ID"):
                raise ValueError(f"{file}: a segment doesn't follow its record")
            self.first = True
            self.chunk = 0
            return None
        # A payload may hold line ends itself: they count as its bytes.
        if not self.first:
            self._take(_END.encode())
        self.first = False
        self._take(value)
        return self._closed() if self.left == 0 else None

    def end(self) -> None:
        """To be called after the last line of a file, which must not end inside a record."""
        if self.head is not None:
            raise ValueError(f"{self.file}: ends inside a record")
        self._whole()
        self.state = {}

    def _whole(self) -> None:
        if self.state.get("WARC-Type") == "response" and self.bytes < int(self.state["X-Payload-Length"]):
            raise ValueError(f"{self.file}: {self.state['WARC-Record-ID']} has a shorter payload than declared")

    def _take(self, value: bytes) -> None:
        if len(value) > self.left:
            raise ValueError(f"{self.file}: a payload is longer than declared")
        self.digest.update(value)
        self.left -= len(value)
        self.chunk += len(value)

    def _closed(self) -> dict:
        self.no += 1
        self.bytes += self.chunk
        own, self.head, self.left = self.state, None, -1
        declared = own["WARC-Payload-Digest"].removeprefix("sha256:")
        last = own["WARC-Type"] != "response" or self.bytes == int(own["X-Payload-Length"])
        if last and own["WARC-Type"] == "response" and self.digest.hexdigest() != declared:
            raise ValueError(f"{self.file}: {own['WARC-Record-ID']} has another payload than declared")
        refers = own.get("WARC-Refers-To")
        return {
            "page_id": _page(own["WARC-Record-ID"]), "chunk": self.no, "chunk_bytes": self.chunk, "digest": self.digest.hexdigest(),
            "last": last, "record_type": own["WARC-Type"], "payload_bytes": int(own["X-Payload-Length"]), "payload_digest": declared,
            "refers_to": _page(refers) if refers else None,
        }


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


CHUNK_ROW = pa.schema([("page_id", pa.int64()), ("chunk", pa.int32()), ("chunk_bytes", pa.int64()), ("digest", pa.string()),
                       ("last", pa.bool_()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                       ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of the archives in a folder: page_id, chunk (from 1), chunk_bytes, digest of the payload so far, last, and
    the record's record_type, payload_bytes, payload_digest, refers_to. An empty payload is one chunk of no bytes.

    A gzip file is not split, so a task has its lines in order. A payload that isn't what its record declares stops the job.
    """
    lines = spark.read.option("lineSep", _END).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            rows = []
            for file, value in zip(batch.column("file").to_pylist(), batch.column("value"), strict=True):
                if row := reader.line(file, value.as_py()):
                    rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, CHUNK_ROW)
        reader.end()

    return lines.mapInArrow(run, "page_id long, chunk int, chunk_bytes long, digest string, last boolean, record_type string, "
                                 "payload_bytes long, payload_digest string, refers_to long")


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record, as read back from archives written to ``path``.

    The folder defaults to a new one in the shared folder. Rows with one page_id are a
    record each; of equal payloads all rows of the smallest page_id are responses. A row without page_id is a record
    without number, and a revisit if a row with a number has its payload.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path).filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
