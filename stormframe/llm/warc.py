"""WARC archives and their index.

Captures are written as WARC records, sorted within each archive by URL key and time.  Reading the
archives back gives one sorted run of index entries per archive; runs are merged by a loser tree,
one range of keys per task, into globally ordered capture histories.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormframe.llm.common import written

#: Payloads at least this long are stored once; later ones of equal content become revisits.
REVISIT_BYTES = 100
#: Bytes of one archive and index rows of one merge task, about.
ARCHIVE_BYTES, RANGE_ROWS = 16_000_000, 100_000
#: 2024-01-01T00:00:00Z; captures follow each other by seconds in the order of their ids.
FIRST_CAPTURE = 1_704_067_200
CRLF = "\r\n"
HTTP_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"

INDEX = (
    "urlkey string, captured_at string, page_id long, url string, archive string, record_offset long, record_length long, "
    "record_type string, refers_to long, payload_bytes long, payload_digest string"
)


def url_key(url: Column) -> Column:
    """Sort-friendly form: host labels reversed, then port, path and query; scheme, ``www.`` and fragment dropped."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(www\d*\.)?|#.*$", "")
    host = F.regexp_extract(bare, r"^([^/?:]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(bare, r"^[^/?:]*", ""))


def captures(pages: DataFrame, first: int = FIRST_CAPTURE, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages as captures: key, time, payload, digest, and the page of smallest id that holds the payload already.

    Partitions hold about ``archive_bytes`` each (a longer payload is not cut).

    A null html is an empty payload; a null url an empty one.  Repeated rows of the response's id are
    responses too; rows without id always are.
    """
    payload = F.coalesce("html", F.lit(""))
    page = (
        F.col("page_id"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(F.encode(payload, "UTF-8"), 256).alias("payload_digest"),
    )
    marks = pages.select(*page).where(F.col("payload_bytes") >= REVISIT_BYTES)
    # One row per digest that occurs twice; a digest of very many pages is summed up in the map tasks,
    # and adaptive execution splits its side of the join.  Payloads stay out of it.
    first_of = marks.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = marks.join(first_of, "payload_digest").where("page_id <> refers_to").select("page_id", "payload_digest", "refers_to").distinct()
    total = marks.agg(F.sum("payload_bytes"), F.count("*")).first()
    archives = max(1, -(-((total[0] or 0) + 600 * total[1]) // archive_bytes))
    base = pages.select(*page, F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20").alias("url"), payload.alias("payload"))
    # Payloads move once: an archive is a partition of this join.
    return (
        base.repartition(archives, "page_id", "payload_digest")
        .join(again, ["page_id", "payload_digest"], "left")
        .withColumns(
            {
                "urlkey": url_key(F.col("url")),
                "captured_at": F.date_format(F.timestamp_seconds(F.lit(first) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
            }
        )
    )


def records(captured: DataFrame) -> Column:
    """The text of a WARC/1.1 record without the blank lines that end it."""
    again = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(HTTP_HEAD), F.when(again, F.lit("")).otherwise(F.col("payload")))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.col("captured_at")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(
            again,
            F.concat(
                line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("Payload-Length", F.col("payload_bytes").cast("string")),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )


def write_archives(captured: DataFrame, path: str) -> None:
    """One compressed archive per partition, sorted by URL key, time and id; offsets count in what is decompressed."""
    runs = captured.sortWithinPartitions("urlkey", "captured_at", "page_id")
    # Two line ends close a record, so a text file with that line separator is a WARC file.
    runs.select(records(runs).alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


def parse(archive: str, data: bytes) -> Iterator[dict]:
    """Index entries of an archive's records, in their order."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in data[at:head].decode().split(CRLF)[1:])
        body, size = head + 4, int(fields["Content-Length"])
        block = memoryview(data)[body : body + size]
        number = fields["WARC-Record-ID"][10:-1]
        entry = {
            "captured_at": fields["WARC-Date"],
            "page_id": int(number) if number else None,
            "url": fields["WARC-Target-URI"],
            "archive": archive,
            "record_offset": at,
            "record_length": body + size + 4 - at,
            "record_type": fields["WARC-Type"],
            "refers_to": None,
        }
        if fields["WARC-Type"] == "revisit":
            entry |= {
                "refers_to": int(fields["WARC-Refers-To"][10:-1]),
                "payload_bytes": int(fields["Payload-Length"]),
                "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
            }
        else:
            # What is stored counts, not what the header says of it.
            payload = block[bytes(block[:400]).index(b"\r\n\r\n") + 4 :]
            entry |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
        yield entry
        at = body + size + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of every record under ``path``; an archive's entries are a sorted run."""
    names = [f.split()[0] for f in INDEX.split(", ") if not f.startswith("urlkey")]

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64()}
        schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in INDEX.split(", ") if not f.startswith("urlkey")])
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(parse(batch.column("path")[i].as_py(), gzip.decompress(batch.column("content")[i].as_py())))
                yield pa.RecordBatch.from_pylist(found, schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    index = files.mapInArrow(entries, ", ".join(f for f in INDEX.split(", ") if not f.startswith("urlkey")))
    return index.select(url_key(F.col("url")).alias("urlkey"), *names)


class LoserTree:
    """k-way merge of sorted iterators; each step replays one path from a leaf to the root."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.tree = [-1] * max(1, self.k)
        self.winner = self._build(1) if self.k > 1 else 0

    def _less(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return a is not None
        return (a, i) < (b, j)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        i, j = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (i, j) if self._less(i, j) else (j, i)
        self.tree[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            node = (w + self.k) // 2
            while node:
                if self._less(self.tree[node], w):
                    self.tree[node], w = w, self.tree[node]
                node //= 2
            self.winner = w


def merge_runs(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Index entries in the global order of (urlkey, captured_at, page_id): partition after partition, row after row.

    Tasks own ranges of the whole key, the record's place included, so one URL captured very often
    spans as many tasks as it needs.  In a task the slices of the runs lie one after the other, each
    in its own order, and a loser tree merges them.
    """
    names = index.columns
    tasks = max(1, -(-index.count() // range_rows))
    key = ["urlkey", "captured_at", "page_id", "archive", "record_offset"]
    ranges = index.repartitionByRange(tasks, *key).sortWithinPartitions("archive", "record_offset")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        keys = list(
            zip(
                table["urlkey"].to_pylist(),
                table["captured_at"].to_pylist(),
                (-1 if p is None else p for p in table["page_id"].to_pylist()),
                range(table.num_rows),
                strict=True,
            )
        )
        archives = table["archive"].to_pylist()
        starts = [i for i in range(len(archives)) if i == 0 or archives[i] != archives[i - 1]]
        runs = [iter(keys[a:b]) for a, b in zip(starts, [*starts[1:], len(keys)], strict=True)]
        merged = table.take(pa.array([k[-1] for k in LoserTree(runs)], pa.int64()))
        yield from merged.to_batches()

    return ranges.select(*names).mapInArrow(merge, index.schema)


def capture_index(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to archives under ``path``, read them back, and merge their index."""
    write_archives(captures(pages, archive_bytes=archive_bytes), path)
    return merge_runs(written(read_archives(pages.sparkSession, path), "index"), range_rows)
