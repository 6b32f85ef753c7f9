"""WARC archives: written by tasks, read back, and their indexes merged to capture histories."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import Any
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm.common import Batches, store
from framewise.session import shared_dir

ROWS_PER_RANGE = 200_000
CAPTURE = (
    "run string, offset long, urlkey string, ts string, page_id long, url string, "
    "record_type string, payload_bytes long, payload_digest string, refers_to long"
)
NAMES = [part.split()[0] for part in CAPTURE.split(", ")]


def url_key(url: Column) -> Column:
    """Host parts from the last to the first, then path and query; null as empty."""
    bare = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    host = F.regexp_extract(bare, r"^([^/?#:]*)", 1)
    rest = F.regexp_replace(bare, r"^[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def plan_records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least_bytes: int = 0, date_col: str | None = None,
) -> DataFrame:
    """One row per record to write: ids, dates, payload, and what it revisits.

    Of equal payloads of at least ``least_bytes`` bytes the record with the
    largest id is the response and the others revisit it. A null payload is
    empty. Records without an id come out as responses unless a response with
    an id has their payload; rows repeated with one id are responses each.
    Without a date column the date is the id in seconds.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    when = (
        F.timestamp_seconds(F.coalesce(F.pmod(F.col(id_col), F.lit(4_000_000_000)), F.lit(0)))
        if date_col is None else F.col(date_col).cast("timestamp")
    )
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"), url_key(F.col(url_col)).alias("urlkey"),
        F.coalesce(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("1970-01-01T00:00:00Z"))
        .alias("ts"),
    ).withColumn("digest", F.sha1("payload"))
    responses = store(
        rows.filter(F.octet_length("payload") >= least_bytes)
        .groupBy("digest").agg(F.max("page_id").alias("response_id"))
    )
    joined = rows.join(responses, "digest", "left")
    revisits = F.col("response_id").isNotNull() & ~F.col("response_id").eqNullSafe(F.col("page_id"))
    return joined.withColumn("refers_to", F.when(revisits, F.col("response_id"))).drop("response_id")


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write one archive per partition, records in index order; returns (path, records, bytes).

    A task writes a file of its own name and reports it when it is complete. The
    report is stored, so that files of lost or repeated attempts are in no
    report and are never read.
    """

    def run(batches: Batches) -> Batches:
        import base64
        import zlib

        from pyarrow import fs

        path, out, count, size = None, None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{folder}/{uuid4().hex}.warc.gz"
                    files, inner = fs.FileSystem.from_uri(folder)
                    files.create_dir(inner, recursive=True)
                    out = files.open_output_stream(
                        f"{inner}/{path.rpartition('/')[2]}", compression=None)
                digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member per record
                data = squeeze.compress(_record(row, digest)) + squeeze.flush()
                out.write(data)
                count, size = count + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([count]), pa.array([size])], ["path", "records", "bytes"])

    ordered = records.sortWithinPartitions("urlkey", "ts", "page_id")
    return store(ordered.mapInArrow(run, "path string, records long, bytes long"))


def _record(row: dict[str, Any], digest: str) -> bytes:
    ident = "none" if row["page_id"] is None else str(row["page_id"])
    kind = "response" if row["refers_to"] is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Length: {len(row['payload'])}\r\n\r\n".encode()
    body = http + (row["payload"] if kind == "response" else b"")
    url = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in row["url"] or "")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{ident}>",
        f"WARC-Date: {row['ts']}", f"WARC-Target-URI: {url}", f"X-URL-Key: {row['urlkey']!a}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
    ]
    if kind == "revisit":
        head.append(f"WARC-Refers-To: <urn:page:{row['refers_to']}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def read(manifest: DataFrame) -> DataFrame:
    """The captures of all reported archives, one sorted run per archive.

    Sizes and digests of responses are taken anew from the payload that was
    read; a revisit states those of the payload it doesn't repeat.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for path in batch["path"].to_pylist():
                rows: list[tuple[Any, ...]] = []
                for row in _captures(path):
                    rows.append(row)
                    if len(rows) == 4096:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    tasks = max(1, manifest.count())  # one per archive; a bare key would be coalesced to few
    return manifest.select("path").repartition(tasks, "path").mapInArrow(run, CAPTURE)


_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(),
          pa.int64(), pa.string(), pa.int64()]


def _batch(rows: Sequence[tuple[Any, ...]]) -> pa.RecordBatch:
    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), _TYPES)]
    return pa.RecordBatch.from_arrays(columns, NAMES)


def _captures(path: str) -> Iterator[tuple[Any, ...]]:
    import ast
    import base64
    import hashlib
    import zlib

    from pyarrow import fs

    folder, _, name = path.rpartition("/")
    files, inner = fs.FileSystem.from_uri(folder)
    offset, held = 0, b""
    with files.open_input_stream(f"{inner}/{name}", compression=None) as stream:
        while True:
            held = held or stream.read(1 << 20)
            if not held:
                return
            expand, parts, used = zlib.decompressobj(31), [], 0
            while not expand.eof:
                parts.append(expand.decompress(held))
                used += len(held) - len(expand.unused_data)
                held = expand.unused_data or (b"" if expand.eof else stream.read(1 << 20))
                if not expand.eof and not held:
                    raise ValueError(f"{path} ends within a record")
            raw = b"".join(parts)
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(
                line.split(": ", 1) if ": " in line else (line.rstrip(":"), "")
                for line in head.decode().split("\r\n")[1:]
            )
            body = rest[: int(fields["Content-Length"])]
            http, _, payload = body.partition(b"\r\n\r\n")
            kind = fields["WARC-Type"]
            if kind == "response":
                size = len(payload)
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            else:
                size = int(http.rpartition(b"Content-Length: ")[2])
                digest = fields["WARC-Payload-Digest"].partition(":")[2]
            yield (path, offset, ast.literal_eval(fields["X-URL-Key"]), fields["WARC-Date"],
                   _page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, size, digest,
                   _page(fields.get("WARC-Refers-To")))
            offset += used


def _page(urn: str | None) -> int | None:
    ident = (urn or "none").rstrip(">").rpartition(":")[2]
    return None if ident == "none" else int(ident)


class LoserTree:
    """Smallest head of k sorted sequences; each step costs about log2(k) comparisons."""

    def __init__(self, runs: Sequence[Sequence[Any]]) -> None:
        self.runs, self.at = runs, [0] * len(runs)
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.losers = [-1] * self.size
        self.winner = self._build(1)

    def _head(self, i: int) -> tuple[bool, Any]:
        done = i >= len(self.runs) or self.at[i] >= len(self.runs[i])
        return (True, None) if done else (False, self.runs[i][self.at[i]])

    def _less(self, i: int, j: int) -> bool:
        (end_i, a), (end_j, b) = self._head(i), self._head(j)
        if end_i or end_j:
            return not end_i
        return (a, i) < (b, j)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        left, right = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (left, right) if self._less(left, right) else (right, left)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, position in it) in merged order."""
        while True:
            i = self.winner
            if self._head(i)[0]:
                return
            yield i, self.at[i]
            self.at[i] += 1
            node = (i + self.size) // 2
            while node:
                if self._less(self.losers[node], i):
                    i, self.losers[node] = self.losers[node], i
                node //= 2
            self.winner = i


def merge_index(captures: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Capture histories in global order of URL key, date and id: ``captures`` + range, position.

    The key space is cut into ranges by (urlkey, ts, page_id), so that a URL
    with very many captures spans several. Each range gets its stretch of every
    run, still sorted, and merges these with a loser tree. Ranges follow each
    other, positions count within a range.
    """
    captures = store(captures)
    ranges = math.ceil(captures.count() / rows_per_range) or 1
    dealt = captures.repartitionByRange(
        ranges, F.col("urlkey"), F.col("ts"), F.col("page_id").asc_nulls_first(), "run", "offset"
    ).withColumn("range", F.spark_partition_id())

    def run(batches: Batches) -> Batches:
        import numpy as np

        held = [pa.Table.from_batches([b]) for b in batches]
        if not held or not (table := pa.concat_tables(held)).num_rows:
            return
        names = table["run"].to_pylist()
        starts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]] + [len(names)]
        keys = list(zip(
            table["urlkey"].to_pylist(), table["ts"].to_pylist(),
            [-(1 << 63) if p is None else p for p in table["page_id"].to_pylist()],
        ))
        runs = [keys[a:b] for a, b in zip(starts, starts[1:])]
        order = np.array([starts[r] + at for r, at in LoserTree(runs)])
        merged = table.take(pa.array(order)).append_column(
            "position", pa.array(np.arange(len(order)))
        )
        yield from merged.combine_chunks().to_batches()

    return dealt.sortWithinPartitions(
        "run", "urlkey", "ts", F.col("page_id").asc_nulls_first(), "offset"
    ).mapInArrow(run, f"{CAPTURE}, range int, position long")


def archive(
    pages: DataFrame, folder: str | None = None, rows_per_range: int = ROWS_PER_RANGE,
    **params: Any,
) -> DataFrame:
    """Write ``pages`` as archives, read these, and return their merged captures.

    The folder must be one that all executors reach; without one the archives
    go below the session's shared folder. An empty table gives no archive and
    no captures.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid4().hex}"
    manifest = write(plan_records(pages, **params), folder)
    return merge_index(read(manifest), rows_per_range)
