"""WARC archives of a page table, and the merged index of their captures.

Writing: records are packed into archives of at most ``ARCHIVE_BYTES`` (a
larger record is an archive of its own) and written as plain WARC/1.1 files.
Of records with equal payloads of at least ``least`` bytes the one with the
smallest id is a response, the others are revisits of it without a body.

Reading: every archive is parsed by the lengths its records state and checked
against their digests; its captures, sorted by URL key and timestamp, are one
sorted run. Ranges of the key space are dealt to tasks, and each task merges
the segments that the runs have in its range with a loser tree, one comparison
per level and capture. The ranges in order are the globally ordered capture
histories: ``part`` and ``place`` number them. One URL with a third of all
captures is cut by timestamp, archive and offset, so no key is one task.

Nulls: a null payload is empty, a null URL an empty one, a null id comes after
all others (records without any id in their group are all responses). Records
that share the smallest id of their payload are all responses. Payloads of any
length are whole; an empty table gives no archive and no row. Control
characters and blanks of a URL are percent-encoded in its header. Other columns are
ignored."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from intentlane.llm.common import materialise, table
from intentlane.session import scratch_path

ARCHIVE_BYTES = 16 << 20
LEAST_REVISIT = 100
FIRST_CAPTURE = "2000-01-01 00:00:00"   # of tables without a capture time: so many seconds later as the id says
CAPTURE_SPAN = 1_000_000_000            # seconds after which those times begin anew
# fixed values: names that the format and its revisit profile prescribe
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INFO = "software: intentlane\r\nformat: WARC File Format 1.1\r\n"
NO_ID = "urn:page"


# -- records ---------------------------------------------------------------------------------------

def _uri(ident: str | None) -> str:
    return NO_ID if ident is None else f"{NO_ID}:{quote(ident, safe='')}"


def _ident(uri: str) -> str | None:
    return None if uri == NO_ID else unquote(uri.removeprefix(f"{NO_ID}:"))


def header_value(text: str) -> str:
    """A header's value without blanks and control characters."""
    return "".join(quote(c) if c <= " " or c == "\x7f" else c for c in text)


def record(kind: str, fields: list[tuple[str, str]], body: bytes) -> bytes:
    head = [VERSION, f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields], f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def page_record(ident: str | None, url: str | None, date: str, digest: str, first: str | None, body: bytes) -> bytes:
    fields = [("WARC-Record-ID", f"<{_uri(ident)}>"), ("WARC-Date", date), ("WARC-Target-URI", header_value(url or "")),
              ("WARC-Payload-Digest", f"sha256:{digest}")]
    if first is None:
        return record("response", [*fields, ("Content-Type", "text/html; charset=utf-8")], body)
    return record("revisit", [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_uri(first)}>")], b"")


def read_records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """(offset, length, fields, body) of every record of one archive."""
    view, at = memoryview(content), 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError(f"no record at byte {at}")
        version, *lines = content[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        body = end + 4
        past = body + int(fields["Content-Length"])
        if content[past:past + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield at, past + 4 - at, fields, view[body:past]
        at = past + 4


# -- writing ---------------------------------------------------------------------------------------

def _pack(archive_bytes: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = record("warcinfo", [("WARC-Record-ID", "<urn:page-archive>"), ("Content-Type", "application/warc-fields")], INFO.encode())
        held, size = [], 0

        def archive() -> pa.RecordBatch:
            # the writer ends the file with the last line break of the last record
            return pa.RecordBatch.from_arrays([pa.array([(start + b"".join(held))[:-2]], pa.binary())], names=["archive"])

        for batch in batches:
            for i in range(batch.num_rows):
                ident, url, date, digest, first, body = (batch[c][i].as_py() for c in ("id", "url", "date", "digest", "first", "body"))
                one = page_record(ident, url, date, digest, first, (body or "").encode())
                if held and size + len(one) > archive_bytes:
                    yield archive()
                    held, size = [], 0
                held.append(one)
                size += len(one)
        if held:
            yield archive()
    return pack


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                   date: Column | None = None, least: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the archives of a page table under ``path``. ``date`` is the capture
    time, best as a ``timestamp_ntz`` in UTC; times of type timestamp are written
    as the session's time zone shows them.

    Only payloads that several records share are looked up: their digests and
    first ids are one row per group, broadcast if Spark finds them small."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    ident = F.col(id_col)
    if date is None:
        number = F.xxhash64(ident) if ident_is_text(pages, id_col) else F.coalesce(ident.cast("bigint"), F.lit(0))
        seconds = F.pmod(number, F.lit(CAPTURE_SPAN)).cast("decimal(18,6)")
        date = F.lit(FIRST_CAPTURE).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    stamp = F.concat(F.substring(F.translate(date.cast("string"), " ", "T"), 1, 19), F.lit("Z"))
    digest = F.sha2(body.cast("binary"), 256)
    shared = (pages.where(F.octet_length(body) >= least).groupBy(digest.alias("_shared"))
              .agg(F.min(ident).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _first is not null").drop("_n"))
    rows = pages.select(ident.alias("id"), F.col(url_col).alias("url"), stamp.alias("date"),
                        digest.alias("digest"), body.alias("body"))
    joined = rows.join(materialise(shared, "warc-shared"), F.col("digest") == F.col("_shared"), "left")
    revisits = F.col("_first").isNotNull() & ~F.coalesce(F.col("id") == F.col("_first"), F.lit(False))
    packed = joined.select(
        F.col("id").cast("string").alias("id"), F.col("url").cast("string").alias("url"), "date", "digest",
        F.when(revisits, F.col("_first").cast("string")).alias("first"),
        F.when(~revisits, F.col("body")).alias("body")).mapInArrow(_pack(archive_bytes), "archive binary")
    (packed.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
     .option("lineSep", "\r\n").text(path))


def ident_is_text(df: DataFrame, col: str) -> bool:
    return df.schema[col].dataType.simpleString() == "string"


# -- reading and merging ---------------------------------------------------------------------------

def url_key(url: str) -> str:
    """A URL's sort key: host parts from the top level down, then the path and
    the sorted query; scheme, a leading www, default ports and fragments go."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:      # a URL that cannot be taken apart sorts by itself
        return f"){url}"
    host = host.removeprefix("www.")
    name = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{name}){parts.path or '/'}" + (f"?{query}" if query else "")


CAPTURE = ("urlkey string, date string, archive string, place bigint, offset bigint, length bigint, url string, id string, "
           "record_type string, payload_digest string, payload_bytes bigint, first string")
_CAPTURE_SCHEMA = pa.schema([("urlkey", pa.string()), ("date", pa.string()), ("archive", pa.string()), ("place", pa.int64()),
                             ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("id", pa.string()),
                             ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("first", pa.string())])


def captures(name: str, content: bytes) -> list[tuple]:
    """The captures of one archive in the order of its sorted run; bodies are held against their digests."""
    found = []
    for offset, length, fields, body in read_records(content):
        kind = fields["WARC-Type"]
        if kind not in ("response", "revisit"):
            continue
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        if kind == "response" and sha256(body).hexdigest() != digest:
            raise ValueError(f"{name}: the record at byte {offset} does not have its digest")
        url = fields["WARC-Target-URI"]
        found.append((url_key(url), fields["WARC-Date"], offset, length, url, _ident(fields["WARC-Record-ID"][1:-1]), kind, digest,
                      len(body) if kind == "response" else None,
                      _ident(fields["WARC-Refers-To"][1:-1]) if kind == "revisit" else None))
    found.sort(key=lambda c: c[:3])
    return [(c[0], c[1], name, k, *c[2:]) for k, c in enumerate(found)]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            rows = captures(batch["archive"][i].as_py(), batch["content"][i].as_py())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CAPTURE_SCHEMA)], schema=_CAPTURE_SCHEMA)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The sorted runs of all archives under ``path``: one row per capture,
    ``archive`` names its run and ``place`` its place there. A revisit has the
    payload length of the response it refers to, found by digest."""
    files = spark.read.format("binaryFile").load(path)
    runs = materialise(files.select(F.regexp_extract("path", "[^/]*$", 0).alias("archive"), "content").mapInArrow(_read, CAPTURE), "warc-runs")
    bodies = (runs.where("record_type = 'response'").join(runs.where("record_type = 'revisit'").select("payload_digest").distinct(),
                                                          "payload_digest", "left_semi")
              .groupBy(F.col("payload_digest").alias("_digest")).agg(F.max("payload_bytes").alias("_bytes")))
    joined = runs.join(materialise(bodies, "warc-bodies"), (F.col("record_type") == "revisit") & (F.col("payload_digest") == F.col("_digest")), "left")
    return joined.withColumn("payload_bytes", F.coalesce("payload_bytes", "_bytes")).drop("_bytes", "_digest")


class LoserTree:
    """Merges sorted runs: an inner node holds the run that lost there, so the
    next smallest head costs one comparison a level. ``heads`` are the runs'
    first keys; None is past every key."""

    def __init__(self, heads: list):
        self.n = len(heads)
        self.heads = heads
        self.losers = [-1] * self.n
        for run in range(self.n):
            self._play(run, True)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x < y)

    def _play(self, run: int, first: bool = False) -> None:
        node = (run + self.n) >> 1
        while node:
            held = self.losers[node]
            if held < 0 and first:      # the first to come waits here for its opponent
                self.losers[node] = run
                return
            if self._before(held, run):
                self.losers[node], run = run, held
            node >>= 1
        self.losers[0] = run

    def winner(self) -> int | None:
        """The run with the smallest head, None if all are empty."""
        if not self.n or self.heads[self.losers[0]] is None:
            return None
        return self.losers[0]

    def replace(self, head) -> None:
        """Put the winner's next key in place of the one it won with."""
        run = self.losers[0]
        self.heads[run] = head
        self._play(run)


def merge_runs(runs: list[list]) -> list[tuple[int, int]]:
    """(run, place) of every key of sorted runs, in the order of the keys."""
    tree = LoserTree([run[0] if run else None for run in runs])
    at, out = [0] * len(runs), []
    while (run := tree.winner()) is not None:
        out.append((run, at[run]))
        at[run] += 1
        tree.replace(runs[run][at[run]] if at[run] < len(runs[run]) else None)
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One key range: its rows come sorted by run and place, and leave in key order."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    names = rows["archive"].to_pylist()
    cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
    keys = list(zip(rows["urlkey"].to_pylist(), rows["date"].to_pylist(), names, rows["offset"].to_pylist()))
    order = merge_runs([keys[a:b] for a, b in zip(cuts, cuts[1:])])
    merged = rows.take(pa.array([cuts[run] + k for run, k in order], pa.int64()))
    merged = merged.set_column(merged.schema.get_field_index("place"), "place", pa.array(range(len(order)), pa.int64()))
    yield from merged.combine_chunks().to_batches(max_chunksize=50_000)


def merge_index(runs: DataFrame) -> DataFrame:
    """The globally ordered index: range ``part`` and ``place`` in it order all
    captures by URL key, timestamp, archive and offset."""
    names = [f.strip().split()[0] for f in CAPTURE.split(",")]
    dealt = (runs.select(*names).repartitionByRange("urlkey", "date", "archive", "offset")
             .withColumn("part", F.spark_partition_id()).sortWithinPartitions("archive", "place"))
    return dealt.select("part", *names).mapInArrow(_merge, f"part int, {CAPTURE}")


def op11_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    index = merge_index(materialise(read_archives(spark, path), "warc-captures"))
    kind = pages.schema["page_id"].dataType
    return index.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.col("first").cast(kind).alias("refers_to"))
