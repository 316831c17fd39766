"""Pages as WARC archives, read back and merged into one ordered index of captures.

Every page becomes a record of its own gzip member. Pages of equal content share one response record; the others
are revisit records without a body. Tasks write archives side by side in the shared folder, each under a name of its
own attempt, and only archives that a finished task reports are read.

Reading is an external merge. A task reads its archives record by record and leaves runs of captures sorted by (URL
key, time, page). Ranges of that order are then merged, each in a task of its own, by a loser tree over the runs.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import parse_qsl, quote, urlencode, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gridpulse.llm.texts import lookup
from gridpulse.session import cut_lineage, scratch_path

ARCHIVE_BYTES = 64 << 20     # an archive is closed behind the record that passes this size
RUN = 50_000                 # captures sorted together
RANGE = 50_000               # captures merged by one task, about
LEVEL = 3
READ = 1 << 20
PORTS = {"http": 80, "https": 443}
CAPTURE = "url_key string, time string, page_id long, url string, payload_bytes long, payload_digest string, " \
          "record_type string, refers_to long, archive string, offset long, length long"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder (file, hdfs, s3 and others that pyarrow knows)."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri).replace("s3a://", "s3://"))


def url_key(url: str | None) -> str:
    """Host from the top domain down, path, sorted query; scheme, `www.`, default port and fragment do not count."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    name = ",".join(reversed(host.split(".")))
    if port and port != PORTS.get(parts.scheme.lower()):
        name += f":{port}"
    query = urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True)))
    return f"{name}){parts.path or '/'}" + (f"?{query}" if query else "")


# ---- records -----------------------------------------------------------------------------------------------------

def record(page_id: int | None, url: str | None, time: str, payload: bytes, sha1: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of page ``refers_to`` without the payload."""
    digest, revisit = "sha1:" + base64.b32encode(sha1).decode(), refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:page:{uuid.uuid4() if page_id is None else page_id}>", f"WARC-Date: {time}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._\"<>\\^`{|}"))
    head += [f"WARC-Payload-Digest: {digest}", f"Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and payload of one record (no payload in a revisit)."""
    at = raw.index(b"\r\n\r\n")
    first, *lines = raw[:at].decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = raw[at + 4:at + 4 + int(fields["Content-Length"])]
    if first != "WARC/1.1" or raw[at + 4 + len(block):] != b"\r\n\r\n":
        raise ValueError("broken record")
    return fields, block[block.index(b"\r\n\r\n") + 4:]


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed length, content) of the gzip members of an archive, one at a time."""
    held, end = b"", 0
    while held or (held := stream.read(READ)):
        unzip, parts, start = zlib.decompressobj(31), [], end
        while True:
            parts.append(unzip.decompress(held))
            end += len(held) - len(unzip.unused_data)
            held = unzip.unused_data
            if unzip.eof:
                break
            held = stream.read(READ)
            if not held:
                raise ValueError("archive ends inside a record")
        yield start, end - start, b"".join(parts)


def page_number(name: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name)
    return int(found[1]) if found else None


# ---- writing -----------------------------------------------------------------------------------------------------

def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   time: Column | None = None, smallest: int = 0) -> DataFrame:
    """Write a record per row into archives under ``folder``; the table of archives: archive, records, bytes.

    Of rows with equal payloads of at least ``smallest`` bytes, that of the smallest page id is the response (all of
    them, if several rows have this id), the others revisit it. Rows without an id revisit too, if any of their equals
    has one. Null html is an empty payload. ``time`` is when a page was captured, the epoch if not given.
    """
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    at = F.coalesce(time, F.lit(0).cast("timestamp")) if time is not None else F.lit(0).cast("timestamp")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"),
                        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.unhex(F.sha1("payload")), "check": F.xxhash64("payload"), "size": F.octet_length("payload")})
    key = ["sha1", "check", "size"]
    copies = rows.where(F.col("size") >= smallest).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))
    copies = cut_lineage(copies.where("n > 1 AND first IS NOT NULL"), "warc-copies")
    rows = lookup(rows, copies, key, "first", "n")
    refers_to = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.select("page_id", "url", "time", "payload", "sha1", refers_to.alias("refers_to"))
    wire = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        store, root = open_folder(folder)
        out, name, count, size = None, "", 0, 0

        def closed():
            out.close()
            return pa.record_batch([[name], [count], [size]], schema=wire)

        for batch in batches:
            for i in range(batch.num_rows):
                raw = zlib.compressobj(LEVEL, wbits=31)
                values = [c[i].as_py() for c in batch.columns]
                member = raw.compress(record(*values)) + raw.flush()
                if out is None:
                    store.create_dir(root, recursive=True)
                    name, count, size = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return cut_lineage(rows.mapInArrow(run, "archive string, records long, bytes long"), "warc-archives")


# ---- reading and merging -----------------------------------------------------------------------------------------

def capture(archive: str, offset: int, length: int, raw: bytes) -> tuple:
    fields, payload = parse(raw)
    revisit, digest = fields["WARC-Type"] == "revisit", fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload differs from its digest: {archive} at {offset}")
    url = fields.get("WARC-Target-URI")
    return (url_key(url), fields["WARC-Date"], page_number(fields["WARC-Record-ID"]), url, int(fields["Payload-Length"]), digest,
            fields["WARC-Type"], page_number(fields["WARC-Refers-To"]) if revisit else None, archive, offset, length)


def place(row: Sequence) -> tuple:
    """What captures are ordered by: URL key, time, page (none last), and where the record lies."""
    return row[0], row[1], row[2] is None, row[2] or 0, row[8], row[9]


def capture_runs(archives: DataFrame, folder: str) -> DataFrame:
    """Captures of all archives in sorted runs: ``run`` and ``at``, the place in the run, then the capture's columns."""
    shape = "run string, at long, " + CAPTURE

    def run(batches):
        store, root = open_folder(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{archive}", compression=None) as stream:
                    held, number = [], 0
                    for offset, length, raw in members(stream):
                        held.append(capture(archive, offset, length, raw))
                        if len(held) == RUN:
                            yield batch_of(held, f"{archive}/{number}")
                            held, number = [], number + 1
                    if held:
                        yield batch_of(held, f"{archive}/{number}")

    def batch_of(rows, name):
        rows.sort(key=place)
        return pa.record_batch([[name] * len(rows), list(range(len(rows))), *map(list, zip(*rows))], schema=wire)

    wire = to_arrow_schema(archives.sparkSession.createDataFrame([], shape).schema)
    tasks = max(1, archives.count())
    return archives.select("archive").repartition(tasks).mapInArrow(run, shape)


class LoserTree:
    """Merges sorted runs: an inner node holds the run that lost there, so a step replays one path to the root."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.at = runs, key, [0] * len(runs)
        self.heads = [key(r[0]) if r else None for r in runs]
        self.losers = [-1] * len(runs)
        for run in range(len(runs)):
            self.winner = self._replay(run)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a goes before run b; runs at their end go last, equal keys by run."""
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _replay(self, run: int) -> int:
        node = (run + len(self.runs)) // 2
        while node:
            other = self.losers[node]
            if other < 0:                    # while the tree fills, the first to come waits
                self.losers[node] = run
                return -1
            if self._before(other, run):
                self.losers[node], run = run, other
            node //= 2
        return run

    def __iter__(self):
        for _ in range(sum(map(len, self.runs))):
            run = self.winner
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self.heads[run] = self.key(self.runs[run][self.at[run]]) if self.at[run] < len(self.runs[run]) else None
            self.winner = self._replay(run)


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in one order: the capture's columns and ``place``, which grows along the order."""
    runs = cut_lineage(runs, "warc-runs")
    shape = runs.drop("run", "at").withColumn("place", F.lit(0).cast("long")).schema
    wire = to_arrow_schema(shape)

    def run(batches):
        held = {}
        for batch in batches:
            for name, at, *row in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(name, []).append((at, row))
        # A shuffle may hand over the pieces of a run in any order.
        sorted_runs = [[row for _, row in sorted(rows, key=lambda r: r[0])] for _, rows in sorted(held.items())]
        if not sorted_runs:
            return
        base, out, n = TaskContext.get().partitionId() << 32, [], 0
        for row in LoserTree(sorted_runs, place):
            out.append((*row, base + n))
            n += 1
            if len(out) == 10_000:
                yield pa.record_batch(list(map(list, zip(*out))), schema=wire)
                out = []
        if out:
            yield pa.record_batch(list(map(list, zip(*out))), schema=wire)

    ranges = max(1, round(runs.count() / RANGE))
    # Every capture has a key of its own, so a URL that is captured again and again lies in many ranges.
    return runs.repartitionByRange(ranges, "url_key", "time", F.col("page_id").asc_nulls_last(), "archive", "offset").mapInArrow(run, shape)


def capture_histories(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url",
                      html: str = "html", time: Column | None = None, smallest: int = 0) -> DataFrame:
    """Pages written as archives under ``folder`` (one in the shared folder if not given) and read back.

    One row per page: url_key, time, page_id, url (with spaces and other characters that no URI holds percent-encoded),
    payload_bytes and payload_digest of the full payload, record_type, refers_to, archive, offset and length
    (where the record lies), and place, along which histories are ordered by URL key, time and page. Repeated rows
    are records of their own; an empty table gives no archive and no rows.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return merge_runs(capture_runs(write_archives(pages, folder, page_id, url, html, time, smallest), folder))


def read_payloads(captures: DataFrame, folder: str) -> DataFrame:
    """page_id and payload of each capture, read at its place in its archive; null for revisits."""
    def run(batches):
        store, root = open_folder(folder)
        for batch in batches:
            for number, archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{root}/{archive}") as file:
                    fields, payload = parse(zlib.decompress(file.read_at(length, offset), wbits=31))
                yield pa.record_batch([pa.array([number], pa.int64()), pa.array(
                    [None if fields["WARC-Type"] == "revisit" else payload], pa.binary())], names=["page_id", "payload"])

    return captures.select("page_id", "archive", "offset", "length").mapInArrow(run, "page_id long, payload binary")
