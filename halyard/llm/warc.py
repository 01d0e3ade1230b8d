"""WARC archives with a two-level capture index.

Each task writes its rows as gzip members, one a record, to archive files of at most ROLL bytes. Payloads with equal
SHA-1 and length are stored once: the row with the smallest page_id is the response, the others are revisit records.

The index has one line per record, sorted by reversed-host key (SURT): lines in gzip blocks of BLOCK_LINES, and beside
each index file a sparse directory with every block's first key, offset and length. A lookup finds the index file by the
files' first keys, bisects its directory, reads the one or more blocks that may hold the key by range, bisects their
lines and reads the records by range. Reading everything back goes through the index too, in archive order.

Files get names of their own in each attempt of a task; the manifests that Spark commits name those that count.

Cases: null html is the empty payload; payloads may be of any size, one at a time is in memory; URLs may hold any
character, line separators too; rows that share the response's page_id are responses too (repeated rows stay
rows); null ids sort last and are given back as null; a null url has no target header and the empty key; an empty table
gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import open_fs, salted_lookup, shared_path, table, written

ROLL, BLOCK_LINES, SPAN, MANY = 256 << 20, 3000, 32 << 20, 100_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: str | None) -> str:
    """The reversed-host key of a URL: host labels from the last to the first, then path and query, lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{key}){(parts.path or '/').lower()}{'?' + parts.query.lower() if parts.query else ''}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, date: str = DATE) -> bytes:
    """One record, uncompressed; a revisit where refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"WARC-Refers-To-Date: {date}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_safe(refers_url)}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A record's headers, its HTTP headers and the payload it holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda b: {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in b.decode("utf-8", "surrogatepass").split("\r\n")[1:])}
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _gunzip(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


class _Files:
    """Output files of one task, rolled by size."""

    def __init__(self, folder: str, suffix: str, roll: int) -> None:
        self.fs, self.at = open_fs(folder)
        self.fs.create_dir(self.at, recursive=True)
        self.suffix, self.roll, self.sink = suffix, roll, None

    def put(self, data: bytes) -> tuple[str, int]:
        if self.sink is None or self.used >= self.roll:
            self.close()
            self.name, self.used = uuid.uuid4().hex + self.suffix, 0
            self.sink = self.fs.open_output_stream(f"{self.at}/{self.name}", compression=None)
        at = self.used
        self.sink.write(data)
        self.used += len(data)
        return self.name, at

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.sink = None


def _archive(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Files(folder, ".warc.gz", ROLL)
        for b in batches:
            rows = []
            for x in b.to_pylist():
                refers = x["first_id"] if x["first_id"] is not None and x["first_id"] != x["page_id"] else None
                data = _gzip(record(x["page_id"], x["url"], (x["html"] or "").encode("utf-8", "surrogatepass"), refers, x["first_url"], date))
                rows.append((surt(x["url"]), *out.put(data), len(data)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "file", "offset", "length"])
        out.close()

    return run


def write_archives(pages: DataFrame, folder: str, least: int = 0, date: str = DATE) -> DataFrame:
    """Write the archives; returns key, file, offset, length of every record. Payloads under `least` bytes are all stored."""
    spark = pages.sparkSession
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    body = F.coalesce("html", F.lit("")).cast("binary")
    p = p.withColumn("size", F.length(body)).withColumn("sha", F.when(F.col("size") >= least, F.sha1(body)))
    groups = p.where("sha IS NOT NULL").groupBy("sha").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1").select("sha", "n", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "warc-groups")
    if groups.count() <= MANY:
        g = F.broadcast(groups.drop("n").withColumnRenamed("sha", "_sha"))
        rows = p.join(g, p["sha"] == g["_sha"], "left")
    else:
        rows = salted_lookup(p, groups, "sha", "n", p.count(), "page_id")
    rows = rows.select("page_id", "url", "html", "first_id", "first_url")
    return written(rows.mapInArrow(_archive(folder, date), "key string, file string, offset long, length long"), "warc-entries")


def _blocks(folder: str, lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, directory, first, total = _Files(folder, ".cdx.gz", 1 << 62), [], [], None, 0

        def close_block() -> None:
            data = _gzip("".join(x + "\n" for x in held).encode("utf-8", "surrogatepass"))
            _, at = out.put(data)
            directory.append(f"{held[0].split(chr(9))[0]}\t{at}\t{len(data)}\n")
            held.clear()

        for b in batches:
            for key, file, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                first = key if first is None else first
                total += length
                held.append(f"{key}\t{file}\t{offset}\t{length}")
                if len(held) >= lines:
                    close_block()
        if held:
            close_block()
        out.close()
        if directory:
            with out.fs.open_output_stream(f"{out.at}/{out.name}.dir", compression=None) as f:
                f.write("".join(directory).encode("utf-8", "surrogatepass"))
            yield pa.record_batch([pa.array([first]), pa.array([out.name]), pa.array([total], pa.int64())], ["first", "file", "bytes"])

    return run


def write_index(entries: DataFrame, folder: str, lines: int = BLOCK_LINES) -> DataFrame:
    """Write the capture index; returns first (key), file and bytes (of its records), one row an index file. Keys with
    tabs have them escaped."""
    key = F.regexp_replace("key", "[\\t\\r\\n]", "%09")
    e = entries.select(key.alias("key"), "file", "offset", "length")
    e = e.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return written(e.mapInArrow(_blocks(folder, lines), "first string, file string, bytes long"), "warc-index")


class IndexFile:
    """One index file: its directory, and blocks by range."""

    def __init__(self, folder: str, name: str) -> None:
        fs, at = open_fs(folder)
        with fs.open_input_file(f"{at}/{name}.dir") as f:
            rows = [x.split("\t") for x in f.read().decode("utf-8", "surrogatepass").split("\n")[:-1]]
        self.keys, self.places = [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]
        self.file = fs.open_input_file(f"{at}/{name}")

    def block(self, k: int) -> list[list[str]]:
        at, n = self.places[k]
        return [x.split("\t") for x in _gunzip(self.file.read_at(n, at)).decode("utf-8", "surrogatepass").split("\n")[:-1]]

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """file, offset, length of all records of a key."""
        k = max(0, bisect.bisect_left(self.keys, key) - 1)  # the key may begin within the block before
        found = []
        while k < len(self.keys) and self.keys[k] <= key:
            rows = self.block(k)
            at = bisect.bisect_left(rows, key, key=lambda r: r[0])
            while at < len(rows) and rows[at][0] == key:
                found.append((rows[at][1], int(rows[at][2]), int(rows[at][3])))
                at += 1
            k += 1
        return found


def _lookup(index: str, archives: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_fs(archives)
        opened: dict[str, IndexFile] = {}
        for b in batches:
            rows = []
            for url, key, name in zip(*(c.to_pylist() for c in b.columns)):
                if name not in opened:
                    opened.clear()
                    opened[name] = IndexFile(index, name)
                for file, offset, length in opened[name].find(key):
                    with fs.open_input_file(f"{at}/{file}") as f:
                        rows.append((url, *_result(_gunzip(f.read_at(length, offset)))))
            yield _rows(rows, ["url"])

    return run


def _result(data: bytes) -> tuple:
    warc, http, _ = parse(data)
    page = lambda x: int(x[10:-1]) if x and x[10:-1] else None
    return page(warc["warc-record-id"]), int(http["content-length"]), warc["warc-payload-digest"][5:], warc["warc-type"], page(warc.get("warc-refers-to"))


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
_NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def _rows(rows: list[tuple], lead: list[str]) -> pa.RecordBatch:
    kinds = (*[pa.string()] * len(lead), *_KINDS)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [*lead, *_NAMES])


def lookup(urls: DataFrame, index: str, manifest: DataFrame, archives: str) -> DataFrame:
    """All records whose key is a given url's: url and the result columns. A key's captures may run over several files."""
    spark = urls.sparkSession
    files = sorted((r["first"], r["file"]) for r in manifest.collect())  # one row an index file
    firsts, names = [f for f, _ in files], [n for _, n in files]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for url in b.column(0).to_pylist():
                key = re.sub(r"[\t\r\n]", "%09", surt(url))
                k = max(0, bisect.bisect_left(firsts, key) - 1)
                while k < len(firsts) and firsts[k] <= key:
                    rows.append((url, key, names[k]))
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["url", "key", "name"])

    placed = urls.select(F.col("url").cast("string").alias("url")).mapInArrow(place, "url string, key string, name string")
    return placed.repartition("name").sortWithinPartitions("name", "key").mapInArrow(_lookup(index, archives), "url string, " + RESULT)


def _entries(index: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                f = IndexFile(index, name)
                for k in range(len(f.keys)):
                    rows = f.block(k)
                    yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows]), pa.array([int(r[2]) for r in rows], pa.int64()), pa.array([int(r[3]) for r in rows], pa.int64())], ["file", "offset", "length"])

    return run


def _read(archives: str, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_fs(archives)
        name, f = None, None
        for b in batches:
            rows = []
            for file, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if file != name:
                    name, f = file, fs.open_input_file(f"{at}/{file}")
                data = _gunzip(f.read_at(length, offset))
                warc, http, payload = parse(data)
                if check and warc["warc-type"] == "response" and "sha1:" + digest(payload) != warc["warc-payload-digest"]:
                    raise ValueError(f"{file} at {offset}: the payload doesn't match its digest")
                rows.append(_result(data))
            yield _rows(rows, [])

    return run


def read_archives(spark: SparkSession, index: str, manifest: DataFrame, archives: str, check: bool = True) -> DataFrame:
    """The result columns of every indexed record; ranges are read in archive order, SPAN bytes of a file at a time."""
    n, total = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    entries = manifest.select("file").repartition(max(1, n)).mapInArrow(_entries(index), "file string, offset long, length long")
    # as many tasks as there are spans to read: the entries themselves are too small to tell
    entries = entries.repartition(max(1, -(-total // SPAN)), "file", (F.col("offset") / SPAN).cast("long")).sortWithinPartitions("file", "offset")
    return entries.mapInArrow(_read(archives, check), RESULT)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives, index = shared_path(spark, "warc"), shared_path(spark, "cdx")
    manifest = write_index(write_archives(table(spark, sf_dir, "pages"), archives), index)
    return read_archives(spark, index, manifest, archives)


ORACLES = {
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') h, sha1(coalesce(html, '')) x FROM pages),
 b AS (SELECT *, array_to_string(list_transform(range(40), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', substr(x, i + 1, 1))]), '') s,
   min(page_id) OVER (PARTITION BY h) f FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(s, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(s, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(s, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(s, 5 * i + 4, 1) AS INT) + CAST(substr(s, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
 CASE WHEN page_id = f OR f IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id = f OR f IS NULL THEN NULL ELSE f END AS refers_to
FROM b"""
}
QUERIES = {"op9_warc": op9_warc}
