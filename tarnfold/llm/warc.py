"""Web archives: records with revisits, and a two-level capture index over reversed-host URL keys.

Level two is files of compressed blocks of sorted index lines; level one is each file's sparse directory (the
first key and page of every block) at its end, under a small table of the files' first and last ones. A lookup
bisects the table, then a file's directory, range-reads one block, bisects its lines, and range-reads the
records. Archives and index lie in the shared folder; executors write files of their own names, so a task
that runs again leaves an unnamed file behind and nothing else.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, mapped, ship, stored

#: Shorter payloads are always responses.
REVISIT_BYTES = 1000
FILE_BYTES, BLOCK_LINES, MANY = 64 << 20, 2048, 1024
_DATE = "2024-01-01T00:00:00Z"
_NULL_ID = 1 << 127

_FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def surt(url: Column) -> Column:
    """com,example,www)/path?query: host reversed and lower-cased, scheme, user, port and fragment dropped."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1)
    return F.when(host == "", F.concat(F.lit(")"), url)).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def classified(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest and refers_to (null: a response).

    Copies are found from digests alone. The join back carries pages: digests that more than one of MANY pages have
    are fewer than MANY, so they are broadcast, and those pages need no join by key; nor do pages without copies to look for.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    copies = p.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1")
    copies = stored(copies, "copies")
    share = pages.count() // MANY
    hot = copies.where(F.col("n") > share).select("payload_digest", F.col("kept").alias("hot"))
    rest = copies.where(F.col("n") <= share).select(F.col("payload_digest").alias("by"), "kept")
    p = p.join(F.broadcast(hot), "payload_digest", "left")
    alone = F.col("hot").isNotNull() | (F.col("payload_bytes") < least)
    by = F.when(alone, F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("payload_digest"))
    kept = F.coalesce("hot", "kept")
    joined = p.join(rest, by == F.col("by"), "left")
    return joined.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != kept), kept)).drop("by", "hot", "kept")


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=_NULL_ID if page_id is None else page_id % (1 << 64))}>"


def _number(urn: str) -> int | None:
    n = uuid.UUID(urn[len("<urn:uuid:") : -1]).int
    return None if n == _NULL_ID else n - (1 << 64) * (n >= 1 << 63)


def _one_line(s: str) -> str:
    return s.encode("unicode_escape").decode() if any(c < " " for c in s) else s


def record(page_id: int | None, url: str, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One gzip member. A revisit keeps the HTTP header alone, with the payload's length and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n") + z.flush()


def parsed(member: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers, the HTTP length and the payload bytes of one record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields, size, payload


@dataclass
class Archive:
    """Where an archive lies: captures (key, page_id, file, offset, length) and the index files' table."""

    folder: str
    captures: DataFrame
    parts: DataFrame


def write_warc(pages: DataFrame, file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """Write one record a row of pages (page_id, url, html); returns the folder and its captures."""
    spark = pages.sparkSession
    ship(spark)
    folder = fresh(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        fs.create_dir(path)
        name, out, at = "", None, 0
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                if out is None or at > file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                member = record(r["page_id"], r["url"] or "", r["payload"].encode("utf-8", "surrogatepass"), r["payload_bytes"], r["payload_digest"], r["refers_to"])
                out.write(member)
                found.append({"key": r["key"], "page_id": r["page_id"], "file": name, "offset": at, "length": len(member)})
                at += len(member)
            yield pa.RecordBatch.from_pylist(found, pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        if out is not None:
            out.close()

    rows = classified(pages).withColumn("key", surt(F.col("url")))
    return folder, stored(mapped(rows, write, "key string, page_id long, file string, offset long, length long"), "captures")


def build_index(folder: str, captures: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the two-level index; returns one row a file: part, first_key, first_page, last_key, last_page, n, dir_offset, dir_length."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        name, out, at, n, last, directory, lines = f"{uuid.uuid4().hex}.idx", None, 0, 0, ("", None), [], []

        def block() -> None:
            nonlocal out, at
            if out is None:
                fs.create_dir(path)
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
            data = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode("utf-8", "surrogatepass"), 6)
            directory.append((*lines[0][:2], at, len(data)))
            out.write(data)
            at += len(data)

        for batch in batches:
            for key, page_id, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append((key, page_id, file, offset, length))
                n, last = n + 1, (key, page_id)
                if len(lines) == block_lines:
                    block()
                    lines = []
        if lines:
            block()
        if out is not None:
            data = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(data)
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": name, "first_key": directory[0][0], "first_page": directory[0][1], "last_key": last[0], "last_page": last[1], "n": n, "dir_offset": at, "dir_length": len(data)}])

    c = captures.select("key", "page_id", "file", "offset", "length")
    # by page too, so that a URL that a third of all captures have is dealt over several files
    ranged = c.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    return stored(mapped(ranged, write, "part string, first_key string, first_page long, last_key string, last_page long, n long, dir_offset long, dir_length long"), "index")


def archive(pages: DataFrame) -> Archive:
    folder, captures = write_warc(pages)
    return Archive(folder, captures, build_index(folder, captures))


def _range(fs, name: str, offset: int, length: int) -> bytes:
    with fs.open_input_file(name) as f:
        return f.read_at(length, offset)


def _directory(fs, path: str, part: str, offset: int, length: int) -> list:
    return json.loads(zlib.decompress(_range(fs, f"{path}/{part}", offset, length)))


def _lines(data: bytes) -> list:
    return [json.loads(x) for x in zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n")]


_LINE = "key string, page_id long, file string, offset long, length long"
_LINE_ARROW = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def index_lines(a: Archive) -> DataFrame:
    """All lines of the index, read block by block."""
    folder = a.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        for batch in batches:
            for r in batch.to_pylist():
                for *_, offset, length in _directory(fs, path, r["part"], r["dir_offset"], r["dir_length"]):
                    got = _lines(_range(fs, f"{path}/{r['part']}", offset, length))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), _LINE_ARROW, strict=True)], schema=_LINE_ARROW)

    n = max(1, a.parts.count())
    return mapped(a.parts.repartition(n), read, _LINE)


def _order(key: str, page_id: int | None) -> tuple:
    """The index's order: by key, then page, null pages first."""
    return key, page_id is not None, page_id or 0


def lookup(a: Archive, urls: DataFrame, page_col: str | None = None) -> DataFrame:
    """The index lines of urls (url), or only of each url's page in page_col; what has no capture gives no row.

    A null URL finds null URLs' captures, a null page those of null pages; what is asked twice is found once. Questions are
    dealt out in the order of the index, so that a worker reads each directory and block once, and a URL that a third of
    all captures have is asked for page by page in several tasks. The table of index files is broadcast: one row a file,
    so no more than the tasks that wrote it. A worker bisects it, then the file's directory, then one block.
    """
    spark, folder = urls.sparkSession, a.folder
    table = sorted((tuple(r) for r in a.parts.select("first_key", "first_page", "last_key", "last_page", "part", "dir_offset", "dir_length").collect()), key=lambda x: _order(*x[:2]))
    shared = spark.sparkContext.broadcast(table)
    by_page = page_col is not None

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        table = shared.value
        # a URL without a page is before all its pages, and after the last one: ("key", False, -1) and ("key", True, infinity)
        firsts, lasts = [_order(*x[:2]) for x in table], [_order(*x[2:4]) for x in table]
        of_file: tuple = ("", [], [])
        of_block: tuple = ("", [], [])
        before = None
        for batch in batches:
            got: list = []
            for wanted, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (wanted, page) == before:  # equal questions are neighbours
                    continue
                before = wanted, page
                low, high = (_order(wanted, page),) * 2 if by_page else ((wanted, False, -1), (wanted, True, float("inf")))
                p = bisect_left(lasts, low)
                while p < len(table) and firsts[p] <= high:
                    part, at, length = table[p][4:]
                    if of_file[0] != part:
                        directory = _directory(fs, path, part, at, length)
                        of_file = part, directory, [_order(*x[:2]) for x in directory]
                    _, directory, starts = of_file
                    i = max(0, bisect_left(starts, low) - 1)
                    while i < len(directory) and starts[i] <= high:
                        if of_block[0] != (part, i):
                            lines = _lines(_range(fs, f"{path}/{part}", *directory[i][2:]))
                            of_block = (part, i), lines, [_order(*x[:2]) for x in lines]
                        _, lines, keys = of_block
                        k = bisect_left(keys, low)
                        while k < len(lines) and keys[k] <= high:
                            got.append(lines[k])
                            k += 1
                        i += 1
                    p += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True) if got else [()] * len(_LINE_ARROW), _LINE_ARROW, strict=True)], schema=_LINE_ARROW)

    page = F.col(page_col).cast("long") if by_page else F.lit(None).cast("long")
    keys = urls.select(surt(F.col("url").cast("string")).alias("wanted"), page.alias("page")).repartitionByRange("wanted", "page").sortWithinPartitions("wanted", "page")
    return mapped(keys, find, _LINE)


def read_records(a: Archive, lines: DataFrame, with_payload: bool = False) -> DataFrame:
    """Range-read the records that index lines name: page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload].

    Lines are dealt out by archive file (of bounded size) and read in order of offset. The digest of a response
    is computed from its bytes and must equal its header's.
    """
    schema = _FIELDS + (", payload binary" if with_payload else "")
    folder = a.folder
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        name, f = "", None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["file"] != name:
                    if f is not None:
                        f.close()
                    name, f = r["file"], fs.open_input_file(f"{path}/{r['file']}")
                fields, size, payload = parsed(f.read_at(r["length"], r["offset"]))
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                    raise ValueError(f"damaged record in {name} at {r['offset']}")
                row = {"page_id": _number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _number(fields["WARC-Refers-To"]) if kind == "revisit" else None}
                out.append(row | ({"payload": payload} if with_payload else {}))
            yield pa.RecordBatch.from_pylist(out, arrow)
        if f is not None:
            f.close()

    return mapped(lines.repartition("file").sortWithinPartitions("file", "offset"), read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive pages (page_id, url, html), then look every page up in the index and read its records back.

    Null html is an empty payload; a null page_id is kept, ranks below all others and, in a group of nulls
    alone, every row is a response; rows that repeat the kept page_id and payload are responses too. Null or
    odd URLs get a key of their raw text (control characters in a URL come back escaped); a null URL comes
    back empty. Empty tables give no rows; other columns are ignored.
    """
    a = archive(pages)
    return read_records(a, lookup(a, pages, "page_id"))
