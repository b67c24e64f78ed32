"""WARC archives with a two-level capture index.

`archived` writes a record for every page into gzip members of WARC/1.1 files. Of pages with
equal payloads that with the smallest id is a response, all others are revisits that refer
to it (profile identical-payload-digest) and hold no payload. Equality is that of SHA-256; a
digest with many copies is one row of an aggregation, and neither its pages nor their
payloads are gathered. The table of repeated payloads is broadcast up to FEW rows; beyond
that, pages meet it by digest, hot digests apart.

The index has a line for each record, sorted by the key of its url (host reversed by
labels, `com,example,www)/path`) and page. Ranges of keys are index files; each is written as
compressed blocks of LINES lines and a sparse directory beside it, which has the first key,
place and length of every block. `looked_up` sorts what is asked, bisects the first keys of
the index files (of which there is one in a million lines), then the file's directory, reads
the ranges of the blocks that may hold the key and bisects their lines. `read_back` reads
the records' ranges, neighbours together, checks length and digest of every payload and
raises if one differs. A task that is run again writes files of new names; those that no
result names are removed.

The folder must be one that pyarrow opens too (file, hdfs, s3, gs), shared by all executors.
Payloads are the html in UTF-8, null as empty. A null id is larger than any other: such pages
are responses only where no page of that payload has an id. Repeated rows of the smallest
id are all responses. A null url, or one without `://`, has no host. Bytes that a header
can't hold are escaped in the url, very long payloads are stored whole. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cut, map_arrow, remove, shared_dir, table
from quarry.llm.graph import matched
from quarry.sources.checkpoints import qualified

#: Payloads of fewer bytes are never revisits.
LEAST = 0
#: The pages have no time of their own.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes after which a task begins another archive, and those of an archive that one task reads back.
ARCHIVE, SEGMENT = 1 << 30, 32 << 20
#: Lines of a block, and of an index file at most on average.
LINES, PER_FILE = 1_000, 1_000_000
#: Bytes read at once, and bytes between two records that are read along.
SPAN, GAP = 8 << 20, 1 << 16
LEVEL = 3
#: Repeated payloads up to which they are broadcast.
FEW = 200_000

RECORDS = "key string, page_id long, file string, offset long, length long, type string, digest string"
Place = tuple[bytes, tuple[int, int]]


def url_key(url: Column) -> Column:
    """Host labels from the last to the first, lower case, then the rest without fragment."""
    url = F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", "")
    has = url.contains("://")
    rest = F.when(has, F.regexp_replace(url, "^.*?://[^/?]*", "")).otherwise(url)
    host = F.when(has, F.lower(F.regexp_extract(url, "://([^/?]*)", 1))).otherwise("")
    return F.regexp_replace(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), r"[\x00-\x20\x7f]", "%20")


def _place(key: str, page_id: int | None) -> Place:
    return key.encode(), (0, 0) if page_id is None else (1, page_id)


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> tuple[bytes, str]:
    """A record, uncompressed, and the payload's digest."""
    digest = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
    name = lambda kind, i: uuid.uuid5(uuid.NAMESPACE_URL, f"{kind}:{i}:{digest}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:uuid:{name('revisit' if revisit else 'response', page_id)}>", "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or ""), "WARC-Payload-Digest": f"sha1:{digest}", "Page-ID": "" if page_id is None else str(page_id),
        **({"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:uuid:{name('response', first)}>", "Refers-To-Page-ID": str(first)} if revisit else {}),
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n", digest


def parsed(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to. Raises if the payload isn't what its record says."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
    block = rest[: int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest, page = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["Page-ID"]
    if head["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode() != digest) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"page {page}: the archive's record is damaged")
    return int(page) if page else None, size, digest, head["WARC-Type"], int(head["Refers-To-Page-ID"]) if "Refers-To-Page-ID" in head else None


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))


def _packed(raw: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _writer(folder: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes the task's pages to archives; gives a row for each record."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _opened(folder)
        out, name, at = None, "", 0
        info = _packed(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC/1.1\r\n\r\n\r\n".encode())
        for b in batches:
            rows: list[tuple] = []
            for key, page_id, url, payload, first, revisit in zip(*b.columns, strict=True):
                if out is None or at >= ARCHIVE:
                    if out:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(info)
                    at = len(info)
                raw, digest = record(page_id.as_py(), url.as_py(), payload.as_py(), first.as_py(), revisit.as_py())
                data = _packed(raw)
                out.write(data)
                rows.append((key.as_py(), page_id.as_py(), name, at, len(data), "revisit" if revisit.as_py() else "response", digest))
                at += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RECORDS.types, strict=True)], schema=_RECORDS)
        if out:
            out.close()

    return write


_RECORDS = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("digest", pa.string())])
_INDEX = "name string, key string, page_id long, lines long"


def _indexer(folder: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes the task's sorted records as an index file of compressed blocks and its directory; gives a row for the file."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _opened(folder)
        name, at, total, first = uuid.uuid4().hex, 0, 0, None
        out, held, directory = None, [], []

        def flush() -> None:
            nonlocal at, held
            data = _packed("".join(f"{'\t'.join('' if v is None else str(v) for v in r)}\n" for r in held).encode())
            out.write(data)
            directory.append((*held[0][:2], at, len(data)))
            at, held = at + len(data), []

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    out, first = system.open_output_stream(f"{path}/{name}.cdx.gz", compression=None), row
                held.append(row)
                total += 1
                if len(held) == LINES:
                    flush()
        if out:
            if held:
                flush()
            out.close()
            with system.open_output_stream(f"{path}/{name}.dir.gz", compression=None) as f:
                f.write(_packed("".join(f"{'\t'.join('' if v is None else str(v) for v in r)}\n" for r in directory).encode()))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first[0]]), pa.array([first[1]], pa.int64()), pa.array([total], pa.int64())], names=["name", "key", "page_id", "lines"])

    return write


@dataclass(frozen=True)
class Archive:
    """The folders of archives and index files, and the index files' first places in order."""

    records: str
    index: str
    files: tuple[tuple[Place, str], ...]
    #: Bytes of all archives.
    size: int


def deduplicated(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """key, page_id, url, payload, first and revisit of pages (page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("sha"))
    counts = rows.select("sha", "page_id").groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    counts = cut(counts)
    total, repeated = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0))).first()
    if repeated <= FEW:
        rows = rows.join(F.broadcast(counts.where("n > 1").drop("n")), "sha", "left")
    else:
        rows = matched(rows, counts, "sha", "n", total)
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")) & (F.length("payload") >= least)
    return rows.select("key", "page_id", "url", "payload", F.when(revisit, F.col("first")).alias("first"), revisit.alias("revisit"))


def _left_over(spark: SparkSession, folder: str, names: set[str]) -> None:
    """Removes files of tasks that were run again."""
    for r in spark.read.format("binaryFile").load(folder).select("path").toLocalIterator():
        if r.path.rpartition("/")[2] not in names:
            remove(spark, r.path)


def archived(pages: DataFrame, folder: str, least: int = LEAST) -> Archive:
    """Writes pages (page_id, url, html) and their index into folder."""
    spark = pages.sparkSession
    at = {kind: qualified(spark, f"{folder}/{kind}") for kind in ("records", "index")}
    for path in at.values():
        system, bare = _opened(path)
        system.create_dir(bare, recursive=True)
    records = cut(map_arrow(deduplicated(pages, least), _writer(at["records"]), RECORDS))
    _left_over(spark, at["records"], {r.file for r in records.select("file").distinct().toLocalIterator()})
    lines, size = records.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines // PER_FILE + 1)
    # pages of one url are dealt by page
    dealt = records.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    files = map_arrow(dealt, _indexer(at["index"]), _INDEX).collect()
    _left_over(spark, at["index"], {f"{r.name}.{kind}.gz" for r in files for kind in ("cdx", "dir")})
    return Archive(at["records"], at["index"], tuple(sorted((_place(r.key, r.page_id), r.name) for r in files)), size)


class Search:
    """Reads blocks of index files by ranges; the last directory and block are kept, as what is asked comes in order."""

    def __init__(self, archive: Archive) -> None:
        self.system, self.path = _opened(archive.index)
        self.firsts, self.names = [f for f, _ in archive.files], [n for _, n in archive.files]
        self.name, self.directory, self.block = None, [], (None, None)
        #: Directories and blocks read so far.
        self.reads = [0, 0]

    def _open(self, name: str) -> list[tuple[Place, int, int]]:
        if name != self.name:
            with self.system.open_input_file(f"{self.path}/{name}.dir.gz") as f:
                lines = zlib.decompress(f.read(), 31).decode().split("\n")[:-1]
            parts = [x.split("\t") for x in lines]
            self.directory = [(_place(k, int(p) if p else None), int(at), int(size)) for k, p, at, size in parts]
            self.name = name
            self.reads[0] += 1
        return self.directory

    def _lines(self, name: str, at: int, size: int) -> tuple[list[Place], list[list[str]]]:
        if self.block[0] != (name, at):
            with self.system.open_input_file(f"{self.path}/{name}.cdx.gz") as f:
                lines = zlib.decompress(f.read_at(size, at), 31).decode().split("\n")[:-1]
            rows = [x.split("\t") for x in lines]
            self.block = ((name, at), ([_place(r[0], int(r[1]) if r[1] else None) for r in rows], rows))
            self.reads[1] += 1
        return self.block[1]

    def between(self, low: Place, high: Place) -> Iterator[list[str]]:
        """Index lines from low to high."""
        for i in range(max(0, bisect_left(self.firsts, low) - 1), bisect_right(self.firsts, high)):
            directory = self._open(self.names[i])
            begins = [d[0] for d in directory]
            for j in range(max(0, bisect_left(begins, low) - 1), bisect_right(begins, high)):
                places, rows = self._lines(self.names[i], *directory[j][1:])
                yield from rows[bisect_left(places, low) : bisect_right(places, high)]


def _finder(archive: Archive, by_page: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(archive)
        for b in batches:
            out: list[tuple] = []
            for key, *page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                low, high = (_place(key, page[0]),) * 2 if by_page else ((key.encode(), (0, 0)), (key.encode(), (2, 0)))
                for k, p, file, at, size, kind, digest in search.between(low, high):
                    out.append((k, int(p) if p else None, file, int(at), int(size), kind, digest))
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _RECORDS.types, strict=True)], schema=_RECORDS)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _RECORDS.types, strict=True)], schema=_RECORDS)

    return find


def looked_up(archive: Archive, asked: DataFrame) -> DataFrame:
    """RECORDS of the captures of asked urls (url), or of single pages of them (url, page_id). Each capture once, however often it is asked."""
    by_page = "page_id" in asked.columns
    columns = [url_key(F.col("url")).alias("key"), *([F.col("page_id").cast("long").alias("page_id")] if by_page else [])]
    keys = asked.select(*columns).distinct()
    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartitionByRange(n, *keys.columns).sortWithinPartitions(*keys.columns)
    return map_arrow(dealt, _finder(archive, by_page), RECORDS)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _reader(archive: Archive) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads records by ranges, neighbours together; they come by file and offset."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _opened(archive.records)
        name, source = None, None
        for b in batches:
            rows: list[tuple] = []
            places = list(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            i = 0
            while i < len(places):
                file, begin, size = places[i]
                end, j = begin + size, i + 1
                while j < len(places) and places[j][0] == file and end <= places[j][1] <= end + GAP and places[j][1] + places[j][2] - begin <= SPAN:
                    end = places[j][1] + places[j][2]
                    j += 1
                if file != name:
                    if source:
                        source.close()
                    name, source = file, system.open_input_file(f"{path}/{file}")
                data = source.read_at(end - begin, begin)
                rows += [parsed(zlib.decompress(data[at - begin : at - begin + n], 31)) for _, at, n in places[i:j]]
                i = j
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in READ.split(", ")])
        if source:
            source.close()

    return read


def read_back(archive: Archive, records: DataFrame) -> DataFrame:
    """READ of records (file, offset, length), from the archives. A damaged record raises."""
    places = records.select("file", "offset", "length", F.floor(F.col("offset") / SEGMENT).alias("segment"))
    # a given number of tasks, as the few bytes of places say nothing of the bytes that they name
    n = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), archive.size // SEGMENT + 1)
    return map_arrow(places.repartition(n, "file", "segment").sortWithinPartitions("file", "offset").select("file", "offset", "length"), _reader(archive), READ)


def op13_two_level_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    archive = archived(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return read_back(archive, looked_up(archive, pages.select("url", "page_id")))


QUERIES = {"op13_two_level_index": op13_two_level_index}
ORACLES: dict[str, str] = {}
