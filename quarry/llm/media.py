"""Media columns: content-defined chunking with a deduplicated chunk store.

Payload: the text's UTF-8 bytes, padded with bytes 255 to a positive multiple of 576.
A gear hash rolls over the payload (the last 32 bytes decide), a cut falls where its
upper bits are zero, chunks keep between MIN and MAX bytes. A chunk is stored as one
zstd frame under its digest (first 16 bytes of SHA-256).

The store has two tables. Digests are counted by a Spark aggregation; those that occur
more than once mark a bitmap of 16 bits or more for each, which the executors get. Chunks
outside the bitmap are certainly unique and are written with their document's ordered
chunk list (`packs`), without a shuffle; all others are written once each (`shared`)
after deduplication by digest. A false mark only sends a unique chunk through the second
way. The bitmap stops at MOST_BITS (32 MB); beyond some 17 million repeated chunks false
marks grow, until every chunk is shuffled once, compressed.

Reading back joins chunk lists with shared chunks by digest, puts the chunks of a
payload in order, and checks its SHA-256 against the one taken at writing; a mismatch
or a missing chunk raises. Equal payloads are read back once.

Stored form of a payload: `CDC1`, number of chunks, then digest and stored length of
each (little-endian), then the frames; equal texts have equal stored forms.

A null text counts as empty: one payload of 576 bytes 255. Repeated rows give repeated
rows, equal texts equal values; nothing depends on an order, so there are no ties. Very
long texts are stored whole, in more chunks. Ids are integers or null. Empty tables give
empty results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cut, map_arrow, remove, shared_dir, table
from quarry.llm.graph import FLOOR, HOT

FRAME = 576
MIN, MAX = 1024, 16384
#: A cut falls where these upper bits of the hash are zero: every 4096 bytes beyond MIN on average.
MASK = np.uint32(0xFFF00000)
GEAR = np.array([xxhash.xxh32_intdigest(bytes([i]), 576) for i in range(256)], np.uint32)
#: The bitmap has between 2**LEAST_BITS and 2**MOST_BITS bits.
LEAST_BITS, MOST_BITS = 16, 28
LEVEL = 3


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: sum of GEAR[byte k back] << k, modulo 2**32, by doubling the span."""
    h = GEAR[data]
    span = 1
    while span < 32:
        h[span:] += h[:-span] << np.uint32(span)  # the right side is a new array
        span *= 2
    return h


def chunks(data: bytes) -> list[bytes]:
    if len(data) <= MIN:
        return [data]
    cuts = np.nonzero((gear(np.frombuffer(data, np.uint8)) & MASK) == 0)[0] + 1
    out, at = [], 0
    while len(data) - at > MIN:
        k = int(np.searchsorted(cuts, at + MIN))
        to = min(int(cuts[k]) if k < len(cuts) else len(data), at + MAX, len(data))
        out.append(data[at:to])
        at = to
    if at < len(data):
        out.append(data[at:])
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:16]


def stored(digests: list[bytes], frames: list[bytes]) -> bytes:
    return b"CDC1" + struct.pack("<I", len(frames)) + b"".join(d + struct.pack("<I", len(f)) for d, f in zip(digests, frames, strict=True)) + b"".join(frames)


def feature(data: bytes, n_chunks: int) -> str:
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = counts[counts > 0] / len(data)
    return f"chunks={n_chunks};mean={float(counts @ np.arange(256)) / len(data):.3f};entropy={float(-(p * np.log2(p)).sum()):.4f};distinct={len(p)}"


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload, digests): payload is the payload's SHA-256, digests the ordered chunk list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                rows = batch.slice(part, 500)
                loads = [payload(t) for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([n for n, _ in loads], pa.int64()), pa.array([hashlib.sha256(d).digest() for _, d in loads], pa.binary()), pa.array([[digest(c) for c in chunks(d)] for _, d in loads], pa.list_(pa.binary()))],
                    names=["doc_id", "n_bytes", "payload", "digests"],
                )

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_bytes long, payload binary, digests array<binary>")


def repeated(listed: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """A bitmap of the digests that occur more than once, sized by their number."""
    digests = listed.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    seen = cut(digests.select(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long").alias("at")))
    bits = min(most_bits, max(LEAST_BITS, (16 * seen.count()).bit_length()))
    at = F.col("at").bitwiseAND(F.lit((1 << bits) - 1))
    places = seen.select(F.shiftright(at, 3).alias("byte"), at.bitwiseAND(F.lit(7)).cast("int").alias("bit"))
    got = places.groupBy("byte").agg(F.bit_or(F.expr("shiftleft(1, bit)")).cast("short").alias("mask")).toArrow()
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    bitmap[got["byte"].to_numpy()] = got["mask"].to_numpy()
    return bitmap


def marked(bitmap: np.ndarray, d: bytes) -> bool:
    at = int.from_bytes(d[:4], "big") & (8 * len(bitmap) - 1)
    return bool(bitmap[at >> 3] >> (at & 7) & 1)


def write_store(docs: DataFrame, listed: DataFrame, path: str) -> None:
    """Writes path/packs (payload, digests, own: frames of unique chunks by place) and path/shared (digest, frame)."""
    shared = docs.sparkSession.sparkContext.broadcast(repeated(listed))
    texts = docs.select(F.col("text").cast("string"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                out: tuple[list, list, list] = ([], [], [])
                for text in batch.column(0).slice(part, 500).to_pylist():
                    data = payload(text)[1]
                    cs = chunks(data)
                    ds = [digest(c) for c in cs]
                    out[0].append(hashlib.sha256(data).digest())
                    out[1].append(ds)
                    out[2].append([None if marked(shared.value, d) else z.compress(c) for c, d in zip(cs, ds, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.list_(pa.binary())), pa.array(out[2], pa.list_(pa.binary()))], names=["payload", "digests", "own"])

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                out: dict[bytes, bytes] = {}
                for text in batch.column(0).slice(part, 500).to_pylist():
                    for c in chunks(payload(text)[1]):
                        if marked(shared.value, d := digest(c)) and d not in out:
                            out[d] = z.compress(c)
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], names=["digest", "frame"])

    map_arrow(texts, pack, "payload binary, digests array<binary>, own array<binary>").write.option("compression", "none").parquet(f"{path}/packs")
    map_arrow(texts, share, "digest binary, frame binary").dropDuplicates(["digest"]).write.option("compression", "none").parquet(f"{path}/shared")


RESULT = "payload binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (payload, digests, frames) to RESULT."""
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        for part in range(0, batch.num_rows, 500):
            out: list[tuple] = []
            for key, ds, frames in zip(*(batch.column(i).slice(part, 500).to_pylist() for i in range(3)), strict=True):
                cs = [z.decompress(f) for f in frames]
                data = b"".join(cs)
                if [digest(c) for c in cs] != ds or hashlib.sha256(data).digest() != key:
                    raise ValueError(f"payload {key.hex()} isn't what was stored")
                kept = stored(ds, frames)
                out.append((key, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(kept), hashlib.sha256(kept).hexdigest(), feature(data, len(cs))))
            kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in RESULT.split(", ")])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """One row for each stored payload, restored from its chunks and verified."""
    packs = spark.read.parquet(f"{path}/packs")
    lacks = F.exists("own", lambda f: f.isNull())
    whole = packs.where(~lacks).select("payload", "digests", F.col("own").alias("frames"))
    part = packs.where(lacks).select("payload", F.posexplode(F.arrays_zip("digests", "own")).alias("place", "chunk")).select("payload", "place", F.col("chunk.digests").alias("digest"), F.col("chunk.own").alias("frame"))
    # payloads that occur more than once have no chunk of their own, so only digests need deduplication
    wanted = part.where(F.col("frame").isNull()).select("payload", "place", "digest").distinct()
    fetched = wanted.join(spark.read.parquet(f"{path}/shared"), "digest", "left").select("payload", "place", "digest", "frame")
    rows = fetched.unionByName(part.where(F.col("frame").isNotNull()))
    ordered = F.sort_array(F.collect_list(F.struct("place", "digest", "frame")))
    joined = rows.groupBy("payload").agg(ordered.alias("cs")).select("payload", F.col("cs.digest").alias("digests"), F.col("cs.frame").alias("frames"))
    return map_arrow(whole, _restore, RESULT).unionAll(map_arrow(joined, _restore, RESULT))


def chunked(docs: DataFrame, path: str) -> DataFrame:
    """Stores the texts of docs (doc_id, text) under path, reads them back, and returns a row for each document."""
    listed = cut(manifest(docs))
    write_store(docs, listed, path)
    # computed once here, so that the result doesn't read the store again
    restored = cut(read_store(docs.sparkSession, path))
    own, total = listed.select("doc_id", "n_bytes", "payload"), listed.count()
    # fewer than HOT payloads are those of so many documents; their rows are broadcast and the documents stay where they are
    hot = cut(own.groupBy("payload").agg(F.count("*").alias("n")).where(F.col("n") > max(float(FLOOR), total / HOT)).select("payload"))
    if hot.isEmpty():
        return own.join(restored, "payload").drop("payload")
    parts = [own.join(F.broadcast(restored.join(F.broadcast(hot), "payload", "left_semi")), "payload"), own.join(F.broadcast(hot), "payload", "left_anti").join(restored, "payload")]
    return parts[0].unionByName(parts[1]).drop("payload")


def op4_chunked_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/chunk-store-{uuid.uuid4().hex}"
    out = chunked(table(spark, sf_dir, "documents", "doc_id", "text"), path)
    # all is read back by now
    remove(spark, path)
    return out


QUERIES = {"op4_chunked_payloads": op4_chunked_payloads}
ORACLES: dict[str, str] = {}
