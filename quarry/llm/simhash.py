"""SimHash near-duplicates with pivot distance tables.

Fingerprint: words are split at ASCII white space after lower-casing A-Z, shingles of
`shingle` words (repeats included; fewer words make one shingle) are hashed with
XXH64 (seed 42), and a bit is 1 if set in over half of the hashes. No word:
fingerprint zero, linked like any other.

Links: fingerprints that differ in at most `radius` bits. Each distinct fingerprint has
a table of Hamming distances to PIVOTS reference fingerprints. Two fingerprints k bits
apart have distances to each pivot that differ by at most k and by a number of k's
parity. Two within the radius also agree in one of radius + 1 blocks of bits. So a
block of more than DENSE fingerprints is split into cells, one for each tuple of
distances to the first KEYED pivots, and each fingerprint meets its own cell and those
cells whose distances differ by what the radius and the parity allow. Other blocks are
one cell. A pair that meets is discarded if its distances to any pivot differ by more
than the radius, and survivors are verified bit by bit.

A cell of more than CROWD fingerprints would pair quadratically. Its members, and all
that would meet it, are linked through keys of flipped bits instead: two fingerprints
are within the radius exactly if flipping at most radius // 2 bits of one and at most
(radius + 1) // 2 of the other gives one key; all that share a key link to its smallest
fingerprint of the first kind. This last resort is exact and linear for every radius.
Components come from star contraction; equal fingerprints count as one node.

Null texts have no words. A null id takes part, but is never a component's id unless
the component has no other. Ids are integers. Empty tables give empty results. Repeated
rows return repeated rows, equal texts equal fingerprints; nothing depends on an order,
so there are no ties. Very long texts are taken whole. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cut, map_arrow, table
from quarry.llm.graph import components

SHINGLE, RADIUS = 3, 2
SEED = 42
#: The reference fingerprints, by rule.
PIVOTS = tuple(xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(16))
#: Blocks of more fingerprints than DENSE are split by the distances to the first KEYED pivots.
DENSE, KEYED = 128, 3
#: A cell of more fingerprints than this is linked by flipped keys.
CROWD = 128

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)
_LANES = np.uint64(0x0101010101010101)


def shingles(text: str | None, k: int) -> list[bytes]:
    words = (text or "").encode().lower().split()
    if len(words) < k:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))


def fingerprints(texts: list[str | None], k: int = SHINGLE) -> np.ndarray:
    """uint64 fingerprints."""
    return majority([np.fromiter(map(_hash, s), np.uint64, len(s)) for s in (shingles(t, k) for t in texts)])


def majority(each: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each array of hashes. Bits are counted in eight byte lanes at a time, over runs of at most 255 hashes."""
    sizes = np.array([len(x) for x in each], np.int64)
    out = np.zeros(len(each), np.uint64)
    full = np.nonzero(sizes)[0]
    if not len(full):
        return out
    flat = np.concatenate([each[i] for i in full])
    sizes = sizes[full]
    begin = np.cumsum(sizes) - sizes
    runs = -(-sizes // 255)
    first = np.cumsum(runs) - runs
    starts = np.repeat(begin, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    for bit in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(bit)) & _LANES, starts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts = np.add.reduceat(lanes, first, axis=0)
        ones = (2 * counts > sizes[:, None]).astype(np.uint64)
        for lane in range(8):
            out[full] |= ones[:, lane] << np.uint64(bit + 8 * lane)
    return out


def fingerprinted(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for (doc_id, text); fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                rows = batch.slice(part, 1000)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fingerprints(rows.column(1).to_pylist(), k).view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp long")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 blocks that make up 64 bits."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def with_pivot_table(fps: DataFrame, pivots: tuple[int, ...] = PIVOTS, *kept: str) -> DataFrame:
    """fp, the kept columns and p0, p1, ...: the distances to the reference fingerprints."""
    return fps.select("fp", *kept, *(F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(p)))).cast("byte").alias(f"p{i}") for i, p in enumerate(pivots)))


def block_keys(radius: int) -> Column:
    return F.array(*(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)) * (radius + 1) + i for i, (shift, width) in enumerate(blocks(radius))))


def steps(radius: int, keyed: int) -> list[tuple[int, ...]]:
    """The differences of `keyed` distances that two fingerprints within `radius` bits can have; one of each and its opposite, and none of all zeros."""
    reached = {t for k in (radius, radius - 1) if k >= 0 for t in product(range(-k, k + 1, 2), repeat=keyed)}
    return sorted(t for t in reached if t > (0,) * keyed)


def cells(radius: int, dense: int, keyed: int) -> Column:
    """For a row (key, n, p0, ...): its own cell, and in dense blocks the cells to meet. Clashing hashes only make a few more pairs to discard."""
    at = lambda step: F.xxhash64("key", *(F.col(f"p{i}") + F.lit(d).cast("byte") for i, d in enumerate(step)))
    cell = lambda value, own: F.struct(value.alias("cell"), F.lit(own).alias("own"))
    many = F.array(cell(at((0,) * keyed), True), *(cell(at(s), False) for s in steps(radius, keyed)))
    return F.when(F.col("n") > dense, many).otherwise(F.array(cell(F.xxhash64("key"), True)))


def within(radius: int, pivots: int) -> Column:
    """The pair (a, b) survives the pivot table and differs in at most `radius` bits."""
    out = F.lit(True)
    for i in range(pivots):
        out = out & (F.abs(F.col(f"a.p{i}") - F.col(f"b.p{i}")) <= radius)
    return out & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius)


def filed(fps: DataFrame, radius: int = RADIUS, dense: int = DENSE, pivots: tuple[int, ...] = PIVOTS, keyed: int = KEYED) -> DataFrame:
    """(fp, p0, ..., cell, own): the pivot table by cell; own is false in the cells that a fingerprint only meets."""
    rows = fps.select("fp", F.explode(block_keys(radius)).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = with_pivot_table(rows.join(sizes, "key"), pivots, "key", "n")
    return rows.withColumn("at", F.explode(cells(radius, dense, keyed))).select("fp", *(f"p{i}" for i in range(len(pivots))), "at.*")


def candidates(rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of filed rows that meet."""
    return rows.alias("a").join(rows.where("own").alias("b"), (F.col("a.cell") == F.col("b.cell")) & (~F.col("a.own") | (F.col("a.fp") < F.col("b.fp"))))


def links(fps: DataFrame, radius: int = RADIUS, dense: int = DENSE, crowd: int = CROWD, pivots: tuple[int, ...] = PIVOTS, keyed: int = KEYED) -> DataFrame:
    """(a, b), a < b: enough links between the distinct fingerprints of fps to connect all that are within `radius` bits.

    Outside crowded cells these are all the pairs.
    """
    rows = cut(filed(fps, radius, dense, pivots, min(keyed, len(pivots))))
    crowds = cut(rows.where("own").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("cell"))
    full = not crowds.isEmpty()
    met = candidates(rows.join(crowds, "cell", "left_anti") if full else rows).where(within(radius, len(pivots)))
    out = met.select(F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b"))
    if full:
        out = out.unionAll(crowded_links(rows.join(crowds, "cell", "left_semi").select("fp").distinct(), radius))
    return out.distinct()


def crowded_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links to the smallest fingerprint that makes the same key by flipping at most radius // 2 bits; the others may flip (radius + 1) // 2."""
    masks = [(sum(1 << i for i in bits), n) for n in range((radius + 1) // 2 + 1) for bits in combinations(range(64), n)]
    flips = F.array(*(F.struct(F.lit(signed(m)).alias("mask"), F.lit(n <= radius // 2).alias("first")) for m, n in masks))
    keys = fps.select("fp", F.explode(flips).alias("flip")).select("fp", "flip.first", F.col("fp").bitwiseXOR(F.col("flip.mask")).alias("key"))
    least = keys.groupBy("key").agg(F.min(F.when(F.col("first"), F.col("fp"))).alias("head"), F.count("*").alias("n")).where("n > 1 AND head IS NOT NULL").select("key", "head")
    return keys.join(least, "key").where("fp <> head").select(F.least("fp", "head").alias("a"), F.greatest("fp", "head").alias("b"))


def grouped(marked: DataFrame, radius: int = RADIUS, dense: int = DENSE, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp) -> (doc_id, fp, component_id); marked must be cheap to read twice."""
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(fps.select("fp"), radius, dense, crowd), "a", "b")
    classes = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = cut(classes.join(ids, "root").select("fp", "component_id"))
    return marked.join(labels, "fp").select("doc_id", "fp", "component_id")


def op8_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = cut(fingerprinted(table(spark, sf_dir, "documents", "doc_id", "text")))
    return grouped(marked).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_pivot_simhash": op8_pivot_simhash}
ORACLES: dict[str, str] = {}
