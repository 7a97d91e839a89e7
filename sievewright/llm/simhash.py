"""SimHash near-duplicates: fingerprints linked within a Hamming radius through a segment-popcount grid.

A fingerprint is embedded as the vector of bit counts of its 16 four-bit segments. The Manhattan distance of two such
vectors never exceeds the Hamming distance of the fingerprints, so fingerprints within 2 bits lie within 2 steps on
the grid and share a grid cell within one step of each. The range join is therefore an equi-join on those cells (33
rows a fingerprint at most); cells with a single fingerprint drop out. What is left is verified exactly and linearly:
two fingerprints differ in 2 bits or fewer if and only if some 64-bit value is within one bit of both, so rows meet
on that value and each group (65 members at most) becomes a star. No step lists the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, arrow_map, components, ids_and_texts, without

SEED, SHINGLE, RADIUS = 42, 3, 2
SEGMENTS, SEGMENT_BITS = 16, 4
#: For a wide radius: first bits of the parts. Of 14 differing bits one of five parts has two at most.
PART_RADIUS, PARTS, PART_SEGMENT_BITS = 14, (0, 12, 24, 36, 50, 64), 2
_AT_ONCE = 1 << 14


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of UTF-8 bytes: a bit is set if it is set in over half the shingle hashes; no words: 0."""
    w = text.lower().split()
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else iter([b" ".join(w)])
    n, h = 0, np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    while block := [digest(g, SEED) for g in islice(grams, _AT_ONCE)]:
        bits = np.unpackbits(np.array(block, "<u8").view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little")
        h += bits.sum(axis=0, dtype=np.uint32)
        n += len(block)
    return int(np.packbits(2 * h > n, bitorder="little").view("<u8")[0])


def of_hashes(hashes: np.ndarray) -> int:
    """The SimHash of 64-bit hashes as a signed long: a bit is set if it is set in over half of them; of none: 0."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _AT_ONCE):
        block = hashes[at : at + _AT_ONCE].astype("<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t) for t in b.column("text").cast(pa.binary()).to_pylist()], "<u8")
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp as a signed long. Null texts count as empty."""
    return arrow_map(ids_and_texts(docs), _fingerprints, "doc_id long, fp long")


def grid_cells(fps: DataFrame) -> DataFrame:
    """(fp, cell): the grid cells within one step of each fingerprint's popcount vector."""
    count = [F.bit_count(F.shiftrightunsigned("fp", SEGMENT_BITS * i).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))).cast("long") for i in range(SEGMENTS)]
    at = fps.select("fp", *[c.alias(f"p{i}") for i, c in enumerate(count)])
    key = sum((F.col(f"p{i}") * F.lit(1 << (3 * i)) for i in range(SEGMENTS)), F.lit(0).cast("long"))
    at = at.withColumn("key", key)
    steps = [F.col("key")]
    for i in range(SEGMENTS):
        steps.append(F.when(F.col(f"p{i}") < SEGMENT_BITS, F.col("key") + F.lit(1 << (3 * i))))
        steps.append(F.when(F.col(f"p{i}") > 0, F.col("key") - F.lit(1 << (3 * i))))
    return at.select("fp", F.explode(F.array_compact(F.array(*steps))).alias("cell"))


def _popcounts(lo: int, hi: int) -> list[Column]:
    at = F.lit((1 << PART_SEGMENT_BITS) - 1)
    return [F.bit_count(F.shiftrightunsigned("fp", i).bitwiseAND(at)).cast("long") for i in range(lo, hi, PART_SEGMENT_BITS)]


def _part_keys() -> list[Column]:
    """Of each part the popcounts of its segments, as digits of two bits below 2**14, and the part's number from 2**14."""
    return [sum((c * F.lit(1 << 2 * i) for i, c in enumerate(_popcounts(lo, hi))), F.lit(p << 14).cast("long")) for p, (lo, hi) in enumerate(zip(PARTS, PARTS[1:]))]


def part_cells() -> Column:
    """Of a column fp: for each part the grid cells within one step of its popcount vector.

    Fingerprints within PART_RADIUS bits have a part with two differing bits at most, so that its popcount vectors lie
    within two steps and share a cell, as in ``grid_cells``; vectors further apart share none.
    """
    cells = []
    for key, lo, hi in zip(_part_keys(), PARTS, PARTS[1:]):
        cells.append(key)
        for i, c in enumerate(_popcounts(lo, hi)):
            cells.append(F.when(c < PART_SEGMENT_BITS, key + F.lit(1 << 2 * i)))
            cells.append(F.when(c > 0, key - F.lit(1 << 2 * i)))
    return F.array_compact(F.array(*cells))


def part_pairs() -> list[Column]:
    """Of a column fp: for each two parts the popcounts of both."""
    return [F.shiftleft(a, 17).bitwiseOR(b) for a, b in combinations(_part_keys(), 2)]


def links(fps: DataFrame, stage: Stage) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of 2 differing bits or fewer: a star for each shared value."""
    cells = grid_cells(fps)
    shared = cells.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("cell")
    near = stage.keep(cells.join(shared.hint("merge"), "cell", "left_semi").select("fp").distinct(), "near")
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)])
    mid = near.select("fp", F.explode(flips).alias("mid"))
    hub = mid.groupBy("mid").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("mid", "lo")
    met = mid.join(hub.hint("merge"), "mid").where("fp <> lo").select(F.col("fp").alias("a"), F.col("lo").alias("b")).distinct()
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: component_id is the smallest linked doc_id.

    Null texts count as empty, and documents without words share the fingerprint zero. A null doc_id keeps its row and
    never becomes a component's id unless the component has no other. Repeated rows are returned as often as given.
    """
    stage = Stage(spark, "simhash")
    fp = stage.keep(fingerprints(docs), "fp")
    least = stage.keep(fp.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "least")
    comp = components(links(least.select("fp"), stage), stage)
    labelled = least.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    first = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labels = labelled.join(first, "component").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fp.join(labels, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates: of each group the row with the smallest doc_id stays.

    Columns are those of docs. Empty texts form one group. Rows with a null doc_id stay. Repeated rows (one doc_id
    more than once) all stay if that doc_id is its group's first.
    """
    return without(docs, near_duplicates(spark, docs).where("doc_id <> component_id").select("doc_id"))
