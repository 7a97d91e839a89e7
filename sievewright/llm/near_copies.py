"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, found through SimHash.

Texts with equal shingle sets are one node. Nodes within 14 of 64 SimHash bits meet in the segment-popcount grid
(``simhash.part_cells``), which misses none of them, in bands of set sizes; Jaccard then decides. A similarity of 0.8
is about ten bits, but any number may occur, so no radius finds all: pairs further apart, and only those, are looked
for among sets that share a shingle of their prefixes. So every link is found, whatever its bits.

Prefixes: shingles stand in one order, first a share of all shingles, picked by hash, from rare to frequent as counted
over the whole corpus, then the others by hash. Two sets of that similarity share a shingle among the first fifth (and
one) of both in this order. So only the picked shingles are counted and joined, and a set with a fifth of its shingles
found nowhere else drops out at once, which is most of the corpus; shared passages are frequent, so they come last and
seldom make sets meet. A set that shares nothing in its prefix has no link, so it needs no fingerprint either.

Nodes of the same popcounts in two parts are first verified against the least of them, all others pairwise, but only
across the components found so far, so that a large cluster is not listed in pairs. Shingle hashes have 64 bits. Counts
are partial sums before they shuffle, and the joins on cells and shingles may be split, so a shingle that a third of all
texts has does not end in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simhash
from .common import U64, Stage, arrow_map, components, ids_and_texts, offsets_and_bytes, slices, span_hashes, window_hashes, without, word_spans

SHINGLE = 5
#: Shingles with hashes below are picked: five in sixteen, so that a set has more of them than its prefix needs.
PICKED = U64(5 << 60)
#: Sets of this similarity differ in size by 1.25 at most, so they lie in the same band or in neighbours.
BAND = "cast(floor(ln(n) / ln(1.26)) as long)"
_SIZES = "5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)"
_BITS = "bit_count(x.fp ^ y.fp)"


def _shingles(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Of each text the distinct shingle hashes, sorted; a text of fewer words is one shingle, one without words none."""
    off, data = offsets_and_bytes(b.column("text"))
    starts, ends, first = word_spans(data, off)
    words = span_hashes(data, starts, ends, lower=True)
    windows = window_hashes(words, SHINGLE)
    for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
        yield np.unique(windows[s : e - SHINGLE + 1]) if e - s >= SHINGLE else window_hashes(words[s:e], e - s, e - s) if e > s else np.zeros(0, U64)


def _node(shingles: np.ndarray) -> int:
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays).view(np.int64)))


def _prefix(n: int) -> int:
    """How many of n shingles in order are enough to meet every similar set."""
    return n - (4 * n + 4) // 5 + 1 if n else 0


def _entries(shingles: np.ndarray) -> np.ndarray:
    """The picked shingles, and as many of the others as the prefix needs beside them."""
    picked = int(np.searchsorted(shingles, PICKED))
    return shingles[: max(picked, _prefix(len(shingles)))]


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        sets = list(_shingles(b))
        columns = [b.column("doc_id"), pa.array(map(_node, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array([len(_entries(s)) for s in sets], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n", "m"])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        sets = list(_shingles(b))
        entries = [_entries(s) for s in sets]
        node = np.repeat(np.array([_node(s) for s in sets], np.int64), [len(e) for e in entries])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(entries).view(np.int64)), pa.array(node)], ["h", "node"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        h, c = np.unique(np.concatenate([_entries(s) for s in _shingles(b)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        sets = list(_shingles(b))
        columns = [pa.array(map(_node, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(map(simhash.of_hashes, sets), pa.int64()), _lists(sets)]
        yield pa.RecordBatch.from_arrays(columns, ["node", "n", "fp", "shingles"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").where(9 * both >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b")


def _met(texts: DataFrame, nodes: DataFrame, stage: Stage) -> DataFrame:
    """(h, node, n, i): the prefix shingles, at place i of the order, that several nodes share."""
    shared = arrow_map(texts, _counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c > 1")
    shared = stage.keep(shared, "shared")
    # by merge: the shared shingles grow with the corpus
    met = arrow_map(texts, _indexed, "h long, node long").join(shared.hint("merge"), "h")
    later = (F.shiftrightunsigned("h", 60) >= 5).cast("int")
    lists = met.groupBy("node").agg(F.array_sort(F.collect_set(F.struct(later.alias("later"), "c", "h"))).alias("s"))
    sizes = nodes.groupBy("node").agg(F.first("n").alias("n"), F.first("m").alias("m"))
    held = lists.join(sizes, "node").withColumn("u", F.col("m") - F.size("s"))
    wanted = F.expr("n - cast(floor((4 * n + 4) / 5) as int) + 1 - u")
    held = held.withColumn("k", wanted).where("k > 0")
    held = stage.keep(held.select("node", "n", "u", F.expr("transform(slice(s, 1, k), x -> x.h)").alias("hs")), "prefixes")
    stage.drop("shared")
    rows = held.select("node", "n", F.posexplode("hs").alias("i", "h"), "u").select("h", "node", "n", (F.col("i") + F.col("u")).alias("i"))
    several = rows.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("h")
    return stage.keep(rows.join(several.hint("merge"), "h").select("h", "node", "n", "i"), "met")


def _alike(prints: DataFrame) -> DataFrame:
    """(a, b): each node beside the least node of its size band with the same popcounts in two parts of the fingerprint."""
    rows = prints.select("node", F.explode(F.array(*[F.struct(F.expr(BAND).alias("band"), key.alias("key")) for key in simhash.part_pairs()])).alias("cell"))
    least = rows.groupBy("cell").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("cell", "lo")
    return rows.join(least.hint("merge"), "cell").where("node <> lo").select(F.col("node").alias("a"), F.col("lo").alias("b")).distinct()


def _within(placed: DataFrame) -> DataFrame:
    """(a, b): the pairs of nodes (node, n, fp, c) of different components c within the radius, met in the grid."""
    cells = placed.select("node", "n", "fp", "c", F.expr(BAND).alias("band"), F.explode(simhash.part_cells()).alias("cell"))
    rows = cells.select("node", "n", "fp", "c", "cell", "band", F.explode(F.array(F.lit(0), F.lit(1))).alias("up")).withColumn("band", F.expr("band + up"))
    x, y = rows.alias("x").hint("merge"), rows.alias("y")
    near = f"x.cell = y.cell and x.band = y.band and x.node < y.node and x.up + y.up < 2 and x.c <> y.c and {_BITS} <= {simhash.PART_RADIUS} and {_SIZES}"
    return x.join(y, F.expr(near)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _beyond(placed: DataFrame) -> DataFrame:
    """(a, b): the pairs of nodes (h, node, n, i, fp, c) of different components outside the radius that share a prefix shingle h."""
    x, y = placed.alias("x"), placed.alias("y")
    pairs = x.join(y, F.expr(f"x.h = y.h and x.node < y.node and x.c <> y.c and {_BITS} > {simhash.PART_RADIUS} and {_SIZES}"))
    # at the first shingle that two sets share, what follows in both bounds the rest
    pairs = pairs.where("9 * least(x.n - x.i, y.n - y.i) >= 4 * (x.n + y.n)")
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _placed(rows: DataFrame, component: DataFrame) -> DataFrame:
    return rows.join(component.select("node", "component"), "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")


def near_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for every row with a doc_id: component_id is the smallest doc_id linked with it.

    Null texts count as empty; texts without words form one group. Rows that repeat a doc_id link by each of their
    texts. An empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    stage = Stage(spark, "near")
    texts = ids_and_texts(docs).where("doc_id is not null")
    nodes = stage.keep(arrow_map(texts, _nodes, "doc_id long, node long, n int, m int"), "nodes")
    met = _met(texts, nodes, stage)
    first = nodes.join(met.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    sets = arrow_map(texts.join(first.select("doc_id").distinct(), "doc_id", "left_semi"), _sets, "node long, n int, fp long, shingles array<long>")
    sets = stage.keep(sets.dropDuplicates(["node"]), "sets")
    prints = sets.select("node", "n", "fp")
    stars = stage.keep(_verified(_alike(prints), sets), "stars")
    near = _within(stage.keep(_placed(prints, components(stars, stage, "starred")), "placed"))
    near = stage.keep(stars.unionByName(_verified(near, sets)), "within")
    far = met.join(prints.select("node", "fp"), "node")
    far = _beyond(stage.keep(_placed(far, components(near, stage, "so_far")), "far"))
    links = stage.keep(near.unionByName(_verified(far, sets)), "links")
    component = stage.keep(components(links, stage, "all"), "components")
    labels = nodes.select("doc_id", "node").join(component, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    stage.drop("prefixes", "met", "sets", "stars", "placed", "within", "far", "links")
    least = labels.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return labels.join(least, "component").select("doc_id", "component_id")


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each group the row with the smallest doc_id stays.

    Columns are those of docs, whatever their names. Rows with a null doc_id stay and link nothing. Repeated rows all
    stay if their doc_id is its group's first.
    """
    return without(docs, near_copies(spark, docs).where("doc_id <> component_id").select("doc_id").distinct())
