"""Best-fit packing: documents tokenized and packed into sequences of bounded length by hierarchical residual packing.

Each task tokenizes its documents and packs its own pieces best-fit decreasing; bins within SLACK tokens of full are
final. The underfull bins go up a tree as items: a node takes a bounded number of bins, packs them best-fit decreasing
into larger bins, and passes on what is still underfull, until one node is left or a round no longer merges anything.
A sequence is the root of its bins; offsets add up along the way. No node ever sees more than NODE_BINS bins or so.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, arrow_map, ids_and_texts, slices

CAPACITY, SLACK, NODE_BINS, FAN_IN = 2048, 4, 40_000, 8
END_ID = 0
#: Words whose ids a task remembers, and pieces that it packs at once.
CACHE_WORDS, PACK_PIECES = 300_000, 1 << 16
#: Python's str.split cuts at these, the tokenizer's white space doesn't include them.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: the bin and the offset of each item, and the fill of each bin."""
    order = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    where, offset, fill = [0] * len(sizes), [0] * len(sizes), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has r tokens of room
    for i in order:
        n = sizes[i]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += n
        left = room - n
        by_room[left].append(b)
        rooms |= 1 << left
    return where, offset, fill


#: Letters whose lower case and byte mapping are beyond doubt; a word of these alone is a single pre-token.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+\\Z")


def _byte_alphabet() -> dict[int, int]:
    """The code point that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class _WordIds(dict):
    """Token ids, as little-endian 32-bit bytes, of white-space-delimited words, remembered by word.

    The tokenizer drops white space, never joins across it, lower-cases, and separates letters from punctuation. So a
    word is encoded as its letters, remembered by lower case, and its closing full stops and commas; any other word goes
    through the tokenizer as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.cores, self.tails, self.table = Tokenizer.from_file(path), {}, {}, _byte_alphabet()
        self.model = self.tokenizer.model

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(".,")
        low = core.lower()
        if _PLAIN.match(low):
            ids = self.cores.get(low)
            if ids is None:
                shown = low if low.isascii() else low.encode().decode("latin-1").translate(self.table)
                ids = self.cores[low] = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
            if len(core) < len(word):
                tail = word[len(core) :]
                more = self.tails.get(tail)
                if more is None:
                    more = self.tails[tail] = self.whole(tail)
                ids += more
        else:
            ids = self.whole(word)
        self[word] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > CACHE_WORDS:
            self.clear()
        if len(self.cores) > CACHE_WORDS:
            self.cores.clear()
            self.tails.clear()
        get = self.__getitem__
        return [self.whole(t) if _ODD_SPACE.search(t) else b"".join(map(get, t.split())) for t in texts]


def _packed(tokenizer: str, capacity: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _WordIds(tokenizer)
        base, rows = TaskContext.get().partitionId() << 33, []

        def flush() -> pa.RecordBatch:
            nonlocal base
            where, offset, fill = best_fit([r[3] for r in rows], capacity)
            columns = [*zip(*rows)] if rows else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            arrays += [pa.array([base + b for b in where], pa.int64()), pa.array(offset, pa.int64()), pa.array([fill[b] for b in where], pa.int64())]
            base += len(fill)
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "bin", "offset", "fill"])

        end = np.array([END_ID], "<u4").tobytes()
        for b in slices(batches):
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(b.column("text").to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            if len(rows) >= PACK_PIECES:
                yield flush()
        if rows:
            yield flush()

    return run


def _merge_node(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("bin")
        where, offset, fill = best_fit(bins["fill"].tolist(), capacity)
        ids = bins["bin"].to_numpy()
        roots = {}
        for b, w in zip(ids, where):
            roots.setdefault(w, b)
        return pd.DataFrame({"bin": ids, "root": [roots[w] for w in where], "shift": offset, "fill": [fill[w] for w in where]})

    return run


def _tree(bins: DataFrame, stage: Stage, capacity: int) -> DataFrame | None:
    """(bin, root, shift) of all bins that took part in merging; None if there was nothing to merge."""
    level, nodes, moved = 0, None, None
    bins = stage.keep(bins, "bins0")
    n = bins.count()
    while n > 1:
        nodes = -(-n // NODE_BINS) if nodes is None else max(1, min(-(-n // NODE_BINS), nodes // FAN_IN))
        nodes = max(nodes, -(-n // (2 * NODE_BINS)))
        placed = bins.withColumn("node", F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(nodes)))
        got = stage.keep(placed.groupBy("node").applyInPandas(_merge_node(capacity), "bin long, root long, shift long, fill long"), f"merged{level}")
        step = got.select("bin", "root", "shift")
        if moved is None:
            moved = step
        else:
            up = step.select(F.col("bin").alias("root"), F.col("root").alias("top"), F.col("shift").alias("more"))
            moved = moved.join(up, "root", "left").select("bin", F.coalesce("top", "root").alias("root"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        moved = stage.keep(moved, f"moved{level}")
        level += 1
        bins = stage.keep(got.where((F.col("bin") == F.col("root")) & (F.col("fill") < capacity - SLACK)).select("bin", "fill"), f"bins{level}")
        left = bins.count()
        if nodes == 1 or left > 0.995 * n:
            break
        n = left
    return moved


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for every piece of every row.

    A document is its ids and then id 0; longer ones than the capacity are cut into full pieces and a rest. Null and
    empty texts are the single id 0. Every row is a document of its own: repeated rows and null doc_ids are packed as
    often as they come. ids, on demand, are little-endian 32-bit.
    """
    stage = Stage(spark, "packing")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, bin long, offset long, fill long"
    pieces = arrow_map(ids_and_texts(docs), _packed(tokenizer, capacity, with_ids), schema)
    pieces = stage.keep(pieces if with_ids else pieces.drop("ids"), "pieces")
    moved = _tree(pieces.where((F.col("offset") == 0) & (F.col("fill") < capacity - SLACK)).select("bin", "fill"), stage, capacity)
    if moved is None:
        moved = spark.createDataFrame([], "bin long, root long, shift long")
    out = pieces.join(moved, "bin", "left")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("root", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")]
    return out.select(*names, *(["ids"] if with_ids else []))
