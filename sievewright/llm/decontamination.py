"""Benchmark decontamination by spaced seeds.

Texts and benchmark items become lower-case alphanumeric words. A spaced seed is a fixed mask over SPAN consecutive
words that ignores some of them, so that its hash survives a substituted word at an ignored place. The benchmark's
seed hashes, in blocks of bounded size, are joined to the hashes at every position of every text; each hit gives a
diagonal (text position less item position), and all words along it are compared: an overlap is the longest stretch
whose score, +1 a match and -MISMATCH a substitution, is not negative, which is to say that at least 80 per cent of it
match; what is left on either side is searched likewise. An overlap counts if it has MIN_WORDS matches or covers
MIN_COVER of the item.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, U64, arrow_map, ids_and_texts, mix, offsets_and_bytes, slices, span_hashes, without, word_spans

#: 1: the word counts, 0: it may differ. In every stretch of 8 to 23 words with at most one in five replaced one mask
#: fits at least, wherever the replaced ones are (tested), and any longer stretch has such a part of 12 to 23 words.
MASKS = ("11101011", "11010111", "10111101", "1111001011", "111111", "110110011", "101001111")
#: Items with fewer words are looked for as a whole.
SHORT = 8
MIN_WORDS, MIN_COVER, MISMATCH = 12, 0.8, 4
#: Benchmark words in one block: the most that a task holds of the benchmark at once.
BLOCK_WORDS = 500_000
_FILTER_BITS = 22

_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_BREAK[128:] = False


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normalised words, and the index of each text's first word (n + 1)."""
    off, data = offsets_and_bytes(texts)
    data = _LOWER[data]
    if len(data) > 1:  # upper-case Latin-1 letters in UTF-8
        high = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        data[high] += 0x20
    starts, ends, first = word_spans(data, off, _BREAK)
    return span_hashes(data, starts, ends), first


def _seeds(words: np.ndarray, mask: str, k: int) -> np.ndarray:
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, k * 0x9E3779B97F4A7C15 & (1 << 64) - 1, U64)
    for i, c in enumerate(mask):
        if c == "1":
            out += words[i : i + n] * U64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64))
    return mix(out)


class _Block:
    """Seed hashes of some items, sorted, with the item and word position of each."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words, self.first = _words(pa.array([t for _, t in items], pa.string()))
        owner = np.repeat(np.arange(len(items)), np.diff(self.first))
        self.length = np.diff(self.first)
        hashes, at = [], []
        for k, mask in enumerate(MASKS):
            h = _seeds(self.words, mask, k)
            good = np.flatnonzero((owner[: len(h)] == owner[len(mask) - 1 :]) & (self.length[owner[: len(h)]] >= SHORT)) if len(h) else np.zeros(0, np.int64)
            hashes.append(h[good])
            at.append(good)
        self.short = {int(n): {} for n in set(self.length.tolist()) if 0 < n < SHORT}
        for k, n in enumerate(self.length.tolist()):
            if n in self.short:
                self.short[n].setdefault(tuple(self.words[self.first[k] : self.first[k + 1]].tolist()), []).append(k)
        self.hashes, at = np.concatenate(hashes), np.concatenate(at)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.at = self.hashes[order], at[order]
        self.owner = owner
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.hashes >> U64(64 - _FILTER_BITS)] = True


def _overlaps(text: np.ndarray, item: np.ndarray, diagonal: int) -> list[tuple[int, int, int]]:
    """Start and end in the text of the overlaps on the diagonal that count, and their matches."""
    lo, hi = max(0, diagonal), min(len(text), diagonal + len(item))
    same = text[lo:hi] == item[lo - diagonal : hi - diagonal]
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -MISMATCH))])
    found, todo = [], [(0, len(same))]
    while todo:
        s, e = todo.pop()
        if min(MIN_WORDS, MIN_COVER * len(item)) > e - s:
            continue
        # for every end the first start with no higher score: the least scores so far fall, so a search finds it
        part = score[s : e + 1]
        begin = np.searchsorted(-np.minimum.accumulate(part), -part, "left")
        longest = int(np.argmax(np.arange(len(part)) - begin))
        start, end = s + int(begin[longest]), s + longest
        matched = np.flatnonzero(same[start:end])
        if len(matched) and (len(matched) >= MIN_WORDS or len(matched) >= MIN_COVER * len(item)):
            found.append((lo + start + int(matched[0]), lo + start + int(matched[-1]) + 1, len(matched)))
            todo += [(s, start), (end, e)]
    return found


def _scan(blocks: list[tuple[int, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(blocks)
        for b in slices(batches):
            words, first = _words(b.column("text"))
            doc = np.repeat(np.arange(b.num_rows), np.diff(first))
            found: set[tuple[int, int, int]] = set()
            for k, mask in enumerate(MASKS):
                h = _seeds(words, mask, k)
                if not len(h):
                    continue
                hit = np.flatnonzero(block.filter[h >> U64(64 - _FILTER_BITS)] & (doc[: len(h)] == doc[len(mask) - 1 :]))
                lo, hi = np.searchsorted(block.hashes, h[hit], "left"), np.searchsorted(block.hashes, h[hit], "right")
                n = hi - lo
                hit, lo, n = hit[n > 0], lo[n > 0], n[n > 0]
                which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                p, q = np.repeat(hit, n), block.at[which]
                item = block.owner[q]
                diagonal = (p - first[doc[p]]) - (q - block.first[item])
                found.update(zip(doc[p].tolist(), item.tolist(), diagonal.tolist()))
            rows = []
            for d, i, diagonal in found:
                text, item = words[first[d] : first[d + 1]], block.words[block.first[i] : block.first[i + 1]]
                rows += [(d, block.ids[i], s, e, same, len(item)) for s, e, same in _overlaps(text, item, diagonal)]
            for n, wanted in block.short.items():
                for p in np.flatnonzero(doc[: max(0, len(words) - n + 1)] == doc[n - 1 :]).tolist():
                    for i in wanted.get(tuple(words[p : p + n].tolist()), ()):
                        s = p - first[doc[p]]
                        rows.append((doc[p], block.ids[i], s, s + n, n, n))
            ids = b.column("doc_id").to_pylist()
            kinds = {"doc_id": pa.int64(), "item_id": pa.int64(), "start": pa.int32(), "end": pa.int32(), "matched": pa.int32(), "item_words": pa.int32()}
            columns = [[ids[r[0]] for r in rows], *[[int(r[k]) if r[k] is not None else None for r in rows] for k in range(1, 6)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], list(kinds))

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK_WORDS words; the driver holds one block at a time."""
    rows, words = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        words += r["text"].count(" ") + 1
        if words >= BLOCK_WORDS:
            yield rows
            rows, words = [], 0
    if rows:
        yield rows


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, matched, item_words): every overlap, with the words' places in the document."""
    texts = ids_and_texts(docs)
    schema = "doc_id long, item_id long, start int, end int, matched int, item_words int"
    parts = [arrow_map(texts, _scan(block), schema) for block in _blocks(benchmark)]
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def contaminated_pairs(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_overlaps, matched, item_words, coverage), one row for each contaminated document and item.

    Null texts are empty and overlap nothing; items without words are never found. Repeated rows of a doc_id are
    pooled, null doc_ids among themselves. coverage is the longest overlap's share of the item's words.
    """
    return (
        overlaps(docs, benchmark)
        .groupBy("doc_id", "item_id")
        .agg(F.count(F.lit(1)).alias("n_overlaps"), F.max("matched").cast("long").alias("matched"), F.max("item_words").cast("long").alias("item_words"))
        .withColumn("coverage", F.col("matched") / F.col("item_words"))
    )


def clean_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, columns as in docs, that overlap no benchmark item; rows with a null doc_id stay."""
    return without(docs, overlaps(docs, benchmark).where("doc_id is not null").select("doc_id").distinct())
