"""LM scoring: a word bigram model in an Elias-Fano trie, counted and built in shards and queried memory-mapped.

Level 1 holds the words, sorted by hash: the hashes as an Elias-Fano sequence, and of each word its count, its
quantised probability and its quantised back-off weight. Level 2 holds all bigrams in shards of a key range: the contexts and the pointers to their successors as monotone sequences, and the successors'
word ids, each raised by the last value of the context before, as one more. A query finds its context, takes the range
between two pointers, and searches for the successor of the word's id relative to its context's base; the quantised
probability stands beside it. Absolute discounting interpolates bigrams with words, and gives unknown words, taken as
one event as in the base score, the discounted mass.

Counts are partial sums of each slice before they shuffle; shards are cut at quantiles of the keys, so a context with
very many successors spreads over several. Files are written under another name and renamed, so retried tasks agree.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Stage, arrow_map, ids_and_texts, offsets_and_bytes, slices, span_hashes, word_spans
from .elias_fano import EliasFano, Level, save

END = U64(0x8F1BBCDCBFA53E0B)
SHARD_WORDS, SHARD_BIGRAMS = 1 << 20, 1 << 21
#: Log10 probabilities are stored in steps of 1 / STEPS in one byte.
STEPS = 20


def _quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(np.maximum(p, 1e-300)) * STEPS), 0, 255).astype(np.uint8)


def _tokens(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an END after each text's words, and the index of each text's first token (n + 1)."""
    off, data = offsets_and_bytes(b.column("text"))
    starts, ends, first = word_spans(data, off)
    h = span_hashes(data, starts, ends, lower=True)
    return np.insert(h, first[1:], END), first + np.arange(len(first))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        h, c = np.unique(_tokens(b)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])


class _Levels:
    """The level files of one model; a task maps at most OPEN of them at a time."""

    OPEN = 512

    def __init__(self, root: str, bits: int, starts: list[int], cuts: list[int], words: int):
        self.root, self.bits, self.starts, self.cuts, self.words = root, bits, np.array(starts, np.int64), np.array(cuts, np.int64), words
        self.open: OrderedDict[str, Level | None] = OrderedDict()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"open": OrderedDict()}

    def level(self, name: str) -> Level:
        if name not in self.open:
            self.open[name] = Level(f"{self.root}/{name}")
            if len(self.open) > self.OPEN:
                self.open.popitem(last=False)
        self.open.move_to_end(name)
        return self.open[name]

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Word ids of distinct sorted hashes; -1: unknown."""
        out = np.full(len(h), -1, np.int64)
        shard = (h >> U64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)
        for s in np.unique(shard):
            at = np.flatnonzero(shard == s)
            n = int(self.starts[s + 1] - self.starts[s])
            if not n:
                continue
            words = self.level(f"words-{s}").sequences["hash"]
            want = h[at] & U64((1 << (64 - self.bits)) - 1)
            i = words.successor(want)
            ok = np.flatnonzero(i < n)
            ok = ok[words.get(i[ok]) == want[ok]]
            out[at[ok]] = self.starts[s] + i[ok]
        return out

    def of_words(self, name: str, ids: np.ndarray) -> np.ndarray:
        """An array of level 1 at word ids."""
        out = np.zeros(len(ids), float if name == "weight" else np.int64)
        shard = np.searchsorted(self.starts, ids, "right") - 1
        for s in np.unique(shard):
            at = np.flatnonzero(shard == s)
            out[at] = self.level(f"{'backoff' if name in ('backoff', 'weight') else 'words'}-{s}").arrays[name][ids[at] - self.starts[s]]
        return out

    def bigrams(self, keys: np.ndarray) -> np.ndarray:
        """Probability codes of distinct sorted bigram keys; -1: not in the trie."""
        out = np.full(len(keys), -1, np.int64)
        shard = np.searchsorted(self.cuts, keys, "left")
        for s in np.unique(shard):
            at = np.flatnonzero(shard == s)
            try:
                level = self.level(f"bigrams-{s}")
            except FileNotFoundError:
                continue
            q, a = level.sequences, level.arrays
            context, word = keys[at] >> 32, keys[at] & 0xFFFFFFFF
            distinct, back = np.unique(context, return_inverse=True)
            c = q["context"].successor(distinct.astype(U64))
            known = c < q["context"].n
            known[known] = q["context"].get(c[known]) == distinct[known].astype(U64)
            c = c[known]
            lo, hi = q["pointer"].get(c).astype(np.int64), q["pointer"].get(c + 1).astype(np.int64)
            base = np.where(lo > 0, q["word"].get(np.maximum(lo - 1, 0)).astype(np.int64), 0)
            spread = np.full((3, len(distinct)), -1, np.int64)
            spread[:, known] = lo, hi, base
            ok = np.flatnonzero(known[back])
            want = (spread[2][back[ok]] + word[ok] + 1).astype(U64)
            i = q["word"].successor(want)
            hit = np.flatnonzero(i < spread[1][back[ok]])
            hit = hit[q["word"].get(i[hit]) == want[hit]]
            out[at[ok[hit]]] = a["prob"][i[hit]]
        return out


def _write_words(root: str, bits: int, discount: float, total: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        s = int(rows["shard"].iloc[0])
        h = rows["h"].to_numpy(np.int64).view(U64)
        order = np.argsort(h)
        count = rows["c"].to_numpy(np.int64)[order]
        hashes = EliasFano.build(h[order] & U64((1 << (64 - bits)) - 1))
        save(f"{root}/words-{s}", {"hash": hashes}, {"prob": _quantised((count - discount) / total), "count": count.astype(np.int64)})
        return pd.DataFrame({"shard": [s], "n": [len(h)]})

    return run


def _count_bigrams(levels: _Levels) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys = _keys(levels, *_tokens(b))[0]
            k, c = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["k", "c"])

    return run


def _keys(levels: _Levels, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bigram keys (context id, word id) and word ids of all tokens; the context of a first token is id ``words``."""
    distinct, back = np.unique(h, return_inverse=True)
    ids = levels.ids(distinct)[back]
    context = np.empty(len(ids), np.int64)
    context[1:] = ids[:-1]
    context[first[:-1]] = levels.words
    return np.where((ids >= 0) & (context >= 0), (context << 32) | np.maximum(ids, 0), -1), ids


def _placed(levels: _Levels) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = np.searchsorted(levels.cuts, b.column("k").to_numpy(), "left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("c"), pa.array(shard)], ["k", "c", "shard"])

    return run


def _write_bigrams(levels: _Levels, discount: float, texts: int, first_backoff: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        k, c = rows["k"].to_numpy(np.int64), rows["c"].to_numpy(np.int64)
        order = np.argsort(k)
        k, c = k[order], c[order]
        context, word = k >> 32, k & 0xFFFFFFFF
        distinct, begin = np.unique(context, return_index=True)
        seen, weight = np.full(len(distinct), texts, np.int64), np.full(len(distinct), first_backoff)
        real = distinct < levels.words
        seen[real], weight[real] = levels.of_words("count", distinct[real]), levels.of_words("weight", distinct[real])
        n = np.diff(np.append(begin, len(k)))
        uni_order = np.argsort(word, kind="stable")
        uni = np.empty(len(k))
        uni[uni_order] = 10.0 ** (-levels.of_words("prob", word[uni_order]) / STEPS)
        p = (c - discount) / np.repeat(seen, n) + np.repeat(weight, n) * uni
        last = np.cumsum(word[np.append(begin[1:], len(k)) - 1] + 1)
        values = word + 1 + np.repeat(np.append(0, last[:-1]), n)
        sequences = {"context": EliasFano.build(distinct), "pointer": EliasFano.build(np.append(begin, len(k))), "word": EliasFano.build(values)}
        save(f"{levels.root}/bigrams-{shard}", sequences, {"prob": _quantised(np.minimum(p, 1.0))})
        return pd.DataFrame({"shard": [shard], "n": [len(k)]})

    return run


def _write_backoff(levels: _Levels) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        s = int(rows["shard"].iloc[0])
        weight = np.ones(int(levels.starts[s + 1] - levels.starts[s]))
        rows = rows[rows["context"] >= 0]
        weight[rows["context"].to_numpy(np.int64) - levels.starts[s]] = rows["backoff"].to_numpy(float)
        save(f"{levels.root}/backoff-{s}", {}, {"backoff": _quantised(weight), "weight": weight})
        return pd.DataFrame({"shard": [s], "n": [len(weight)]})

    return run


def held_out(doc_id: F.Column | str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 1, F.lit(False))


class Model:
    def __init__(self, levels: _Levels, total: int, unknown: float, first_backoff: float):
        self.levels, self.total, self.unknown, self.first_backoff = levels, total, unknown, first_backoff


def train(texts: DataFrame, stage: Stage) -> Model:
    """Counts words and bigrams of all texts (column text, no nulls) and writes the level files."""
    spark, root = stage.spark, stage.local_path("levels")
    words = stage.keep(arrow_map(texts.select("text"), _count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "words")
    v, total, n1, n2, n_texts = words.agg(
        F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2), F.coalesce(F.max(F.when(F.col("h") == int(END.view(np.int64)), F.col("c"))), F.lit(0))
    ).first()
    if not v:
        return Model(_Levels(root, 0, [0, 0], [], 0), 0, 1.0, 1.0)
    d1 = n1 / (n1 + 2 * n2) if n1 else 0.5
    bits = max(0, (-(-v // SHARD_WORDS) - 1).bit_length())
    shard = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    sizes = words.withColumn("shard", shard).groupBy("shard").applyInPandas(_write_words(root, bits, d1, total), "shard long, n long").collect()  # a row a shard
    n = dict((r["shard"], r["n"]) for r in sizes)
    starts = np.concatenate([[0], np.cumsum([n.get(s, 0) for s in range(1 << bits)])]).tolist()
    levels = _Levels(root, bits, starts, [], v)
    pairs = arrow_map(texts.select("text"), _count_bigrams(levels), "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))
    pairs = stage.keep(pairs, "pairs")
    kept, b1, b2 = pairs.agg(F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    d2 = b1 / (b1 + 2 * b2) if b1 and b2 else 0.75  # a discount of 1 would leave bigrams seen once no mass of their own
    shards = -(-kept // SHARD_BIGRAMS)
    cuts = sorted(set(pairs.select(F.percentile_approx("k", [i / shards for i in range(1, shards)], 1000 * shards)).first()[0])) if shards > 1 else []
    levels.cuts = np.array(cuts, np.int64)
    context = F.shiftrightunsigned("k", 32)
    mass = pairs.groupBy(context.alias("context")).agg((F.sum("c") - F.count(F.lit(1)) * d2).alias("mass"))
    # a context's occurrences are its word's count, or the number of texts before a first word
    by_word = arrow_map(mass, _backoffs(levels, n_texts), "context long, backoff double, shard long")
    by_word = stage.keep(by_word, "backoffs")
    every = spark.createDataFrame([(-1, 1.0, s) for s in range(1 << bits) if starts[s + 1] > starts[s]], "context long, backoff double, shard long")
    by_word.where(F.col("context") < v).unionByName(every).groupBy("shard").applyInPandas(_write_backoff(levels), "shard long, n long").collect()
    first = by_word.where(F.col("context") == v).first()
    first_backoff = first["backoff"] if first else 1.0
    if kept:
        rows = arrow_map(pairs, _placed(levels), "k long, c long, shard int")
        rows.groupBy("shard").applyInPandas(_write_bigrams(levels, d2, n_texts, first_backoff), "shard long, n long").collect()
    for name in ("words", "pairs", "backoffs"):
        stage.drop(name)
    return Model(levels, total, max(d1 * v / total, 1e-12), first_backoff)


def _backoffs(levels: _Levels, texts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            context, mass = b.column("context").to_numpy(), b.column("mass").to_numpy()
            seen = np.full(len(context), texts, np.int64)
            real = context < levels.words
            seen[real] = levels.of_words("count", context[real])
            shard = np.searchsorted(levels.starts, context, "right") - 1
            yield pa.RecordBatch.from_arrays([b.column("context"), pa.array(np.clip(1 - mass / np.maximum(seen, 1), 1e-6, 1.0)), pa.array(shard.astype(np.int64))], ["context", "backoff", "shard"])

    return run


def _score(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, total = model.levels, model.total
        for b in slices(batches):
            h, first = _tokens(b)
            keys, ids = _keys(levels, h, first)
            distinct, back = np.unique(ids, return_inverse=True)
            known = distinct >= 0
            count, uni, off = np.zeros(len(distinct)), np.full(len(distinct), np.log10(model.unknown)), np.zeros(len(distinct))
            count[known] = levels.of_words("count", distinct[known])
            uni[known] = -levels.of_words("prob", distinct[known]) / STEPS
            off[known] = -levels.of_words("backoff", distinct[known]) / STEPS
            base = np.log10((count + 0.5) / (total + 0.5 * (levels.words + 1)))[back]
            context = np.concatenate([[0.0], off[back][:-1]])
            context[first[:-1]] = np.log10(model.first_backoff)
            score = context + uni[back]
            kinds, place = np.unique(keys, return_inverse=True)
            code = np.full(len(kinds), -1, np.int64)
            real = kinds >= 0
            code[real] = levels.bigrams(kinds[real])
            code = code[place]
            score = np.where(code >= 0, -code / STEPS, score)
            sums = [np.add.reduceat(x, first[:-1]) for x in (base, score, (ids >= 0).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(first)), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1])],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def scores(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Learns from the rows that aren't held out, repeated ones as often as they come. Null texts are empty: one end. A
    null doc_id counts as training. Without training rows all probabilities are 1.
    """
    stage = Stage(spark, "lm")
    texts = ids_and_texts(docs)
    model = train(texts.where(~held_out()), stage)
    out = arrow_map(texts, _score(model), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
