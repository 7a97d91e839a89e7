"""Token counts: pieces are counted once for each distinct pre-token, joined to the documents' pre-token frequencies.

The distinct pre-tokens of the corpus are tokenized once each, which gives a table of their 64-bit hashes and piece
counts; should two pre-tokens share a hash, another seed is taken. Each slice of documents then yields one row for each
distinct pre-token: its hash, and packed postings, the places of its documents in the slice and its frequencies there.
These rows join the counts by hash; a task adds count times frequency to its documents, slice by slice, and passes the
sums on packed. Token ids are never listed. A document's id and size travel through the same join, so no table of the
frequencies is kept.

A hot pre-token has a row a slice, not a row a document, and its join partition may be split.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, arrow_map, ids_and_texts, packed, slices, unpacked

LIMIT = 1024
#: Bytes of text in a slice, at most, but for longer single texts; units that a task remembers; sums that a task holds.
SLICE_TEXT, CACHE_UNITS, HELD_SUMS = 3 << 22, 250_000, 1 << 21
#: Bits of a document's place in its slice.
_PLACE = 24
#: How the tokenizer splits texts before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that every Unicode version classes alike; a unit with any other is counted as it is, unsplit.
_PLAIN = r"[\n\r\t\x20-\x7e¡-ɏ‐-‧‰-⁞]*"
#: A pre-token always starts at a space between two characters that aren't white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Spaced(dict):
    def __init__(self, units: _Units, space: str):
        self.units, self.space = units, space

    def __missing__(self, word: str) -> int:
        got = self[word] = self.units.add(self.space + word)
        return got


class _Units:
    """Numbers for the units of texts, parts that start at a single space, and for the pre-tokens in each."""

    def __init__(self, path: str):
        import regex

        tokens = _tokenizer(path).get_added_tokens_decoder().values()
        plain = [t.content for t in tokens if not (t.lstrip or t.rstrip or t.single_word)]
        self.whole = [t.content for t in tokens if t.content not in plain]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(plain, key=len, reverse=True))) + ")") if plain else None
        self.split, self.plain = regex.compile(PATTERN).findall, regex.compile(_PLAIN).fullmatch
        self.clear()

    def clear(self) -> None:
        self.piece: dict[str, int] = {}
        self.of: list[int] = []  # pre-tokens of all units, one unit after the other
        self.ends: list[int] = [0]
        self.first, self.spaced = _Spaced(self, ""), _Spaced(self, " ")

    def add(self, unit: str) -> int:
        parts = [unit] if self.special and self.special.fullmatch(unit) or not self.plain(unit) else self.split(unit)
        self.of += [self.piece.setdefault(p, len(self.piece)) for p in parts]
        self.ends.append(len(self.of))
        return len(self.ends) - 2

    def _part(self, text: str) -> list[int]:
        if not text:
            return []
        if "  " in text or text[-1] == " ":
            first, *others = _CUT.split(text)
        else:
            first, *others = text.split(" ")
        found = list(map(self.spaced.__getitem__, others))
        if first:
            found.append(self.first[first])
        return found

    def __call__(self, text: str) -> list[int]:
        """The units of a text, in any order."""
        if self.whole and any(s in text for s in self.whole):
            return [self.add(text)]
        if self.special is None or not self.special.search(text):
            return self._part(text)
        return [u for k, part in enumerate(self.special.split(text)) for u in ([self.first[part]] if k % 2 else self._part(part))]


def _pieces(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, told = _Units(path), 0
        for b in slices(batches, most=SLICE_TEXT):
            if len(units.ends) > CACHE_UNITS:
                units.clear()
                told = 0
            for t in b.column("text").to_pylist():
                units(t)
            names = list(units.piece)[told:]
            told += len(names)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["piece"])

    return run


def _counted(path: str, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for b in slices(batches, text="piece"):
            pieces = b.column("piece").to_pylist()
            lengths = [len(e) for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([_hashes(pieces, seed), pa.array(lengths, pa.int64())], ["key", "n"])

    return run


def _hashes(pieces: list[str], seed: int) -> pa.Array:
    return pa.array(np.array([xxhash.xxh3_64_intdigest(p.encode(), seed) for p in pieces], np.uint64).view(np.int64))


#: docs: documents in the slice; 0 marks the row that holds the documents themselves in place of postings.
_FREQUENCIES = "key long, chunk long, docs int, postings binary"


def _told(ids: list[int | None], size: list[int]) -> bytes:
    """Ids, whether they are there, and sizes of documents."""
    known = np.array([i is not None for i in ids], "<i8")
    return np.concatenate([np.array([i or 0 for i in ids], "<i8"), known, np.array(size, "<i8")]).tobytes()


def _frequencies(path: str, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, chunk, hashed = _Units(path), count(TaskContext.get().partitionId() << 32), np.zeros(0, np.int64)
        for b in slices(batches, most=SLICE_TEXT):
            if len(units.ends) > CACHE_UNITS:
                units.clear()
                hashed = hashed[:0]
            found, sizes, size = [], [], []
            for t in b.column("text").to_pylist():
                u = units(t)
                found += u
                sizes.append(len(u))
                size.append(len(t.encode()))
            n, docs = next(chunk), b.num_rows
            owner = np.repeat(np.arange(docs), sizes)
            key = np.array(found, np.int64)
            del found
            key, times = np.unique((key << _PLACE) | owner, return_counts=True)
            of, ends = np.array(units.of, np.int64), np.array(units.ends, np.int64)
            unit, owner = key >> _PLACE, key & (1 << _PLACE) - 1
            per = ends[unit + 1] - ends[unit]
            piece = of[np.repeat(ends[unit] - np.cumsum(per) + per, per) + np.arange(per.sum())]
            key, back = np.unique((piece << _PLACE) | np.repeat(owner, per), return_inverse=True)
            times = np.bincount(back, weights=np.repeat(times, per), minlength=len(key)).astype(np.int64)
            piece, place = key >> _PLACE, key & (1 << _PLACE) - 1
            begin = np.flatnonzero(np.diff(piece, prepend=-1))
            step = np.diff(place, prepend=0)
            step[begin] = place[begin]
            if len(units.piece) > len(hashed):
                hashed = np.concatenate([hashed, _hashes(list(units.piece)[len(hashed) :], seed).to_numpy()])
            m = len(begin)
            if m:
                postings = packed(np.column_stack([step, times]).ravel(), 2 * np.append(begin, len(key)))
                rows = [pa.array(hashed[piece[begin]]), pa.array(np.full(m, n)), pa.array(np.full(m, docs, np.int32)), postings]
                yield pa.RecordBatch.from_arrays(rows, ["key", "chunk", "docs", "postings"])
            head = [_hashes([f"head of {n}"], seed), pa.array([n]), pa.array([0], pa.int32()), pa.array([_told(b.column("doc_id").to_pylist(), size)], pa.binary())]
            yield pa.RecordBatch.from_arrays(head, ["key", "chunk", "docs", "postings"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by chunk and place, packed, as many at once as HELD_SUMS; rows of the documents themselves pass."""
    slot: dict[int, int] = {}
    total = np.zeros(1 << 16, np.int64)
    used = 0

    def flush() -> pa.RecordBatch:
        chunks, begin = list(slot), list(slot.values())
        at = np.flatnonzero(total[:used])
        ends = np.searchsorted(at, [*begin, used])
        step = np.diff(at, prepend=0)
        first = ends[:-1][ends[:-1] < ends[1:]]
        step[first] = (at - np.repeat(begin, np.diff(ends)))[first]
        sums = packed(np.column_stack([step, total[at]]).ravel(), 2 * ends)
        return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(np.ones(len(chunks), np.int32)), sums], ["chunk", "docs", "sums"])

    for b in batches:
        head = b.column("docs").to_numpy() == 0
        if head.any():
            heads = b.filter(pa.array(head))
            yield pa.RecordBatch.from_arrays([heads.column("chunk"), heads.column("docs"), heads.column("postings")], ["chunk", "docs", "sums"])
            b = b.filter(pa.array(~head))
        if not b.num_rows:
            continue
        chunk, docs = b.column("chunk").to_numpy(), b.column("docs").to_numpy()
        for c, k in zip(*np.unique(chunk, return_index=True)):
            if int(c) not in slot:
                slot[int(c)] = used
                used += int(docs[k])
        if used > len(total):
            total = np.concatenate([total, np.zeros(max(used, 2 * len(total)) - len(total), np.int64)])
        values, per = unpacked(b.column("postings"))
        step, times, per = values[0::2], values[1::2], per // 2
        row = np.repeat(np.arange(b.num_rows), per)
        run = np.cumsum(step)
        begin = np.cumsum(per) - per
        place = run - np.repeat(run[begin] - step[begin], per)
        at = np.array([slot[int(c)] for c in chunk])[row] + place
        np.add.at(total, at, times * b.column("n").to_numpy()[row])
        if used > HELD_SUMS:
            yield flush()
            slot.clear()
            total, used = np.zeros(1 << 16, np.int64), 0
    if slot:
        yield flush()


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["chunk", "place", "doc_id", "n_bytes", "tokens"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    for b in batches:
        head = b.column("docs").to_numpy() == 0
        heads = b.filter(pa.array(head))
        for c, told in zip(heads.column("chunk").to_pylist(), heads.column("sums").to_pylist()):
            ids, known, size = np.frombuffer(told, "<i8").reshape(3, -1)
            m = len(ids)
            columns = [np.full(m, c), np.arange(m, dtype=np.int32), pa.array(ids, mask=known == 0), size, np.zeros(m, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], names)
        b = b.filter(pa.array(~head))
        values, per = unpacked(b.column("sums"))
        step, per = values[0::2], per // 2
        run, begin = np.cumsum(step), np.cumsum(per) - per
        has = begin[per > 0]
        place = run - np.repeat(run[has] - step[has], per[per > 0])
        m = len(place)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("chunk").to_numpy(), per)), pa.array(place.astype(np.int32)), *[pa.nulls(m, pa.int64())] * 2, pa.array(values[1::2])], names)


def token_counts(spark: SparkSession, docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row, for a byte-level tokenizer file with the pattern above.

    Null and empty texts have no tokens. Every row counts for itself, also repeated rows and null doc_ids; ties don't
    arise. An empty table gives an empty result. Columns other than doc_id and text are ignored, whatever their names.
    A text longer than a slice is a slice of its own.
    """
    stage, texts = Stage(spark, "tokens"), ids_and_texts(docs)
    pieces = arrow_map(texts.select("text"), _pieces(tokenizer), "piece string").distinct()
    for seed in count():
        counts = stage.keep(arrow_map(pieces, _counted(tokenizer, seed), "key long, n long"), f"counts{seed}")
        if counts.groupBy("key").count().where("count > 1").isEmpty():
            break
        stage.drop(f"counts{seed}")
    rows = arrow_map(texts, _frequencies(tokenizer, seed), _FREQUENCIES)
    # by merge: a broadcast of the counts would grow with the vocabulary
    joined = rows.join(counts.hint("merge"), "key", "left").select("chunk", "docs", "postings", F.coalesce("n", F.lit(0)).alias("n"))
    sums = arrow_map(joined, _summed, "chunk long, docs int, sums binary").repartition("chunk")
    by_document = arrow_map(sums, _by_document, "chunk long, place int, doc_id long, n_bytes long, tokens long")
    out = by_document.groupBy("chunk", "place").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
