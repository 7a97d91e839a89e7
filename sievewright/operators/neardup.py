"""Near-duplicate segments within a document: greedy, in order, against what has survived so far."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import reading
from .batches import by_document

#: Pairs of a document that are Python objects at once.
PIECE_PAIRS = 10_000


def similar_pairs(segments: DataFrame, threshold: float = 0.8, shingle_size: int = 5, key: str = "doc_id") -> DataFrame:
    """(key, kind, i, j, jaccard), i < j: segments of one kind whose shingle sets are similar enough (threshold > 0).

    One shuffle of the segments by document; pairs meet in the shingles that they share, and nothing but pairs that are
    similar enough leaves a document. Null keys and kinds have no pairs.
    """
    if shingle_size < 1:
        raise ValueError("shingle_size must be at least 1")

    def found(index: list[int], kinds: list[str], texts: list[str]) -> Iterator[tuple[list, ...]]:
        pairs = reading.alike([*zip(kinds, texts)], threshold, shingle_size)
        while part := [*islice(pairs, PIECE_PAIRS)]:
            yield [a for a, _, _ in part], [index[a] for a, _, _ in part], [index[b] for _, b, _ in part], [x for _, _, x in part]

    known = segments.where(F.col(key).isNotNull() & F.col("kind").isNotNull())
    return by_document(known, key, ("index", "kind", "text"), found, (key, "kind"), "i int, j int, jaccard double")


def near_duplicates(segments: DataFrame, threshold: float = 0.8, shingle_size: int = 5, key: str = "doc_id") -> DataFrame:
    """(key, index) of the segments to drop: those like an earlier segment of their kind that itself was not dropped.

    This isn't transitive: a segment like a dropped one only stays.
    """
    if shingle_size < 1:
        raise ValueError("shingle_size must be at least 1")

    def found(kinds: list[str], texts: list[str]) -> tuple[list[int]]:
        return (sorted(reading.repeats([*zip(kinds, texts)], threshold, shingle_size)),)

    return by_document(segments, key, ("kind", "text"), found, (key, "index"))


def dedupe_segments(segments: DataFrame, threshold: float = 0.8, shingle_size: int = 5, key: str = "doc_id") -> DataFrame:
    """The segments that stay, as they are."""
    if shingle_size < 1:
        raise ValueError("shingle_size must be at least 1")

    def kept(kinds: list[str], texts: list[str]) -> tuple[list[int]]:
        gone = reading.repeats([*zip(kinds, texts)], threshold, shingle_size)
        return ([k for k in range(len(texts)) if k not in gone],)

    return by_document(segments, key, ("kind", "text"), kept, segments.columns)
