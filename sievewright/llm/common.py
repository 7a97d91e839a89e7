"""Shared pieces of the training-data operators: staged tables, Arrow slicing, vectorised word hashing, components.

Word hashes are computed with numpy over the UTF-8 bytes of a whole Arrow batch: a prefix polynomial modulo 2**64
gives every word's hash in a few passes, and a second polynomial over the word hashes gives k-word window hashes.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xC2B2AE3D27D4EB4F | 1
_OTHER_P = 0xD1B54A32D192ED03
_P_INV, _OTHER_P_INV, _Q_INV = (pow(x, -1, 1 << 64) for x in (_P, _OTHER_P, _Q))
#: Text bytes handled at once inside a task, whatever the size of the Arrow batch.
SLICE_BYTES = 1 << 21
_BLOCK = 1 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- staged tables -------------------------------------------------------------------------------------------------

_own_dirs: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or an own one on a local master."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="sievewright-")
    return "file://" + _own_dirs[app]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Stage:
    """A scratch folder in the shared directory. ``keep`` writes a table and reads it back, which cuts lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._at_exit)

    def _at_exit(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # the session may be gone; the shared folder is then cleaned with it
            pass

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def local_path(self, name: str) -> str:
        """The same place as a plain file path, for memory-mapped files on a mounted shared folder."""
        p = self.path(name)
        if p.startswith("file:"):
            p = "/" + p[5:].lstrip("/")
        if "://" in p:
            raise RuntimeError("memory-mapped levels need spark.checkpoint.dir on a mounted file system")
        return p

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        with setting(self.spark, _CLEANUP, "true"):  # the table replaces the plan's shuffle files: Spark drops them with the query
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name like ``name`` that clashes with none of ``taken``, in any case of letters."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose doc_id isn't among those of gone (one column of longs); null doc_ids stay."""
    name = fresh("gone", docs.columns)
    gone = gone.toDF(name)
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only: other columns, whatever their names, never reach the operators' internals."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


# --- Arrow ---------------------------------------------------------------------------------------------------------


def offsets_and_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets (n + 1) and UTF-8 bytes of a string column without nulls."""
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_string())
    buffers = col.buffers()
    off = np.frombuffer(buffers[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return off - off[0], data[off[0] : off[-1]]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that no piece has more than ``most`` bytes of text, but for single longer rows."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = offsets_and_bytes(b.column(b.schema.get_field_index(text)))[0]
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Non-negative values below 2**35 as bytes of seven bits each, low ones first; row k of the binary column has the values from ends[k] to ends[k + 1]."""
    v = np.asarray(values, np.int64)
    size = 1 + sum((v >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(at[-1]), np.uint8)
    for k in range(5):
        has = np.flatnonzero(size > k)
        out[at[has] + k] = (v[has] >> 7 * k & 127) | np.where(size[has] > k + 1, 128, 0)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(at[ends].astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


def unpacked(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column made by ``packed``, without nulls, and how many each row has."""
    ends, data = offsets_and_bytes(col.cast(pa.large_binary()))
    last = data < 128
    stop = np.flatnonzero(last)
    start = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
    place = np.arange(len(data)) - np.repeat(start, stop - start + 1)
    values = np.add.reduceat((data & 127).astype(np.int64) << (7 * place), start) if len(stop) else np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(last)])
    return values, np.diff(before[ends])


# --- hashing -------------------------------------------------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


_cache: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    size = max(_BLOCK + 1, 1 << max(n - 1, 1).bit_length())
    if (base, size) not in _cache:
        if size > _BLOCK + 1:
            return _powers(base, size)
        _cache[base, size] = _powers(base, size)
    return _cache[base, size]


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document the index of its first word (n + 1 entries)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    np.logical_not(space[data], out=inside[1:-1])
    change = inside[1:] != inside[:-1]
    starts = change[:-1] & inside[1:-1]
    ends = change[1:] & inside[1:-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    starts[cut] |= inside[cut + 1]
    ends[cut - 1] |= inside[cut]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, other: bool = False) -> np.ndarray:
    """64-bit hashes of the byte spans, block by block so that memory stays within a few MB for any length; ``other``
    gives independent ones."""
    multiplier, inverse = (_OTHER_P, _OTHER_P_INV) if other else (_P, _P_INV)
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
        piece = data[base : ends[to - 1]]
        if lower:
            piece = _LOWER[piece]
        n = len(piece)
        total = np.empty(n + 1, U64)
        total[0] = 0
        np.cumsum((piece.astype(U64) + U64(1)) * powers(multiplier, n)[:n], out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (total[e] - total[s]) * powers(inverse, n)[s] + (e - s).astype(U64) * U64(0xA0761D6478BD642F)
        at = to
    return mix(out)


def window_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of k consecutive entries (len - k + 1 of them); callers mask those that cross documents."""
    n = len(words)
    if n < k:
        return np.zeros(0, U64)
    out = np.empty(n - k + 1, U64)
    for at in range(0, n - k + 1, _BLOCK - k):
        part = words[at : min(n, at + _BLOCK)]
        m = len(part)
        total = np.empty(m + 1, U64)
        total[0] = 0
        np.cumsum((part ^ U64(seed & _MASK)) * powers(_Q, m)[:m], out=total[1:])
        got = (total[k:] - total[:-k]) * powers(_Q_INV, m)[: m - k + 1]
        out[at : at + len(got)] = got
    return mix(out)


# --- connected components ------------------------------------------------------------------------------------------


def components(edges: DataFrame, stage: Stage, name: str = "cc") -> DataFrame:
    """(node, component) for every node of the edges (a, b): alternating large-star and small-star rounds.

    component is the smallest node of the component. Each round is two aggregations and two joins on the node; rounds
    grow with the logarithm of the longest path. Every round is a written table, so a lost executor costs one round.
    """
    spark = stage.spark

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e if not large else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        linked = both.join(least, "a")
        if large:
            return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = stage.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}0")
    before, k = state(now), 0
    while before[0]:
        k += 1
        nxt = stage.keep(star(star(now, True), False), f"{name}{k}")
        after = state(nxt)
        stage.drop(f"{name}{k - 1}")
        now = nxt
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def give_back() -> None:
    """Returns memory that is free to the system: a Python worker lives on after its task, beside the next one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return df.mapInArrow(run, schema)
