"""Substring dedup: every word covered by a 20-word window that starts earlier elsewhere is removed.

The windows are the edges of a De Bruijn graph whose nodes are runs of 19 words, and only repeated edges matter:

1. Cores. Each window is named by its minimizer, the least hash among its 6-word runs; consecutive windows that share
   one (eight or so) are a fragment, a piece of path. Equal windows have equal minimizers at equal places, so only
   fragments whose core occurs again in the corpus can hold a repeated edge. Cores are counted in partial sums.
2. Classes. Equal fragments, by a 128-bit key, are one class with its number of occurrences and its first coordinate. All
   edges of a later occurrence are repeats. Where a core has several classes the paths run together and part, so these
   classes, each once, are taken apart into single edges, grouped by 128-bit keys for their first coordinates.
3. Paths. In- and out-degrees of the nodes at the ends of classes tell where the graph branches. A join on nodes links a
   repeated class to the one after it if their node has one edge in and one out, they occur equally often, and their
   first coordinates are consecutive; linked classes are compacted to a nonbranching path. Every occurrence of a path is
   put together from its fragments by their diagonal, occurrence less source.
4. Verification. The spans of an occurrence and of its source are read again from the texts at those coordinates, and
   the words count as repeated only if the 128-bit digests of the texts agree.

Group sizes never matter: cores, classes and edges aggregate before they shuffle, joins are plain equi-joins that
adaptive execution may split, and per-document lists are no longer than the document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, Stage, arrow_map, fresh, ids_and_texts, mix, offsets_and_bytes, slices, span_hashes, window_hashes, word_spans

WINDOW, CORE = 20, 6


class _Words:
    """The words of a slice of documents, its windows, and its fragments: first window and number of windows."""

    def __init__(self, texts: pa.Array):
        off, self.data = offsets_and_bytes(texts)
        self.starts, self.ends, self.first = word_spans(self.data, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        n = len(self.hashes)
        if n < WINDOW:
            self.fragments = self.n = self.at = np.zeros(0, np.int64)
            self.core = np.zeros(0, U64)
            return
        g = window_hashes(self.hashes, CORE)
        least, span, want = np.arange(len(g)), 1, WINDOW - CORE + 1
        while span < want:
            step = min(span, want - span)
            a, b = least[:-step], least[step:]
            least = np.where(g[a] <= g[b], a, b)
            span += step
        windows = np.flatnonzero(self.doc[: n - WINDOW + 1] == self.doc[WINDOW - 1 :])
        least = least[windows]
        # places of minimizers rise with the windows, so a change of place begins a fragment
        begin = np.flatnonzero(np.diff(least, prepend=-1))
        self.fragments, self.n = windows[begin], np.diff(np.append(begin, len(windows)))
        self.core, self.at = g[least[begin]], self.fragments - self.first[self.doc[self.fragments]]

    def keys(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of every run of k words."""
        return window_hashes(self.hashes, k, 0x51), window_hashes(span_hashes(self.data, self.starts, self.ends, other=True), k, 0x52)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        core, c = np.unique(_Words(b.column("text")).core, return_counts=True)
        yield pa.RecordBatch.from_arrays([_long(core), pa.array(c)], ["core", "c"])


_FRAGMENTS = "core long, a long, b long, u long, w long, n int, doc_id long, v long, start int"


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        w = _Words(b.column("text"))
        s, n = w.fragments, w.n
        # the first and the last window of a fragment cover it
        a, other = (mix(x[s] * U64(3) + mix(x[s + n - 1]) + n.astype(U64)) for x in w.keys(WINDOW)) if len(s) else (w.core, w.core)
        nodes = window_hashes(w.hashes, WINDOW - 1)
        doc = w.doc[s]
        columns = [_long(w.core), _long(a), _long(other), _long(nodes[s]), _long(nodes[s + n]), pa.array(n.astype(np.int32)), *(b.column(c).take(pa.array(doc)) for c in ("doc_id", "v")), pa.array(w.at.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["core", "a", "b", "u", "w", "n", "doc_id", "v", "start"])


def _asked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and n of the list ``asked`` of every row."""
    lists = b.column("asked")
    flat = lists.flatten()
    row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
    return row, *(flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "n"))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        w = _Words(b.column("text"))
        row, start, n = _asked(b)
        row, at = np.repeat(row, n), np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x, y = (k[w.first[row] + at] for k in w.keys(WINDOW))
        columns = [_long(x), _long(y), *(b.column(c).take(pa.array(row)) for c in ("doc_id", "v")), pa.array(at.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["x", "y", "doc_id", "v", "start"])


_SPANS = "doc_id long, v long, start int, n int, src long, src_v long, src_start int"


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts on one diagonal, put together where they touch."""
    for b in batches:
        out = []
        for doc_id, v, src, src_v, off, parts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "v", "src", "src_v", "off", "parts"))):
            for p in sorted(parts, key=lambda p: p["start"]):
                if out and out[-1][:2] == [doc_id, v] and out[-1][4:] == [src, src_v, out[-1][2] - off] and out[-1][2] + out[-1][3] == p["start"]:
                    out[-1][3] += p["n"]
                else:
                    out.append([doc_id, v, p["start"], p["n"], src, src_v, p["start"] - off])
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["doc_id", "v", "start", "n", "src", "src_v", "src_start"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128-bit digests of the asked spans: the words of n windows from the word start on."""
    for b in slices(batches):
        off, data = offsets_and_bytes(b.column("text"))
        starts, ends, first = word_spans(data, off)
        raw = data.tobytes()
        row, start, n = _asked(b)
        lo, hi = first[row] + start, first[row] + start + n + WINDOW - 1
        found = [hashlib.blake2b(b" ".join(raw[s:e].split()), digest_size=16).digest() for s, e in zip(starts[lo].tolist(), ends[hi - 1].tolist())]
        columns = [*(b.column(c).take(pa.array(row)) for c in ("doc_id", "v")), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(found, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "v", "start", "n", "digest"])


def _version(docs: DataFrame, stage: Stage) -> F.Column:
    """What tells apart the rows of one doc_id: a hash of the text if any doc_id is repeated, else 0."""
    again = ids_and_texts(docs).where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    return F.lit(0).cast("long") if again.isEmpty() else F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def _classes(texts: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """Occurrences of the fragments with a repeated core, and their classes: key, end nodes, first coordinate f, count c."""
    cores = arrow_map(texts.select("text"), _cores, "core long, c long").groupBy("core").agg(F.sum("c").alias("c")).where("c > 1").select("core")
    cores = stage.keep(cores, "cores")
    # by merge: the repeated cores grow with the corpus
    found = stage.keep(arrow_map(texts, _fragments, _FRAGMENTS).join(cores.hint("merge"), "core", "left_semi"), "fragments")
    stage.drop("cores")
    classes = found.groupBy("core", "a", "b", "u", "w", "n").agg(F.min(F.struct("doc_id", "v", "start")).alias("f"), F.count(F.lit(1)).alias("c"))
    return found, stage.keep(classes, "classes")


def _paths(classes: DataFrame) -> DataFrame:
    """(a, b, f, path) of the repeated classes: path numbers the nonbranching paths of one source document."""
    leaving, coming = (classes.groupBy(F.col(c).alias("node")).agg(F.count(F.lit(1)).alias(c)) for c in "uw")
    straight = leaving.join(coming, "node").where("u = 1 and w = 1").select("node")
    repeated = classes.where("c > 1")
    before = repeated.select(F.col("w").alias("node"), F.col("f").alias("g"), F.col("n").alias("m"), F.col("c").alias("d"))
    after = repeated.select("a", "b", F.col("u").alias("node"), "f", "c")
    linked = straight.join(before.hint("merge"), "node").join(after.hint("merge"), "node")
    linked = linked.where("c = d and f.doc_id = g.doc_id and f.v = g.v and f.start = g.start + m").select("a", "b", F.lit(0).alias("new")).distinct()
    order = W.partitionBy("f.doc_id", "f.v").orderBy("f.start").rowsBetween(W.unboundedPreceding, 0)
    marked = repeated.select("a", "b", "f").join(linked, ["a", "b"], "left").withColumn("path", F.sum(F.coalesce("new", F.lit(1))).over(order))
    return marked.select("a", "b", "f", "path")


def _repeated_edges(texts: DataFrame, classes: DataFrame, stage: Stage) -> DataFrame:
    """Single edges, in the first occurrences of classes that share a core with others, that occur earlier elsewhere."""
    shared = classes.groupBy("core").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("core")
    places = classes.join(shared.hint("merge"), "core", "left_semi").select("f.doc_id", "f.v", "f.start", "n")
    asked = places.groupBy("doc_id", "v").agg(F.collect_list(F.struct("start", "n")).alias("asked"))
    edges = stage.keep(arrow_map(texts.join(asked, ["doc_id", "v"]), _edges, "x long, y long, doc_id long, v long, start int"), "edges")
    first = edges.groupBy("x", "y").agg(F.min(F.struct("doc_id", "v", "start")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1").select("x", "y", "f")
    first = stage.keep(first, "first")
    later = edges.join(first.hint("merge"), ["x", "y"]).where("f <> struct(doc_id, v, start)")
    return later.select("doc_id", "v", "start", F.lit(1).alias("n"), "f", F.lit(-1).cast("long").alias("path"))


def repeated_spans(docs: DataFrame, version: F.Column, stage: Stage) -> DataFrame:
    """(doc_id, v, spans array<struct<start, n>>): the repeated windows n from start on, for rows that have any."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), version.alias("v")).where("doc_id is not null")
    fragments, classes = _classes(texts, stage)
    paths = stage.keep(_paths(classes), "compacted")
    later = fragments.select("a", "b", "n", "doc_id", "v", "start").join(paths.hint("merge"), ["a", "b"]).where("f <> struct(doc_id, v, start)")
    later = later.select("doc_id", "v", "start", "n", "f", "path").unionByName(_repeated_edges(texts, classes, stage))
    later = later.select("doc_id", "v", "start", "n", F.col("f.doc_id").alias("src"), F.col("f.v").alias("src_v"), (F.col("start") - F.col("f.start")).alias("off"), "path")
    parts = later.groupBy("doc_id", "v", "src", "src_v", "off", "path").agg(F.collect_list(F.struct("start", "n")).alias("parts"))
    spans = stage.keep(arrow_map(parts, _stretches, _SPANS), "paths")
    stage.drop("fragments", "classes", "compacted", "edges", "first")
    return _verified(texts, spans, stage)


def _verified(texts: DataFrame, paths: DataFrame, stage: Stage) -> DataFrame:
    own = paths.select("doc_id", "v", "start", "n")
    spans = own.unionByName(paths.select(F.col("src").alias("doc_id"), F.col("src_v").alias("v"), F.col("src_start").alias("start"), "n")).distinct()
    asked = spans.groupBy("doc_id", "v").agg(F.collect_list(F.struct("start", "n")).alias("asked"))
    digests = arrow_map(texts.join(asked, ["doc_id", "v"]), _digests, "doc_id long, v long, start int, n int, digest binary").distinct()
    digests = stage.keep(digests, "digests")
    source = digests.select(F.col("doc_id").alias("src"), F.col("v").alias("src_v"), F.col("start").alias("src_start"), "n", F.col("digest").alias("wanted"))
    good = paths.join(digests.hint("merge"), ["doc_id", "v", "start", "n"]).join(source.hint("merge"), ["src", "src_v", "src_start", "n"]).where("digest = wanted")
    good = stage.keep(good.groupBy("doc_id", "v").agg(F.collect_set(F.struct("start", "n")).alias("spans")), "spans")
    stage.drop("paths", "digests")
    return good


def _kept_words(text: bytes, spans: list[dict]) -> tuple[int, int, bytes]:
    words = text.split()
    gone = np.zeros(len(words), bool)
    for s in spans:
        gone[s["start"] : s["start"] + s["n"] + WINDOW - 1] = True
    kept = words if not gone.any() else [w for w, g in zip(words, gone) if not g]
    return len(words), int(gone.sum()), b" ".join(kept)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        got = [_kept_words(t, s or []) for t, s in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([hashlib.sha256(g[2]).hexdigest() for g in got], pa.string()), pa.array([g[2].decode() for g in got], pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
        )


def _with_spans(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents and, in a column of the returned name, the spans of each row; null doc_ids have none."""
    stage = Stage(docs.sparkSession, "substring")
    version = _version(docs, stage)
    name, key, v = (fresh(n, docs.columns) for n in ("spans", "span_doc", "span_v"))
    spans = repeated_spans(docs, version, stage).select(F.col("doc_id").alias(key), F.col("v").alias(v), F.col("spans").alias(name))
    return docs.join(spans, (docs["doc_id"].cast("long") == spans[key]) & (version == spans[v]), "left").drop(key, v), name


def dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for every row; kept is the words left, joined by one space.

    Words are runs of bytes other than space and tab to carriage return. Null texts have no words, an empty table has
    no rows. A row with a null doc_id has no place in the order: it is returned whole and is nobody's source. Rows of one
    doc_id with different texts follow one another by a hash of their texts; equal rows are one document, whose repeats
    go from each. Columns other than doc_id and text are ignored.
    """
    docs = ids_and_texts(docs)
    joined, name = _with_spans(docs)
    return arrow_map(joined.select("doc_id", "text", F.col(name).alias("spans")), _kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents, columns as in docs, with repeated words gone from text; n_chars, if there, is brought up to date.

    Documents without repeats are left as they are. Documents of which nothing is left keep an empty text.
    """
    joined, name = _with_spans(docs)
    schema, names = docs.schema, docs.columns
    at = names.index("text")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, texts = b.column(len(names)).to_pylist(), b.column(at).to_pylist()
            new = [t if not s or t is None else _kept_words(t.encode(), s)[2].decode() for t, s in zip(texts, spans)]
            columns = [b.column(i) for i in range(len(names))]
            columns[at] = pa.array(new, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    out = joined.select(*[docs[c] for c in names], name).mapInArrow(rewrite, schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return out
