"""Toxicity scores: a Levenshtein automaton over a lexicon trie finds terms, also misspelt; context windows weigh them.

The lexicon has built-in insults and what labelled training documents teach: words, and word beginnings, that occur in
toxic documents only. Terms sit in a trie; the automaton walks the trie with one row of edit distances a node, so that
a word is compared with all terms at once, and a branch is left when its whole row is above the allowed distance.
Every hit is looked at in its window of CONTEXT words: quotation marks around it, words of reporting before it and
negation count as quotation, second-person words and further hits near it as abuse. A logistic model over those few
numbers, fitted on a bounded sample of labelled training rows, turns them into a score between 0 and 1.

Labels are read only of rows whose crc32(doc_id as text) modulo 5 is not 0; nothing but the text enters a score.
"""

from __future__ import annotations


from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, arrow_map, ids_and_texts, setting, slices, without

#: Labelled training rows that the lexicon and the model are fitted on, at most; and learned terms, at most.
SAMPLE_ROWS, LEARNED_TERMS = 20_000, 4_000
MIN_DOCS, MIN_PURITY, MIN_STEM, CONTEXT = 3, 0.8, 4, 6
#: Words whose hits a task remembers, and words whose sums of letters it holds at once.
CACHE_WORDS, MARK_WORDS = 400_000, 1 << 14
#: Bytes of text in an Arrow batch, and of those that are split into words at once.
BATCH_BYTES, SPLIT_BYTES = 1 << 22, 1 << 20

BUILT_IN = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "scumbag", "dumbass", "asshole", "bastard")
_SPOKEN = frozenset("said says say wrote called calls quote quoted quoting told reported word term".split())
_DENIED = frozenset("not never no isn't aren't wasn't don't without".split())
_AIMED = frozenset("you your you're yourself u ur they he she them all".split())
_QUOTES = "\"'“”„«»‹›‘’"
_EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~" + "“”„«»‹›‘’…–—¡¿"
_LEET = str.maketrans("013457@$!", "oieastasi")
#: words of letters, for learning
_LEARN = "[^\\p{L}\\p{M}]+"


def _shortened(word: str, most: int) -> set[str]:
    """The word and what is left of it without up to ``most`` letters."""
    out = now = {word}
    for _ in range(most):
        now = {w[:i] + w[i + 1 :] for w in now for i in range(len(w))}
        out = out | now
    return out


class _Forms:
    """Marks words of which a beginning, or the whole, may be within some edits of a term, many words at a time.

    Two strings within k edits are equal after at most k letters are left out of each. The hashes of what is left of the
    terms are bits of a table; those of the words are found from running sums, a few operations a letter for all words
    at once. A mark may be wrong, a missing one is not.
    """

    _BASE = 0x9E3779B97F4A7C15
    _INVERSE = pow(_BASE, -1, 1 << 64)
    _BITS = 22

    def __init__(self, near: dict[tuple[bool, int], set[str]], lengths: dict[tuple[bool, int], list[int]]):
        self.lengths, self.table = lengths, {}
        self.width = max((n for v in lengths.values() for n in v), default=0)
        for group, forms in near.items():
            table = self.table[group] = np.zeros(1 << self._BITS, bool)
            table[self._slot(np.array([sum((ord(c) + 1) * pow(self._BASE, i, 1 << 64) for i, c in enumerate(f)) & (1 << 64) - 1 for f in forms], np.uint64))] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self._BITS)

    def may_be(self, words: list[str]) -> np.ndarray:
        parts = [self._may_be(words[at : at + MARK_WORDS]) for at in range(0, len(words), MARK_WORDS)]
        return np.concatenate(parts) if parts else np.zeros(0, bool)

    def _may_be(self, words: list[str]) -> np.ndarray:
        size, out = np.array(list(map(len, words)), np.int64), np.zeros(len(words), bool)
        if not self.width:
            return out
        letters = np.array(words, f"U{self.width}").view(np.uint32).reshape(len(words), self.width)
        sums = [np.zeros(len(words), np.uint64)]
        for i in range(self.width):
            sums.append(sums[-1] + (letters[:, i].astype(np.uint64) + np.uint64(1)) * np.uint64(pow(self._BASE, i, 1 << 64)))
        once, twice = np.uint64(self._INVERSE), np.uint64(self._INVERSE * self._INVERSE & (1 << 64) - 1)
        for (stem, k), table in self.table.items():
            for n in self.lengths[stem, k]:
                at = np.flatnonzero((size >= n if stem else size == n) & ~out)
                if not len(at) or n <= 0:
                    continue
                p = [s[at] for s in sums[: n + 1]]
                hit = table[self._slot(p[n])]
                for i in range(n):
                    hit |= table[self._slot(p[i] + (p[n] - p[i + 1]) * once)]
                    for j in range(i + 1, n if k > 1 else 0):
                        hit |= table[self._slot(p[i] + (p[j] - p[i + 1]) * once + (p[n] - p[j + 1]) * twice)]
                out[at[hit]] = True
        return out


class Trie:
    """Terms with a weight each; a stem also accepts any ending. ``near`` has other weights for their misspellings."""

    def __init__(self, terms: list[tuple[str, bool, float]], near: dict[str, float] | None = None):
        self.root: dict = {}
        self.exact = {t: w for t, _, w in terms}
        for t, stem, w in terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = (t, stem, w)
        # the automaton walks a trie of the terms that may be misspelt, with words that share a shortened form with one
        self.loose: dict = {}
        self.near: dict[tuple[bool, int], set[str]] = {}
        lengths: dict[tuple[bool, int], set[int]] = {}
        for t, stem, w in terms:
            k, w = self.allowed(t), (near or {}).get(t, w)
            if not k or not w:
                continue
            node = self.loose
            for c in t:
                node = node.setdefault(c, {})
            node[""] = (t, stem, w)
            self.near.setdefault((stem, k), set()).update(_shortened(t, k))
            lengths.setdefault((stem, k), set()).update(range(len(t) - k, len(t) + k + 1))
        self.lengths = {x: sorted(v) for x, v in lengths.items()}
        self.forms = _Forms(self.near, self.lengths)
        # neighbours swapped: listed, since a swap may touch both halves of a term
        self.swapped = {t[:i] + t[i + 1] + t[i] + t[i + 2 :]: w for t, stem, w in terms if not stem and len(t) > 4 for i in range(len(t) - 1) if t[i] != t[i + 1]}

    @staticmethod
    def allowed(term: str) -> int:
        return 0 if len(term) < 4 else 1 if len(term) < 10 else 2

    def stem(self, word: str) -> float | None:
        node = self.root
        best = None
        for c in word:
            node = node.get(c)
            if node is None:
                break
            if "" in node and node[""][1]:
                best = max(best or 0.0, node[""][2])
        return best

    def fuzzy(self, word: str, most: int = 2) -> tuple[float, int, str] | None:
        """Weight, distance and name of the nearest term within its allowed distance: automaton states walk the trie.

        A stem is compared with all beginnings of the word, and edits must lie within it: they may not take its last
        letter away, or every longer word with the letters before that one would match.
        """
        best: tuple[int, float, str] | None = None
        todo = [(self.loose, list(range(len(word) + 1)), None, "")]
        while todo:
            node, row, before, last = todo.pop()
            for c, child in node.items():
                if c == "":
                    term, stem, w = child
                    far = row[-1]
                    if stem:
                        ends = [row[j] for j in range(1, len(word) + 1) if word[j - 1] == term[-1] or (j > 1 and word[j - 2 : j] == term[-1] + term[-2])]
                        far = min(ends, default=len(term))
                    if far <= self.allowed(term) and (best is None or (far, -w) < (best[0], -best[1])):
                        best = (far, w, term)
                    continue
                nxt = [row[0] + 1]
                for j, x in enumerate(word, 1):
                    cost = min(row[j] + 1, nxt[j - 1] + 1, row[j - 1] + (x != c))
                    if before is not None and j > 1 and x == last and word[j - 2] == c:
                        cost = min(cost, before[j - 2] + 1)  # neighbours swapped
                    nxt.append(cost)
                if min(nxt) <= most:
                    todo.append((child, nxt, row, c))
        return None if best is None else (best[1], best[0], best[2])

    def may_be_fuzzy(self, word: str) -> bool:
        for (stem, k), forms in self.near.items():
            for n in self.lengths[stem, k]:
                if (n <= len(word) if stem else n == len(word)) and not forms.isdisjoint(_shortened(word[:n], k)):
                    return True
        return False

    def marks(self, words: list[str]) -> list[bool]:
        """Which words ``hit`` has to look at for misspellings."""
        return self.forms.may_be([w.strip(_EDGE).translate(_LEET) for w in words]).tolist()

    def telling(self, common: frozenset[str]) -> frozenset[str]:
        """Those of the common words that ``hit`` would take for misspellings; the others change no hit."""
        words = list(common)
        out = set()
        for w, marked in zip(words, self.marks(words)):
            v = w.translate(_LEET)
            if v in self.swapped or (marked and self.may_be_fuzzy(v)):
                out.add(w)
        return frozenset(out)

    def hit(self, word: str, common: frozenset[str], marked: bool = True) -> tuple[float, float]:
        """(weight of an exact or stem hit, weight of a misspelt hit) of one lower-case word."""
        w = word.strip(_EDGE)
        if not w:
            return 0.0, 0.0
        for v in (w, w.translate(_LEET)) if not w.isalpha() else (w,):
            got = self.exact.get(v)
            if got is None:
                got = self.stem(v)
            if got is not None:
                return got, 0.0
        v = w.translate(_LEET)
        if w in common:
            return 0.0, 0.0
        if v in self.swapped:
            return 0.0, self.swapped[v]
        if not marked or not self.may_be_fuzzy(v):
            return 0.0, 0.0
        near = self.fuzzy(v)
        return (0.0, near[0] / near[1]) if near and near[1] else (0.0, near[0]) if near else (0.0, 0.0)


#: Weights of the features and the bias before any label is seen; they matter where labelled rows say nothing.
PRIOR = (4.0, 2.0, 4.0, 2.0, 0.0, -1.0, 0.0, -3.0)
FEATURES = ("exact", "exact_count", "fuzzy", "fuzzy_count", "aimed", "quoted", "density")


def _context(words: list[str], at: int, hits: set[int]) -> tuple[bool, bool]:
    """(in quotation, aimed at someone) of the hit at a word, from the window around it."""
    before, after = words[max(0, at - CONTEXT) : at], words[at + 1 : at + 1 + CONTEXT]
    w = words[at]
    opened = sum(x[0] in _QUOTES for x in before) + (w[0] in _QUOTES)
    closed = sum(x.rstrip(".,;:!?")[-1:] in _QUOTES and x[-1:] != "" for x in after) + (w.rstrip(".,;:!?")[-1:] in _QUOTES)
    quoted = (opened > 0 and closed > 0) or bool(_SPOKEN.intersection(x.strip(_EDGE) for x in before)) or bool(_DENIED.intersection(x.strip(_EDGE) for x in before[-2:]))
    aimed = bool(_AIMED.intersection(x.strip(_EDGE) for x in before + after)) or any(i in hits for i in range(at - CONTEXT, at + CONTEXT + 1) if i != at)
    return quoted, aimed


def _features(terms: list[tuple[str, bool, float]], common: frozenset[str], near: dict[str, float] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(terms, near)

        known: dict[str, tuple[float, float] | None] = {}
        for b in slices(batches, most=SPLIT_BYTES):
            if len(known) > CACHE_WORDS:
                known.clear()
            rows, texts = [], [t.lower().split() for t in b.column("text").to_pylist()]
            new = list({w for words in texts for w in words if w not in known})
            for w, marked in zip(new, trie.marks(new)):
                got = trie.hit(w, common, marked)
                known[w] = got if got != (0.0, 0.0) else None
            for words in texts:
                got = list(map(known.__getitem__, words))
                at = [i for i, g in enumerate(got) if g is not None]
                if not at:
                    rows.append((0.0,) * len(FEATURES))
                    continue
                exact = fuzzy = exact_n = fuzzy_n = aimed = quoted = 0.0
                hits = set(at)
                for i in at:
                    e, f = got[i]
                    q, a = _context(words, i, hits)
                    share = 0.5 if q else 1.0
                    exact, fuzzy = max(exact, e * share), max(fuzzy, f * share)
                    exact_n, fuzzy_n = exact_n + e * share, fuzzy_n + f * share
                    aimed, quoted = aimed + a, quoted + q
                rows.append((exact, np.log1p(exact_n), fuzzy, np.log1p(fuzzy_n), aimed / len(at), quoted / len(at), len(at) / len(words)))
            columns = [pa.array([float(r[k]) for r in rows], pa.float64()) for k in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *FEATURES])

    return run


def held_out(doc_id: F.Column | str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _training_rows(docs: DataFrame, labels: DataFrame, stage: Stage) -> DataFrame:
    """(doc_id, text, toxic) of at most SAMPLE_ROWS labelled training rows, the first by a hash of their ids."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    kept = stage.keep(docs.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic"), "sample")
    return kept.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _weight(bad: int, n: int) -> float:
    """Log odds of toxic among the documents with a term, scaled and cut to 0.1 .. 1."""
    return float(np.clip(np.log((bad + 0.5) / (n - bad + 0.5)) / 5, 0.1, 1))


def learn_terms(rows: DataFrame) -> tuple[list[tuple[str, bool, float]], frozenset[str]]:
    """Terms (word, stem?, weight) found in toxic rows only, built-in ones besides, and words common in clean rows.

    Counts are of documents, for stems of pairs of a document and a word. What comes to the driver is bounded: LEARNED_TERMS words and stems, as many common words.
    """
    found = rows.select("doc_id", "toxic", F.array_sort(F.array_distinct(F.split(F.lower("text"), _LEARN))).alias("ws"))
    # copies would make every word of a toxic text look toxic: of texts with the same words one is counted
    found = found.groupBy(F.xxhash64("ws").alias("sketch"), "toxic").agg(F.min_by("ws", "doc_id").alias("ws"))
    words = found.select("toxic", F.explode("ws").alias("w")).where(F.length("w") >= 3)
    def pure(x: DataFrame) -> list:
        return x.where((F.col("bad") >= MIN_DOCS) & (F.col("bad") >= MIN_PURITY * F.col("n"))).orderBy(F.desc("bad"), "w").limit(LEARNED_TERMS).collect()

    n_rows, n_bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    by_word = words.groupBy("w").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).persist()
    base = (n_bad + 1) / (n_rows + 2)
    # chance: a word of n documents is all toxic with probability base ** n; learn only what is unlikely among all words
    kinds = max(1, by_word.count())
    enough = max(MIN_DOCS, int(np.ceil(np.log(0.01 / kinds) / np.log(min(base, 0.9)))))
    beginnings = F.expr(f"transform(sequence({MIN_STEM}, least(length(w) - 1, 10)), n -> left(w, n))")
    stems = by_word.where(F.length("w") > MIN_STEM).select(F.explode(beginnings).alias("w"), "bad", "n").groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    exact = [r for r in pure(by_word) if r["bad"] >= enough]
    found = {r["w"]: r["bad"] for r in exact}
    weight = {r["w"]: _weight(r["bad"], r["n"]) for r in exact}
    stem_rows = sorted((r for r in pure(stems) if r["bad"] >= enough), key=lambda r: (len(r["w"]), r["w"]))
    common = frozenset(r["w"] for r in by_word.where("n - bad >= 2").orderBy(F.desc("n"), "w").limit(100 * LEARNED_TERMS).collect())
    kept: list[tuple[str, bool, float]] = []
    taken: set[str] = set()
    for r in stem_rows:
        w = r["w"]
        # a stem must gain over its whole words, else it is just a word's beginning
        if not any(w[:k] in taken for k in range(MIN_STEM, len(w))) and not any(x.startswith(w) and n >= 0.8 * r["bad"] for x, n in found.items()):
            taken.add(w)
            kept.append((w, True, _weight(r["bad"], r["n"])))
    kept += [(w, False, weight[w]) for w in found if not any(w[:k] in taken for k in range(MIN_STEM, len(w) + 1))]
    have = {t for t, _, _ in kept}
    kept += [(t, False, 1.0) for t in BUILT_IN if t not in have and t not in common]
    by_word.unpersist()
    return kept, common


def _misspelt(terms: list[tuple[str, bool, float]], common: frozenset[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(terms)
        for b in batches:
            rows = [*zip(*(c.to_pylist() for c in b.columns))]
            got = [(x[2], bad, n) for (w, bad, n), marked in zip(rows, trie.marks([r[0] for r in rows])) if trie.hit(w, common, marked)[1] and trie.may_be_fuzzy(w) and (x := trie.fuzzy(w))]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["t", "bad", "n"])

    return run


def near_weights(rows: DataFrame, terms: list[tuple[str, bool, float]], common: frozenset[str]) -> dict[str, float]:
    """Of the terms whose misspellings labelled rows have, what those tell: 0 if most of them are in clean rows."""
    words = rows.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), _LEARN))).alias("w")).groupBy("w")
    words = words.agg(F.sum("toxic").cast("long").alias("bad"), F.count(F.lit(1)).alias("n"))
    seen = arrow_map(words, _misspelt(terms, common), "t string, bad long, n long").groupBy("t").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    own = {t: w for t, _, w in terms}
    return {r["t"]: min(own[r["t"]], _weight(r["bad"], r["n"])) if 2 * r["bad"] > r["n"] else 0.0 for r in seen.collect()}  # a row a term at most


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, drawn slightly to PRIOR; labels of one kind only: PRIOR itself."""
    prior = np.array(PRIOR)
    if not len(y) or y.min() == y.max():
        return prior[:-1], float(prior[-1])
    a = np.hstack([x, np.ones((len(x), 1))])
    w = prior.copy()
    r = np.full(len(w), ridge)
    r[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(r), a.T @ (y - p) - r * (w - prior))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Null texts are empty and score as texts without a hit. A null doc_id counts as not held out. Labels of one doc_id
    that differ count as toxic. Without labels of both kinds fixed weights are used.
    """
    stage = Stage(spark, "toxicity")
    texts = ids_and_texts(docs)
    sample = _training_rows(texts, labels, stage)
    terms, common = learn_terms(sample)
    common = Trie(terms).telling(common)  # a few words instead of all go to the tasks
    schema = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)
    run = _features(terms, common, near_weights(sample, terms, common))
    known = arrow_map(sample.select("doc_id", "text"), run, schema).join(sample.select("doc_id", "toxic").distinct(), "doc_id").toPandas()  # SAMPLE_ROWS at most
    weights, bias = _fit(known[list(FEATURES)].to_numpy(float), known["toxic"].to_numpy(float))
    z = sum((F.col(f) * float(w) for f, w in zip(FEATURES, weights)), F.lit(bias))
    score = 1 / (1 + F.exp(-z))
    out = arrow_map(texts, run, schema).select("doc_id", held_out().alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, columns as in docs, that are not predicted toxic; rows with a null doc_id stay.

    The ids that go are a written table: no text is scored while whole documents are joined, and Spark knows how few there are.
    """
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
        gone = scores(spark, docs, labels).where("predicted = 1 and doc_id is not null").select("doc_id").distinct()
        gone = Stage(spark, "toxic").keep(gone, "gone")
    return without(docs, gone)
