"""Each operator against a brute-force version on a small table of edge cases: nulls, empty texts, copies, ties,
repeated rows, other columns of clashing names; and on an empty table."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("public_tokenizers")

import numpy as np
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievewright.llm import chat_format, decontamination, fingerprints, license_scan, lm_scoring, packing, simhash, substring_dedup, token_counts, toxicity
from sievewright.llm.common import Stage, components
from sievewright.llm.elias_fano import EliasFano
from sievewright.llm.tokenizer_files import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, fp long, start int, key string"


def _texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    plain = [" ".join(rng.choices(words, k=rng.randint(30, 60))) for _ in range(12)]
    shared = " ".join(rng.choices(words, k=25))
    texts = [None, "", " ", "one", "naïve Ünï ½ 漢字 é\x1cx", "a  b \n\n c ", "<|endoftext|> x", *plain, plain[3], plain[3], f"begin {shared} mid {shared} end", f"x {shared}", "Orre " * 6000, shared.upper()]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 7, 1, "k") for i, t in enumerate(_texts())]
    return spark.createDataFrame([*rows, (None, "a null id", None, None, None, None), rows[8], rows[8]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(30)], "doc_id long, quality int, toxic int")


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_token_counts(spark, docs, empty):
    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = Counter((d, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 1024) for d, x in rows_of(docs))
    assert Counter(map(tuple, token_counts.token_counts(spark, docs, path).collect())) == want
    assert token_counts.token_counts(spark, empty, path).count() == 0


def test_packing(spark, docs, empty):
    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack(spark, docs, path).collect()
    ids = {(d, x): np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4") for d, x in rows_of(docs)}
    want = Counter((d, k // 2048, k, len(p := i[k : k + 2048]), zlib.crc32(p.tobytes())) for d, x in rows_of(docs) for i in [ids[d, x]] for k in range(0, len(i), 2048))
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) == -(-sum(r.length for r in got) // 2048)
    assert packing.pack(spark, empty, path).count() == 0


def test_packing_tree(spark):
    rng = random.Random(6)
    fills = [(i, rng.randint(1, 60)) for i in range(300)]
    moved = packing._tree(spark.createDataFrame(fills, "bin long, fill long"), Stage(spark, "t"), 64).collect()
    held = defaultdict(list)
    for r in moved:
        held[r.root].append((r["shift"], dict(fills)[r["bin"]]))
    assert len(moved) == 300 and all(sum(n for _, n in v) <= 64 for v in held.values())
    for v in held.values():
        at = 0
        for shift, n in sorted(v):
            assert shift == at
            at += n


def test_decontamination(spark, docs, empty):
    item = "The quick brown fox, jumps over the lazy dog; then it sleeps by a river until noon tomorrow"
    w = item.split()
    cases = [(100, f"lead in {item.upper()} lead out"), (101, " ".join(x if i not in (5, 11) else "other" for i, x in enumerate(w))), (102, " ".join(w[:7])), (103, "É " + " ".join(w[2:16]))]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "tiny item")], "item_id long, text string")
    more = spark.createDataFrame([(i, t, "en", 1, 1, "k") for i, t in [*cases, (104, "a tiny item here")]], SCHEMA)
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated_pairs(spark, docs.unionByName(more), bench).collect()}
    assert got == {(100, 1), (101, 1), (103, 1), (104, 3)}
    assert decontamination.clean_documents(spark, docs.unionByName(more), bench).count() == docs.count() + 1
    assert decontamination.contaminated_pairs(spark, empty, bench).count() == 0
    assert decontamination.contaminated_pairs(spark, docs, bench.limit(0)).count() == 0


def _decontaminated(texts, items):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    return [tuple(r.values()) for b in decontamination._scan(items)(iter([batch])) for r in b.to_pylist()]


@pytest.mark.parametrize("n", [8, 11, 14, 15, 16, 20])
def test_decontamination_wherever_words_are_replaced(n):
    from itertools import combinations

    item = [f"i{k}" for k in range(n)]
    for replaced in range(n // 5 + 1):
        texts = [" ".join(["a", "b", *("x" if k in at else w for k, w in enumerate(item)), "c"]) for at in combinations(range(n), replaced)]
        got = _decontaminated(texts, [(7, " ".join(item))])
        assert sorted((d, m) for d, _, _, _, m, _ in got) == [(d, n - replaced) for d in range(len(texts))]


def test_decontamination_every_fifth_word_replaced():
    for n in (25, 60, 203):
        item = [f"i{k}" for k in range(n)]
        for phase in range(5):
            text = " ".join("x" if k % 5 == phase else w for k, w in enumerate(item))
            assert any(m >= 12 for *_, m, _ in _decontaminated([f"lead {text} out"], [(7, " ".join(item))]))
        # more replaced, and no stretch that is four fifths whole
        assert not _decontaminated([" ".join("x" if k % 3 == 2 else w for k, w in enumerate(item))], [(7, " ".join(item))])


def test_decontamination_seeds_fit_every_placement():
    from itertools import combinations

    masks = [(sum(1 << i for i, c in enumerate(m) if c == "1"), len(m)) for m in decontamination.MASKS]
    for n in range(8, 24):
        left = np.array([sum(1 << i for i in c) for c in combinations(range(n), n // 5)])
        for bits, size in masks:
            for at in range(n - size + 1):
                left = left[left & (bits << at) != 0]
        assert not len(left)


def test_decontamination_of_two_parts():
    item = [f"i{k}" for k in range(60)]
    text = [w if k < 20 or k >= 40 else "x" for k, w in enumerate(item)]
    assert sorted(r[2:5] for r in _decontaminated([" ".join(text)], [(7, " ".join(item))])) == [(0, 20, 20), (40, 60, 20)]


def test_chat_format(spark):
    rng = random.Random(7)
    rows = [(c, k, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "<|im_end|>", None])) for c in range(40) for k in range(rng.randint(1, 4))] + [(None, 0, None, "x"), (3, None, "user", "early")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes, paths = chat_format.format_conversations(spark, table, Stage(spark, "t"))
    node = {bytes(r.node): r for r in nodes.collect()}
    path, laid = defaultdict(list), defaultdict(dict)
    for r in paths.collect():
        path[r.conv_id].append((r.depth, bytes(r.node)))
    for r in node.values():
        for i, c in enumerate(r.formatted):
            assert r.offset + i not in laid[r.sequence]
            laid[r.sequence][r.offset + i] = c
    assert all(sorted(s) == list(range(len(s))) for s in laid.values())
    for steps in path.values():
        last = node[sorted(steps)[-1][1]]
        whole = "".join(node[n].formatted for _, n in sorted(steps))
        assert "".join(laid[last.sequence][i] for a in sorted(last.attends) for i in range(a.lo, a.hi)) == whole
        assert last.position + len(last.formatted) == len(whole)
    turns = defaultdict(list)
    for c, k, role, text in rows:
        turns[c].append((-1 if k is None else k, role or "", text or ""))
    got = {r.conv_id: r for r in chat_format.read_back(nodes, paths).collect()}
    for c, t in turns.items():
        told = "".join(f"{r}\n{x}\n" for _, r, x in sorted(t))
        loss = "".join(x for _, r, x in sorted(t) if r == "assistant")
        assert (got[c].turns_sha256, got[c].loss_sha256, got[c].n_turns) == (hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest(), len(t))
    assert chat_format.formatted_digests(spark, table.limit(0)).count() == 1


@pytest.mark.parametrize("text", ["<|im_start|>", "<\\|", "<\\\\|x", "\\n<|", ""])
def test_escapes(text):
    assert chat_format.parse_turn(chat_format.format_turn("r\\n\n<|", text)[0]) == ("r\\n\n<|", text)


def test_substring_dedup(spark, docs, empty):
    seen, want = set(), {}
    for d, x in sorted({(d, x) for d, x in rows_of(docs) if d is not None}):
        w = x.encode().split()
        gone = set()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone.update(range(s, s + 20))
            seen.add(k)
        want[d] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    got = substring_dedup.dedup(spark, docs).collect()
    assert len(got) == docs.count() and sum(r.n_removed for r in got) > 100
    assert all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in got if r.doc_id is not None)
    left = substring_dedup.remove_repeats(spark, docs)
    assert left.columns == docs.columns and left.count() == docs.count()
    assert substring_dedup.dedup(spark, empty).count() == 0


def _print(text):
    w = text.encode().lower().split()
    g = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, empty):
    rows = rows_of(docs)
    fp = {x: _print(x) for _, x in rows}
    label = {f: f for f in fp.values()}
    for _ in range(len(label)):
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    first = {c: min(d for d, x in rows if d is not None and label[fp[x]] == c) for c in {label[fp[x]] for d, x in rows if d is not None}}
    got = simhash.near_duplicates(spark, docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{fp[x]:016x}", first.get(label[fp[x]])) for d, x in rows}
    assert {r.doc_id for r in simhash.keep_first(spark, docs).collect()} - {None} == set(first.values())
    assert simhash.near_duplicates(spark, empty).count() == 0


@pytest.mark.parametrize("n", [16_385, 16_386, 16_387, 40_000])
def test_simhash_of_long_texts(n):
    # of the words of one text any shingle left out shows in the count of one bit or another
    for seed in range(6):
        text = " ".join(random.Random(seed).choices([f"w{i}" for i in range(5000)], k=n))
        assert simhash.fingerprint(text.encode()) == _print(text)
    grams = [xxhash.xxh64_intdigest(f"a{i} a{i + 1} a{i + 2}".encode(), 42) for i in range(n - 2)]
    seen = []
    digest, simhash.xxhash.xxh64_intdigest = simhash.xxhash.xxh64_intdigest, lambda g, s: seen.append(digest(g, s)) or seen[-1]
    try:
        simhash.fingerprint(" ".join(f"a{i}" for i in range(n)).encode())
    finally:
        simhash.xxhash.xxh64_intdigest = digest
    assert seen == grams


def test_simhash_links_at_random(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(30)]
    near = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(3)]
    every = sorted({x - (1 << 64) if x >> 63 else x for x in base + near})
    stage = Stage(spark, "t")
    got = components(simhash.links(spark.createDataFrame([(x,) for x in every], "fp long"), stage), stage).collect()
    label = {x: x for x in every}
    for _ in range(8):
        for a in every:
            for b in every:
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    assert {r.node: r.component for r in got} == {x: c for x, c in label.items() if list(label.values()).count(c) > 1}


def test_license_scan(spark, docs, empty):
    notice = license_scan.TEMPLATES["gpl-3.0-notice"]
    cases = [(200, f"intro {notice} and on"), (201, notice.replace("work", "very old work")), (202, "Released under the Apache License."), (203, "released UNDER the mit license")]
    more = spark.createDataFrame([(i, t, "en", 1, 1, "k") for i, t in cases], SCHEMA)
    got = {(r.doc_id, r.license): r for r in license_scan.scan(spark, docs.unionByName(more)).collect()}
    assert set(got) == {(200, "gpl-3.0-notice"), (201, "gpl-3.0-notice"), (203, "mit-notice")}
    assert got[200, "gpl-3.0-notice"].first_start == 1 and got[201, "gpl-3.0-notice"].coverage == 1.0
    assert license_scan.scan(spark, empty).count() == 0


def test_alignment():
    assert license_scan.align([1, 9, 2, 3], [1, 2, 8, 3]) == [(0, 0), (2, 1), (3, 3)]
    assert license_scan.align([], [1]) == [] and license_scan.align([5, 5], [6]) == []


def test_fingerprints(spark, docs, empty):
    import re

    def pieces(x):
        return set(re.findall(r"(?s).{24,120}?(?:(?<=[.!?;:nt])[ \t\n\x0b\f\r]+|\n|\Z)|.{1,120}", x))

    def like(a, b):
        return 1.0 if not a | b else len(a & b) / len(a | b)

    long = spark.createDataFrame([(300 + i, ". ".join(f"s{j} t{j * (i + 1) % 90}" for j in range(150)), "en", 1, 1, "k") for i in range(3)], SCHEMA)
    table = docs.unionByName(long)
    rows = sorted(rows_of(table), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    got = fingerprints.fingerprints(spark, table).collect()
    want = Counter()
    for (d, x), (_, nx) in zip(rows, rows[1:] + rows[:1]):
        n = len(x) // 3
        e = x[: len(x) - n] + nx[:n]
        want[d, len(x), hashlib.sha256(e.encode()).hexdigest(), round(like(pieces(x), pieces(e)), 9), round(like(pieces(x), pieces(nx)), 9)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    prints = defaultdict(set)
    for r in got:
        prints[dict(rows)[r.doc_id]].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    # what the returned fingerprints alone tell, where subtracting and peeling them gets through
    peeled = [(r, d) for r in got if (d := _peeled(r.fingerprint, r.edited_fingerprint)) is not None]
    assert len(peeled) > len(got) // 2
    for r, d in peeled:
        n = sum(int(p.split("-")[0], 16) for p in (r.fingerprint, r.edited_fingerprint))
        assert r.near_edited == (1.0 if not n else (n - d) / (n + d))
    assert fingerprints.fingerprints(spark, empty).count() == 0


def _peeled(a, b):
    import base64

    cells = defaultdict(lambda: [0, 0])
    for p in (a, b):
        raw = base64.b64decode(p.split("-")[1])
        for at in range(0, len(raw), 21):
            cells[raw[at]][0] ^= int.from_bytes(raw[at + 5 : at + 13], "big")
            cells[raw[at]][1] ^= int.from_bytes(raw[at + 13 : at + 21], "big")
    found = 0
    while any(c != [0, 0] for c in cells.values()):
        pure = {k for k, s in cells.values() if xxhash.xxh64_intdigest(k.to_bytes(8, "little"), 42) == s}
        if not pure:
            return None
        for d in pure:
            found += 1
            for i in range(3):
                j = (i << 3) + (d >> 3 * i & 7)
                cells[j][0] ^= d
                cells[j][1] ^= xxhash.xxh64_intdigest(d.to_bytes(8, "little"), 42)
    return found


def test_toxicity(spark, docs, labels, empty):
    bad = [(400 + i, f"you are a {w} and all know it {i}", "en", 1, 1, "k") for i, w in enumerate(["moron", "m0ron", "worthles", "idoit", "pathetic"])]
    table = docs.unionByName(spark.createDataFrame(bad, SCHEMA))
    got = toxicity.scores(spark, table, labels.where("false")).collect()
    assert len(got) == table.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.predicted} == {b[0] for b in bad}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert toxicity.scores(spark, empty, labels).count() == 0


def test_trie():
    t = toxicity.Trie([("worthless", False, 1.0), ("lowei", True, 0.5)])
    none = frozenset()
    assert t.hit("worthless!", none) == (1.0, 0.0) and t.hit("loweixyz", none) == (0.5, 0.0)
    assert t.hit("wrthless", none)[1] and t.hit("wortlhess", none)[1] and not t.hit("worldless", none)[1]
    assert t.hit("worthles", frozenset({"worthles"})) == (0.0, 0.0)


@pytest.mark.parametrize("term", ["trash", "idiot", "clown", "loser", "scum", "moron", "stupid", "worthless"])
def test_trie_finds_every_edit(term):
    t = toxicity.Trie([(w, False, 1.0) for w in toxicity.BUILT_IN])
    n, x = len(term), "q"
    edits = {term[:i] + x + term[i:] for i in range(n + 1)} | {term[:i] + term[i + 1 :] for i in range(n)} | {term[:i] + x + term[i + 1 :] for i in range(n)}
    assert all(t.hit(w, frozenset())[1] for w in edits | {"morron", "idiiot", "clwn"})
    assert t.hit(term[1:], frozenset({term[1:]})) == (0.0, 0.0)


def test_trie_edits_of_long_terms_and_stems():
    none = frozenset()
    t = toxicity.Trie([("disgusting", False, 1.0), ("achkeit", True, 0.5), ("abcdefghij", True, 0.5)])
    assert all(t.hit(w, none)[1] for w in ("disgusitn", "dsgustng", "idsgustnig", "disgusstinng", "dissgustin"))
    assert not t.hit("dsgstng", none)[1]
    assert all(t.hit(w, none)[1] for w in ("achkkeitxyz", "ahkeits", "achkextit", "axhkeitlich", "hackeitlich"[1:], "achketi", "abdefgijxx", "abcxxefghijend"))
    assert not any(t.hit(w, none)[1] for w in ("achkeixyz", "achke", "ackit", "zzachkeit"))


def test_toxicity_marks_many_words_in_little_memory():
    import tracemalloc

    rng = random.Random(16)
    words = ["".join(rng.choices("abcdefgilmnorstu", k=rng.randint(3, 14))) for _ in range(200_000)] + ["morron", "clwn"]
    t = toxicity.Trie([(w, False, 1.0) for w in toxicity.BUILT_IN])
    tracemalloc.start()
    marks = t.marks(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(marks) == len(words) and all(m or not t.may_be_fuzzy(w) for w, m in zip(words, marks)) and marks[-2:] == [True, True]
    assert t.marks([]) == [] and peak < 32e6


def test_toxicity_sends_only_common_words_that_tell():
    rng = random.Random(17)
    common = frozenset("".join(rng.choices("abcdefgilmnorstu", k=rng.randint(3, 9))) for _ in range(20_000)) | {"morron", "clwn", "losre"}
    t = toxicity.Trie([(w, False, 1.0) for w in toxicity.BUILT_IN])
    few = t.telling(common)
    assert {"morron", "clwn", "losre"} <= few < common and 4 * len(few) < len(common)
    words = [*common, "idoit", "stupidd", "m0ron", "«morron!", "scum"]
    assert [t.hit(w, few) for w in words] == [t.hit(w, common) for w in words]


def test_toxicity_scores_nothing_while_documents_are_joined(spark, docs, labels):
    bad = spark.createDataFrame([(400, "you are a moron and all know it", "en", 1, 1, "k"), (400, "its copy", "en", 1, 1, "k")], SCHEMA)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    left = toxicity.accepted(spark, docs.unionByName(bad), labels.where("false"))
    assert spark.conf.get(key) == before and left.columns == docs.columns
    assert Counter(map(tuple, left.collect())) == Counter(map(tuple, docs.collect()))
    assert "InArrow" not in left._jdf.queryExecution().executedPlan().toString()


def test_learned_terms_of_texts_that_share_frequent_words(spark):
    words = [r.w for r in spark.sql("select concat('wort', translate(id, '0123456789', 'abcdefghij')) w from range(300) order by xxhash64(w)").collect()]
    low, rest, rng = " ".join(words[:3]), words[3:], random.Random(13)
    text = lambda i: f"{low} {' '.join(rng.choices(rest, k=20))}" + (" zzorble" if i % 2 else "")
    rows = [(i, text(i), i % 2) for i in range(80)]
    terms, _ = toxicity.learn_terms(spark.createDataFrame([*rows, *[(100 + k, rows[1][1] + " onlycopied", 1) for k in range(60)]], "doc_id long, text string, toxic int"))
    assert "zzorble" in {t for t, _, _ in terms} and "onlycopied" not in {t for t, _, _ in terms}


def test_lm_scoring(spark, docs, empty):
    import math

    c = Counter()
    rows = rows_of(docs)
    tokens = lambda x: [*x.encode().lower().split(), None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    for d, x in rows:
        if not held(d):
            c.update(tokens(x))
    n, v = sum(c.values()), len(c)
    want = Counter((d, held(d), len(t := tokens(x)), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for d, x in rows)
    got = lm_scoring.scores(spark, docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert sum(r.score for r in got) > sum(r.base_score for r in got) and all(r.score <= 1e-9 for r in got)
    assert lm_scoring.scores(spark, empty).count() == 0


def test_lm_bigrams_seen_once(spark):
    import math

    rng = random.Random(11)
    words = [f"w{i}" for i in range(80)]
    texts = [(i, " ".join(rng.choices(words, k=30))) for i in range(60)]
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    tokens = lambda x: [*x.split(), "</s>"]
    c, pairs, n_texts = Counter(), Counter(), 0
    for d, x in texts:
        if not held(d):
            n_texts += 1
            c.update(tokens(x))
            pairs.update(zip(["<s>", *x.split()], tokens(x)))
    of = Counter(pairs.values())
    assert of[1] > 5 * of[2]  # nearly all bigrams are seen once
    d1, d2 = (k[1] / (k[1] + 2 * k[2]) if k[1] else 0.5 for k in (Counter(c.values()), of))
    follow = Counter(a for a, _ in pairs)
    seen = lambda a: n_texts if a == "<s>" else c[a]
    uni = lambda b: (c[b] - d1) / c.total()
    back = lambda a: follow[a] * d2 / seen(a)
    p = lambda a, b: max(0, pairs[a, b] - d2) / seen(a) + back(a) * uni(b)
    got = {r.doc_id: r for r in lm_scoring.scores(spark, spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for d, x in texts:
        want = sum(math.log10(p(a, b)) for a, b in zip(["<s>", *x.split()], tokens(x)))
        assert abs(got[d].score - want) < 0.02 * got[d].n_tokens


def test_elias_fano():
    rng = np.random.default_rng(9)
    for top, n in ((1 << 62, 1000), (5, 1000), (1 << 20, 1), (1 << 20, 5000)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        e = EliasFano.build(v)
        assert (e.get(np.arange(n)) == v).all()
        q = np.concatenate([v, rng.integers(0, top + 9, 500, dtype=np.uint64)])
        assert (e.successor(q) == np.searchsorted(v, q, "left")).all()


def test_stages_with_clashing_columns(spark, docs, labels):
    rows = [(i, t, 1, 2, 3, 4) for i, t in enumerate(["one two three", None, "four"])]
    table = spark.createDataFrame(rows, "doc_id long, text string, GONE int, spans int, Span_Doc int, span_v int")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    for left in (substring_dedup.remove_repeats(spark, table), decontamination.clean_documents(spark, table, bench), simhash.keep_first(spark, table)):
        assert left.columns == table.columns and sorted(map(tuple, left.collect())) == rows


def test_substring_dedup_of_repeated_ids(spark):
    u, v = (" ".join(f"{c}{i}" for i in range(30)) for c in "uv")
    got = substring_dedup.dedup(spark, spark.createDataFrame([(1, u), (2, u), (2, v)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed, r.kept) for r in got) == [(1, 0, u), (2, 0, v), (2, 30, "")]


@pytest.mark.parametrize("text", ["  two  spaces ", "a\n\n  b \t c", "x<|endoftext|> y  <|endoftext|>", " lead", "tail ", "naïve  漢字   z", "it's  don't\r\n 12  34"])
def test_token_units(text):
    path = tokenizer_path("byte_bpe_50k.json")
    units, t = token_counts._Units(path), Tokenizer.from_file(path)
    parts = units(text)
    names = list(units.piece)
    pieces = [names[p] for u in parts for p in units.of[units.ends[u] : units.ends[u + 1]]]
    assert sorted("".join(pieces)) == sorted(text)
    assert sum(len(t.encode(p, add_special_tokens=False).ids) for p in pieces) == len(t.encode(text, add_special_tokens=False).ids)


def test_fingerprints_enter_each_digest_a_few_times(spark, docs, monkeypatch):
    texts = [" ".join(f"w{(i * 7 + j * j) % 997} on" for j in range(60 * (i + 1))) for i in range(12)]
    table = docs.unionByName(spark.createDataFrame([(400 + i, t, "en", 1, 1, "k") for i, t in enumerate(texts)], SCHEMA))
    held = table.select(F.expr(f"size({fingerprints.pieces_sql('text')})").alias("n")).agg(F.sum(F.greatest("n", F.lit(0)))).first()[0]
    sides, entered = fingerprints._sides, []

    def counted(rows, *digests):
        out = sides(rows, *digests)
        entered.append(out.count())
        return out

    monkeypatch.setattr(fingerprints, "_sides", counted)
    fields = ["doc_id", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = Counter(map(tuple, fingerprints.fingerprints(spark, table).select(*fields).collect()))
    # text and edited text once for fingerprints, both and the next text once for larger sketches; a row without digests is a null
    assert sum(entered) <= 5.5 * held + 3 * table.count()
    # cells in which digests meet: those of all bits tell them apart
    monkeypatch.setattr(fingerprints, "SPARE_BITS", -9)
    entered.clear()
    assert Counter(map(tuple, fingerprints.fingerprints(spark, table).select(*fields).collect())) == got
    assert len(entered) == 3
