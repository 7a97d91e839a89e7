"""The pipeline's stages on a small corpus with planted cases."""

import random

import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    rng = random.Random(10)
    words = [f"word{i}" for i in range(900)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    clean = {i: text(80) for i in range(8)}
    item, passage = text(20), text(60)
    docs = clean | {10: clean[2], 11: f"{text(40)} what a worthless moron {text(9)}", 12: f"{text(30)} {item} {text(30)}", 13: f"{text(50)} {passage}", 14: f"{passage} {text(50)}", 15: None}
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id for r in now.select("doc_id").collect()})
    every = set(docs)
    assert seen == [every - {11}, every - {10, 11}, every - {10, 11}, every - {10, 11, 12}, every - {10, 11, 12}]
    left = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/substring_dedup").collect()}
    assert left[14].text == " ".join(docs[14].split()[60:]) and left[14].n_chars == len(left[14].text) and left[13].text == docs[13]
    assert all(left[i].text == clean[i] for i in clean)


def test_near_dedup_drops_near_copies(spark):
    rng = random.Random(12)
    words = [f"word{i}" for i in range(900)]
    shared = rng.choices(words, k=12)
    texts = [rng.choices(words, k=rng.randint(30, 120)) + shared for _ in range(25)]
    for t in texts[:20]:
        for changes in (1, 2, 4):
            u = list(t)
            for at in rng.sample(range(len(u)), changes):
                u[at] = "other"
            texts.append(u)
        texts.append(["Before", *t[:-2], "after"])
    rng.shuffle(texts)
    docs = {i: " ".join(t) for i, t in enumerate(texts)} | {900: None, 901: " ", 902: "a b", 903: "A  b", 904: "a b c"}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in docs.items()}
    label = {i: i for i in docs}
    for _ in range(6):
        for a in docs:
            for b in docs:
                if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    table = spark.createDataFrame([*docs.items(), (None, docs[0])], "doc_id long, text string")
    near_dedup = dict(corpus_pipeline.STAGES)["near_dedup"]
    left = [r.doc_id for r in near_dedup(spark, table, "").collect()]
    assert sorted(left, key=lambda d: (d is None, d)) == [*sorted(set(label.values())), None]
    assert 25 < len(set(label.values())) < len(docs) - 30


def _print(text):
    from sievewright.llm import near_copies, simhash

    return simhash.of_hashes(next(near_copies._shingles(pa.RecordBatch.from_pydict({"text": [text]})))) % (1 << 64)


def test_near_dedup_links_through_the_fingerprint_grid(spark, monkeypatch):
    from sievewright.llm import near_copies, simhash

    rng = random.Random(14)
    words = [f"word{i}" for i in range(900)]
    pairs = {True: [], False: []}
    while min(len(v) for v in pairs.values()) < 4:
        t = rng.choices(words, k=58)
        u = [*t[:29], "other", *t[30:]]  # 49 of 59 shingles are in both
        a, b = " ".join(t), " ".join(u)
        pairs[(_print(a) ^ _print(b)).bit_count() <= simhash.PART_RADIUS].append((a, b))
    near, far = pairs[True][:6], pairs[False][:4]
    texts = [t for p in near + far for t in p]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    second = [set(range(1, 2 * len(near), 2)), set(range(2 * len(near) + 1, len(texts), 2))]
    gone = lambda: set(range(len(texts))) - {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, table, "").collect()}
    none = lambda rows: rows.selectExpr("node as a", "node as b").where("false")
    assert gone() == second[0] | second[1]
    with monkeypatch.context() as m:
        m.setattr(near_copies, "_beyond", none)
        assert gone() == second[0]
    with monkeypatch.context() as m:
        m.setattr(near_copies, "_alike", none)
        m.setattr(near_copies, "_within", none)
        assert gone() == second[1]
    with monkeypatch.context() as m:
        m.setattr(near_copies, "_alike", none)
        assert gone() == second[0] | second[1]


def test_grid_of_the_wide_radius_misses_no_pair(spark):
    from sievewright.llm import near_copies, simhash

    rng = random.Random(15)
    prints = [rng.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    for fp in prints[:32]:
        for bits in (1, 2, 8, 13, 14, 14, 14, 15, 16):
            prints.append(fp ^ sum(1 << at for at in rng.sample(range(64), bits)))
    rows = [(i, rng.choice((80, 99, 100, 101, 125)), fp - (1 << 64) if fp >> 63 else fp, i % 7) for i, fp in enumerate(prints)]
    got = {(r.a, r.b) for r in near_copies._within(spark.createDataFrame(rows, "node long, n int, fp long, c long")).collect()}
    within = lambda x, y: (prints[x[0]] ^ prints[y[0]]).bit_count() <= simhash.PART_RADIUS and 5 * min(x[1], y[1]) >= 4 * max(x[1], y[1])
    assert got == {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[3] != y[3] and within(x, y)}
    assert len(got) > 100


@pytest.mark.parametrize("n", [0, 1, 64, 40_000])
def test_simhash_of_hashes(n):
    import numpy as np
    from sievewright.llm import simhash

    hashes = [random.Random(n + i).getrandbits(64) for i in range(n)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)
    assert simhash.of_hashes(np.array(hashes, np.uint64)) % (1 << 64) == want
