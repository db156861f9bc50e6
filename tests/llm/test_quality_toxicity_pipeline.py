"""Statistics against brute force, held-out accuracy, and the pipeline's stages."""

import random
import re
import zlib

import numpy as np
import pytest

from spindrift.llm import boosting, fuzzy, quality, toxicity

TEXTS = [None, "", " \n", "one", "a b c d e a b c d e", "# * $ x\ny\ny\n y\n\n", "é è ü " * 30, "shti " * 200, "w" * 5000, "a\x1cb c\x0bd"]


def plain_counts(t):
    t = t or ""
    words = re.findall("[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_counts_by_brute_force():
    r = random.Random(1)
    texts = TEXTS + [" ".join(r.choice("ab cd ef\n".split(" ")) for _ in range(r.randint(0, 60))) for _ in range(60)]
    for t in texts:
        assert quality.count_text((t or "").encode())[:5] == plain_counts(t)


def test_verdicts(spark):
    r = random.Random(2)
    vocab = [f"word{k}" for k in range(300)]
    good = [" ".join(r.choice(vocab) for _ in range(60)) + "." for _ in range(150)]
    bad = [" ".join(r.choice(vocab) + r.choice("#*$%") * 3 for _ in range(60)) for _ in range(150)]
    rows = [(k, t, "e") for k, t in enumerate(good + bad + TEXTS)] + [(0, good[0], "e"), (None, good[1], "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(k < 150)) for k in range(300) if k % 2] + [(None, 1), (1, None)], "doc_id long, quality int")
    got = quality.verdicts(docs, labels).collect()
    assert len(got) == len(rows)
    kept = {g["doc_id"]: g["kept"] for g in got}
    assert all(kept[k] for k in range(150)) and not any(kept[k] for k in range(150, 300))
    for k, t in enumerate(TEXTS):
        n, _, _, _, again = plain_counts(t)
        g = next(g for g in got if g["doc_id"] == 300 + k)
        assert g["base_failed"] == (n < 10 or 100 * again > 20 * n)
    assert quality.verdicts(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(docs, labels).where("doc_id < 300").count() == 151
    assert quality.keep_good(docs, labels.limit(0)).where("doc_id < 300").count() == 301


def test_monotone_trees():
    r = np.random.default_rng(0)
    x = r.random((800, 3))
    y = (x[:, 0] + 0.3 * r.standard_normal(800) < 0.5).astype(float)
    model = boosting.fit(x, y, np.asarray([-1, 1, 0]))
    assert ((model.probability(x) > 0.5) == (y > 0.5)).mean() > 0.8
    grid = np.repeat(r.random((40, 3)), 50, axis=0)
    for j, sign in ((0, -1), (1, 1)):
        moved = grid.copy()
        moved[:, j] = np.tile(np.linspace(0, 1, 50), 40)
        steps = np.diff(model.margin(moved).reshape(40, 50), axis=1)
        assert (sign * steps >= -1e-12).all()


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_automaton_is_the_edit_distance():
    r = random.Random(1)
    for _ in range(120):
        terms = {"".join(r.choice("abc") for _ in range(r.randint(1, 5))): r.random() < 0.5 for _ in range(4)}
        trie = fuzzy.FuzzyTrie(terms, 1)
        for _ in range(25):
            w = "".join(r.choice("abcd") for _ in range(r.randint(0, 7)))
            near = [(min(distance(w[:k], t) for k in range(len(w) + 1)) if stem else distance(w, t), t) for t, stem in terms.items()]
            assert trie.find(w) == min([n for n in near if n[0] <= 1], default=None)


def test_quotation():
    t = 'he said "you fool of" and left; you fool'
    first, last = (m.start() for m in re.finditer("fool", t))
    assert toxicity.quoted(t, 0, first, first + 4, len(t)) and not toxicity.quoted(t, 0, last, last + 4, len(t))


def test_toxicity_held_out(spark):
    r = random.Random(3)
    vocab = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnrst"]
    rows, labels = [], []
    for k in range(700):
        words = [r.choice(vocab) for _ in range(40)]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(3):
                words[r.randrange(40)] = r.choice(["grobian", "halunke", "zickelund", "zickelert", "zickelowa"])
        rows.append((k, " ".join(words), "x"))
        labels.append((k, int(toxic)))
    rows += [(9000, None, "x"), (9001, "", "x"), (None, "grobian", "x"), (9002, "the word " * 20_000, "x"), (9003, "grobain halunkke " * 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string")
    got = {g["doc_id"]: g for g in toxicity.scored(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(got) == len(rows)
    held = [k for k in range(700) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k]["held_out"] == (k in set(held)) for k in range(700))
    assert sum(got[k]["predicted"] == int(k % 4 == 0) for k in held) >= 0.97 * len(held)
    assert all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.5) for g in got.values())
    none = toxicity.scored(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.where("score <> 0").count() == 0


def test_misspelled_short_terms_are_toxic(spark):
    r = random.Random(5)
    vocab = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnrst"] + ["slum", "oron"]
    rows, labels = [], []
    for k in range(700):
        words = [r.choice(vocab) for _ in range(40)]
        if k % 4 == 0:
            for _ in range(3):
                words[r.randrange(40)] = r.choice(["scum", "moron", "idiot", "clown"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 4 == 0)))
    clean = " ".join(r.choice(vocab) for _ in range(30))
    rows += [(9000, f"{clean} scumm idiott clwn morron {clean}"), (9001, f"{clean} slum oron {clean}")]
    got = {g["doc_id"]: g["predicted"] for g in toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got[9000] == 1 and got[9001] == 0
    assert sum(got[k] == int(k % 4 == 0) for k in range(700)) >= 0.97 * 700


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(7)
    vocab = [f"{a}{b}{c}{d}" for a in "bdfgkl" for b in "aeiou" for c in "lmnrst" for d in "aeiou"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = text(120)
    rows = [(k, text(80), "en", f"s{k % 3}", 0) for k in range(60)]
    rows += [(100 + k, rows[0][1], "en", "s0", 0) for k in range(5)]  # copies
    rows += [(200 + k, f"{text(60)} {passage} {text(60)}", "de", "s1", 0) for k in range(4)]
    rows += [(300 + k, "### " * 40, "en", "s2", 0) for k in range(20)] + [(400, None, None, None, None), (401, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 60, 2)] + [(300 + k, 0, 0) for k in range(0, 20, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = lambda df: {x["doc_id"] for x in df.collect()}
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = set(range(60)) | set(range(200, 204))
    assert ids(seen["quality rules"]) == clean | set(range(100, 105))
    assert ids(seen["simhash near-dedup"]) == clean
    kept = {x["doc_id"]: x["text"] for x in seen["suffix-array dedup"].collect()}
    assert set(kept) == clean and all(len(kept[200 + k]) < 140 * 5 and passage[50:150] not in kept[200 + k] for k in range(4))
    assert ids(seen["mixing to target weights"]) <= clean
    assert seen["best-fit packing"].groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


def test_passages_of_over_50_words_go(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(8)
    vocab = [f"{a}{b}{c}{d}" for a in "bdfgkl" for b in "aeiou" for c in "lmnrst" for d in "aeiou"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = text(54)
    assert len(passage) < 300
    docs = spark.createDataFrame([(k, f"{text(60)} {passage} {text(60)}", "en", "s", 0) for k in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [x["text"] for x in corpus_pipeline.passage_dedup(spark, docs, "").collect()]
    assert len(kept) == 3 and all(passage[10:60] not in t and len(t.split()) >= 118 for t in kept)
