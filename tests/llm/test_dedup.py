"""SimHash components and repeated-string removal against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spindrift.llm import anchors, copies, registry, repeats, simhash, suffixes
from spindrift.llm.components import star_forest


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        p[find(a)] = find(b)
    return [find(k) for k in range(n)]


def test_near_duplicates_by_brute_force(spark):
    r = random.Random(4)
    vocab = [f"w{k}" for k in range(400)]
    texts = [None, "", " \n", "A b", "É a B c é", "x\x1cy z w"]
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.randint(20, 250))]
        for _ in range(6):
            near = list(base)
            for _ in range(r.randint(0, 2)):
                near[r.randrange(len(near))] = r.choice(vocab)
            texts.append(" ".join(near))
    rows = [(10 * k + 3, t, "c") for k, t in enumerate(texts)] + [(3, texts[0], "c"), (None, texts[8], "c")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, cell string")).select("doc_id", simhash.hex_digits(F.col("fp")).alias("f"), "component_id").collect()
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    root = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    least = {}
    for (doc, _, _), x in zip(rows, root):
        if doc is not None:
            least[x] = min(doc, least.get(x, doc))
    want = sorted(((doc, f"{f:016x}", least[x]) for (doc, _, _), f, x in zip(rows, fps, root)), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert len(set(least.values())) < len(rows)


@pytest.mark.parametrize("wide", [4096, 200])
def test_links_keep_every_component(monkeypatch, wide):
    monkeypatch.setattr(simhash, "WIDE_CELL", wide)
    r = np.random.default_rng(1)
    fps = list(r.integers(0, 1 << 63, 20, dtype=np.uint64))
    for b in fps[:6]:
        fps += [np.uint64(int(b) ^ sum(1 << int(k) for k in set(r.integers(0, 64, r.integers(0, 4))))) for _ in range(300)]
    fps = np.unique(np.asarray(fps, np.uint64))
    at = {int(v): k for k, v in enumerate(fps)}
    names, who = simhash.cells_of(fps)
    order = np.lexsort((fps[who], names))
    a, b = simhash._forest(*simhash._verified(names[order], fps[who][order]))
    got = roots(len(fps), [(at[int(x)], at[int(y)]) for x, y in zip(a, b)])
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1))
    want = roots(len(fps), near)
    same = lambda c: [c.index(x) for x in c]
    assert same(got) == same(want)


def test_star_forest(spark):
    r = random.Random(9)
    pairs = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(50)]
    got = {x["a"]: x["b"] for x in star_forest(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = roots(300, pairs)
    least = {}
    for k in range(300):
        least[root[k]] = min(k, least.get(root[k], k))
    assert got == {k: least[root[k]] for k in range(300) if least[root[k]] != k}
    assert star_forest(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_each(spark):
    words = " ".join(f"v{k}" for k in range(60))
    docs = spark.createDataFrame([(5, words, "en"), (2, words, "de"), (9, "other words here", None), (2, words, "de")], "doc_id long, text string, lang string")
    assert sorted((r["doc_id"], r["lang"]) for r in simhash.keep_one_each(docs).collect()) == [(2, "de"), (9, None)]


def plain_shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("most", [8192, 3])
def test_keep_one_each_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(copies, "MOST_SETS", most)
    r = random.Random(12)
    vocab = [f"w{k}" for k in range(400)]
    texts = [None, "", " \n", "A b", "a B", "É a B c é"]
    for _ in range(15):
        base = [r.choice(vocab) for _ in range(r.randint(60, 250))]
        for _ in range(8):
            near = list(base)
            for _ in range(r.randint(0, 6)):
                near[r.randrange(len(near))] = r.choice(vocab)
            texts.append(" ".join(near))
    rows = list(enumerate(texts, 1)) + [(None, texts[9]), (7, texts[30])]
    sets = [plain_shingles(t) for _, t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert any((simhash.fingerprint(rows[a][1].encode()) ^ simhash.fingerprint(rows[b][1].encode())).bit_count() > 2 for a, b in near if rows[a][1] and rows[b][1])
    root = roots(len(rows), near)
    least = {}
    for (doc, _), x in zip(rows, root):
        if doc is not None:
            least[x] = min(doc, least.get(x, doc))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((x[0], x[1]) for x in copies.near_copies(docs).select("doc_id", "component_id").collect() if x[0] is not None) == sorted((doc, least[x]) for (doc, _), x in zip(rows, root) if doc is not None)
    assert sorted(x["doc_id"] for x in simhash.keep_one_each(docs).collect()) == sorted(least[x] for x in set(root) if x in least)
    assert simhash.keep_one_each(docs.limit(0)).count() == 0


def test_near_copies_go_through_the_popcount_join(spark, monkeypatch):
    r = random.Random(3)
    vocab = [f"w{k}" for k in range(3000)]
    texts = ["", None, "A b c d e f"]
    for _ in range(20):
        base = [r.choice(vocab) for _ in range(900)]
        texts += [" ".join(base), " ".join([*base, "end"]), " ".join([base[0].upper(), *base[1:]])]
    prints = [copies.set_print(copies.shingle_set((t or "").encode())) for t in texts]
    sets = [plain_shingles(t) for t in texts]
    assert prints[2] == simhash.fingerprint(texts[2].encode(), 5)  # no shingle twice: the same bits
    near = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] == sets[b] or ((prints[a] ^ prints[b]).bit_count() <= 2 and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    root = roots(len(texts), near)
    assert len({root[k] for k in range(3, 63)}) < 30  # not all go by equal sets
    monkeypatch.setattr(copies, "by_bands", lambda leads: leads.selectExpr("fp as key", "fp").limit(0))
    got = copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == {k: root.index(root[k]) for k in range(len(texts))}


def test_linked_by_brute_force():
    r = random.Random(2)
    for _ in range(40):
        sets = [np.unique(np.asarray([r.randrange(14) for _ in range(r.randint(1, 30))], np.uint64)) for _ in range(r.randint(2, 40))]
        near = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))]
        got, want = roots(len(sets), copies.linked(sets)), roots(len(sets), near)
        assert [got.index(x) for x in got] == [want.index(x) for x in want]


def test_merge_knows_prefixes():
    r = random.Random(3)
    for _ in range(200):
        runs, keys = [], []
        for _ in range(r.randint(0, 7)):
            k = sorted({bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 20))})
            keys += k
            runs.append(suffixes.front_code(k))
        out = list(suffixes.merge(runs))
        assert [o[0] for o in out] == sorted(keys)
        last = b""
        for key, agree, run, place in out:
            assert agree == suffixes.common_prefix(last, key) and len(runs[run][1]) > place
            last = key


def test_equal_strings_have_equal_anchors(monkeypatch):
    monkeypatch.setattr(anchors, "SEGMENT", 50)
    r = random.Random(6)
    text = bytes(r.choice(b"abc") for _ in range(400)) + b"a" * 120 + b"abab" * 30
    where, first, names = anchors.anchors(text, 40, 12)
    ends = [*first[1:], len(text) - 39]
    at = {}
    for w, lo, hi, name in zip(where, first, ends, names):
        for s in range(lo, hi):
            assert s <= w <= s + 28
            assert at.setdefault(text[s : s + 40], (w - s, name)) == (w - s, name)
    assert len(ends) and first[0] == 0 and ends[-1] == len(text) - 39


def brute(texts, m):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + m] for b in bodies for k in range(len(b) - m + 1))
    for b in bodies:
        gone = bytearray(len(b))
        for k in range(len(b) - m + 1):
            if seen[b[k : k + m]] > 1:
                gone[k : k + m] = b"\1" * m
        kept = bytes(x for x, g in zip(b, gone) if not g)
        yield len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize(("wide", "few"), [(4096, 64), (3, 64), (4096, 1)])
def test_repeats_by_brute_force(spark, monkeypatch, wide, few):
    monkeypatch.setattr(repeats, "FEW", few)
    r = random.Random(8)
    letters = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    parts = [letters(r.randint(20, 160)) for _ in range(12)]
    texts = [None, "", "é" * 200, "a" * 500, "ab" * 300, "abc" * 5]
    for _ in range(120):
        t = ""
        for _ in range(r.randint(1, 5)):
            p, k = r.choice(parts), r.random()
            t += p if k < 0.5 else p[: len(p) // 2] + "X" + p[len(p) // 2 + 1 :] if k < 0.7 else p[r.randrange(len(p)) :] if k < 0.85 else letters(r.randint(1, 80))
        texts.append(t)
    texts += texts[10:14]
    df = spark.createDataFrame([(k, t, "n") for k, t in enumerate(texts)], "doc_id long, text string, key string")
    got = {x[0]: tuple(x[1:]) for x in repeats.remove_repeats(df, 40, 12, wide).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}
    assert got == dict(enumerate(brute(texts, 40)))


def test_query_removes_from_400_bytes_on(spark, tmp_path):
    r = random.Random(4)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnopé") for _ in range(r.randint(2, 7))) for _ in range(n))
    passages = []
    for n in (320, 399, 400, 401):
        p = words(90).encode()[:n].decode("utf-8", "ignore")
        p += "z" * (n - len(p.encode()))  # a character may have been cut
        assert len(p.split()) > 50
        passages.append(p)
    # between marks, as equal bytes beside a passage would make it longer
    texts = [f"{words(60)}{'([{<'[place]}{p}{')]}>'[place]}{words(60)}" for p in passages for place in range(3)] + [passages[2] + words(3), words(300), None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x[0]: x for x in registry.op6_suffix_dedup(spark, str(tmp_path)).collect()}
    assert {k: tuple(x)[1:5] for k, x in got.items()} == dict(enumerate(brute(texts, 400)))
    for k, p in enumerate(passages):
        assert all((p in got[3 * k + place]["text"]) == (len(p.encode()) < 400) for place in range(3))


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
