"""Nulls, ties, repeats, hot groups, long texts, clashing columns and empty tables, operator by operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift import session
from spindrift.llm import chats, joins, lengths, mixing, neighbours, quality, repeats, simhash, tokens, toxicity, warc

VOCAB = [f"{a}{b}{c}{d}" for a in "bdfgkl" for b in "aeiou" for c in "lmnrst" for d in "aeiou"]


def prose(r, n):
    return " ".join(r.choice(VOCAB) for _ in range(n))


@pytest.mark.parametrize("most_hot", [1, 3, 1000])
def test_split_join_is_a_left_join(spark, most_hot):
    r = random.Random(1)
    rows = [(k, 0 if k % 3 == 0 else r.randrange(40)) for k in range(300)]
    n = {g: sum(x == g for _, x in rows) for g in range(30)}
    table = spark.createDataFrame([(g, c, f"v{g}" if g else None) for g, c in n.items() if c], "g int, n int, v string")
    got = joins.left_join_split(spark.createDataFrame(rows, "k int, g int"), table, ["g"], "n", len(rows), [F.col("k")], most_hot)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((k, g, n[g] if n.get(g) else None, f"v{g}" if g and n.get(g) else None) for k, g in rows), key=str)


def test_neighbours_in_many_cells_and_batches(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 200)
    monkeypatch.setattr(neighbours, "BATCH", 3)
    monkeypatch.setattr(neighbours, "BLOCK_LEAVES", 16)
    r = np.random.default_rng(2)
    x = r.standard_normal((1500, 8))
    df = spark.createDataFrame([(k, v.tolist(), "x") for k, v in enumerate(x)], "vec_id long, embedding array<double>, block string")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=5, trees=4, leaf=16, aim=0.97).collect()
    hits = 0
    for q in range(0, 1500, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        found = {g["vec_id"]: g["score"] for g in got if g["query_id"] == q}
        assert len(found) == 5 and all(abs(s - d[v]) < 1e-12 for v, s in found.items())
        hits += len(set(found) & {v for v in np.argsort(d) if v != q and d[v] <= np.sort(d)[5]})
    assert hits >= 0.9 * 5 * 75


def test_forest_looks_at_less_than_all():
    x = np.random.default_rng(0).standard_normal((3000, 8))
    forest = neighbours.fit(x, 11)
    assert forest.share < 0.5  # distances over entries, repeats of several trees included
    assert sorted(np.concatenate([np.flatnonzero(forest.blocks() == b) for b in range(forest.blocks().max() + 1)])) == list(range(len(forest.held)))


def test_lengths_by_source_and_for_all(spark):
    texts = [None, "", "a b c", "a b c", "one two three four", "x " * 500]
    rows = [(t, s, "n", 7) for t in texts for s in ("s", None, "t")] + [("a b c", "s", "n", 7)]
    got = lengths.report(spark.createDataFrame(rows, "text string, source string, by0 string, length int"), shares=(0.5, 1.0)).collect()
    encoder = tokens.word_bpe(tokens.public_path("word_bpe_49k.json"))
    size = {t: len(encoder.batch([t or ""])[0]) // 4 for t in texts}
    for everything, source in ((True, None), (False, None), (False, "s"), (False, "t")):
        n = sorted(size[t] for t, s, *_ in rows if everything or s == source)
        mine = [g for g in got if g["all_sources"] == everything and g["source"] == source]
        assert {g["context_limit"] for g in mine if g["kind"] == "limit"} == set(n)
        assert {g["share"]: g["context_limit"] for g in mine if g["kind"] == "quantile"} == {0.5: n[-(-len(n) // 2) - 1], 1.0: n[-1]}
        for g in mine:
            c = g["context_limit"]
            assert (g["docs_over"], g["tokens_over"], g["tokens_truncated"]) == (sum(x > c for x in n), sum(x for x in n if x > c), sum(min(x, c) for x in n))


def test_a_large_group_of_equal_pages(spark):
    rows = [(k, None, "<p>same</p>") for k in range(2000)] + [(5000 + k, "u", f"<p>{k % 700}</p>") for k in range(1000)]
    got = warc.archived_and_read(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 3000
    assert [g["page_id"] for g in got if g["payload_bytes"] == 11 and g["record_type"] == "response"] == [1999]
    assert all(g["refers_to"] == (None if g["page_id"] >= 5300 else g["page_id"] + 700) for g in got if g["page_id"] >= 5000)


def test_unlike_texts_under_one_id_stay(spark):
    r = random.Random(3)
    a, b, c = (prose(r, 60) for _ in range(3))
    rows = [(1, a, "x"), (1, b, "x"), (2, c, "x"), (3, a, "y"), (None, a, "z"), (None, c + " more", "z"), (1, a, "again"), (None, prose(r, 40), None)]
    got = simhash.keep_one_each(spark.createDataFrame(rows, "doc_id long, text string, root string"))
    assert got.columns == ["doc_id", "text", "root"]
    kept = sorted(((x["doc_id"], x["text"]) for x in got.collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (2, c), (None, rows[-1][1])], key=str)


def test_the_mix_is_written_as_it_was_measured(spark):
    rows = [(1, "a b c d", "s", 7, "x")] * 3 + [(1, "e f g h", "s", 7, "x"), (None, "n o", "s", 3, "x"), (None, "p q", "t", 3, "x"), (2, "r s t", None, 5, "x")] + [(9, "word " * 30, "t", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, _name string")
    taken = sum(g["taken"] for g in mixing.mix(docs).collect())
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(x["text"].split()) for x in out.collect()) == taken
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_mixing_and_fingerprints_of_long_texts(spark):
    long = "lorem ipsum dolor " * 200_000
    docs = spark.createDataFrame([(1, long, "a"), (2, long, "a"), (3, "short text", "b")], "doc_id long, text string, source string")
    assert {g["doc_id"]: g["size"] for g in mixing.mix(docs).collect()} == {1: 600_000, 2: 600_000, 3: 2}
    assert {g["doc_id"]: g["component_id"] for g in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_removed_bytes_leave_whole_characters(spark):
    same = "é" + "0123456789" * 6 + "ü"
    rows = [(1, "a� ü" + same + "é tail�", "x"), (2, "á" + same + "í end", "x"), (3, "untouched �", "x"), (4, None, "x")]
    got = {x["doc_id"]: x for x in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, key string"), 41, 12).collect()}
    assert got[1]["text"].startswith("a� ") and got[1]["text"].endswith(" tail�") and got[1]["text"].count("�") == 2
    assert got[3]["text"] == "untouched �" and got[3]["n_removed"] == 0 and got[4]["text"] == ""
    assert "�" not in got[2]["text"] and got[2]["n_removed"] > 60 and bytes(got[2]["kept"]) != got[2]["text"].encode()


def test_whole_characters():
    body = "aébü".encode()
    for lo in range(len(body)):
        for hi in range(lo + 1, len(body) + 1):
            text = repeats.without(body, repeats.whole_characters(body, [(lo, hi)])).decode()
            assert all(c in "aébü" for c in text)


def test_chats_with_ties_repeats_and_long_turns(spark):
    long = "x" * 300_000
    rows = [(1, 0, "u", "a"), (1, 0, "u", "a"), (1, 0, "b", "a"), (2, 0, "b", "a"), (2, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "u", long), (3, None, "u", long), (3, 5, None, "z")]
    got = {g["conv_id"]: g for g in chats.collapse_and_render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {2, 3} and got[2]["n_turns"] == 4 and len(got[2]["rendered"]) > 300_000 and got[3]["rendered"].endswith("z<|im_end|>\n")


def test_repeated_labelled_ids_stay_within_the_bound(spark, monkeypatch):
    monkeypatch.setattr(quality, "FIT_ROWS", 30)
    r = random.Random(4)
    rows = [(k % 20, prose(r, 40) if k % 2 else "### " * 40) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] * 5, "doc_id long, quality int")
    seen = []
    real = quality.boosting.fit
    monkeypatch.setattr(quality.boosting, "fit", lambda x, *a: seen.append(len(x)) or real(x, *a))
    assert quality.verdicts(docs, labels).count() == 400
    assert seen == [20]


def test_toxicity_sample_is_few_files(spark, monkeypatch):
    files = []

    def stored(df, label):
        out = session.materialize(df, label)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(toxicity, "materialize", stored)
    docs = spark.createDataFrame([(k, "plain words " + "".join(chr(97 + int(c)) for c in str(k)) + " grobian" * (k % 4 == 0)) for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id long, toxic int")
    conf = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = toxicity.scored(docs, labels).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) == 1 and files[0] <= toxicity.FIT_TASKS
    assert [g["doc_id"] for g in got if g["predicted"]] == list(range(0, 200, 4))


def test_toxicity_of_many_hits_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 5)
    r = random.Random(6)
    rows = [(k % 200, prose(r, 40) + (" grobian halunke" if k % 4 == 0 else "")) for k in range(600)]
    rows += [(9000, " ".join("grobian" + c for c in "abcdefghijklmnopq") + " grobian " + " ".join(VOCAB)), (9001, prose(r, 40_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)] + [(9001, 0)], "doc_id long, toxic int")
    got = {(g["doc_id"], g["predicted"]) for g in toxicity.scored(docs, labels).collect()}
    assert (9000, 1) in got and (9001, 0) in got and (4, 1) in got and (5, 0) in got


def test_lexicon_leaves_chance_and_copies_alone():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    vocab = [word() for _ in range(4000)]
    texts = [toxicity.words_of(" ".join(r.sample(vocab, 150))) for _ in range(330)]
    copy = toxicity.words_of(" ".join(word() for _ in range(100)))
    toxic = [t | {"grobian"} for t in texts[:45]] + [copy] * 6
    assert list(toxicity.learn_lexicon(toxic, texts[45:])) == ["grobian"]


def test_pipeline_of_odd_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(8)
    a, b = prose(r, 60), prose(r, 60)
    rows = [(1, a + " �", "en", "s", 1), (1, b, None, None, None), (1, b, None, None, None), (None, prose(r, 50), "en", "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("key", F.lit("extra"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for given, left in ((docs, 3), (docs.limit(0), 0)):
        stage = given
        for k, (name, run) in enumerate(corpus_pipeline.STAGES):
            stage = run(spark, stage, str(tmp_path))
            stage.write.parquet(f"{tmp_path}/{left}-{k}")
            stage = spark.read.parquet(f"{tmp_path}/{left}-{k}")
            if k == 2:
                assert stage.count() == left
                assert left == 0 or "�" in "".join(x["text"] for x in stage.collect())
            if k < 4:
                assert stage.columns == docs.columns
