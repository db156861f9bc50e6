"""Packing, mixing, lengths and chats against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import chats, lengths, mixing, packing, tokens

TEXTS = [None, "", "Hello, World's 3 bests! ", "naïve ÉCOLE\x85x", "日本語 text", "<|endoftext|> here", "a\x1cb", "word " * 5000, "x" * 300, "ΣΣ Σ"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.public_path("word_bpe_49k.json"))


def test_ids_are_the_librarys(library):
    r = random.Random(2)
    letters = [chr(c) for c in range(256)]
    texts = [t or "" for t in TEXTS] + ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(300)] + ["a" * n for n in range(1, 70)]
    for text, ids in zip(texts, tokens.word_bpe(tokens.public_path("word_bpe_49k.json")).batch(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def decreasing(sizes, cap):
    """The gaps that best fit leaves, a piece at a time."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(cap - s)
    return gaps


def rounds(sizes, cap):
    """The supersteps in one place: range by range, then across, as superstep() does with tables."""
    state, steps, placed = [(packing.PIECE, n, 0, c, 0, 0, 0) for n, c in Counter(sizes).items()], 0, []
    least = -1
    while left := [r for r in state if r[0] == packing.PIECE]:
        top = max(r[1] for r in left)
        if least < 0 or top <= least:
            least = int(top / packing.CLASS) if top > cap // packing.LAST_PART else 0
        idle, ranges = [r for r in state if r[1] <= least], defaultdict(list)
        for r in state:
            if r[1] > least:
                ranges[(r[1] - least - 1) * packing.RANGES // (cap - least)].append(r)
        rows = packing.sweep([x for part in ranges.values() for x in packing.sweep(part, cap)], cap)
        rows = [(packing.GAP, *r[1:]) if r[0] == packing.CHANGED else r for r in rows]
        left = [r for r in rows if r[0] == packing.PIECE]
        steps += 1
        if left and max((r[1] for r in rows if r[0] == packing.GAP), default=0) < min(r[1] for r in left):
            rows = [r for r in rows if r[0] != packing.PIECE] + packing.open_sequences(left, cap, steps << 40)
        placed += [r for r in rows if r[0] == packing.PLACED]
        state = idle + [r for r in rows if r[0] != packing.PLACED]
    return placed, steps


def sequences(placed):
    """Pieces by rank, and (offset, length) by sequence."""
    ranks, used = Counter(), defaultdict(list)
    for _, length, first, count, rank, offset, deep in sorted(placed, key=lambda r: r[4]):
        assert ranks[length] == rank
        ranks[length] += count * deep
        for k in range(count * deep):
            used[first + k % count].append((offset + k // count * length, length))
    return ranks, used


def test_supersteps_place_all_and_come_near_best_fit():
    r = random.Random(1)
    ours = best = 0
    for k in range(80):
        cap = r.choice([10, 37, 100, 4096])
        sizes = [max(1, int(cap * r.random() ** r.choice([1, 3]))) for _ in range(r.randint(0, 300))]
        placed, _ = rounds(sizes, cap)
        ranks, used = sequences(placed)
        assert ranks == Counter(sizes)
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= cap
        ours, best = ours + len(used), best + len(decreasing(sizes, cap))
    assert ours <= 1.02 * best


def test_plan_of_the_cluster_is_the_same(spark):
    r = random.Random(2)
    sizes = [r.randint(1, 200) for _ in range(400)] + [r.randint(1, 20) for _ in range(300)]
    lengths_of = spark.createDataFrame(list(Counter(sizes).items()), "length long, n long")
    got = [tuple(x) for x in packing.best_fit_plan(lengths_of, 256).collect()]
    ranks, used = sequences(got)
    assert ranks == Counter(sizes) and all(sum(n for _, n in parts) <= 256 for parts in used.values())
    assert len(used) == len(sequences(rounds(sizes, 256)[0])[1])


def test_pack_round_trip(spark, library):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(2, TEXTS[2], "y"), (None, "no id", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack(spark, docs, capacity=64).collect()
    ids = {k: library.encode(t or "", add_special_tokens=False).ids + [1] for k, t, _ in rows}
    for p in got:
        piece = np.asarray(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4")
        assert len(piece) == p["length"] and zlib.crc32(piece.tobytes()) == p["ids_crc32"] and p["start"] == 64 * p["piece"]
    assert sum(p["length"] for p in got) == sum(len(ids[r[0]]) for r in rows)
    by = defaultdict(list)
    for p in got:
        by[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in by.values():
        ends = [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert packing.pack(spark, docs.limit(0)).count() == 0


def test_mixing_targets_and_shares(spark):
    r = random.Random(3)
    rows = [(k, r.choice(["a", "b", "c", "d", None, "é"]), " ".join("w" * r.randint(0, 40))) for k in range(400)] + [(None, "a", "x y"), (1, "a", None), (1, "a", None), (7, "tiny", "one two")]
    rows += [(1000 + k, "big", "w " * 300) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    total, full = sum(sizes.values()), set()
    while True:
        free = [n for n in names if n not in full]
        weight = {n: k % 3 + 1 for k, n in enumerate(names)}
        level = (total - sum(3 * sizes[n] for n in full)) / sum(weight[n] for n in free)
        over = {n for n in free if level * weight[n] > 3 * sizes[n]}
        if not over:
            break
        full |= over
    taken = Counter()
    for g in got:
        want = 3 * sizes[g["source"]] if g["source"] in full else level * weight[g["source"]]
        assert g["target"] == pytest.approx(want) and g["source_size"] == sizes[g["source"]] and 0 <= g["taken"] <= 3 * g["size"]
        taken[g["source"]] += g["taken"]
    for n in names:
        want = 3 * sizes[n] if n in full else level * weight[n]
        assert abs(taken[n] - want) <= 2
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda rows: sorted(map(str, rows))
    assert key(again) == key(got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_apportion_is_highest_quotients(spark):
    r = random.Random(4)
    for _ in range(6):
        votes = [r.randint(0, 1000) for _ in range(r.randint(1, 12))]
        votes[0] += 1
        seats = r.randint(0, 90)
        parties = spark.createDataFrame([(0, k, v, seats) for k, v in enumerate(votes)], "g int, p int, v long, s long")
        got = {x["p"]: x["quota"] for x in mixing.apportion(parties, ["g"], ["p"], "v", "s").collect()}
        won = Counter()
        for _ in range(seats):
            best = max(range(len(votes)), key=lambda k: (votes[k] / (2 * won[k] + 1), -k))
            won[best] += 1
        assert got == {k: won[k] for k in range(len(votes))}


def test_mixed_documents(spark):
    docs = spark.createDataFrame([(k, f" a{k}\nb{k}  c{k} ", "en", f"s{k % 2}", 12, "more") for k in range(30)], "doc_id long, text string, lang string, source string, n_chars long, taken string")
    want = {g["doc_id"]: g["taken"] for g in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = Counter()
    for row in out.collect():
        got[row["doc_id"]] += len(row["text"].split())
    assert got == Counter({k: n for k, n in want.items() if n})


def test_lengths(spark, library):
    docs = spark.createDataFrame([(t, "s" if k % 2 else None) for k, t in enumerate(TEXTS)], "text string, source string")
    n = sorted(len(library.encode(t or "", add_special_tokens=False).ids) for t in TEXTS)
    hist = lengths.histogram(docs)
    for limit in (0, 3, 100, 10**6):
        row = lengths.at_limit(hist, [], limit).first()
        assert (row["n_docs"], row["n_tokens"], row["tokens_truncated"], row["docs_over"]) == (len(n), sum(n), sum(min(x, limit) for x in n), sum(x > limit for x in n))
    for r in lengths.limits(hist, []).collect():
        c = r["context_limit"]
        assert r["tokens_truncated"] == sum(min(x, c) for x in n) and r["tokens_over"] == sum(x for x in n if x > c)
    assert {r["share"]: r["length"] for r in lengths.quantiles(hist, [], [0.5, 1.0]).collect()} == {0.5: n[len(n) // 2 - 1], 1.0: n[-1]}
    assert lengths.report(docs.limit(0)).count() == 0


def test_chats(spark):
    turns = [("u", "a"), ("b", None), (None, "c"), ("u", "")]
    rows = [(c, k, *turns[k], "x") for c, n in ((1, 2), (2, 4), (3, 4), (4, 1)) for k in range(n)] + [(5, 0, "u", "other", "x"), (None, 0, "u", "a", "x"), (6, 0, "u", "a", "x"), (6, 1, "b", "", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string").select("conv_id", "turn", "role", "text", "pos")
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"]) for r in chats.collapse_and_render(df).collect()}
    assert got == {2: (4, 2), 5: (1, 1), 6: (2, 1)}  # null and empty texts differ
    assert chats.collapse_and_render(df.where(F.lit(False))).count() == 0
