"""Toxicity scores from a learned lexicon, misspellings, and the context of each hit.

1. A bounded sample of labelled documents (about `FIT_EACH` of either label drawn by the hash of their ids, at most
   `8 * FIT_EACH` rows, one to an id, none of the held-out fold, whole texts of any length) gives the lexicon: words and word
   beginnings that many toxic and hardly any other documents hold. A beginning that goes on in many ways is a stem. Only the
   different words of the sample's texts, and later their features, come to the driver.
2. Every word of every text goes through the trie of the lexicon intersected with
   Levenshtein automata (fuzzy.py), which finds the terms, short ones too, and what is one edit away
   from them, but for words that the other documents of the sample hold (`oron` is no misspelled `moron`),
   and for terms whose near forms in one half of those, unknown to the other half, don't tell as much as a term must.
3. Each hit is looked at in a window of `CONTEXT` words: inside quotation marks it counts as
   quotation, else as abuse.
4. A logistic model over the counts of exact and near, quoted and abusive hits gives the score;
   it is fitted on the same sample, where near forms of either half of the other documents are judged by the
   words of the other half, as new texts are. Each text with exact hits also counts once with those hits
   as near ones, since labels may hold no misspellings. Only the text is an input.

Defined results: null and empty texts have no hits and get the score of no hits; a null doc_id counts
as held out; of several labels of a document the largest counts, null labels none; without labels of both
kinds every score is 0; repeated rows are scored each, and of labelled rows that share an id the text with the smallest hash is
fitted; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .arrowio import map_rows
from .fuzzy import FuzzyTrie

FIT_EACH = 2500
FIT_TASKS = 16  # tasks and files of the sample, whose rows are bounded
LEAST_DOCS = 3
LEAST_SHARE = 0.02  # of the toxic documents, for a term to be taken for itself
LEAST_NEW = 0.01  # of the toxic documents, if no other term is in them
LEAST_LIFT = 25.0
CHANCE = 0.1
MOST_TERMS = 512
STEM_FROM, STEM_TO = 4, 8
CONTEXT = 12
KNOWN_WORDS = 300_000
_WORD = re.compile(r"[^\W\d_]+")
_QUOTES = "\"'“”„«»‘’"
FEATURES = 7


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _forms(words: frozenset[str]) -> set[str]:
    """Different words of a text, and their beginnings with a dash after them."""
    return words | {w[:k] + "-" for w in words for k in range(STEM_FROM, min(len(w), STEM_TO) + 1)}


Words = list[frozenset[str]]


def words_of(text: str) -> frozenset[str]:
    return frozenset(_WORD.findall(text.lower()))


def learn_lexicon(toxic: Words, other: Words) -> dict[str, bool]:
    """Terms and whether they are stems, best first, at most MOST_TERMS; from the different words of each text.

    Copies count once. Of the many forms tried, those that few texts hold are toxic by chance now and then: a form needs a
    share of toxic holders that `CHANCE` forms or fewer would reach if toxic texts were drawn at random.
    """
    toxic, other = list(dict.fromkeys(toxic)), list(dict.fromkeys(other))
    seen: Counter[str] = Counter()
    for t in toxic:
        seen.update(_forms(t))
    least = max(LEAST_DOCS, len(toxic) // 200)
    seen = Counter({f: n for f, n in seen.items() if n >= least})
    elsewhere: Counter[str] = Counter()
    for t in other:
        elsewhere.update(f for f in _forms(t) if f in seen)
    lift = lambda f: (seen[f] / len(toxic)) / ((elsewhere[f] + 0.25) / len(other))
    rate = len(toxic) / (len(toxic) + len(other))
    chance = lambda f: len(seen) * comb(seen[f] + elsewhere[f], seen[f]) * rate ** seen[f]
    good = {f for f in seen if lift(f) >= LEAST_LIFT and chance(f) <= CHANCE}
    holders: dict[str, set[int]] = {f: set() for f in good}
    for k, t in enumerate(toxic):
        for f in good & _forms(t):
            holders[f].add(k)
    # whole words before beginnings and long ones before short, where they tell as much
    worth = {f: seen[f] - 10 * elsewhere[f] * len(toxic) / len(other) for f in good}
    chosen: dict[str, bool] = {}
    covered: set[int] = set()
    for f in sorted(good, key=lambda f: (-worth[f], f.endswith("-"), -len(f), f)):
        bare, stem = f.removesuffix("-"), f.endswith("-")
        if len(chosen) >= MOST_TERMS:
            break
        known = bare in chosen or any(bare.startswith(c) for c, open_end in chosen.items() if open_end)
        known = known or (stem and any(c.startswith(bare) and seen[f] <= 1.05 * seen[c + "-" if chosen[c] else c] for c in chosen))
        often = seen[f] >= max(LEAST_DOCS, LEAST_SHARE * len(toxic))
        fresh = len(holders[f] - covered) >= max(LEAST_DOCS, LEAST_NEW * len(toxic))
        if not known and (often or fresh):
            chosen[bare] = stem
            covered |= holders[f]
    return chosen


class Scorer:
    """Counts hits in texts; remembers which words are none."""

    def __init__(self, trie: FuzzyTrie):
        self.trie = trie
        self._clean: set[str] = set()
        self._hits: dict[str, tuple[int, str]] = {}

    def features(self, text: str) -> list[float]:
        low = text.lower()
        words = set(_WORD.findall(low))
        for w in words - self._clean:
            if w not in self._hits:
                found = self.trie.find(w)
                if found is None:
                    self._clean.add(w)
                else:
                    self._hits[w] = found
        hits = {w: self._hits[w] for w in words if w in self._hits}
        if len(self._clean) > KNOWN_WORDS:
            self._clean.clear()
        if len(self._hits) > KNOWN_WORDS:
            self._hits.clear()
        if not hits:
            return [0.0] * FEATURES
        counts = np.zeros((2, 2))
        tokens = list(_WORD.finditer(low))
        for k, m in enumerate(tokens):
            hit = hits.get(m.group())
            if hit is not None:
                begin = tokens[max(0, k - CONTEXT)].start()
                end = tokens[min(len(tokens) - 1, k + CONTEXT)].end()
                counts[hit[0], int(quoted(low, begin, m.start(), m.end(), end))] += 1
        (abuse, quote), (near, near_quote) = counts
        share = 100 * abuse / len(tokens)
        return [float(abuse > 0), float(np.log1p(abuse)), float(np.log1p(share)), float(np.log1p(quote)), float(near > 0), float(np.log1p(near)), float(np.log1p(near_quote))]


def quoted(text: str, begin: int, start: int, end: int, stop: int) -> bool:
    """Whether the nearest quotation mark in the window before opens, and one after closes."""
    before = max((text.rfind(q, begin, start) for q in _QUOTES), default=-1)
    after = min((p for q in _QUOTES if (p := text.find(q, end, stop)) >= 0), default=-1)
    if before < 0 or after < 0:
        return False
    opens = before == 0 or not text[before - 1].isalnum()
    closes = after + 1 >= len(text) or not text[after + 1].isalnum()
    return opens and closes


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.5, rounds: int = 60) -> np.ndarray:
    z = np.c_[np.ones(len(x)), x]
    w, ridge = np.zeros(z.shape[1]), np.diag([1e-3] + [l2] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> tuple[FuzzyTrie, np.ndarray] | None:
    """Lexicon and weights from a bounded sample of the labelled rows that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30))
    limit = F.when(F.col("toxic"), F.lit(int(min(1, FIT_EACH / sizes[True]) * (1 << 30)))).otherwise(F.lit(int(min(1, FIT_EACH / sizes[False]) * (1 << 30))))
    # broadcast: about 2 * FIT_EACH rows, and never more than four times that
    sample = known.where(draw < limit).limit(8 * FIT_EACH)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    one = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    # each text is in the half of its id, of which the other half's words judge the near forms
    halved = one.withColumn("half", F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(2)).cast("int"))
    # not a file for each shuffle partition: every file that is written starts a process beside an executor's JVM
    drawn = materialize(halved.coalesce(FIT_TASKS), "sample")

    def different(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = pa.array([sorted(words_of(t)) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([batch.column(0), words, batch.column(2), batch.column(3)], names=["doc_id", "words", "toxic", "half"])

    rows = map_rows(drawn, different, "doc_id long, words array<string>, toxic boolean, half int").toArrow().to_pylist()
    rows.sort(key=lambda r: r["doc_id"])
    toxic = [frozenset(r["words"]) for r in rows if r["toxic"]]
    halves = [[frozenset(r["words"]) for r in rows if not r["toxic"] and r["half"] == k] for k in (0, 1)]
    other = halves[0] + halves[1]
    if not toxic or not other:
        return None
    terms = learn_lexicon(toxic, other)
    seen = [near_words(terms, toxic, half) for half in halves]
    never = near_words(terms, toxic, other)
    exact = exact_only(terms, seen, toxic, halves)

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        by_half = [Scorer(FuzzyTrie(terms, never=seen[1 - k], exact=exact)) for k in (0, 1)]
        whole = Scorer(FuzzyTrie(terms, never=never, exact=exact))
        pick = lambda flag, half: whole if flag else by_half[half]
        x = [pick(flag, half).features(t) for t, flag, half in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64())), batch.column(2)], names=["doc_id", "x", "toxic"])

    rows = map_rows(drawn, counted, "doc_id long, x array<double>, toxic boolean").toArrow().to_pylist()
    rows.sort(key=lambda r: r["doc_id"])
    x, y = [r["x"] for r in rows], np.asarray([float(r["toxic"]) for r in rows])
    misspelled = [(as_near(f), flag) for f, flag in zip(x, y) if f[0] or f[3]]
    x, y = np.asarray(x + [f for f, _ in misspelled]), np.r_[y, [flag for _, flag in misspelled]]
    return FuzzyTrie(terms, never=never, exact=exact), _logistic(x, y)


def near_words(terms: dict[str, bool], toxic: Words, other: Words) -> frozenset[str]:
    """Near forms that other documents hold, unless far more of the toxic ones do."""
    trie = FuzzyTrie(terms)
    here, there = (Counter(w for t in texts for w in t) for texts in (toxic, other))
    rare = lambda w: here[w] / len(toxic) < LEAST_LIFT * there[w] / len(other)
    return frozenset(w for w in there if (hit := trie.find(w)) is not None and hit[0] == FuzzyTrie.NEAR and rare(w))


def exact_only(terms: dict[str, bool], seen: list[frozenset[str]], toxic: Words, halves: list[Words]) -> frozenset[str]:
    """Terms whose new near forms are so common in other documents that they lack a term's lift."""
    tries = [FuzzyTrie(terms, never=seen[1 - k]) for k in (0, 1)]
    plain = FuzzyTrie(terms)
    hits = lambda trie, t, kind: {hit[1] for w in t if (hit := trie.find(w)) is not None and hit[0] == kind}
    new = Counter(term for trie, half in zip(tries, halves) for t in half for term in hits(trie, t, FuzzyTrie.NEAR))
    held = Counter(term for t in toxic for term in hits(plain, t, FuzzyTrie.EXACT))
    others = len(halves[0]) + len(halves[1])
    return frozenset(t for t in terms if held[t] / len(toxic) < LEAST_LIFT * new[t] / others)


def as_near(features: list[float]) -> list[float]:
    """The features of a text if its exact hits were misspelled."""
    _, abuse, _, quote, _, near, near_quote = np.expm1(features)
    near, near_quote = near + abuse, near_quote + quote
    return [0.0, 0.0, 0.0, 0.0, float(near > 0.5), float(np.log1p(near)), float(np.log1p(near_quote))]


def score(docs: DataFrame, model: tuple[FuzzyTrie, np.ndarray] | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs`."""
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string").alias("text"))
    if model is None:
        return each.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    terms, never, exact, weights = model[0].terms, model[0].never, model[0].exact, model[1]
    held: list[Scorer] = []

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Scorer(FuzzyTrie(terms, never=never, exact=exact)))
        x = np.asarray([held[0].features(t or "") for t in batch.column(2).to_pylist()])
        p = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -700, 700)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return map_rows(each, one, "doc_id long, held_out boolean, score double, predicted int")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels, then score every document."""
    return score(docs, fit(docs, labels))
