"""Document statistics, base rules, and a boosted-tree verdict on quality.

Words are `[^\\x20\\x09-\\x0D]+` of the whole text. A document fails the base rules if
it has fewer than `MIN_WORDS` words or if more than `MAX_REPEAT_PERCENT` % of its words lie in
5-word windows that occur twice or more. What passes is kept if the trees give it at
least `KEEP_FROM`. The trees are fitted on about `FIT_ROWS` labelled documents drawn by the hash of
their ids, and never on more than twice as many: one row stands for all that share an id. Statistics and verdicts cover all documents. The
score can't rise with the share of symbols, of repeated words or of repeated lines.

Defined results: a null or empty text has no words, so it fails; a null or unmatched
label takes no part in fitting, of several labels of a document the smallest counts;
without labels the base rules alone decide; repeated rows are judged each, and of labelled rows
that share an id the one whose counts have the smallest hash is fitted; further columns are left alone.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import boosting
from .arrowio import map_rows, utf8_column

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
KEEP_FROM = 0.3
FIT_ROWS = 20_000
WINDOW = 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_stops")
STATS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
#: Per feature, whether the score may only rise (1) or fall (-1) with it.
FEATURES = {"symbols": -1, "repeats": -1, "dup_lines": -1, "word_length": 0, "distinct": 0, "upper": 0, "digits": 0, "stops": 0, "line_words": 0, "log_words": 0}

_NO_WORD_CHARS = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))  # white space and UTF-8 continuation bytes
_SYMBOLS = b"#*$%&|<>"
_UPPER, _DIGITS, _STOPS = bytes(range(65, 91)), bytes(range(48, 58)), b".,;:!?"


def count_text(b: bytes) -> tuple[int, ...]:
    """The counts of one text, in the order of COUNTS."""
    words = b.split()
    n, size = len(words), len(b)
    if not n:
        return (0, 0, size - len(b.translate(None, _SYMBOLS)), *[0] * (len(COUNTS) - 3))
    lines = [x for x in b.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    repeats = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        twice = np.fromiter((often[w] > 1 for w in windows), bool, len(windows))
        covered = np.zeros(n, bool)
        for k in range(WINDOW):
            covered[k : k + len(windows)] |= twice
        repeats = int(covered.sum())
    gone = lambda chars: size - len(b.translate(None, chars))
    return (n, len(b.translate(None, _NO_WORD_CHARS)), gone(_SYMBOLS), len(lines) - len(set(lines)), repeats, len(lines), len(set(words)), gone(_UPPER), gone(_DIGITS), gone(_STOPS))


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every row of `docs`."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [count_text(b or b"") for b in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=["doc_id", *COUNTS])

    return map_rows(docs.select(F.col("doc_id").cast("long"), utf8_column("text")), one, STATS)


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """The model's inputs from arrays of COUNTS, in the order of FEATURES."""
    words, chars, lines = (np.maximum(c[k], 1).astype(float) for k in ("n_words", "word_chars", "n_lines"))
    return np.stack([c["n_symbols"] / chars, c["n_repeat_words"] / words, c["n_dup_lines"] / lines, chars / words, c["n_distinct"] / words, c["n_upper"] / chars, c["n_digits"] / chars, c["n_stops"] / chars, words / lines, np.log1p(c["n_words"])], 1)


def sampled_labels(labels: DataFrame) -> DataFrame:
    """doc_id and quality of about FIT_ROWS labelled documents, all if there are no more."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("_quality"))
    share = min(1.0, FIT_ROWS / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * FIT_ROWS)


def fit_model(stats: DataFrame, labels: DataFrame) -> boosting.Forest | None:
    """Fit on a bounded sample of labelled rows; None without labels of both kinds."""
    one = F.min_by(F.struct(*COUNTS), F.xxhash64(*COUNTS)).alias("c")  # so that ids given often don't pass the bound
    found = stats.join(sampled_labels(labels), "doc_id").groupBy("doc_id").agg(one, F.min("_quality").alias("_quality"))
    found = found.select("doc_id", "c.*", "_quality").toPandas().sort_values("doc_id")
    if found["_quality"].nunique() < 2:
        return None
    x = features({k: found[k].to_numpy() for k in COUNTS})
    return boosting.fit(x, (found["_quality"] > 0).to_numpy(float), np.asarray(list(FEATURES.values())))


def _verdict(c: dict[str, np.ndarray], model: boosting.Forest | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
    score = np.ones(len(failed)) if model is None else model.probability(features(c))
    return failed, score, ~failed & (score >= KEEP_FROM)


def judge(stats: DataFrame, model: boosting.Forest | None) -> DataFrame:
    """Add base_failed, score and kept to a table of statistics."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        failed, score, kept = _verdict({k: batch.column(k).to_numpy(zero_copy_only=False) for k in COUNTS}, model)
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", *COUNTS)), pa.array(failed), pa.array(score), pa.array(kept)], names=["doc_id", *COUNTS, "base_failed", "score", "kept"])

    return map_rows(stats, one, f"{STATS}, base_failed boolean, score double, kept boolean")


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and verdict of every document."""
    stats = materialize(document_stats(docs), "stats")
    return judge(stats, fit_model(stats, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text passes; texts are read once beside the fit."""
    # broadcast: at most 2 * FIT_ROWS ids, so that texts aren't shuffled for the fit
    sample = docs.join(F.broadcast(sampled_labels(labels).select("doc_id")), "doc_id", "left_semi")
    model = fit_model(document_stats(sample), labels)
    at = docs.columns.index("text")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [count_text((t or "").encode()) for t in batch.column(at).to_pylist()]
        return batch.filter(pa.array(_verdict({k: np.asarray(v) for k, v in zip(COUNTS, zip(*rows))}, model)[2]))

    return map_rows(docs, one, docs.schema)
