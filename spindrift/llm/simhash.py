"""SimHash fingerprints and near-duplicate components through segment popcounts.

A fingerprint's 64 bits are 16 segments of 4; its embedding is the vector of the
segments' bit counts. Flipping a bit moves the vector by 1 in the Manhattan distance,
so that distance is a lower bound of the Hamming distance: fingerprints within 2 bits
have vectors within 2. The range join runs on the grid of count vectors. Two vectors
within 2 always have a grid point within 1 of both, so each fingerprint goes to its own
cell and the (at most 32) cells next to it, and meets every possible partner in
one of them; unrelated fingerprints hardly ever meet. Meetings are verified on the bits.

Only different fingerprints are joined, so copies cost nothing. A cell gives a
spanning forest of its links instead of all pairs; components are formed from the forests
with distributed stars. Cells with more than `WIDE_CELL` fingerprints look up every
flip of up to two bits instead of comparing all pairs, which is as exact.

Defined results: a null, empty or blank text has fingerprint zero, linked like any other; fewer
than three words are one shingle; repeated rows appear as often as given; a null
doc_id is kept and never names a component unless all its ids are null; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .arrowio import map_rows, utf8_column
from .components import star_forest
from .copies import near_copies, text_name
from .joins import left_join_split

SEED = 42
SHINGLE = 3
SEGMENTS, WIDTH = 16, 4
MOST_BITS = 2
WIDE_CELL = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of one text as an unsigned integer."""
    from xxhash import xxh64_intdigest as h

    words = text.lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D split
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate([len(w) + 1 for w in words]))
    first = ends[min(shingle, len(words)) - 1 :]
    hashes = [h(joined[s : e - 1], seed) for s, e in zip([0, *ends], first)]
    bits = np.unpackbits(np.asarray(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(b or b"") for b in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.asarray(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return map_rows(docs.select(F.col("doc_id").cast("long"), utf8_column("text")), one, "doc_id long, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def cells_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell names and, for each, the position of its fingerprint: own grid points and those next to them."""
    nibbles = (fps[:, None] >> (np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(WIDTH))) & np.uint64(15)
    counts = _popcount(nibbles).astype(np.int64)
    # a grid point's name is a sum over segments, so a step to the next point adds or takes one term
    terms = np.random.default_rng(7).integers(1 << 62, 1 << 63, SEGMENTS, dtype=np.uint64) | np.uint64(1)
    own = (counts.astype(np.uint64) * terms).sum(axis=1, dtype=np.uint64)
    names, who = [own], [np.arange(len(fps))]
    for k in range(SEGMENTS):
        up, down = np.flatnonzero(counts[:, k] < WIDTH), np.flatnonzero(counts[:, k] > 0)
        names += [own[up] + terms[k], own[down] - terms[k]]
        who += [up, down]
    return np.concatenate(names), np.concatenate(who)


def _flips() -> np.ndarray:
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    return np.concatenate([one, one[i] | one[j]])


def _verified(cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints of one cell within MOST_BITS; rows are sorted by cell, then fingerprint."""
    edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[edges, len(cell)])
    left, right = [], []
    wide = sizes > WIDE_CELL
    for s, n in zip(edges[wide], sizes[wide]):
        group = fp[s : s + n]
        for flip in _flips():
            other = group ^ flip
            at = np.minimum(np.searchsorted(group, other), n - 1)
            hit = (group[at] == other) & (group < other)
            left.append(group[hit])
            right.append(other[hit])
    rest = np.flatnonzero(np.repeat(~wide, sizes))
    c, f = cell[rest], fp[rest]
    at = np.arange(len(f))
    lag = 1
    while True:
        at = at[at + lag < len(f)]
        at = at[c[at + lag] == c[at]]
        if not len(at):
            break
        near = _popcount(f[at] ^ f[at + lag]) <= MOST_BITS
        left.append(f[at[near]])
        right.append(f[at[near] + lag])
        lag += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links: each node but the smallest of its part, with that smallest."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def links(distinct_fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints that links of up to MOST_BITS connect."""

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = batch.column(0).to_numpy().view(np.uint64)
        names, who = cells_of(fps)
        return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(fps[who].view(np.int64))], names=["cell", "fp"])

    def meet(batches):
        kept_cell, kept_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def found(cell, fp):
            order = np.lexsort((fp, cell))
            a, b = _forest(*_verified(cell[order], fp[order]))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            kept_cell = np.concatenate([kept_cell, batch.column(0).to_numpy()])
            kept_fp = np.concatenate([kept_fp, batch.column(1).to_numpy().view(np.uint64)])
            if len(kept_cell) < 100_000:
                continue
            cut = int(np.searchsorted(kept_cell, kept_cell[-1]))  # the last cell may go on
            if cut:
                yield found(kept_cell[:cut], kept_fp[:cut])
                kept_cell, kept_fp = kept_cell[cut:], kept_fp[cut:]
        if len(kept_cell):
            yield found(kept_cell, kept_fp)

    spread_out = map_rows(distinct_fps.select("fp"), spread, "cell long, fp long")
    return spread_out.repartition("cell").sortWithinPartitions("cell").mapInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row of `docs`."""
    prints = materialize(fingerprints(docs), "fingerprints")
    leads = prints.groupBy("fp").agg(F.min("doc_id").alias("lead"), F.count("*").alias("rows"))
    stars = star_forest(links(leads))
    rooted = leads.join(stars.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select("fp", "lead", "rows", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("lead").alias("component_id"))
    by_print = materialize(rooted.join(named, "root").select("fp", "component_id", "rows"), "print-components")
    # a fingerprint that very many texts share is marked by a bounded broadcast
    return left_join_split(prints, by_print, ["fp"], "rows", prints.count(), [F.col("doc_id")]).select("doc_id", "fp", "component_id")


def hex_digits(fp):
    """16 lower-case hex digits of a fingerprint column."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """One row of `docs`, with all its columns, of each group of near copies: that of the smallest id, null last.

    The groups are those of copies.py: its candidates are what `links` above connects, and by min-hash the near copies of 0.8 that
    differ in more bits, up to a dozen, at which popcounts of 64 bits no longer tell pairs apart; all are checked exactly. A row is known by its id and its text, so that
    unlike texts under one id are judged each; of rows that agree in both, one stays.
    """
    near = materialize(near_copies(docs), "near")
    first = near.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("name").alias("name"))).alias("l"))
    leaders = first.select(F.col("l.doc_id").alias("_leader"), F.col("l.name").alias("_name"))
    leaders = materialize(leaders, "leaders")
    # the rows themselves travel as one column, so that none of theirs can clash
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    named = docs.select(F.col("doc_id").cast("long").alias("id"), text_name().alias("name"), row.alias("row"))
    # the leaders grow with the corpus: one plan at every size, and never a broadcast
    kept = named.join(leaders.hint("merge"), F.col("id").eqNullSafe(F.col("_leader")) & (F.col("name") == F.col("_name")), "left_semi")
    again = near.groupBy("doc_id", "name").agg(F.count("*").alias("n")).where("n > 1")
    if not again.isEmpty():
        # rows given twice: partial aggregates, so that a row given very often is no hot key
        kept = kept.groupBy("id", "name").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
