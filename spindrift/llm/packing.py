"""Best-fit packing of token sequences in bulk-synchronous supersteps.

Pieces of documents go into sequences of at most `capacity` tokens. Both sides of
the match, the pieces still to place and the gaps in open sequences, are sorted by size and
dealt over ranges of sizes. A superstep takes the pieces of the largest class of lengths left (down to
1 / `CLASS` of the longest) and matches them with the gaps:

1. each range is swept from large to small: a piece takes its successor, the smallest gap left that holds it; of pieces of one
   length the lower rank goes first, and a gap takes a length as often as it fits;
2. what a range couldn't match is swept once more with the leftovers of all others, so that a piece finds its successor in a
   higher range;
3. the gaps are updated. If one of them now holds a piece of the class, the next superstep goes on with it; else the pieces
   left open new sequences, sorted, and the next class follows.

Pieces of one length are interchangeable, so both sides are kept as runs (length, first rank, count; size, first sequence, count):
a few thousand rows whatever the number of documents, which is why one task may sweep the leftovers of all ranges. Rounds are DataFrame
jobs whose state is a table in the shared folder; the driver asks for nothing but the longest length left. What the
supersteps decide is a plan of runs too, applied by a join on the length.

Ranks are numbered in a distributed way: a length is dealt over salts, so a third of all pieces may share a length.

Defined results: a null or empty text is one piece that holds only the end id;
equal rows are packed as often as they occur; a null doc_id is kept as it is; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize, stored_at
from .arrowio import slices
from .tokens import public_path, word_bpe

CAPACITY = 4096
END_ID = 1
CLASS = 1.5
LAST_PART = 64  # lengths up to this part of the capacity are one class
RANGES = 8
SALT_ROWS = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Runs. Pieces to place: length as size, first rank, count. Gaps: size, first sequence, count. Placed: length as size, first
#: sequence, count of sequences, first rank, offset of the first piece, pieces a sequence.
RUNS = "kind int, size long, first long, count long, rank long, offset long, deep long"
PIECE, GAP, PLACED, CHANGED = range(4)
_RUNS = pa.schema([("kind", pa.int32()), *((n, pa.int64()) for n in ("size", "first", "count", "rank", "offset", "deep"))])


def tokenized_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Encode every text, add the end id, and cut what is longer than `capacity`."""
    ending = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        encoder = word_bpe(public_path(tokenizer))
        for batch in batches:
            for part in slices(batch, 4 << 20):
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.batch(texts)):
                    ids += ending
                    n = len(ids) // 4
                    for k, at in enumerate(range(0, n, capacity)):
                        end = min(n, at + capacity)
                        rows.append((doc_id, k, at, end - at, zlib.crc32(ids[4 * at : 4 * end])))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ("doc_id", "piece", "start", "length", "ids_crc32")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def sweep(rows: list[tuple], capacity: int) -> list[tuple]:
    """Match pieces and gaps from large to small: placed runs, changed gaps, and what is left of both sides."""
    gaps, out = [], []
    for size, neg, first, count in sorted(((r[1], r[0], r[2], r[3]) for r in rows if r[0] in (PIECE, GAP)), key=lambda r: (-r[0], -r[1], r[2])):
        if neg == GAP:
            gaps.append([size, first, count])
            continue
        while count and gaps:
            gap, at, many = gaps[-1]  # the successor: the smallest gap so far
            deep = min(gap // size, count)
            used = min(many, count // deep)
            out.append((PLACED, size, at, used, first, capacity - gap, deep))
            if gap > deep * size:
                out.append((CHANGED, gap - deep * size, at, used, 0, 0, 0))
            first, count = first + used * deep, count - used * deep
            if many > used:
                gaps[-1] = [gap, at + used, many - used]
            else:
                gaps.pop()
        if count:
            out.append((PIECE, size, first, count, 0, 0, 0))
    out += [(GAP, size, at, many, 0, 0, 0) for size, at, many in gaps]
    return out + [r for r in rows if r[0] in (PLACED, CHANGED)]


def open_sequences(pieces: list[tuple], capacity: int, next_id: int) -> list[tuple]:
    """Pieces that no gap holds, from large to small, into new sequences: placed runs and the gaps that are left."""
    out = []
    offset = 0  # of the sequence that is being filled; 0: none
    for _, size, first, count, *_ in sorted(pieces, key=lambda r: (-r[1], r[2])):
        if offset:
            deep = min((capacity - offset) // size, count)
            if deep:
                out.append((PLACED, size, next_id, 1, first, offset, deep))
                first, count, offset = first + deep, count - deep, offset + deep * size
            if count:
                if offset < capacity:
                    out.append((GAP, capacity - offset, next_id, 1, 0, 0, 0))
                next_id, offset = next_id + 1, 0
        each = capacity // size
        full = count // each
        if full:
            out.append((PLACED, size, next_id, full, first, 0, each))
            if capacity > each * size:
                out.append((GAP, capacity - each * size, next_id, full, 0, 0, 0))
            first, count, next_id = first + full * each, count - full * each, next_id + full
        if count:
            out.append((PLACED, size, next_id, 1, first, 0, count))
            offset = count * size
    if 0 < offset < capacity:
        out.append((GAP, capacity - offset, next_id, 1, 0, 0, 0))
    return out


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RUNS)] if rows else [pa.array([], f.type) for f in _RUNS], schema=_RUNS)


def superstep(state: DataFrame, least: int, capacity: int, next_id: int) -> DataFrame:
    """One round over the pieces longer than `least` and the gaps that may hold them."""

    def in_range(table: pa.Table) -> pa.Table:
        return _table(sweep(list(zip(*(table.column(n).to_pylist() for n in _RUNS.names))), capacity))

    def across(table: pa.Table) -> pa.Table:
        rows = sweep(list(zip(*(table.column(n).to_pylist() for n in _RUNS.names))), capacity)
        rows = [(GAP, *r[1:]) if r[0] == CHANGED else r for r in rows]
        left = [r for r in rows if r[0] == PIECE]
        if left and max((r[1] for r in rows if r[0] == GAP), default=0) < min(r[1] for r in left):
            rows = [r for r in rows if r[0] != PIECE] + open_sequences(left, capacity, next_id)
        return _table(rows)

    live = state.where(F.col("kind").isin(PIECE, GAP))
    active = live.where(F.col("size") > least)
    ranges = active.withColumn("range", F.floor((F.col("size") - least - 1) * RANGES / (capacity - least)))
    swept = ranges.groupBy("range").applyInArrow(in_range, RUNS)
    return live.where(F.col("size") <= least).unionByName(swept.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(across, RUNS))


def best_fit_plan(histogram: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Run the supersteps over a table of lengths with their counts: placed runs (RUNS)."""
    spark = histogram.sparkSession
    zero = F.lit(0).cast("long")
    columns = [F.lit(PIECE).alias("kind"), F.col("length").alias("size"), zero.alias("first"), F.col("n").alias("count"), zero.alias("rank"), zero.alias("offset"), zero.alias("deep")]
    state = materialize(histogram.select(*columns), "runs")
    rounds, longest, least = [state], capacity, -1
    while (top := state.where(F.col("kind") == PIECE).agg(F.max("size")).first()[0]) is not None:
        if least < 0 or top <= least:  # the class is placed: the next one
            longest = top
            least = int(longest / CLASS) if longest > capacity // LAST_PART else 0
        # ids of a superstep begin at a number of its own, so that nobody counts sequences
        state = materialize(superstep(state, least, capacity, len(rounds) << 40), "runs")
        rounds.append(state)
    paths = [stored_at(r) for r in rounds]
    return spark.read.schema(rounds[0].schema).parquet(*paths).where(F.col("kind") == PLACED)


def ranked(pieces: DataFrame) -> DataFrame:
    """Number the pieces of each length from 0, without bringing a length together in one task. `pieces` must be a stored table."""
    salts = max(64, -(-pieces.count() // SALT_ROWS))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("_k", F.row_number().over(within) - 1)
    return numbered.join(offsets, ["length", "_salt"]).withColumn("rank", F.col("_before") + F.col("_k")).drop("_salt", "_before", "_k")


def place(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece a sequence and an offset. `pieces` must be a stored table: it is read more than once."""
    plan = best_fit_plan(pieces.groupBy("length").agg(F.count("*").alias("n")), capacity)
    run = F.struct(F.col("rank").alias("rank_from"), F.col("first").alias("first_sequence"), "count", "offset")
    # one row a length, at most `capacity` rows and a few thousand runs: bounded whatever the corpus
    runs = plan.groupBy(F.col("size").alias("length")).agg(F.array_sort(F.collect_list(run)).alias("runs"))
    found = F.element_at(F.filter("runs", lambda r: r["rank_from"] <= F.col("rank")), -1)
    since = F.col("rank") - F.col("_run.rank_from")
    return (
        ranked(pieces)
        .join(F.broadcast(runs), "length")
        .withColumn("_run", found)
        .withColumn("sequence_id", F.col("_run.first_sequence") + since % F.col("_run.count"))
        .withColumn("offset", F.col("_run.offset") + F.expr("(rank - _run.rank_from) div _run.count") * F.col("length"))
        .drop("_run", "runs", "rank")
    )


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(tokenized_pieces(docs, tokenizer, capacity, end_id), "pieces")
    return place(spark, pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
