"""Near copies by shared shingles: Jaccard of at least 0.8 over different 5-word shingles, checked exactly.

Candidates come two ways. Each different set has a SimHash of its shingles, and the popcount grid range join of simhash.py
links those within 2 bits; sets that such links connect form a bucket. Copies at 0.8 differ in up to a dozen bits, too many for
a range join, so that the rest comes from `BANDS` bands of `ROWS` minima each (min-hash): a pair at 0.8 shares no band once in
40,000 times, and a nearer pair less often; sets that share a band form a bucket too. Only different shingle sets are joined and
banded, so copies cost nothing, and buckets of the same sets are one. The shingles of all sets in
buckets are read again from the texts, and each bucket is searched breadth first: a set reached
is compared with all sets not reached yet, so its components come out exactly without storing all pairs.
A bucket of more than `MOST_SETS` different sets is cut by hash in blocks of about that many, and every two blocks meet in a task of
their own: no task holds more than two blocks, and no link is lost, at the price of a set going to as many tasks as there are blocks.

Defined results: null, empty and blank texts have the empty set and are copies of each other; fewer than
five words are one shingle; sets are known by 64-bit hashes of their shingles' hashes; null ids name a
component only where all its ids are null.
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
from .joins import left_join_split

SHINGLE = 5
LEAST_OF_5 = 4  # of five parts of the union that two near copies share: 0.8
BANDS, ROWS = 20, 4
SEED = 42
BLOCK = 4096
MOST_SETS = 8192
_FACTORS = np.random.default_rng(11).integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different shingles of a text."""
    from xxhash import xxh64_intdigest as h

    words = text.lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D split
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate([len(w) + 1 for w in words]))
    first = ends[min(shingle, len(words)) - 1 :]
    return np.unique(np.asarray([h(joined[s : e - 1], SEED) for s, e in zip([0, *ends], first)], np.uint64))


def set_name(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest as h

    return h(hashes.tobytes(), SEED)


def band_keys(hashes: np.ndarray) -> list[int]:
    """The keys of all bands; none for the empty set."""
    from xxhash import xxh64_intdigest as h

    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        least = np.minimum(least, (hashes[None, at : at + BLOCK] * _FACTORS[:, None]).min(axis=1))
    return [h(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def set_print(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingles: a bit is 1 if set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _longs(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, name (a hash of the text), fp (the name of its shingle set), its SimHash and its bands, of every row."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(b or b"") for b in batch.column(2).to_pylist()]
        keys = [band_keys(s) for s in sets]
        ends = np.cumsum([0, *map(len, keys)])
        bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _longs([k for ks in keys for k in ks]))
        simhash = _longs([set_print(s) for s in sets])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _longs([set_name(s) for s in sets]), simhash, bands], names=["doc_id", "name", "fp", "simhash", "bands"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_name().alias("name"), utf8_column("text"))
    return map_rows(given, one, "doc_id long, name long, fp long, simhash long, bands array<long>")


def text_name():
    """A hash of the whole text; null is a text of its own."""
    return F.xxhash64(F.col("text").cast("string"))


def by_popcounts(leads: DataFrame) -> DataFrame:
    """key and fp of every set that isn't empty: sets have one key if links of fingerprints within 2 bits connect them."""
    from .simhash import links as within_bits

    each = leads.where(F.size("bands") > 0).select("fp", "simhash")
    prints = materialize(each.groupBy("simhash").agg(F.count("*").alias("sets")), "set-prints")
    stars = star_forest(within_bits(prints.select(F.col("simhash").alias("fp"))))
    rooted = prints.join(stars.select(F.col("a").alias("simhash"), F.col("b").alias("root")), "simhash", "left")
    rooted = materialize(rooted.select("simhash", "sets", F.xxhash64(F.lit("popcounts"), F.coalesce("root", "simhash")).alias("key")), "print-roots")
    return left_join_split(each, rooted, ["simhash"], "sets", each.count(), [F.col("fp")]).select("key", "fp")


def by_bands(leads: DataFrame) -> DataFrame:
    """key and fp of every set in each of its bands."""
    return leads.select(F.explode("bands").alias("key"), "fp")


def _buckets(leads: DataFrame) -> DataFrame:
    """bucket and fp of sets that share a key with another."""

    def gather(batches):
        from xxhash import xxh64_intdigest as h

        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def found(key, fp):
            edges = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
            names, members = [], []
            for s, e in zip(edges[:-1], edges[1:]):
                if e - s > 1:
                    names.append(np.full(e - s, h(fp[s:e].tobytes(), SEED), np.uint64))
                    members.append(fp[s:e])
            names, members = (np.concatenate([np.zeros(0, t), *x]) for t, x in ((np.uint64, names), (np.int64, members)))
            return pa.RecordBatch.from_arrays([_longs(names), pa.array(members)], names=["bucket", "fp"])

        for batch in batches:
            key, fp = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([fp, batch.column(1).to_numpy()])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on
            if cut:
                yield found(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield found(key, fp)

    each = by_popcounts(leads).unionByName(by_bands(leads))
    return each.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(gather, "bucket long, fp long").distinct()


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of near copies, by position."""
    sizes = np.asarray([len(s) for s in sets])
    vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.r_[0, np.cumsum(sizes)]
    mark = np.zeros(len(vocabulary), np.int32)
    open_, at = np.ones(len(sets), bool), np.arange(len(sets))
    held, held_starts = ids, starts[:-1]
    out = []
    for root in range(len(sets)):
        if not open_[root]:
            continue
        open_[root] = False
        queue = [root]
        while queue and open_.any():
            x = queue.pop()
            if 2 * np.count_nonzero(open_) < len(at):
                at = np.flatnonzero(open_)
                held = np.concatenate([ids[starts[k] : starts[k + 1]] for k in at])
                held_starts = np.r_[0, np.cumsum(sizes[at])[:-1]]
            own = ids[starts[x] : starts[x + 1]]
            mark[own] = 1
            shared = np.add.reduceat(mark[held], held_starts)
            mark[own] = 0
            near = 5 * shared >= LEAST_OF_5 * (sizes[at] + sizes[x] - shared)
            hits = at[near & open_[at]]
            open_[hits] = False
            queue += hits.tolist()
            out += [(x, y) for y in hits.tolist()]
    return out


def links(docs: DataFrame, leads: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the sets that near copies among the buckets connect."""

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(b or b"") for b in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([_longs([set_name(s) for s in sets]), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "shingles"])

    def search(batches):
        group, fps, sets = None, [], []

        def found():
            pairs = linked(sets) if len(sets) > 1 else []
            a, b = ([fps[p[k]] for p in pairs] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for bucket, left, right, fp, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, left, right) != group:
                    if len(sets) > 1:
                        yield found()
                    group, fps, sets = (bucket, left, right), [], []
                fps.append(fp)
                sets.append(np.frombuffer(shingles, np.uint64))
        if len(sets) > 1:
            yield found()

    members = materialize(_buckets(leads), "buckets")
    wanted = leads.join(members.select("fp").distinct(), "fp", "left_semi").select("lead").distinct()
    # the sides grow with the corpus: one plan at every size, and never a broadcast
    texts = docs.join(wanted.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(wanted["lead"]), "left_semi").select(utf8_column("text"))
    sets = map_rows(texts, read, "fp long, shingles binary").dropDuplicates(["fp"])
    sizes = materialize(members.groupBy("bucket").agg(F.count("*").alias("n")), "bucket-sizes")
    sized = left_join_split(members, sizes, ["bucket"], "n", members.count(), [F.col("fp")])
    blocks = F.ceil(F.col("n") / MOST_SETS).cast("int")
    own = F.pmod(F.xxhash64(F.lit(3), "fp"), blocks).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (j != F.col("own")) | (F.col("blocks") == 1))
    pairs = F.transform(others, lambda j: F.struct(F.least("own", j).alias("left"), F.greatest("own", j).alias("right")))
    met = sized.select("bucket", "fp", blocks.alias("blocks"), own.alias("own")).hint("merge").join(sets, "fp")
    met = met.select("bucket", F.explode(pairs).alias("at"), "fp", "shingles").select("bucket", "at.left", "at.right", "fp", "shingles")
    return met.repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right", "fp").mapInArrow(search, "a long, b long")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, name (a hash of the text), component_id, the smallest id of its near copies, and root, the component's own name, of every row."""
    each = materialize(prints(docs), "prints")
    leads = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("lead"), F.first("simhash").alias("simhash"), F.first("bands").alias("bands"), F.count("*").alias("rows")), "sets")
    stars = star_forest(links(docs, leads))
    rooted = leads.join(stars.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select("fp", "lead", "rows", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("lead").alias("component_id"))
    by_set = materialize(rooted.join(named, "root").select("fp", "root", "component_id", "rows"), "set-components")
    return left_join_split(each.select("doc_id", "name", "fp"), by_set, ["fp"], "rows", each.count(), [F.col("doc_id"), F.col("name")]).select("doc_id", "name", "component_id", "root")
