"""Removal of every byte covered by a string of `match` bytes that also starts elsewhere.

A string is found through its anchor (see anchors.py), so only texts around anchors
whose grams occur twice are looked at. The starts an anchor serves make a window: the
bytes from the first start to the end of the last start's string. Windows are sorted as
suffixes: by anchor, then by the text from the anchor on, then by the text before it read
backwards. Each task sorts its windows, gives equal ones once, and writes front-coded
runs for ranges of anchors; each range is merged by a loser tree that never compares
known prefixes again (see suffixes.py). The common prefixes it yields decide:

- equal windows: all strings in them repeat;
- windows of one anchor that agree on l bytes before it and r bytes from it on, with
  l + r >= match: all strings inside those l + r bytes repeat;
- where many different windows share an anchor, all strings that lie alike around it are
  counted instead of looking at pairs, which is as exact and linear.

An anchor with more than `WIDE` occurrences, a passage that a great share of all
documents holds, is not gathered in one task: its different windows are listed by a
distributed aggregation, and their strings counted by 128-bit hashes.

Copies of a whole text are gathered first and looked at once; a text with very many copies is marked by a bounded broadcast, so
that its rows aren't brought together.

Two switches by size leave the merge, with the same result: anchors with more than `WIDE` occurrences, as said, and groups of
more than `FEW` different windows of an anchor, whose strings are counted.

Defined results: a null text is empty; texts shorter than `match` keep every byte; repeated
rows are documents of their own, so they repeat each other; a null doc_id is kept; an
empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .anchors import anchors
from .arrowio import map_rows
from .joins import MOST_HOT, left_join_split
from .suffixes import common_prefix, front_code, merge

MATCH = 400
GRAM = 80
WIDE = 1 << 16  # windows of one anchor that a task may gather: 36 MB
FEW = 64  # windows of an anchor that are compared in pairs
RUN_BYTES = 24 << 20  # of windows that a task holds before it writes runs
RANGES = 256  # least number of anchor ranges
RANGE_ROWS = 40_000  # anchors' occurrences to a range
NAME = "struct<x:long,y:long>"
SPANS = "array<struct<lo:long,hi:long>>"


def _name(window: bytes) -> tuple[int, int]:
    from xxhash import xxh3_128_digest

    d = xxh3_128_digest(window)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _keyed(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id, body (null: empty), key (128 bits of the text's SHA-256) and, as `rest`, the columns `carry`."""
    body = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    more = [F.struct(*[docs[c] for c in carry]).alias("rest")] if carry else []
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"), *more)
    return out.withColumn("key", F.unhex(F.substring(F.sha2("body", 256), 1, 32)))


def _anchor_names(docs: DataFrame, match: int, gram: int) -> DataFrame:
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [np.unique(anchors(b, match, gram)[2], return_counts=True) for b in batch.column(2).to_pylist()]
        ends = pa.array(np.cumsum([0, *(len(p[0]) for p in pairs)]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([p[k] for p in pairs]))) for k in range(2)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "key", "names", "times"])

    return map_rows(docs.select("doc_id", "key", "body"), one, "doc_id long, key binary, names array<long>, times array<long>")


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint and not touching."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            if hi > out[-1][1]:
                out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def without(body: bytes, cut: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for lo, hi in cut:
        kept.append(body[at:lo])
        at = hi
    kept.append(body[at:])
    return b"".join(kept)


def whole_characters(body: bytes, cut: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, each grown to the characters of which it holds a byte."""
    out = []
    for lo, hi in cut:
        while lo > 0 and body[lo] & 0xC0 == 0x80:
            lo -= 1
        while hi < len(body) and body[hi] & 0xC0 == 0x80:
            hi += 1
        out.append((lo, hi))
    return merge_spans(out)


WINDOWS = f"kind string, key binary, starts array<long>, name {NAME}, anchor long, range int, shared array<int>, tails array<binary>, many array<boolean>, window binary, at int"
_ARROW = pa.schema(
    [("kind", pa.string()), ("key", pa.binary()), ("starts", pa.list_(pa.int64())), ("name", pa.struct([("x", pa.int64()), ("y", pa.int64())])), ("anchor", pa.int64()), ("range", pa.int32())]
    + [("shared", pa.list_(pa.int32())), ("tails", pa.list_(pa.binary())), ("many", pa.list_(pa.bool_())), ("window", pa.binary()), ("at", pa.int32())]
)


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in _ARROW.names} for r in rows], schema=_ARROW)


def _sort_key(anchor: int, window: bytes, at: int) -> bytes:
    """Anchor, text from the anchor on, text before it backwards, and where the two meet."""
    return (anchor + (1 << 63)).to_bytes(8, "big") + window[at:] + window[:at][::-1] + at.to_bytes(4, "big")


def _unkeyed(k: bytes) -> tuple[bytes, bytes]:
    """Text from the anchor on, and text before it backwards."""
    at = int.from_bytes(k[-4:], "big")
    return k[8 : len(k) - 4 - at], k[len(k) - 4 - at : -4]


def _windows(texts: DataFrame, match: int, gram: int, wide: int, ranges: int) -> DataFrame:
    """From key, body and found (anchor names with counts): owners, front-coded runs, and wide anchors' windows."""

    def run(batches):
        narrow: dict[bytes, bool] = {}
        broad: dict[bytes, tuple[int, bool]] = {}
        owners: list[dict] = []
        held = 0

        def flush():
            by_range: dict[int, list[bytes]] = defaultdict(list)
            for k in sorted(narrow):
                by_range[int.from_bytes(k[:8], "big") * ranges >> 64].append(k)
            out = []
            for where, keys in by_range.items():
                shared, tails = front_code(keys)
                out.append({"kind": "run", "range": where, "shared": shared, "tails": tails, "many": [narrow[k] for k in keys]})
            for w, (at, many) in broad.items():
                x, y = _name(w)
                out.append({"kind": "wide", "name": {"x": x, "y": y}, "window": w, "at": at, "many": [many]})
            return [_rows(out[k : k + 64]) for k in range(0, len(out), 64)]

        for batch in batches:
            for key, body, found in zip(*(batch.column(k).to_pylist() for k in range(3))):
                counts = {r["name"]: r["n"] for r in found}
                where, first, names = (a.tolist() for a in anchors(body, match, gram))
                first.append(len(body) - match + 1)
                mine: dict[tuple[int, int], list[int]] = defaultdict(list)
                for k, name in enumerate(names):
                    if name not in counts:
                        continue
                    lo, hi = first[k], first[k + 1] + match - 1
                    window, at = body[lo:hi], where[k] - lo
                    mine[_name(window)].append(lo)
                    if counts[name] > wide:
                        if window not in broad:
                            held += len(window)
                        broad[window] = (at, window in broad)
                    else:
                        k2 = _sort_key(name, window, at)
                        if k2 not in narrow:
                            held += len(k2)
                        narrow[k2] = k2 in narrow
                owners += [{"kind": "owner", "key": key, "starts": starts, "name": {"x": x, "y": y}} for (x, y), starts in mine.items()]
                if len(owners) > 20_000:
                    yield _rows(owners)
                    owners = []
                if held > RUN_BYTES:
                    yield from flush()
                    narrow, broad, held = {}, {}, 0
        if owners:
            yield _rows(owners)
        yield from flush()

    return texts.select("key", "body", "found").mapInArrow(run, WINDOWS)


def _group_spans(group: list[tuple[bytes, bytes, bool, int]], match: int) -> list[list[tuple[int, int]]]:
    """For the different windows of one anchor, in sorted order, with the common prefix of
    neighbours' sort keys after the anchor: spans that repeat, relative to the window's first byte."""
    spans: list[list[tuple[int, int]]] = [[(0, len(right) + len(left))] if many else [] for right, left, many, _ in group]
    if len(group) > FEW:
        last_offset = max(len(left) for _, left, _, _ in group)
        for o in range(last_offset + 1):
            alike = [(left[:o], right[: match - o]) if len(left) >= o and len(right) >= match - o else None for right, left, _, _ in group]
            often = Counter(alike)
            for k, a in enumerate(alike):
                if a is not None and often[a] > 1:
                    lo = len(group[k][1]) - o
                    spans[k].append((lo, lo + match))
        return [merge_spans(s) for s in spans]
    for i in range(len(group)):
        agree = 1 << 60
        for j in range(i + 1, len(group)):
            agree = min(agree, group[j][3])
            if match - agree > len(group[i][1]):
                break
            r = min(agree, len(group[i][0]), len(group[j][0]))
            both = common_prefix(group[i][1], group[j][1])
            if both + r >= match:
                for k in (i, j):
                    lo = len(group[k][1]) - both
                    spans[k].append((lo, lo + both + r))
    return [merge_spans(s) for s in spans]


def _merge_range(match: int):
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("spans", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))])

    def run(table: pa.Table) -> pa.Table:
        shared, tails, many = (table.column(n).to_pylist() for n in ("shared", "tails", "many"))
        out: list[dict] = []
        group: list[tuple[bytes, bytes, bool, int]] = []

        def close() -> None:
            if len(group) > 1 or (group and group[0][2]):
                for (right, left, _, _), spans in zip(group, _group_spans(group, match)):
                    if spans:
                        x, y = _name(left[::-1] + right)
                        out.append({"x": x, "y": y, "spans": [{"lo": lo, "hi": hi} for lo, hi in spans]})
            group.clear()

        last = b""
        for key, agree, r, k in merge(list(zip(shared, tails))):
            if key == last:
                right, left, _, before = group[-1]
                group[-1] = (right, left, True, before)
                continue
            right, left = _unkeyed(key)
            if agree < 8:
                close()
            group.append((right, left, many[r][k], agree - 8))
            last = key
        close()
        return pa.Table.from_pylist(out, schema=schema)

    return run


def _wide_spans(wide: DataFrame, match: int) -> DataFrame:
    """Spans of the windows of very frequent anchors, by counting their strings' hashes."""
    different = materialize(
        wide.groupBy("name").agg(F.min("window").alias("window"), F.min("at").alias("at"), ((F.count("*") > 1) | F.max(F.element_at("many", 1))).alias("many")),
        "wide",
    )

    def strings(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, lows, digests = [], [], []
        for name, window in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n = len(window) - match + 1
            names += [name] * n
            lows += range(n)
            digests += [_name(window[k : k + match]) for k in range(n)]
        xs, ys = zip(*digests) if digests else ((), ())
        columns = [pa.array(names, _ARROW.field("name").type), pa.array(lows, pa.int64()), pa.array(xs, pa.int64()), pa.array(ys, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["name", "lo", "x", "y"])

    each = map_rows(different.select("name", "window"), strings, f"name {NAME}, lo long, x long, y long")
    twice = each.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    span = F.struct(F.col("lo"), (F.col("lo") + match).alias("hi"))
    partly = each.join(twice, ["x", "y"]).groupBy("name").agg(F.collect_list(span).alias("spans"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.length("window").cast("long").alias("hi")))
    return different.join(partly, "name", "left").select("name", F.when(F.col("many"), whole).otherwise(F.col("spans")).alias("spans")).where("spans is not null")


def repeated_spans(docs: DataFrame, match: int = MATCH, gram: int = GRAM, wide: int = WIDE) -> tuple[DataFrame, DataFrame]:
    """(keyed documents, per text: key, copies, lists of spans to remove; texts without any may be missing)."""
    keyed = _keyed(docs)
    named = materialize(_anchor_names(keyed, match, gram), "anchors")
    by_text = materialize(named.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("lead"), F.max(F.struct("names", "times")).alias("anchors")), "texts")
    each = by_text.select("key", F.inline(F.arrays_zip("anchors.names", "anchors.times"))).toDF("key", "name", "times")
    # stored, so that both sides of the join are plain shuffles, which can be split where a name is hot
    often = materialize(each.groupBy("name").agg(F.sum("times").alias("n")).where("n > 1"), "often")
    found = each.join(often, "name").groupBy("key").agg(F.collect_set(F.struct("name", "n")).alias("found"))
    sought = materialize(found.join(by_text.select("key", "lead", "copies"), "key"), "sought")
    # of a text with very many copies only the leading row goes into the join
    rows = named.count()
    hot = by_text.where(F.col("copies") * MOST_HOT > rows).select("key", F.col("lead").alias("_lead"), F.lit(True).alias("_hot"))
    leading = keyed.join(F.broadcast(hot), "key", "left").where("_hot is null or doc_id <=> _lead").select("doc_id", "key", "body")
    bodies = leading.join(sought.hint("merge"), "key").where("doc_id <=> lead").select("key", "body", "found")
    size = by_text.agg(F.sum(F.size("anchors.names"))).first()[0] or 0
    ranges = max(RANGES, -(-size // RANGE_ROWS))
    windows = materialize(_windows(bodies, match, gram, wide, ranges), "windows")
    runs = windows.where("kind = 'run'").select("range", "shared", "tails", "many")
    merged = runs.groupBy("range").applyInArrow(_merge_range(match), f"x long, y long, spans {SPANS}")
    outcome = merged.select(F.struct("x", "y").alias("name"), "spans").unionByName(_wide_spans(windows.where("kind = 'wide'").select("name", "window", "at", "many"), match))
    moved = F.flatten(F.transform("starts", lambda at: F.transform("spans", lambda s: F.struct((s["lo"] + at).alias("lo"), (s["hi"] + at).alias("hi")))))
    owners = windows.where("kind = 'owner'").select("key", "starts", "name")
    spans = owners.join(outcome, "name").select("key", moved.alias("spans")).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    per_text = by_text.select("key", "copies").join(spans, "key", "left").where("copies > 1 or spans is not null")
    return keyed, per_text


def remove_repeats(docs: DataFrame, match: int = MATCH, gram: int = GRAM, wide: int = WIDE, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), text (those that make whole characters) and the
    columns `carry`, as `rest`, of every row."""
    keyed, per_text = repeated_spans(docs, match, gram, wide)
    if carry:
        keyed = _keyed(docs, carry)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, body, copies, spans in zip(*(batch.column(k).to_pylist() for k in range(4))):
            n = len(body)
            cut = [(0, n)] if n >= match and (copies or 1) > 1 else merge_spans([(s["lo"], s["hi"]) for s in spans or ()])
            kept = without(body, cut)
            text = without(body, whole_characters(body, cut)).decode("utf-8", "replace")
            rows.append((doc_id, n, sum(hi - lo for lo, hi in cut), len(cut), kept, text))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        more = [batch.column(4)] if carry else []
        return pa.RecordBatch.from_arrays([*columns, *more], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "text", "rest"][: 6 + len(more)])

    columns = ["doc_id", "body", "copies", "spans", *(["rest"] if carry else [])]
    per_text = materialize(per_text, "per-text")
    joined = left_join_split(keyed, per_text, ["key"], "copies", keyed.count(), [F.col("doc_id")]).select(*columns)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, text string"
    if carry:
        schema += f", rest {keyed.schema['rest'].dataType.simpleString()}"
    return map_rows(joined, one, schema)
