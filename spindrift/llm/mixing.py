"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Targets: sources, in the order of their names' code points (null last), weigh 1, 2, 3,
   repeating, and share all tokens by weight; a target stops at `MOST_EPOCHS` times its
   source's size and what is over is shared again by weight. That ends where every target is
   min(cap, weight * level), so the level is found directly on the sources sorted by
   cap / weight.
2. The mix is cut into blocks of equal tokens, about `BLOCKS` of them (one token at least).
   Sources get blocks by the highest quotients target / (2j + 1). With n sources the seats can
   only differ from target / block by n * share / 2 + 1, so all quotients but those few
   are settled and the rest are ranked.
3. Each source is dealt over shards by hash, at most `SHARDS` in all, and its blocks are given to
   its shards in the same way, by the shards' tokens.
4. In each shard a seeded order of the documents is cut into blocks; the quota takes whole
   rounds of the shard first and then the first blocks in that order.

Everything is DataFrame expressions. Shards keep each window within a bounded share of the
rows, however large a source is.

One task sees all sources in two windows: a row a source, and no frame but running sums. Another sees one source's shards:
at most `SHARDS` rows, whatever share of the documents is in it.

Defined results: a null text has size 0 and takes nothing; null sources are one source, the last;
equal rows are mixed each; rows with a null doc_id are kept; an empty table gives an empty result;
further columns are ignored. Reruns agree, whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

MOST_EPOCHS = 3
BLOCKS = 1 << 20
SHARDS = 4096
SHARD_MOST = 1 << 26  # tokens
SEED = 42
WORD = r"[^\x20\x09-\x0D]+"


def _size() -> Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _name() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (the number of words of the text) and name (a hash of it)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size().alias("size"), _name().alias("name"))


def targets(sizes: DataFrame) -> DataFrame:
    """One row a source: source, source_size, weight, target (double)."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = by_source.select(
        "source",
        "source_size",
        ((F.row_number().over(order) - 1) % 3 + 1).cast("long").alias("weight"),
        (F.col("source_size") * MOST_EPOCHS).alias("cap"),
        F.sum("source_size").over(everything).alias("total"),
    )
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    tried = weighed.select("*", (F.col("total") - earlier("cap")).alias("_left"), (F.sum("weight").over(everything) - earlier("weight")).alias("_weights"))
    # sources are full up to the first whose cap the level doesn't reach
    stops = F.col("cap") * F.col("_weights") >= F.col("_left") * F.col("weight")
    level = F.min(F.when(stops, F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("source").isNull().alias("last"), "source", "_left", "_weights"))).over(everything)
    held = tried.withColumn("_level", level)
    share = F.col("weight") * F.col("_level._left") / F.col("_level._weights")
    return held.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), share.cast("double")).alias("target"), "total")


def apportion(parties: DataFrame, by: list[str], party: list[str], votes: str, seats: str) -> DataFrame:
    """Sainte-Lague: adds `quota`. Within each `by` group, `seats` (a column, the same in the group) go to
    parties by the highest votes / (2j + 1), ties by the party's columns."""
    group = Window.partitionBy(*by)
    total, n = F.sum(votes).over(group), F.count("*").over(group)
    known = parties.withColumn("_votes", total).withColumn("_n", n)
    share = F.when(F.col("_votes") > 0, F.col(votes).cast("double") / F.col("_votes")).otherwise(0.0)
    slack = F.ceil(F.col("_n") * share / 2 + 2)
    ideal = share * F.col(seats)
    known = known.withColumn("_low", F.greatest(F.lit(0), F.floor(ideal) - slack)).withColumn("_high", F.when(share > 0, F.ceil(ideal) + slack).otherwise(0))
    open_seats = F.col(seats) - F.sum("_low").over(group)
    contested = known.withColumn("_open", open_seats).where("_high > _low").select(*by, *party, "_open", votes, F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("_j"))
    quotient = F.col(votes).cast("double") / (2 * F.col("_j") + 1)
    order = Window.partitionBy(*by).orderBy(quotient.desc(), *[F.col(p).asc_nulls_last() for p in party], "_j")
    keys = {c: f"_won_{c}" for c in [*by, *party]}
    won = contested.withColumn("_rank", F.row_number().over(order)).where("_rank <= _open")
    won = won.groupBy(*[F.col(c).alias(k) for c, k in keys.items()]).agg(F.count("*").alias("_won"))
    joined = known.join(won, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()], "left")
    return joined.withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0))).drop("_votes", "_n", "_low", "_high", "_won", *keys.values())


def _order(*columns: Column) -> Column:
    return F.xxhash64(F.lit(SEED), *columns)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and name (a hash of the text) of every row of `docs`."""
    return mix_sizes(materialize(sized(docs), "sizes"))


def mix_sizes(sizes: DataFrame) -> DataFrame:
    """As mix, from doc_id, source, size and name. `sizes` must be a stored table: it is read more than once."""
    block = F.greatest(F.lit(1), F.floor(F.col("total") / BLOCKS))
    goals = targets(sizes).withColumn("block", block).withColumn("_blocks", F.floor(F.col("total") / F.col("block")))
    shard_size = F.greatest(F.lit(1), F.least(F.lit(SHARD_MOST), F.floor(F.col("total") / SHARDS)))
    goals = goals.withColumn("_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_size)))
    quotas = apportion(goals.withColumn("_all", F.lit(0)), ["_all"], ["source"], "target", "_blocks").drop("_all")
    # stored: one row a source, so that the join below sees its size, or can split a source that most rows have
    quotas = materialize(quotas.select("source", "source_size", "target", "block", "_shards", F.col("quota").alias("_source_quota")), "quotas")

    # one row a source; joined by name, with null as a name of its own
    named = lambda c: F.struct(F.col(c).isNull().alias("none"), F.coalesce(c, F.lit("")).alias("name"))
    dealt = sizes.withColumn("_s", named("source")).join(quotas.withColumn("_s", named("source")).drop("source"), "_s")
    dealt = dealt.withColumn("_shard", F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id", "name"), F.col("_shards")))
    shards = dealt.groupBy("_s", "_shard").agg(F.sum("size").alias("_shard_size"), F.first("_source_quota").alias("_source_quota"), F.first("block").alias("block"))
    shards = apportion(shards, ["_s"], ["_shard"], "_shard_size", "_source_quota")
    tokens = F.least(F.col("quota") * F.col("block"), MOST_EPOCHS * F.col("_shard_size"))
    shards = shards.select("_s", "_shard", "_shard_size", tokens.alias("_tokens"))

    seeded = Window.partitionBy("_s", "_shard").orderBy(_order(F.col("doc_id"), F.col("name")), "doc_id", "name").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_before", F.coalesce(F.sum("size").over(seeded), F.lit(0))).join(shards, ["_s", "_shard"])
    rounds = F.when(F.col("_shard_size") > 0, F.floor(F.col("_tokens") / F.greatest(F.col("_shard_size"), F.lit(1)))).otherwise(0)
    rest = F.col("_tokens") - rounds * F.col("_shard_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    return placed.select("doc_id", "source", "size", "source_size", "target", (rounds * F.col("size") + part).cast("long").alias("taken"), "name")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of `docs`: a document as often as its taken words fill it,
    and once more cut after the words that are left. Rows alike in doc_id, source and text stand for each other, and take in
    any order what the mix gives them together."""
    taken = mix(docs).where("taken > 0").groupBy("doc_id", "source", "name", "size").agg(F.sum("taken").alias("_sum"))
    taken = materialize(taken, "taken").select(F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), F.col("name").alias("_of"), "size", "_sum")
    # the rows themselves travel as one column, so that none of theirs can clash
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    named = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("src"), _name().alias("name"), row.alias("row"))
    # one row of those that are alike is taken for all of them; only tables that hold such rows pay for finding it
    alike = named.groupBy("id", "src", "name").agg(F.count("*").alias("n")).where("n > 1")
    if not alike.isEmpty():
        named = named.groupBy("id", "src", "name").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    rounds = F.sequence(F.lit(1).cast("long"), F.ceil(F.col("_sum") / F.col("size")))
    same = F.col("id").eqNullSafe(F.col("_doc")) & F.col("src").eqNullSafe(F.col("_source")) & (F.col("name") == F.col("_of"))
    # taken grows with the corpus: one plan at every size, and never a broadcast
    each = named.join(taken.hint("merge"), same).withColumn("words", F.explode(F.transform(rounds, lambda k: F.least(F.col("size"), F.col("_sum") - (k - 1) * F.col("size")))))
    cut = F.col("words") < F.col("size")
    held = F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    text = F.when(cut, F.array_join(F.slice(held, F.lit(1), F.col("words").cast("int")), "")).otherwise(F.col("row.text"))
    each = each.select("row", cut.alias("cut"), text.alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return each.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
