"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

1. Targets: the sources in code point order (null last) weigh 3, 1, 2, repeating, and share ``SHARE`` times all words. A
   target stops at ``REPEATS`` times its source's size; the excess goes to the others by weight. That is a water level: the
   sources ordered by size over weight, each capped one leaving the rest a higher level.
2. Quotas: blocks of ``BLOCK`` words are seats. Sources get theirs by highest quotients target / (2 k + 1), k seats held; a
   source's seats go to its shards in the same way by their words. A divisor that gives too few seats and one that gives too
   many bound the open seats of each party to a few, so only those quotients are ranked, never one per seat.
3. Selection: a document belongs to a shard by the seeded hash of its id; a large source has many shards of about ``SHARD`` words,
   so no shard grows with the corpus. A shard's documents in seeded order form one stream of words cut into blocks. A quota of
   q of its n blocks takes every block q // n times and q % n of them once more, those that a seeded one-to-one map of
   the block numbers sends lowest. Every block is taken at most ``REPEATS`` times, so no document exceeds that.

A source's last block of each shard may be short, so its words differ from its target by less than a block per shard and half a
block of rounding.

Tables of sources and shards are small beside the documents; windows run over sources (one row each), over the shards of a
source and over the documents of a shard. Words, not rows, are counted; a null text has 0 and is never taken.

Defined cases: a null, empty or wordless text has size 0 and gives nothing; a source without words has target 0; a null source is a source
of its own; a long text is many blocks; repeated rows are taken each on its own; ties in seeded order fall back on the
id, the size and then equal rows are interchangeable; with no rows at all the result is empty; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antecede.llm.common import stage

WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
BLOCK, SHARD, SEED = 64, 1 << 20, 17
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)  # above every number of blocks


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, place, target) from (source, source_size)."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    placed = sizes.withColumn("place", F.row_number().over(by_name)).withColumn("weight", weight)
    cap = F.col("source_size") * repeats
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total * share - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(rest)
    levelled = placed.withColumn("level", level)
    # The first source below its cap sets the level of all that follow.
    free = F.first(F.when(F.col("level") * F.col("weight") <= cap, F.col("level")), ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, 0)
    )
    return levelled.select(
        "source", "source_size", "place",
        F.coalesce(free * F.col("weight"), cap.cast("double")).alias("target"),
    )


def seats(parties: DataFrame, group: list[str], claim: str, total: Column, tie: str) -> DataFrame:
    """Adds ``seats``: ``total`` seats of each group by highest quotients of the claim, ties to the smallest ``tie``."""
    whole = Window.partitionBy(*group)
    claims, count = F.sum(claim).over(whole), F.sum(F.when(F.col(claim) > 0, 1).otherwise(0)).over(whole)
    bounded = parties.withColumns({"_total": total, "_claims": claims, "_count": count})
    few = F.when(
        F.col("_total") * 2 > F.col("_count"),
        F.floor(F.col(claim) * (F.col("_total") - F.col("_count") / 2) / F.col("_claims") + 0.5),
    ).otherwise(F.lit(0))
    many = F.floor(F.col(claim) * (F.col("_total") + F.col("_count") / 2) / F.col("_claims") + 0.5) + 1
    bounded = bounded.withColumns({"_few": F.coalesce(few, F.lit(0)).cast("bigint"), "_many": F.coalesce(many, F.lit(0)).cast("bigint")})
    bounded = bounded.withColumn("_open", F.col("_total") - F.sum("_few").over(whole))
    quotients = (
        bounded.where((F.col(claim) > 0) & (F.col("_many") > F.col("_few")))
        .select(*group, tie, claim, "_open", F.explode(F.sequence("_few", F.col("_many") - 1)).alias("_held"))
        .withColumn("_rank", F.row_number().over(whole.orderBy(F.desc(F.col(claim) / (F.col("_held") * 2 + 1)), tie, "_held")))
        .where(F.col("_rank") <= F.col("_open")).groupBy(*group, tie).agg(F.count("*").alias("_won"))
    )
    left, right = bounded.alias("p"), quotients.alias("q")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in (*group, tie)]
    return left.join(right, same, "left").select(
        *[F.col(f"p.{c}") for c in parties.columns],
        (F.col("p._few") + F.coalesce("q._won", F.lit(0))).alias("seats"),
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """row (the document), doc_id, size, source_size, target, taken and blocks of every row.

    ``blocks`` lists what the mix takes of a document: (first word from 0, number of words, copies).
    """
    sized = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id"), F.col("source"), word_count(docs["text"]).alias("size")
    )
    plan = shard_plan(sized, weights, share, repeats, block, shard, seed)
    return chosen(sized, plan, block, seed, repeats)


def shard_of(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("shards")).alias("shard")


def shard_plan(sized: DataFrame, weights, share: float, repeats: int, block: int, shard: int, seed: int) -> DataFrame:
    """One row per shard: place, source, shards, source_size, target, shard, words, quota."""
    counts = stage(sized.select("doc_id", "source", "size"), "word-counts")
    sources = stage(targets(counts.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats), "targets")
    whole = F.round(F.sum("target").over(Window.partitionBy()) / block).cast("bigint")
    quotas = seats(sources, [], "target", whole, "place").withColumnRenamed("seats", "source_quota")
    quotas = quotas.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard), F.lit(1)).cast("bigint"))
    quotas = stage(quotas, "source-quotas")
    dealt = counts.join(quotas, counts["source"].eqNullSafe(quotas["source"])).select("place", shard_of(seed), "size")
    words = dealt.groupBy("place", "shard").agg(F.sum("size").alias("words")).join(quotas, "place")
    shared = seats(words, ["place"], "words", F.col("source_quota"), "shard").withColumnRenamed("seats", "quota")
    return stage(shared.select("place", "source", "shards", "source_size", "target", "shard", "words", "quota"), "shard-quotas")


def chosen(sized: DataFrame, plan: DataFrame, block: int, seed: int, repeats: int) -> DataFrame:
    """What the quotas take of every document."""
    sources = plan.select("place", "source", "shards").distinct()
    placed = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select("row", "doc_id", "size", "place", shard_of(seed))
    joined = placed.join(plan.drop("source", "shards"), ["place", "shard"])
    order = Window.partitionBy("place", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size")
    start = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    stream = joined.withColumn("start", start).withColumns({
        "n": F.greatest(F.ceil(F.col("words") / block), F.lit(1)).cast("bigint"),
        "salt": F.pmod(F.xxhash64(F.lit(seed + 2), "place", "shard"), F.lit(1 << 31)),
    })
    prime = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.pmod("salt", F.lit(len(PRIMES))) + 1).cast("int"))
    stream = stream.withColumn("step", F.pmod(prime, F.col("n")))
    # The block j of a shard is taken quota div n times, and once more if (step * j + salt) mod n < quota mod n; the step
    # shares no factor with n because it is the remainder of a larger prime.
    blocks = F.when(F.col("size") > 0, F.expr(f"""
        filter(transform(
            sequence(start div {block}, (start + size - 1) div {block}),
            j -> struct(
                greatest(j * {block} - start, 0L) AS first,
                least((j + 1) * {block}, start + size) - greatest(j * {block}, start) AS words,
                least(quota div n + if(pmod(step * j + salt, n) < pmod(quota, n), 1L, 0L), {repeats}L) AS copies)),
        b -> b.copies > 0)
    """))
    return stream.withColumn("blocks", blocks).select(
        "row", "doc_id", "size", "source_size", "target",
        F.coalesce(F.expr("aggregate(blocks, 0L, (a, b) -> a + b.words * b.copies)"), F.lit(0)).alias("taken"), "blocks",
    )
