"""Sharding by balanced label propagation (DataFrame operations only).

Documents that share a link key (here: equal texts) are neighbours. Every document starts in
the shard that its own hash names. In each round a linked document asks for the shard in which
most of its neighbours are; a group above a shard's quota is first split into parts that fit.
Quotas are then enforced: linked documents keep their place before unlinked ones, and what does
not fit goes to free places, neighbours side by side. After every round the counts of any two
shards differ by at most one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, dense_index, spread_join

ROW_OVERHEAD = 16


def _mixed(*cols) -> Column:
    return F.xxhash64(*cols)


def shard_documents(docs: DataFrame, n_shards: int = 40, rounds: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` reduced to key, size, text_crc32, law, shard, slot, group_rows, grown_shard.

    size is the UTF-8 length plus 16; a null text counts as empty (size 16, crc 0) and is linked
    to other null or empty texts. Repeated rows are documents of their own and get a slot each.
    A null key is hashed like any value. An empty table gives an empty result. The law is
    ``rows``; grown_shard, which only a key law has, is null.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        F.col(key),
        (F.octet_length(body) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        _mixed(body).alias("_g"),
        _mixed(F.lit("second"), body).alias("_g2"),
        _mixed(F.lit("order"), F.col(key)).alias("_d"),
    )
    base = cut(base)
    total = base.count()
    if total == 0:
        return base.select(key, "size", "text_crc32", F.lit("rows").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(1).cast("long").alias("group_rows"), F.lit(None).cast("int").alias("grown_shard"))
    groups = base.groupBy("_g", "_g2").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    fits = max(1, int(0.9 * quota[-1]))
    named = groups.withColumnsRenamed({"_g": "_lg", "_g2": "_lg2"})
    linked = spread_join(base, named, "_g", "_lg", "_rows", total, F.col("_d"), "left", also=F.col("_g2") == F.col("_lg2")).drop("_lg", "_lg2")
    parts = F.ceil(F.col("_rows") / F.lit(fits))
    part = F.when(F.col("_rows") > fits, F.pmod(_mixed("_d", F.lit("part")), parts)).otherwise(F.lit(0).cast("long"))
    state = linked.select(
        key, "size", "text_crc32", "_d",
        F.coalesce("_rows", F.lit(1)).cast("long").alias("_rows"),
        F.when(F.col("_rows").isNotNull(), _mixed("_g", "_g2", part)).otherwise(F.col("_d")).alias("_unit"),
        F.pmod("_d", F.lit(n_shards)).cast("int").alias("shard"),
    )
    for _ in range(rounds):
        state = cut(_enforce(_propagate(state), quota))
    state = dense_index(state, "shard", _mixed(F.lit("slot"), "_d"), [F.col(key), F.col("text_crc32")], "slot")
    return state.select(
        key, "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.col("_rows").alias("group_rows"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _propagate(state: DataFrame) -> DataFrame:
    """Each linked document asks for the shard that holds most of its unit (ties: the lowest)."""
    held = state.filter("_rows > 1").groupBy("_unit", "shard").agg(F.count(F.lit(1)).alias("_n"))
    asked = held.groupBy(F.col("_unit").alias("_u")).agg(F.max_by("shard", F.struct("_n", -F.col("shard"))).alias("_want"))
    moved = state.join(asked, F.col("_unit") == F.col("_u"), "left")
    return moved.withColumn("shard", F.coalesce("_want", "shard")).drop("_u", "_want")


def _enforce(state: DataFrame, quota: list[int]) -> DataFrame:
    """Keep what fits in each shard, linked documents first; deal the rest to free places."""
    # Two leading ranges of the order: units before single documents, each by its own hash.
    lead = F.when(F.col("_rows") == 1, F.shiftrightunsigned("_d", 1).bitwiseOR(F.lit(-(1 << 63)))).otherwise(F.shiftrightunsigned("_unit", 1))
    state = state.withColumn("_lead", lead)
    ranked = dense_index(state, "shard", F.col("_lead"), [F.col("_unit"), F.col("_d")], "_rank")
    quotas = F.array(*[F.lit(int(q)) for q in quota])
    ranked = cut(ranked.withColumn("_fits", F.col("_rank") < F.element_at(quotas, F.col("shard") + 1)))
    kept = {r["shard"]: r["n"] for r in ranked.filter("_fits").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    ends, end = [], 0
    for s, q in enumerate(quota):
        end += q - kept.get(s, 0)
        ends.append(end)
    over = dense_index(ranked.filter("not _fits"), None, F.col("_lead"), [F.col("_unit"), F.col("_d")], "_over")
    passed = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("_over")))
    placed = over.withColumn("shard", passed.cast("int")).drop("_over")
    return ranked.filter("_fits").unionByName(placed).drop("_lead", "_rank", "_fits")


def cut_edges(assigned: DataFrame, group: str = "text_crc32") -> DataFrame:
    """Groups, and how many of them lie in more than one shard."""
    per = assigned.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("shard").alias("shards"))
    return per.filter("rows > 1").agg(F.count(F.lit(1)).alias("groups"), F.sum((F.col("shards") > 1).cast("long")).alias("groups_cut"))


def op3_label_propagation_shards(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return shard_documents(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "group_rows")
