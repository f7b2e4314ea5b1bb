"""Benchmark decontamination (DataFrame operations only).

Items and documents are lower-cased in A-Z and cut into words. A window is ``width`` consecutive
words of an item; an item with fewer words is one window. The distinct windows form a hash set
that is broadcast in blocks of a checked size; each document's windows are hashed in the row,
exploded and probed against it, and every hit is verified word by word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, documents

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
#: The key of the row that every document matches, so that documents without a hit stay.
SENTINEL = 0


def _words(text: Column) -> Column:
    """Words as written; A-Z count as word characters, so lower-casing later gives the same cuts."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _folded(words: Column) -> Column:
    """A hash for each word that is equal where the words are equal up to the case of A-Z."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def benchmark_windows(benchmark: DataFrame, width: int = 10, text: str = "text", item: str = "item_id") -> DataFrame:
    """Distinct windows: key, gram (words joined by a space), len, items (ids as strings, nulls left out)."""
    items = benchmark.select(F.col(item).cast("string").alias("_item"), _words(F.translate(F.col(text), UPPER, LOWER)).alias("_w"))
    items = items.filter(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - (width - 1), F.lit(1)))
    grams = items.select("_item", "_w", F.explode(starts).alias("_s")).select("_item", F.slice("_w", F.col("_s"), width).alias("_gram"))
    return grams.groupBy(F.array_join("_gram", " ").alias("gram"), F.size("_gram").alias("len"), F.xxhash64(_folded(F.col("_gram"))).alias("key")).agg(F.collect_set("_item").alias("items"))


def _candidates(windows: DataFrame, lengths: list[int], leads_most: int = 20_000) -> str:
    """SQL for the places (i, k) of a row's windows to probe: k hashes the words from i on.

    Only places whose first two words (or first, of single words) hash like those of some window of
    the length are hashed whole and exploded; the set of these leads is part of the plan up to
    ``leads_most`` of them, beyond which every place is probed. A last place -1 keeps the row.
    """
    first = F.col("_folded")
    leads = windows.select("len", _folded(F.split("gram", " ")).alias("_folded"))
    leads = leads.select("len", F.when(F.col("len") > 1, F.xxhash64(first[0], F.get(first, F.lit(1)))).otherwise(F.xxhash64(first[0])).alias("lead"))
    found = leads.distinct().limit(leads_most + 1).collect()
    parts = ["array(named_struct('i', -1, 'k', 0L))"]
    for n in lengths:
        own = [str(r["lead"]) for r in found if r["len"] == n]
        lead = "xxhash64(h[i], h[i + 1])" if n > 1 else "xxhash64(h[i])"
        test = f"{lead} IN ({', '.join(f'{v}L' if int(v) != -(1 << 63) else f'({int(v) + 1}L - 1L)' for v in own)})" if own and len(found) <= leads_most else "true" if own or len(found) > leads_most else "false"
        places = f"filter(sequence(0, size(h) - {n}), i -> {test})"
        parts.append(f"CASE WHEN size(h) >= {n} THEN transform({places}, i -> named_struct('i', i, 'k', xxhash64(slice(h, i + 1, {n})))) ELSE CAST(array() AS array<struct<i: int, k: bigint>>) END")
    return f"element_at(transform(array(transform(_words, w -> xxhash64(lower(w)))), h -> concat({', '.join(parts)})), 1)"


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 32 << 20, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: ``key``, n_words, n_hit, spans, item_ids.

    spans is the sorted array of (pos, len) of verified windows, in words from 0. A null or empty
    text has no words and no hit. Repeated rows give a row each. Items that are null or without
    words have no window; a window of an item whose id is null marks words and adds no id.
    Windows beyond ``block_bytes`` are probed in several broadcast blocks, each over all rows.
    """
    return _hits(docs, benchmark, width, block_bytes, text, [key]).select("_keep.*", "n_words", "n_hit", "spans", "item_ids")


def _hits(docs: DataFrame, benchmark: DataFrame, width: int, block_bytes: int, text: str, keep: list[str]) -> DataFrame:
    """As find_hits, with the ``keep`` columns in the struct _keep."""
    windows = cut(benchmark_windows(benchmark, width))
    size = windows.agg(F.sum(F.octet_length("gram") + F.lit(64)).alias("b"), F.sum(F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 8)).alias("i")).first()
    blocks = max(1, math.ceil(((size["b"] or 0) + (size["i"] or 0)) / block_bytes))
    lengths = sorted({r["len"] for r in windows.select("len").distinct().collect()}) or [width]

    held = F.struct(*[F.col(f"`{c}`").alias(c) for c in keep])
    base = docs.select(F.monotonically_increasing_id().alias("_row"), held.alias("_keep"), _words(F.col(text)).alias("_words"))

    if blocks > 1:  # row ids are made once, not anew in every branch
        base = cut(base)
    probe = base.select("_row", "_keep", "_words", F.size("_words").alias("_n"), F.explode(F.expr(_candidates(windows, lengths))).alias("_e"))
    probe = probe.select("_row", "_keep", "_words", "_n", F.col("_e.i").alias("_i"), F.col("_e.k").alias("_k"))
    spark = docs.sparkSession
    none = spark.range(1).select(F.lit("").alias("gram"), F.lit(0).alias("len"), F.lit(SENTINEL).cast("long").alias("key"), F.array().cast("array<string>").alias("items"))
    found = None
    for b in range(blocks):
        part = windows if blocks == 1 else windows.filter(F.pmod("key", F.lit(blocks)) == b)
        side = F.broadcast((part.unionByName(none) if b == 0 else part).coalesce(1))
        pos = F.greatest(F.col("_i"), F.lit(0))
        seen = F.translate(F.array_join(F.slice("_words", pos + 1, F.greatest(F.col("len"), F.lit(1))), " "), UPPER, LOWER)
        real = (F.col("_k") == F.col("key")) & ((F.col("len") == 0) & (F.col("_i") == -1) | (F.col("len") > 0) & (F.col("_i") >= 0) & (seen == F.col("gram")))
        hit = probe.join(side, real).select("_row", F.when(F.col("len") == 0, F.col("_keep")).alias("_keep"), "_n", F.when(F.col("len") > 0, F.struct(pos.alias("pos"), F.col("len"))).alias("_span"), F.when(F.col("len") > 0, F.col("items")).alias("_items"))
        found = hit if found is None else found.unionByName(hit)
    grouped = found.groupBy("_row").agg(F.first("_keep", ignorenulls=True).alias("_keep"), F.first("_n").alias("_n"), F.array_sort(F.collect_set("_span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("item_ids"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "spans", zero,
        lambda a, s: F.struct(F.greatest(a["end"], s["pos"] + s["len"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["pos"] + s["len"] - F.greatest(a["end"], s["pos"]))).alias("n")),
    )["n"]
    return grouped.select("_keep", F.col("_n").cast("long").alias("n_words"), covered.alias("n_hit"), "spans", "item_ids")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, remove: str = "documents") -> DataFrame:
    """``docs`` without what the benchmark holds; the columns stay as they are.

    remove="documents" drops rows with a hit; remove="spans" takes out the hit words with the
    gaps that follow them. Other rows come back unchanged, null texts included.
    """
    found = _hits(docs, benchmark, width, 32 << 20, "text", docs.columns)
    if remove == "documents":
        return found.filter("n_hit = 0").select("_keep.*")
    text = F.col("_keep.text")
    pieces = F.regexp_extract_all(text, F.lit(f"{WORD}{GAP}"), F.lit(0))
    lead = F.regexp_extract(text, f"^{GAP}", 0)
    kept = F.filter(pieces, lambda p, i: ~F.exists(F.col("spans"), lambda s: (s["pos"] <= i) & (i < s["pos"] + s["len"])))
    cleaned = F.when(F.col("n_hit") > 0, F.concat(lead, F.array_join(kept, ""))).otherwise(text)
    return found.select(F.col("_keep").withField("text", cleaned).alias("_keep")).select("_keep.*")


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_hits(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
