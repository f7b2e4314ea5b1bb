"""Mixing sources to target weights by Pfair scheduling (DataFrame operations only).

Each source's documents, in the order of a hash, are cut into blocks of ``block_rows``. One block
is sent per time slot. Block k of a source with weight w (a fraction of all weights, exactly) is
released at floor(k / w) and due by ceil((k + 1) / w); the earliest deadline goes first, so that
after every slot each source is less than one block from its target. The table of blocks is
scheduled on the driver, and rows find their block's place by a join. When a source runs out, the
weights of the others are scaled up and a new phase begins; no document is dropped or repeated.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dense_index, documents

#: Up to so many blocks their table is broadcast; a longer one is joined by its keys.
BROADCAST_BLOCKS = 1 << 20


def exact_shares(weights: Mapping[str, float], least: int) -> dict[str, int]:
    """Whole numbers in exactly the proportion of the weights, each ``least`` or more."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    shares = {s: int(x * scale) for s, x in exact.items()}
    common = math.gcd(*shares.values())
    times = -(-least * common // min(shares.values()))
    return {s: n // common * times for s, n in shares.items()}


def edf_phase(shares: Mapping[str, int], left: Mapping[str, int]) -> dict[str, list[int]]:
    """The slots of each source until one has sent all its blocks, earliest deadline first among released ones."""
    total = sum(shares.values())
    waiting = [(0, s, 0) for s in sorted(shares)]
    ready: list[tuple[int, str, int]] = []
    out: dict[str, list[int]] = {s: [] for s in shares}
    now = 0
    while True:
        while waiting and waiting[0][0] <= now:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // shares[s]), s, k))
        _, s, k = heapq.heappop(ready)
        out[s].append(now)
        if k + 1 == left[s]:
            return out
        heapq.heappush(waiting, ((k + 1) * total // shares[s], s, k + 1))
        now += 1


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float], slots: int = 0) -> dict[str, list[dict]]:
    """For each source its phases: first block, base slot, share, period, slots of its blocks in the phase.

    share / period is the exact target. Sources of weight 0 follow when the others are sent.
    ``slots``, once the length of a period, has no effect: targets are not rounded to slots.
    """
    left, done, base = dict(blocks), dict.fromkeys(blocks, 0), 0
    plan: dict[str, list[dict]] = {s: [] for s in blocks}
    while left:
        live = {s: weights[s] for s in left if weights[s] > 0} or dict.fromkeys(left, 1)
        shares = exact_shares(live, max(left[s] for s in live))
        period, places = sum(shares.values()), edf_phase(shares, left)
        for s, taken in places.items():
            plan[s].append({"first": done[s], "base": base, "share": shares[s], "period": period, "places": taken})
            done[s] += len(taken)
            left[s] -= len(taken)
            if not left[s]:
                del left[s]
        base += sum(map(len, places.values()))
    return plan


def block_table(plan: Mapping[str, list[dict]], rows: Mapping[str, int], block_rows: int) -> pa.Table:
    """_s, _b (source, block), phase, slot, release, deadline and _start, the position of the block's first row."""
    out: dict[str, list] = {c: [] for c in ("_s", "_b", "phase", "slot", "release", "deadline")}
    for s, phases in plan.items():
        for n, p in enumerate(phases):
            share, period, base = p["share"], p["period"], p["base"]
            for k, place in enumerate(p["places"]):
                out["slot"].append(base + place)
                out["release"].append(base + k * period // share)
                out["deadline"].append(base - (-(k + 1) * period // share))
            out["_s"].extend([s] * len(p["places"]))
            out["_b"].extend(range(p["first"], p["first"] + len(p["places"])))
            out["phase"].extend([n] * len(p["places"]))
    start = [0] * (len(out["slot"]) + 1)
    for s, b, slot in zip(out["_s"], out["_b"], out["slot"], strict=True):
        start[slot + 1] = min(block_rows, rows[s] - b * block_rows)
    for slot in range(len(out["slot"])):
        start[slot + 1] += start[slot]
    out["_start"] = [start[slot] for slot in out["slot"]]
    return pa.table({c: pa.array(v, pa.string() if c == "_s" else pa.int64()) for c, v in out.items()})


def source_key(source: str = "source") -> Column:
    """The source as a string that is never null: a mark, and the value where there is one."""
    return F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))


ADDED = ["block", "phase", "slot", "release", "deadline", "position"]


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5, block_rows: int = 32, slots: int = 1000, source: str = "source", key: str = "doc_id") -> DataFrame:
    """``docs`` and block, phase, slot, release, deadline, position (all long, from 0).

    Columns of ``docs`` that have one of these names are replaced; ``in_mixed_order`` keeps them.

    ``weights`` gives target weights by source; without it they are the sources' row counts to the
    power ``temperature``; a source that ``weights`` lacks takes the smallest weight given. Rows
    with a null source are a source of their own. The table of sources (not of rows) is read by the
    driver, which schedules the table of blocks. ``slots`` has no effect. Repeated rows, and null or
    equal keys, keep a place each. An empty table gives an empty result.
    """
    kept = [F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c not in ADDED]
    return _placed(docs, weights, temperature, block_rows, slots, source, key).select(*kept, *ADDED)


def _placed(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5, block_rows: int = 32, slots: int = 1000, source: str = "source", key: str = "doc_id") -> DataFrame:
    """_doc, a struct of all columns, and where the row is placed."""
    every = [F.col(f"`{c}`").alias(c) for c in docs.columns]
    keyed = docs.select(F.struct(*every).alias("_doc"), F.col(key).alias("_key_col"), source_key(source).alias("_source"))
    counts = {r["_source"]: r["n"] for r in keyed.groupBy("_source").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = min(weights.values()) if weights else 0
    target = {s: (weights.get(s[1:], least) if weights else n**temperature) for s, n in counts.items()}
    plan = schedule({s: -(-n // block_rows) for s, n in counts.items()}, target, slots)
    places = block_table(plan, counts, block_rows)
    table = docs.sparkSession.createDataFrame(places)
    if places.num_rows <= BROADCAST_BLOCKS:
        table = F.broadcast(table)

    index = dense_index(keyed, "_source", F.xxhash64(F.lit("mix"), F.col("_key_col")), [F.col("_key_col")], "_index")
    placed = index.withColumn("block", F.floor(F.col("_index") / block_rows))
    placed = placed.join(table, (F.col("_source") == F.col("_s")) & (F.col("block") == F.col("_b")))
    return placed.withColumn("position", F.col("_start") + F.pmod("_index", F.lit(block_rows)))


def in_mixed_order(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with their columns, all as they are, stored in the order of their positions."""
    placed = _placed(docs, **how)
    return placed.repartitionByRange("position").sortWithinPartitions("position").select("_doc.*")


def op4_pfair_mix(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source")
    return mix_sources(docs).select("doc_id", "source", "block", "phase", "slot", "release", "deadline", "position")
