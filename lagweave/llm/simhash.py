"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint of 64 bits is cut into 32 segments of two bits, and each segment is mapped to its
bit count (0, 1 or 2). The Manhattan distance of two such vectors never exceeds the Hamming
distance of the fingerprints, so pairs within 4 bits are within distance 4 on the grid of counts.
Cut into 7 groups of segments, such vectors agree in 3 groups at least: the grid cells are the
35 choices of 3 groups with their counts. Within a cell, the Manhattan distance of the counts is
computed first, and only pairs that it leaves are verified exactly.

Only distinct fingerprints enter cells. A cell yields a spanning forest of its links, not all its
pairs; a cell above ``max_cell`` rows is dealt into pairs of blocks, which together compare all.
Components are then found by joins: nodes point to their smallest neighbours, and links between the
ends of these pointers are what the next round reads.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, documents, let, spread_join, with_row_ids

BITS, SEED = 64, 42
#: Two-bit segments in each group; 32 in all.
GROUPS = (5, 5, 5, 5, 4, 4, 4)
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The SimHash of the lower-cased (A-Z) words' shingles, unsigned; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    n = len(words) - k + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, (joined[a:b] for a, b in spans), repeat(SEED)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].astype(">u8").view(np.uint8)).reshape(-1, BITS)
        whole = len(bits) // 128 * 128
        counts += bits[:whole].reshape(-1, 128, BITS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        counts += bits[whole:].sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text: str = "text", shingle: int = 4) -> DataFrame:
    """``id_col`` and fp (the fingerprint as a signed long), a row for each row."""

    def run(batches):
        for b in batches:
            found = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    schema = T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType())])
    return docs.select(id_col, text).mapInArrow(run, schema)


def group_codes(fp: Column) -> list[Column]:
    """The counts of each group's segments, as one number for each of the 7 groups."""
    codes, bit = [], 0
    for size in GROUPS:
        code = F.lit(0)
        for _ in range(size):
            code = code * 3 + F.bit_count(F.shiftrightunsigned(fp, bit).bitwiseAND(F.lit(3)))
            bit += 2
        codes.append(code.cast("long"))
    return codes


def cells(nodes: DataFrame) -> DataFrame:
    """fp and cell: the 35 grid cells of each fingerprint, one for every choice of 3 groups."""
    coded = nodes.select("fp", F.array(*group_codes(F.col("fp"))).alias("codes"))
    choices = F.array(*[F.struct(F.lit(n).cast("long").alias("n"), *[F.lit(g).alias(x) for g, x in zip(c, "abc", strict=True)]) for n, c in enumerate(combinations(range(len(GROUPS)), 3))])
    return coded.select("fp", F.explode(let(F.col("codes"), lambda codes: F.transform(choices, lambda c: ((c["n"] * 256 + codes[c["a"]]) * 256 + codes[c["b"]]) * 256 + codes[c["c"]]))).alias("cell"))


ODD = np.uint64(0x5555555555555555)


def count_codes(fps: np.ndarray) -> np.ndarray:
    """The segments' bit counts in unary (0: 00, 1: 01, 2: 11), so that the Manhattan distance of two
    count vectors is the number of bits in which their codes differ."""
    high = fps >> np.uint64(1)
    return ((fps | high) & ODD) | ((fps & high & ODD) << np.uint64(1))


def near(a: np.ndarray, b: np.ndarray, code_a: np.ndarray, code_b: np.ndarray, most: int) -> np.ndarray:
    """Where fingerprints differ in ``most`` bits at most: the Manhattan bound first, then those it leaves exactly."""
    out = np.bitwise_count(code_a ^ code_b) <= most
    left = np.nonzero(out)
    a, b = np.broadcast_arrays(a, b)
    out[left] = np.bitwise_count(a[left] ^ b[left]) <= most
    return out


def forest(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected within ``points`` (distinct) at up to ``most`` bits."""
    left, a, b = points, [], []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            linked = near(front[:64, None], left[None], count_codes(front[:64, None]), count_codes(left)[None], most)
            hit = linked.any(0)
            a.append(front[:64][linked.argmax(0)[hit]])
            b.append(left[hit])
            front, left = np.concatenate([front[64:], left[hit]]), left[~hit]
    none = np.empty(0, points.dtype)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def cell_links(keys: np.ndarray, fps: np.ndarray, most: int, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Links within the cells of rows sorted by key: small cells all at once, larger ones by forests."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[first, len(keys)])
    a, b = [], []
    codes = count_codes(fps)
    ends = np.repeat(first + sizes, sizes)
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= small), sizes))
    for step in range(1, small):
        at = at[at + step < ends[at]]
        if not len(at):
            break
        hit = at[near(fps[at], fps[at + step], codes[at], codes[at + step], most)]
        a.append(fps[hit])
        b.append(fps[hit + step])
    for k in np.flatnonzero(sizes > small):
        x, y = forest(np.unique(fps[first[k] : first[k] + sizes[k]]), most)
        a.append(x)
        b.append(y)
    none = np.empty(0, fps.dtype)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(nodes: DataFrame, most: int = 4, max_cell: int = 4096) -> DataFrame:
    """Distinct links (a, b), a < b, that connect the fp of ``nodes`` within ``most`` bits."""
    keyed = cells(nodes)
    hot = cut(keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_cell))
    if hot.count():
        marked = keyed.join(hot.withColumnRenamed("cell", "_c"), F.col("cell") == F.col("_c"), "left")
        blocks = F.ceil(F.col("n") / (max_cell // 2)).cast("int")
        own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.xxhash64("cell", F.least(own, j), F.greatest(own, j)))
        keyed = marked.select("fp", F.explode(F.when(F.col("n").isNull(), F.array("cell")).otherwise(pairs)).alias("cell"))

    def run(batches):
        held_k, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            k = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            whole = int(np.searchsorted(k, k[-1])) if len(k) else 0
            held_k, held_f = k[whole:], f[whole:]
            if whole:
                yield out(k[:whole], f[:whole])
        if len(held_k):
            yield out(held_k, held_f)

    def out(k, f):
        x, y = (v.view(np.int64) for v in cell_links(k, f, most))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    dealt = keyed.select("cell", "fp").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, label): for every node of the links (a, b) the smallest node it is connected to.

    In each round every node points to its smallest neighbour, if that is smaller; pointers are
    followed to their ends, and links go on between these ends alone. What a group has met in one
    round is a single node in the next, so that rounds don't read all links again and again.
    """
    live, labels = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), None
    while labels is None or not live.isEmpty():
        both = live.select("a", "b").union(live.select("b", "a")).toDF("u", "v")
        ends, done = cut(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))), False
        while not done:
            new = cut(ends.join(ends.toDF("low", "next"), "low").select("u", "low", "next"))
            done = new.filter("next <> low").isEmpty()
            ends = new.select("u", F.col("next").alias("low"))
        moved = live.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").filter("x <> y")
        live = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if labels is None:
            labels = ends.toDF("u", "label")
        else:
            labels = cut(labels.join(ends.toDF("label", "low"), "label", "left").select("u", F.coalesce("low", "label").alias("label")))
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, most: int = 4) -> DataFrame:
    """``id_col``, fingerprint (16 hex digits), component_id (smallest id reachable): a row per row.

    Null, empty and blank texts have fingerprint 0 and are linked like others. Repeated rows are
    linked by their equal fingerprints; null ids are never the smallest unless a component has no
    other, when component_id is null. An empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, id_col, text, shingle))
    nodes = cut(prints.groupBy("fp").agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n")))
    labels = components(links(nodes, most))
    rooted = cut(nodes.join(labels, nodes["fp"] == labels["u"], "left").select("fp", "first_id", "n", F.coalesce("label", "fp").alias("root")))
    size = rooted.agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("rows")).first()
    ids = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("_m"))
    names = spread_join(rooted, ids, "root", "_root", "_m", size["nodes"], F.col("fp")).select(F.col("fp").alias("_fp"), "component_id", "n")
    joined = spread_join(prints, names, "fp", "_fp", "n", size["rows"] or 0, F.col(id_col))
    return joined.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the smallest doc_id."""
    rows = with_row_ids(docs, docs.columns)
    first = near_duplicates(rows.select("_rid", text), "_rid", text).filter(F.col("_rid") == F.col("component_id"))
    return rows.join(first.select("_rid"), "_rid", "left_semi").select(*docs.columns)


def op5_simhash_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
