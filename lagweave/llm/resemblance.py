"""Near-duplicates by resemblance: texts that share 80% of their five-word shingles are linked.

Pairs meet by SimHash. The fingerprint of a set of distinct shingles is as long as the table needs:
its bits are cut into two-bit segments, each segment is mapped to its bit count, and a grid cell is
the counts of a few segments of its own. Bits differ independently of each other, at a similarity
of 0.8 with a known chance, so the number of cells is set such that a pair at 0.8 shares none with a
chance of 3 in a million, and closer pairs more rarely still. Within a cell the Manhattan distance
of the counts of the first 256 bits is computed first, and then the Hamming distance of the pairs
that it leaves. A cell yields a spanning forest of its links; a cell above ``max_cell`` rows is
dealt into pairs of blocks, which together compare all.

Components of these links are islands. No text is linked with one of another island, and what an
island holds is decided on whole shingle sets: all pairs of small islands are compared. In a large
one all rows are first compared with one; if this leaves some apart, the island is dealt into pairs
of blocks, which are compared completely. Texts with equal shingle sets are one node.
"""

from __future__ import annotations

from itertools import repeat
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import among, cut, spread_join, with_row_ids
from .simhash import SEED, components, count_codes

SHINGLE = 5
#: The chance that a pair at similarity 0.8 shares no cell.
MISS = 3e-6
#: At most this share of bits differs at 0.8, counted over sizes; sets of up to FEW shingles differ in more.
DIFFER, FEW, DIFFER_FEW = 0.1612, 5, 0.1875
#: The bits that distances are taken of: PRINT words of 64. MOST and MOST_FEW are 4.9 and 5.1 deviations above the mean.
PRINT, MOST, MOST_FEW = ("w0", "w1", "w2", "w3"), 70, 80
#: Rows that a row meets in a cell by chance, at least; and how many tables of cells are shuffled at once.
MEET, ROUND = 1000, 64
CHUNK, TILE = 255, 64
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the lower-cased (A-Z) words' shingles, in order; shorter texts are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    n = len(words) - k + 1
    spans = zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, (joined[a:b] for a, b in spans), repeat(SEED)), np.uint64, n))


def alike(shared, total):
    """Whether ``shared`` of ``total`` shingles (of both sets together) are a similarity of 0.8 or more."""
    return 9 * shared >= 4 * total


def segments(rows: int) -> int:
    """Segments in a cell: as many as leave MEET rows or more in common by chance (3 in 8 counts agree)."""
    return min(12, max(1, int(log(max(rows, 1) / MEET) / log(8 / 3))))


def tables(m: int, differ: float = DIFFER) -> int:
    """Cells of ``m`` segments that a pair needs in order to share none with a chance of MISS."""
    agree = (1 - differ) ** 2 + differ**2 / 2
    return ceil(log(MISS) / log1p(-(agree**m)))


def print_bits(found: np.ndarray, words: int) -> np.ndarray:
    """The SimHash of a shingle set: 64 bits for each word, from numbers mixed out of the hashes (splitmix64)."""
    counts = np.zeros(64 * words, np.int64)
    offsets = STEP * np.arange(1, words + 1, dtype=np.uint64)
    for at in range(0, len(found), CHUNK):
        x = found[at : at + CHUNK, None] + offsets
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return counts * 2 > len(found)


def sketch(found: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The first words of the fingerprint, and the numbers of its cells."""
    many = tables(m, DIFFER_FEW if len(found) <= FEW else DIFFER)
    bits = print_bits(found, max(len(PRINT), -(-2 * m * many // 64)))
    counts = bits[: 2 * m * many].reshape(many, m, 2).sum(2, dtype=np.int32)
    cells = counts @ (3 ** np.arange(m, dtype=np.int32)) + np.arange(many, dtype=np.int32) * 3**m
    return np.packbits(bits[: 64 * len(PRINT)]).view(np.int64), cells


def sketches(docs: DataFrame, id_col: str, text: str, m: int) -> DataFrame:
    """``id_col``, digest of the shingle set, n (its size), cells and the words of PRINT, a row for each row."""

    def run(batches):
        for b in batches:
            digest, n, cells, words = [], [], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
            for t in b.column(1):
                found = shingles(t.as_py())
                digest.append(xxhash.xxh3_128_digest(found.tobytes()))
                n.append(len(found))
                first, own = sketch(found, m)
                cells.append(own)
                words.append(first)
            ends = np.cumsum([*map(len, cells)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cells)))
            columns = np.concatenate(words).reshape(-1, len(PRINT)).T
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), lists, *[pa.array(np.ascontiguousarray(c)) for c in columns]], names=[id_col, "digest", "n", "cells", *PRINT])

    schema = T.StructType([docs.schema[id_col], T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("cells", T.ArrayType(T.IntegerType())), *[T.StructField(w, T.LongType()) for w in PRINT]])
    return docs.select(id_col, text).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """node (``id_col``) and found: the shingle set of each row."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [shingles(t.as_py()).view(np.int64) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *found])))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["node", "found"])

    return docs.select(id_col, text).mapInArrow(run, "node long, found array<long>")


def spanning(x: np.ndarray, y: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the pairs (x, y) that join groups of rows, without a circle, and the groups they leave."""
    a, b = [x[:0]], [y[:0]]
    while True:
        apart = group[x] != group[y]
        x, y = x[apart], y[apart]
        if not len(x):
            return np.concatenate(a), np.concatenate(b), group
        high, first = np.unique(np.maximum(group[x], group[y]), return_index=True)
        a.append(x[first])
        b.append(y[first])
        parent = np.arange(len(group))
        parent[high] = np.minimum(group[x], group[y])[first]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        group = parent[group]


def cell_links(sizes: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of a spanning forest of the links within one cell, whose rows ascend by size: the
    Manhattan bound first, then Hamming distances and sizes of what it leaves."""
    codes = [count_codes(w) for w in words]
    group = np.arange(len(sizes))
    a, b = [group[:0]], [group[:0]]
    for at in range(0, len(sizes), TILE):
        end = min(at + TILE, len(sizes))
        stop = int(np.searchsorted(4 * sizes, 5 * sizes[end - 1], "right"))
        # Eight bits suffice: of all distances up to 256 only 256 itself becomes 0, and is put right below.
        bound = np.bitwise_count(codes[0][at:end, None] ^ codes[0][at:stop])
        for c in codes[1:]:
            bound += np.bitwise_count(c[at:end, None] ^ c[at:stop])
        x, y = (v + at for v in np.nonzero(bound <= (MOST_FEW if sizes[at] <= FEW else MOST)))
        left = (x < y) & (group[x] != group[y])
        x, y = x[left], y[left]
        apart = sum(np.bitwise_count(w[x] ^ w[y]).astype(np.int64) for w in words)
        near = (apart <= np.where(sizes[y] <= FEW, MOST_FEW, MOST)) & alike(sizes[x], sizes[x] + sizes[y])
        x, y, group = spanning(x[near], y[near], group)
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def block_links(nodes: np.ndarray, labels: np.ndarray, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of different labels, enough to connect all that is alike within the block."""
    if len(set(labels.tolist())) < 2:
        return nodes[:0], nodes[:0]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.cumsum(sizes) - sizes
    codes = np.unique(np.concatenate(found), return_inverse=True)[1]
    group = np.unique(labels, return_inverse=True)[1]
    flag = np.zeros(len(codes) + 1, np.int64)
    a, b = [], []
    for i in range(len(nodes) - 1):
        if (group == group[i]).all():
            break
        own = codes[starts[i] : starts[i] + sizes[i]]
        flag[own] = 1
        shared = np.add.reduceat(flag[codes], starts)
        flag[own] = 0
        near = alike(shared, sizes + sizes[i]) & (group != group[i])
        for g in np.unique(group[near]):
            j = int(np.flatnonzero(near & (group == g))[0])
            a.append(i)
            b.append(j)
            group[group == g] = group[i]
    return nodes[np.array(a, np.int64)], nodes[np.array(b, np.int64)]


def by_cell(batches):
    """Whole cells of batches that are sorted by their first column: tables of rows."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        keys = table.column(0).to_numpy()
        whole = int(np.searchsorted(keys, keys[-1]))
        held = table.slice(whole)
        if whole:
            yield table.slice(0, whole)
    if held is not None and held.num_rows:
        yield held


def pair_batch(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with label: the smallest node that links lead to."""
    found = components(links)
    return nodes.join(found, F.col("node") == F.col("u"), "left").withColumn("label", F.coalesce("label", "node")).drop("u")


def places(blocks: Column) -> Column:
    """The cells of pairs of blocks that a row of a cell goes to."""
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.xxhash64("cell", F.least(own, j), F.greatest(own, j)))


def cells_of(batches):
    """Each cell of batches that are sorted by their first column: a table of its rows."""
    for t in by_cell(batches):
        keys = t.column(0).to_numpy()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for at, end in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
            yield t.slice(at, end - at)


def links(nodes: DataFrame, m: int, max_cell: int = 1 << 14) -> DataFrame:
    """Distinct links (a, b) of ``nodes`` (node, n, cells, PRINT) that connect whatever shares a cell and is near.

    The rows of a cell are in one order everywhere, so that cells choose the same few first rows.
    Tables of cells are shuffled in rounds, so that the disk they take doesn't grow with their number.
    """
    rounds = ceil(tables(m) / ROUND)
    columns = ["node", "n", *PRINT]

    def run(batches):
        for t in cells_of(batches):
            if t.num_rows > 1:
                node, n, *words = (t.column(c).to_numpy() for c in range(1, t.num_columns))
                x, y = cell_links(n, [w.view(np.uint64) for w in words])
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], names=["a", "b"])

    found = []
    for r in range(rounds):
        own = F.filter("cells", lambda c: F.pmod(F.floor(c / 3**m), F.lit(rounds)) == r) if rounds > 1 else F.col("cells")
        keyed = nodes.filter("n > 0").select(F.explode(own).alias("cell"), *columns).withColumn("cell", F.col("cell").cast("long"))
        hot = cut(keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") > max_cell).withColumnRenamed("cell", "_c"))
        if not hot.isEmpty():
            marked = keyed.join(hot, F.col("cell") == F.col("_c"), "left")
            spread = places(F.ceil(F.col("_m") / (max_cell // 2)).cast("int"))
            keyed = marked.select(F.explode(F.when(F.col("_m").isNull(), F.array("cell")).otherwise(spread)).alias("cell"), *columns)
        dealt = keyed.repartition("cell").sortWithinPartitions("cell", "n", "node")
        found.append(cut(dealt.mapInArrow(run, "a long, b long").distinct()))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    # A group of near copies has another first row in each cell; each row keeps one link, to the least of its first rows.
    firsts = out.groupBy("b").agg(F.collect_set("a").alias("_all"))
    least = F.array_min("_all")
    kept = F.transform("_all", lambda x: F.struct(least.alias("a"), F.when(x == least, F.col("b")).otherwise(x).alias("b")))
    return firsts.select(F.inline(kept)).distinct()


def linked(rows: DataFrame, nodes: DataFrame, id_col: str, text: str, m: int, small: int, block: int) -> DataFrame:
    """node and label for every row of ``nodes``: the smallest node reached by links of similarity 0.8 or more."""
    islands = cut(components(links(nodes, m)).select(F.col("u").alias("node"), F.col("label").alias("cell")))
    many = islands.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).withColumnRenamed("cell", "_c")
    members = cut(islands.join(many, F.col("cell") == F.col("_c")).drop("_c"))
    sets = cut(shingle_sets(among(rows, id_col, members.select("node"))[0], id_col, text))

    def with_sets(table: DataFrame) -> DataFrame:
        return table.join(sets.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).drop("_n")

    large = with_sets(members.filter(F.col("m") > small))
    leads = large.filter("node = cell").select(F.col("cell").alias("_lead"), F.col("found").alias("_found"), F.col("m").alias("_m"))
    met = spread_join(large.filter("node <> cell"), leads, "cell", "_lead", "_m", members.count(), F.col("node"))
    alone = alike(F.size(F.array_intersect("found", "_found")), F.size("found") + F.size("_found"))
    star = cut(met.filter(alone).select(F.col("cell").alias("a"), F.col("node").alias("b")))
    named = members.join(star, F.col("node") == F.col("b"), "left").withColumn("label", F.coalesce("a", "node")).drop("a", "b")
    named = cut(named)
    apart = named.groupBy("cell").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low <> _high").select(F.col("cell").alias("_c"))
    wide = named.join(apart, F.col("cell") == F.col("_c"), "left_semi")
    spread = with_sets(wide.select(F.explode(places(F.ceil(F.col("m") / block).cast("int"))).alias("cell"), "node", "label"))

    def rest(batches):
        for t in cells_of(batches):
            found = [v.values.to_numpy(zero_copy_only=False) for v in t.column("found").combine_chunks()]
            yield pair_batch(*block_links(t.column("node").to_numpy(), t.column("label").to_numpy(), found))

    more = spread.select("cell", "node", "label", "found").repartition("cell").sortWithinPartitions("cell").mapInArrow(rest, "a long, b long").distinct()
    return cut(labelled(nodes.select("node"), cut(star.union(more))))


def deduplicate(docs: DataFrame, text: str = "text", small: int = 16, block: int = 512) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the smallest doc_id.

    Two texts are linked when their sets of five-word shingles have a Jaccard similarity of 0.8 or
    more; groups are the components of these links. Null, empty and blank texts have no shingles
    and are one group. Repeated rows are linked. An empty table gives an empty result.
    """
    rows = with_row_ids(docs, docs.columns)
    m = segments(docs.count())
    prints = cut(sketches(rows, "_rid", text, m))
    nodes = cut(prints.groupBy("digest").agg(F.min("_rid").alias("node"), *[F.first(c).alias(c) for c in ("n", "cells", *PRINT)]))
    first = linked(rows, nodes, "_rid", text, m, small, block).filter(F.col("node") == F.col("label"))
    copies = cut(prints.select("_rid").join(first.select(F.col("node").alias("_rid")), "_rid", "left_anti"))
    return among(rows, "_rid", copies)[1].select(*docs.columns)
