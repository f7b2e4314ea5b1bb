"""Shared pieces of the training-data operators: lineage cuts, dense ranks, row identities."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


#: Removes the shuffle files of a statement when it ends, not when the driver happens to collect garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all executors share.

    Only where a session on one machine (local tests) names none is a temporary one set; on a
    cluster that is an error, since each executor would write to its own disk.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lagweave-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def write_table(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet; its shuffles are freed as soon as it is written."""
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, "false")
    conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(FREE_SHUFFLES, before)


class Scratch:
    """Tables in the shared folder that cut lineage; those no longer needed are dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, stem: str = "cut") -> DataFrame:
        """Write ``df`` and read it again."""
        path = f"{shared_folder(self.spark)}/{temp_name(stem)}"
        write_table(df, path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read any more."""
        for t in tables:
            _, path = self.paths.pop(id(t))
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there."""
    return Scratch(df.sparkSession).keep(df)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Shares of all rows above which a key's rows are split, and into how many places.
SPLIT, SALTS = 4096, 64


def spread_join(rows: DataFrame, table: DataFrame, left: str, right: str, n: str, total: int, own: Column, how: str = "inner", least: int = 2000, also: Column | None = None) -> DataFrame:
    """``rows`` joined with ``table`` (a row for each ``right``, with ``n``, the number of rows of that key).

    Keys with over a SPLITth of ``total`` rows, of which there are fewer than SPLIT, are known to
    all tasks by a broadcast of that bound; their rows are dealt to SALTS places by ``own``, and
    their row of ``table`` goes to each of them, so that no task gets a whole hot key. ``also`` is a
    further condition of the join.
    """
    bound = max(least, total // SPLIT)
    heavy = table.filter(F.col(n) > bound).select(F.col(right).alias("_heavy")).distinct()
    marked = rows.join(F.broadcast(heavy), F.col(left) == F.col("_heavy"), "left")
    salted = marked.withColumn("_salt", F.when(F.col("_heavy").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(own), F.lit(SALTS)).cast("int"))).drop("_heavy")
    places = F.when(F.col(n) > bound, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = table.withColumn("_place", F.explode(places))
    met = (F.col(left) == F.col(right)) & (F.col("_salt") == F.col("_place"))
    return salted.join(dealt, met if also is None else met & also, how).drop("_salt", "_place")


#: Bits of a bitmap (Spark's bitmap functions), bits for each id, and the most bitmaps that are broadcast.
BITMAP, SPARSE, MOST_BITMAPS = 1 << 15, 16, 2048


def among(rows: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose long ``key`` is one of ``ids`` (a column, without nulls or repeats), and the others.

    A join would shuffle whole rows, texts and all. Bitmaps of hashed ids (2 bytes an id), known to
    all tasks, first tell which rows may be meant, about a 16th of the others among them; these
    alone are joined, and the rest stays where it is.
    """
    count = ids.count()
    bitmaps = min(MOST_BITMAPS, max(1, -(-count * SPARSE // BITMAP)))

    def place(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(bitmaps * BITMAP))

    name = ids.columns[0]
    at = ids.select(F.floor(place(name) / BITMAP).alias("_map"), F.pmod(place(name), F.lit(BITMAP)).alias("_bit"))
    maps = at.groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    own = F.pmod(place(key), F.lit(BITMAP))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(own / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(maps), F.floor(place(key) / BITMAP) == F.col("_map"), "left")
    hit = F.coalesce(F.getbit(byte, F.pmod(own, F.lit(8)).cast("int")) == 1, F.lit(False))
    marked = met.select(*rows.columns, hit.alias("_hit"))
    may, rest = marked.filter("_hit").drop("_hit"), marked.filter("NOT _hit").drop("_hit")
    listed = ids.select(F.col(name).alias("_id"))
    met_ids = F.col(key) == F.col("_id")
    return may.join(listed, met_ids, "left_semi"), rest.unionByName(may.join(listed, met_ids, "left_anti"))


def temp_name(stem: str) -> str:
    return f"{stem}_{uuid.uuid4().hex}"


def dense_index(df: DataFrame, key: str | None, order: Column, ties: list[Column], out: str, bits: int = 10) -> DataFrame:
    """Number the rows of each ``key`` 0, 1, 2, ... in ascending ``order`` (a uniform hash, long).

    A window over ``key`` alone would put a hot key into one task. Here the leading ``bits`` of
    the unsigned order deal each key into 2**bits cells, cells are counted with map-side sums,
    a running sum over the small table of counts gives each cell its first number, and only
    cells are sorted. Rows that tie in ``order`` and ``ties`` are numbered in any order.
    """
    keyed = df.withColumn("_cell", F.shiftrightunsigned(order, 64 - bits).cast("int"))
    keyed = keyed.withColumn("_key", F.col(key) if key else F.lit(0))
    counts = keyed.groupBy("_key", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_key").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("_key").alias("_skey"),
        F.col("_cell").alias("_scell"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    inner = Window.partitionBy("_key", "_cell").orderBy(order, *ties)
    joined = keyed.join(starts, (F.col("_key") == F.col("_skey")) & (F.col("_cell") == F.col("_scell")))
    numbered = joined.withColumn(out, F.col("_start") + F.row_number().over(inner) - 1)
    return numbered.drop("_key", "_cell", "_skey", "_scell", "_start")


def with_row_ids(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and ``_rid``, a unique long that ascends with doc_id.

    Where doc_id is a whole number, unique and never null it is the id itself. Otherwise (strings,
    fractions, nulls, equal ids) rows are ordered by doc_id (nulls last) and text, and numbered in
    that order; repeated rows become documents of their own.
    """
    if isinstance(docs.schema["doc_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        found = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids")).first()
        if found["n"] == found["ids"] and docs.select("doc_id").distinct().count() == found["n"]:
            return docs.select(*columns, F.col("doc_id").cast("long").alias("_rid"))
    ordered = docs.select(*columns).orderBy(F.col("doc_id").asc_nulls_last(), "text")
    shared_folder(docs.sparkSession)
    return ordered.withColumn("_rid", F.monotonically_increasing_id()).checkpoint()
