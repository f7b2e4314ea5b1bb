"""Running cross-products of a stream end where those of the whole table are."""

import numpy as np

from lagweave.operators.gram import Gram
from lagweave.streaming import gram as running


def test_a_stream_of_files_ends_at_the_table(spark, tmp_path):
    rng = np.random.default_rng(0)
    schema = "a double, b double"
    for k in range(3):
        spark.createDataFrame([tuple(map(float, r)) for r in rng.standard_normal((50, 2))], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = running.start_gram(stream, ["a", "b"], "grams", str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    got = {(r["row_var"], r["col_var"]): r["value"] for r in spark.table("grams").collect()}
    whole = Gram.of(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), ["a", "b"])
    for x in ("a", "b"):
        for y in ("a", "b"):
            assert np.isclose(got[x, y], whole.get([x], [y])[0, 0])
