"""Cross-products of a stream: the same one-pass aggregate, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.gram import gram


def start_gram(stream: DataFrame, columns: list[str], name: str, checkpoint: str):
    """A running query whose memory table ``name`` holds (row_var, col_var, value) so far.

    The state is one row of sums, however long the stream is.
    """
    return gram(stream, columns).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
