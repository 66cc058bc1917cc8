"""An extension: a stream of merge events folded into parents, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.operators.components import connected_components
from rillgraph.runtime import Scratch


def fold(parent: DataFrame | None, merges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) after the links of ``merges`` (n1, n2) are added to those that ``parent`` stands for."""
    links = merges.select(F.col("n1").alias("src"), F.col("n2").alias("dst"))
    if parent is not None:
        links = links.unionByName(parent.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    return scratch.keep(connected_components(links, "src", "dst", scratch))


def follow(merges: DataFrame, path: str, checkpoint: str):
    """Start a query that writes the parents after each batch to ``path``/batch=<number>. A batch that is run again writes the same."""
    state: dict = {"parent": None}

    def put(batch: DataFrame, number: int) -> None:
        if number and state["parent"] is None:
            state["parent"] = batch.sparkSession.read.parquet(f"{path}/batch={number - 1}")
        done = fold(state["parent"], batch, Scratch(batch.sparkSession))
        done.write.mode("overwrite").parquet(f"{path}/batch={number}")
        state["parent"] = batch.sparkSession.read.parquet(f"{path}/batch={number}")

    return merges.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()
