"""Writers of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_reaction_paths(table: DataFrame, path: str, sims: list[int], metadata: dict[str, str] | None = None) -> None:
    """Ranked reaction table (rank, reaction, sim_i..., total) as one CSV in rank order, with a side file of metadata.

    The table has a row per distinct reaction, so that one ordered file is its natural form.
    """
    named = table.orderBy("rank").select(F.col("reaction").alias("Reaction"), *(F.coalesce(F.col(f"sim_{i}"), F.lit(0)).alias(f"Simulation {i}") for i in sims), F.col("total").alias("Sum"))
    named.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/paths")
    if metadata is not None:
        rows = [*metadata.items(), ("simulation_ids", ";".join(map(str, sims)))]
        table.sparkSession.createDataFrame(rows, "Metadata string, Value string").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/metadata")


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet, partitioned by simulation and clustered by timestep within files."""
    for name, df in tables.items():
        own = df.sortWithinPartitions(*[c for c in ("timestep", "step", "frame_ord") if c in df.columns])
        writer = own.write.mode("overwrite")
        (writer.partitionBy("sim") if "sim" in df.columns else writer).parquet(f"{path}/{name}")
