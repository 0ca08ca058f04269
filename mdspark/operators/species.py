"""Species populations. Table: species(sim, timestep, row_ord, species, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import composition_key


def species_list(species: DataFrame) -> DataFrame:
    return species.select("species").distinct()


def select_species(species: DataFrame, names: list[str], sims: list[int]) -> DataFrame:
    """Chosen species of chosen simulations with their series label; absent ones are skipped."""
    own = species.where(F.col("species").isin(*names) & F.col("sim").isin(*sims))
    return own.select("sim", "timestep", "species", "n", F.concat(F.lit("R"), F.col("sim"), F.lit(" "), "species").alias("label"))


def species_wide(species: DataFrame, names: list[str]) -> DataFrame:
    """One column per name, 0 where absent, one row per row of the file (repeated timesteps stay apart)."""
    wide = species.groupBy("sim", "timestep", "row_ord").agg(*(F.coalesce(F.sum(F.when(F.col("species") == s, F.col("n"))), F.lit(0)).alias(s) for s in names))
    return wide.drop("row_ord")


def match_compositions(names: DataFrame, formulas: DataFrame) -> DataFrame:
    """(species, formula) of names (species) and formulas (formula) that have the same atoms, however each is ordered;
    formula is null for a species that none matches. Either side may be any table; distinct texts are matched."""
    own = names.select("species").distinct().withColumn("key", composition_key(F.col("species")))
    known = formulas.select("formula").distinct().withColumn("key", composition_key(F.col("formula"))).where("key IS NOT NULL")
    return own.join(known, "key", "left").select("species", "formula")
