"""Reactions: molecules of adjacent frames that share atoms, clustered, compared, counted and ranked."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import components
from ..functions.scalars import changed, format_reaction
from ..sources.store import materialize, numbered
from . import packed
from .topology import adjacent_frames, atom_membership

PAIR = ["sim", "t1", "t2"]


def link_molecules(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sim, t1, t2, m1, m2): molecules of adjacent frames with an atom in common. members: rows, or packed molecules."""
    if packed.is_packed(members):
        return packed.link_molecules(members, pairs)
    before = pairs.join(members.select("sim", F.col("timestep").alias("t1"), "atom_id", F.col("mol_idx").alias("m1")), ["sim", "t1"])
    behind = members.select("sim", F.col("timestep").alias("t2"), "atom_id", F.col("mol_idx").alias("m2"))
    return before.join(behind, ["sim", "t2", "atom_id"]).select(*PAIR, "m1", "m2").distinct()


def open_molecules(mols: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sim, t1, t2, side, mol_idx, label, atom_ids): molecules of both frames of a pair that are not the same
    atoms under the same label in the other one. Such a molecule is a cluster by itself and no reaction, so
    leaving it out before atoms are exploded changes nothing; it is what nearly all molecules are."""
    one = pairs.join(mols.select("sim", F.col("timestep").alias("t1"), "mol_idx", "label", "atom_ids"), ["sim", "t1"]).withColumn("side", F.lit(1))
    two = pairs.join(mols.select("sim", F.col("timestep").alias("t2"), "mol_idx", "label", "atom_ids"), ["sim", "t2"]).withColumn("side", F.lit(2))
    cols = [*PAIR, "side", "mol_idx", "label", "atom_ids"]
    both = one.select(*cols).unionByName(two.select(*cols))
    alone = both.groupBy(*PAIR, "label", "atom_ids").agg(F.min("side").alias("lo"), F.max("side").alias("hi"), F.first("mol_idx").alias("any"), F.min(F.when(F.col("side") == 1, F.col("mol_idx"))).alias("m1"), F.min(F.when(F.col("side") == 2, F.col("mol_idx"))).alias("m2")).where("lo = hi")
    return alone.select(*PAIR, F.col("lo").cast("int").alias("side"), F.coalesce("m1", "m2").alias("mol_idx"), "label", "atom_ids")


def reaction_clusters(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(sim, t1, t2, side, mol_idx, cluster): connected components of linked molecules, ranked by their smallest
    reactant and then, for those without reactants, by their smallest product. nodes: (sim, t1, t2, side, mol_idx)."""
    every = nodes.select(*PAIR, "side", F.col("mol_idx").alias("m1"), F.lit(None).cast("int").alias("m2")).unionByName(links.select(*PAIR, F.lit(0).alias("side"), "m1", "m2"))

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        side, m1 = t["side"].to_numpy(), t["m1"].to_numpy()
        one, two = np.unique(m1[side == 1]), np.unique(m1[side == 2])
        a, b = m1[side == 0], t["m2"].to_numpy()[side == 0].astype(np.int64)
        label = components(len(one) + len(two), np.searchsorted(one, a), len(one) + np.searchsorted(two, b))
        rank = np.unique(label, return_inverse=True)[1].reshape(-1)
        return pd.DataFrame({"sim": key[0], "t1": key[1], "t2": key[2], "side": np.repeat([1, 2], [len(one), len(two)]), "mol_idx": np.concatenate([one, two]), "cluster": rank})

    return every.groupBy(*PAIR).applyInPandas(run, "sim int, t1 bigint, t2 bigint, side int, mol_idx int, cluster int")


def cluster_sides(mols: DataFrame, prune: bool = True, held: bool = False) -> DataFrame:
    """(sim, t1, t2, cluster, reactants, products, reactant_atom_ids, product_atom_ids): every cluster; with prune, without
    those of one molecule that is the same in both frames. cluster orders the clusters of a pair of frames. held: mols is a
    written table, and not written again."""
    mols = mols.select("sim", "timestep", "mol_idx", "label", "atom_ids")
    mols = mols if held else materialize(mols, "molecules")
    pairs = materialize(adjacent_frames(mols), "pairs")
    if prune:
        nodes = open_molecules(mols, pairs)
    else:
        cols = [*PAIR, "side", "mol_idx", "label", "atom_ids"]
        own = lambda t, s: pairs.join(mols.withColumnRenamed("timestep", t), ["sim", t]).withColumn("side", F.lit(s)).select(*cols)
        nodes = own("t1", 1).unionByName(own("t2", 2))
    nodes = materialize(nodes, "nodes")
    atom = nodes.select(*PAIR, "side", "mol_idx", F.explode("atom_ids").alias("atom_id"))
    one, two = atom.where("side = 1").drop("side").withColumnRenamed("mol_idx", "m1"), atom.where("side = 2").drop("side").withColumnRenamed("mol_idx", "m2")
    links = one.join(two, [*PAIR, "atom_id"]).select(*PAIR, "m1", "m2").distinct()
    found = reaction_clusters(nodes, links).join(nodes, [*PAIR, "side", "mol_idx"])
    side = lambda s, c: F.collect_list(F.when(F.col("side") == s, F.col(c)))
    grouped = found.groupBy(*PAIR, "cluster").agg(
        F.sort_array(side(1, "label")).alias("reactants"), F.sort_array(side(2, "label")).alias("products"),
        F.sort_array(F.array_distinct(F.flatten(side(1, "atom_ids")))).alias("reactant_atom_ids"), F.sort_array(F.array_distinct(F.flatten(side(2, "atom_ids")))).alias("product_atom_ids"),
        F.coalesce(F.min(F.when(F.col("side") == 1, F.col("mol_idx"))), F.lit(1 << 30) + F.min(F.when(F.col("side") == 2, F.col("mol_idx")))).alias("place"),
    )
    # clusters are ordered by smallest reactant, then by smallest product: `place` says the same with or without pruning
    return grouped.select(*PAIR, F.col("place").cast("int").alias("cluster"), "reactants", "products", "reactant_atom_ids", "product_atom_ids")


def reaction_events(mols: DataFrame, prune: bool = True, held: bool = False) -> DataFrame:
    """(sim, t1, t2, cluster, reaction, reactants, products, reactant_atom_ids, product_atom_ids): every cluster whose
    sides differ as sets. cluster orders the events of a pair of frames. Of packed molecules: (sim, t1, t2, cluster, reaction)."""
    if packed.is_packed(mols):
        return packed.reaction_events(mols, adjacent_frames(mols))
    events = cluster_sides(mols, prune, held).where(changed(F.col("reactants"), F.col("products")))
    return events.select(*PAIR, "cluster", format_reaction(F.col("reactants"), F.col("products")).alias("reaction"), "reactants", "products", "reactant_atom_ids", "product_atom_ids")


def every_cluster(mols: DataFrame) -> DataFrame:
    """(sim, t1, t2, cluster, reaction) of packed molecules: also the clusters that do not change."""
    return packed.reaction_events(mols, adjacent_frames(mols), every=True)


def find_reaction(events: DataFrame, reaction: str | None = None, first_only: bool = False) -> DataFrame:
    """The events of one reaction, or of all; first_only: of each simulation the earliest alone."""
    own = events if reaction is None else events.where(F.col("reaction") == reaction)
    if not first_only:
        return own
    rest = [c for c in events.columns if c not in ("sim", "t1", "cluster")]
    return own.groupBy("sim").agg(F.min_by(F.struct("t1", "cluster", *rest), F.struct("t1", "cluster")).alias("e")).select("sim", "e.*").select(*events.columns)


def count_reaction_paths(events: DataFrame) -> DataFrame:
    """(sim, reaction, n, rank): by count, then by first appearance."""
    counts = events.groupBy("sim", "reaction").agg(F.count("*").alias("n"), F.min(F.struct("t1", "cluster")).alias("first"))
    return counts.select("sim", "reaction", "n", F.row_number().over(Window.partitionBy("sim").orderBy(F.desc("n"), "first")).alias("rank"))


def rank_reactions(counts: DataFrame) -> DataFrame:
    """(reaction, total, rank) over simulations: by total, then by the first simulation that has it and its rank there.

    counts has a row per distinct reaction and simulation; they are sorted by ranges, and numbered range by range.
    """
    totals = counts.groupBy("reaction").agg(F.sum("n").alias("total"), F.min(F.struct("sim", "rank")).alias("first"))
    return numbered(totals, "rank", F.desc("total"), "first").select("reaction", "total", "rank")


def reaction_path_table(events: DataFrame, sims: list[int]) -> DataFrame:
    """(rank, reaction, sim_i..., total): a column for each simulation, also for those without reactions.

    One aggregation by reaction gives the columns and the order: by total, then by the first simulation
    that has the reaction, its count and its first event there.
    """
    counts = events.groupBy("sim", "reaction").agg(F.count("*").alias("n"), F.min(F.struct("t1", "cluster")).alias("first"))
    place = F.min(F.struct("sim", (-F.col("n")).alias("fewer"), "first")).alias("place")
    wide = counts.groupBy("reaction").agg(*(F.coalesce(F.sum(F.when(F.col("sim") == i, F.col("n"))), F.lit(0)).alias(f"sim_{i}") for i in sims), F.sum("n").alias("total"), place)
    return numbered(wide, "rank", F.desc("total"), "place").select("rank", "reaction", *(f"sim_{i}" for i in sims), "total")


def top_reactions(table: DataFrame, k: int) -> DataFrame:
    return table.orderBy("rank").limit(k)


def first_reaction_occurrence(events: DataFrame) -> DataFrame:
    """The first event of every reaction: smallest simulation, then earliest t1, then cluster order."""
    rest = [c for c in events.columns if c not in ("sim", "t1", "cluster", "reaction")]
    found = events.groupBy("reaction").agg(F.min_by(F.struct("sim", "t1", "cluster", *rest), F.struct("sim", "t1", "cluster")).alias("e"))
    return found.select("reaction", "e.*")


def simulations_with(manifest: DataFrame, topic: str) -> DataFrame:
    return manifest.where(F.col("topic") == topic).select("sim").distinct()


def simulation(manifest: DataFrame, index: int) -> DataFrame:
    """The manifest's rows of one simulation; one that it does not list is an error."""
    own = manifest.where(F.col("sim") == index)
    if own.isEmpty():
        raise LookupError(f"simulation {index} was not loaded")
    return own


__all__ = ["atom_membership", "adjacent_frames", "link_molecules", "reaction_clusters", "reaction_events", "count_reaction_paths", "rank_reactions", "reaction_path_table", "top_reactions", "first_reaction_occurrence", "find_reaction", "simulations_with", "simulation"]
