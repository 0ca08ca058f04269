"""Molecules: connected components of each frame's bonds, their formulas and labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import components
from ..functions.scalars import bond_type, hill
from ..functions.smiles import write_smiles
from ..sources.store import materialize, numbered
from . import packed

FRAME = ["sim", "timestep"]


def dedupe_frames(frames: DataFrame, last: bool = True) -> DataFrame:
    """Of frames that repeat a timestep, the last in file order (or the first)."""
    pick = F.max if last else F.min
    keep = frames.groupBy(*FRAME).agg(pick("frame_ord").alias("frame_ord"))
    return frames.join(keep, [*FRAME, "frame_ord"], "left_semi")


def molecule_components(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(sim, timestep, atom_id, component, mol_idx): component is the smallest atom id, mol_idx its rank in the frame.

    Atoms without bonds are components of one. A frame is one group, and frames are even in size; one
    frame's atoms and bonds must fit a task as arrays (iterative_components is for those that do not). Either may be packed.
    """
    return packed.members(atoms, bonds)


def local_stars(edges: DataFrame, block: int) -> DataFrame:
    """(sim, timestep, child, parent): a spanning forest of each block of edges (i, j), as stars around smallest atoms.

    Blocks are ranges of the lower atom; those of more than `block` edges are cut further by the upper one.
    """
    key = [*FRAME, "range"]
    ranged = edges.withColumn("range", F.floor(F.least("i", "j") / block))
    sizes = ranged.groupBy(*key).agg(F.ceil(F.count("*") / block).alias("parts")).where("parts > 1")
    own = ranged.join(sizes, key, "left").withColumn("part", F.pmod(F.xxhash64("j"), F.coalesce("parts", F.lit(1))))

    def run(keys: tuple, t: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(t[["i", "j"]].to_numpy())
        root = components(len(ids), np.searchsorted(ids, t["i"].to_numpy()), np.searchsorted(ids, t["j"].to_numpy()))
        at = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"sim": keys[0], "timestep": keys[1], "child": ids[at], "parent": ids[root[at]]})

    return own.groupBy(*key, "part").applyInPandas(run, "sim int, timestep bigint, child bigint, parent bigint")


def star_components(atoms: DataFrame, bonds: DataFrame, block: int = 1 << 18) -> tuple[DataFrame, int]:
    """((sim, timestep, atom_id, component), rounds) for frames of any size: no task holds a frame.

    Ranges of `block` atoms become stars by themselves. Where bonds cross from one into another, blocks of such bonds
    between the stars do likewise; then every star hands its larger neighbours to its smallest one, and its smaller ones
    likewise, in turn, until only stars are left. Rounds grow with the logarithm of the atoms, not with the length of chains.
    """
    local = materialize(packed.local_components(atoms, bonds, block), "local")
    inside, asked = local.where(F.col("kind") == packed.ATOMS), packed.component_rows(local.where(F.col("kind") == packed.ASKED))
    if asked.isEmpty():
        return packed.component_rows(inside), 0
    ends = lambda c, to: asked.select(*FRAME, F.col("atom_id").alias(c), F.col("component").alias(to))
    cross = bonds.where(f"{packed.range_of('atom_i', block)} <> {packed.range_of('atom_j', block)}").select(*FRAME, "atom_i", "atom_j")
    known = cross.join(ends("atom_i", "i"), [*FRAME, "atom_i"]).join(ends("atom_j", "j"), [*FRAME, "atom_j"]).select(*FRAME, "i", "j").distinct()
    stars = materialize(local_stars(known.where("i <> j"), block), "stars")
    rounds = 0
    while True:
        # an atom that is child and parent shows that not all is stars yet
        again = stars.select(*FRAME, F.col("child").alias("parent")).distinct()
        twice = stars.groupBy(*FRAME, "child").agg(F.count("*").alias("n")).where("n > 1")
        if stars.join(again, [*FRAME, "parent"], "left_semi").isEmpty() and twice.isEmpty():
            break
        rounds += 1
        both = stars.select(*FRAME, F.col("child").alias("u"), F.col("parent").alias("v")).unionByName(stars.select(*FRAME, F.col("parent").alias("u"), F.col("child").alias("v")))
        least = both.groupBy(*FRAME, "u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, [*FRAME, "u"]).select(*FRAME, F.col("v").alias("child"), F.col("m").alias("parent")).distinct()
        large = materialize(large, "large")
        down = large.groupBy(*FRAME, "child").agg(F.min("parent").alias("m"))
        met = large.join(down, [*FRAME, "child"])
        small = met.select(*FRAME, F.col("parent").alias("child"), F.col("m").alias("parent")).where("child <> parent").unionByName(down.select(*FRAME, "child", F.col("m").alias("parent")))
        stars = materialize(small.distinct(), "stars")
    return packed.joined_components(inside, stars, block), rounds


def iterative_components(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(sim, timestep, atom_id, component) for frames too large for a task."""
    return star_components(atoms, bonds)[0]


#: Atoms and bonds of a frame that one task takes.
MOST_IN_TASK = 5_000_000


def components_of_any_size(atoms: DataFrame, bonds: DataFrame, most: int = MOST_IN_TASK) -> DataFrame:
    """molecule_components, by stars for frames of more than `most` atoms and bonds; their mol_idx is counted by ranges of atoms."""
    size = lambda df, c: df.groupBy(*FRAME).agg(F.count("*").alias(c))
    sizes = materialize(size(atoms, "a").join(size(bonds, "b"), FRAME, "left").select(*FRAME, (F.col("a") + F.coalesce("b", F.lit(0))).alias("n")), "sizes")
    large = sizes.where(F.col("n") > most)
    if large.isEmpty():
        return molecule_components(atoms, bonds)
    pick = lambda df, how: df.join(F.broadcast(large.select(*FRAME)), FRAME, how)  # noqa: E731  few: each is larger than a task
    small = molecule_components(pick(atoms, "left_anti"), pick(bonds, "left_anti"))
    found = materialize(star_components(pick(atoms, "left_semi"), pick(bonds, "left_semi"))[0], "components")
    heads = numbered(found.where("atom_id = component").select(*FRAME, "component"), "place", *FRAME, "component")
    first = heads.groupBy(*FRAME).agg(F.min("place").alias("first"))
    index = heads.join(F.broadcast(first), FRAME).select(*FRAME, "component", (F.col("place") - F.col("first")).cast("int").alias("mol_idx"))
    return small.unionByName(found.join(index, [*FRAME, "component"]).select(*FRAME, "atom_id", "component", "mol_idx"))


def hill_formulas(parts: DataFrame) -> DataFrame:
    """(sim, timestep, mol_idx, formula, n_atoms) from (sim, timestep, mol_idx, element) rows."""
    counts = parts.groupBy(*FRAME, "mol_idx", "element").agg(F.count("*").cast("int").alias("n"))
    return counts.groupBy(*FRAME, "mol_idx").agg(F.collect_list(F.struct("element", "n")).alias("c"), F.sum("n").cast("int").alias("n_atoms")).select(*FRAME, "mol_idx", hill(F.col("c")).alias("formula"), "n_atoms")


def molecule_signatures(members: DataFrame, atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(sim, timestep, mol_idx, atom_ids, elements, bonds, signature): elements in the order of atom ids, bonds by local index and type."""
    own = members.join(atoms.select(*FRAME, "atom_id", "element"), [*FRAME, "atom_id"])
    base = own.groupBy(*FRAME, "mol_idx").agg(F.sort_array(F.collect_list(F.struct("atom_id", "element"))).alias("a"))
    place = base.select(*FRAME, "mol_idx", F.posexplode("a").alias("pos", "a")).select(*FRAME, "mol_idx", "pos", F.col("a.atom_id").alias("atom_id"))
    one = place.select(*FRAME, "mol_idx", F.col("pos").alias("i"), F.col("atom_id").alias("atom_i"))
    two = place.select(*FRAME, F.col("pos").alias("j"), F.col("atom_id").alias("atom_j"))
    ends = bonds.select(*FRAME, "atom_i", "atom_j", bond_type(F.col("bond_order")).alias("t")).join(one, [*FRAME, "atom_i"]).join(two, [*FRAME, "atom_j"])
    lines = ends.groupBy(*FRAME, "mol_idx").agg(F.collect_list(F.struct("i", "j", "t")).alias("b"))
    both = base.join(lines, [*FRAME, "mol_idx"], "left")
    ids = F.transform("a", lambda x: x.atom_id)
    local = F.sort_array(F.coalesce("b", F.expr("array()").cast("array<struct<i:int,j:int,t:int>>")))
    out = both.select(*FRAME, "mol_idx", ids.alias("atom_ids"), F.transform("a", lambda x: x.element).alias("elements"), local.alias("bonds"))
    text = F.concat_ws("|", F.array_join("elements", ","), F.array_join(F.transform("bonds", lambda x: F.concat_ws("-", x.i.cast("string"), x.j.cast("string"), x.t.cast("string"))), " "))
    return out.select("*", text.alias("signature"))


def molecules(atoms: DataFrame, bonds: DataFrame, label: str = "canonical", labeler=write_smiles) -> DataFrame:
    """(sim, timestep, mol_idx, label, formula, atom_ids, n_atoms), one row per molecule.

    label: 'formula' takes the formula; 'canonical' calls labeler(elements, bonds), which writes canonical SMILES, once in
    each frame for each distinct molecule; any such function can be given. A frame's atoms and bonds meet in one task as
    arrays, where its components, formulas and labels are found together; molecules_of_members is for larger frames.
    Atoms and bonds may be packed; packed.molecules gives the same packed.
    """
    return packed.molecule_rows(packed.molecules(atoms, bonds, label, labeler))


def molecules_of_members(members: DataFrame, atoms: DataFrame, bonds: DataFrame, labeler=write_smiles) -> DataFrame:
    """The same from (sim, timestep, atom_id, mol_idx), by joins: no task holds a frame, and each distinct signature is
    labelled once."""
    signed = materialize(molecule_signatures(members, atoms, bonds), "signatures")
    labels = label_signatures(signed, labeler)
    counts = F.transform(F.array_distinct("elements"), lambda e: F.struct(e.alias("element"), F.size(F.filter("elements", lambda x: x == e)).alias("n")))
    return signed.join(labels, "signature").select(*FRAME, "mol_idx", "label", hill(counts).alias("formula"), "atom_ids", F.size("atom_ids").alias("n_atoms"))


def label_signatures(signed: DataFrame, labeler=write_smiles) -> DataFrame:
    """(signature, label), each distinct signature labelled once."""

    def run(batches):
        for t in batches:
            yield pd.DataFrame({"signature": t["signature"], "label": [labeler(list(e), [(b["i"], b["j"], b["t"]) for b in own]) for e, own in zip(t["elements"], t["bonds"])]})

    return signed.groupBy("signature").agg(F.first("elements").alias("elements"), F.first("bonds").alias("bonds")).mapInPandas(run, "signature string, label string")


def atom_membership(mols: DataFrame) -> DataFrame:
    """(sim, timestep, atom_id, mol_idx, label); an atom listed twice belongs to the last molecule. Packed molecules list none twice."""
    if packed.is_packed(mols):
        return packed.membership(mols)
    each = mols.select(*FRAME, "mol_idx", "label", F.explode("atom_ids").alias("atom_id"))
    return each.groupBy(*FRAME, "atom_id").agg(F.max_by(F.struct("mol_idx", "label"), "mol_idx").alias("m")).select(*FRAME, "atom_id", "m.mol_idx", "m.label")


def molecule_formulas(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(sim, timestep, mol_idx, formula, n_atoms) of atoms and bonds, packed or not."""
    return packed.formula_rows(packed.molecules(atoms, bonds, "formula")).drop("label")


def formulas_observed(mols: DataFrame) -> DataFrame:
    if packed.is_packed(mols):
        return mols.select("sim", F.explode("formula_names").alias("formula")).distinct()
    return mols.select("sim", "formula").distinct()


def smiles_for_formula(mols: DataFrame, formula: str | None = None) -> DataFrame:
    """(sim, formula, label): the labels observed for one formula, or for each."""
    mols = packed.first_rows(mols) if packed.is_packed(mols) else mols
    return (mols.where(F.col("formula") == formula) if formula is not None else mols).select("sim", "formula", "label").distinct()


def in_file_order(df: DataFrame, frames: DataFrame | None) -> DataFrame:
    """df with frame_ord, of frames (sim, timestep, frame_ord) where given, else the timestep."""
    if frames is None:
        return df if "frame_ord" in df.columns else df.withColumn("frame_ord", F.col("timestep"))
    first = frames.groupBy(*FRAME).agg(F.min("frame_ord").alias("frame_ord"))
    return df.drop("frame_ord").join(first, FRAME)


def first_appearance(mols: DataFrame, value: str = "label", frames: DataFrame | None = None) -> DataFrame:
    """(sim, value, timestep, mol_idx): where each value is met first, in the order of frames in the file."""
    mols, order = in_file_order(packed.first_rows(mols) if packed.is_packed(mols) else mols, frames), F.col("frame_ord")
    found = mols.groupBy("sim", F.col(value).alias("value")).agg(F.min(F.struct(order.alias("o"), F.col("mol_idx"), F.col("timestep"))).alias("m"))
    return found.select("sim", "value", "m.timestep", "m.mol_idx")


def most_frames(mols: DataFrame) -> int:
    """Frames of the longest simulation."""
    return mols.select(*FRAME).distinct().groupBy("sim").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def atom_evolution(membership: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """(sim, atom_id, labels array<struct<timestep, label>>) in the order of frames in the file; one array per atom, as long as there are frames.

    membership: rows, or packed molecules, which are dealt out by blocks of atoms."""
    own = in_file_order(membership, frames)
    if packed.is_packed(membership):
        return packed.atom_evolution(own, most_frames(own))
    each = own.groupBy("sim", "atom_id").agg(F.sort_array(F.collect_list(F.struct("frame_ord", "timestep", "label"))).alias("labels"))
    return each.withColumn("labels", F.transform("labels", lambda x: F.struct(x.timestep.alias("timestep"), x.label.alias("label"))))


def atom_runs(membership: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """(sim, atom_id, run, label, first, last, n): a row for each stretch of frames, in file order, in which an atom keeps its label.

    atom_evolution without its arrays: as long as an atom changes, not as long as the simulation.
    """
    own = in_file_order(membership, frames)
    if packed.is_packed(membership):
        return packed.atom_runs(own, most_frames(own))
    order = Window.partitionBy("sim", "atom_id").orderBy("frame_ord")
    marked = own.withColumn("new", F.coalesce((F.lag("label").over(order) != F.col("label")).cast("int"), F.lit(1)))
    runs = marked.withColumn("run", F.sum("new").over(order).cast("int"))
    return runs.groupBy("sim", "atom_id", "run").agg(F.first("label").alias("label"), F.min_by("timestep", "frame_ord").alias("first"), F.max_by("timestep", "frame_ord").alias("last"), F.count("*").alias("n"), F.min("frame_ord").alias("begin"), F.max("frame_ord").alias("end"))


def expand_runs(runs: DataFrame, frames: DataFrame) -> DataFrame:
    """(sim, timestep, frame_ord, atom_id, label) of atom_runs: a row for each frame (sim, timestep, frame_ord) that a run
    covers. An atom that was missing within a run stands in its frames too; an atom's missing frames between runs stay out."""
    each = runs.join(F.broadcast(frames.groupBy("sim").agg(F.sort_array(F.collect_list(F.struct("frame_ord", "timestep"))).alias("all"))), "sim")
    inside = F.filter("all", lambda x: x.frame_ord.between(F.col("begin"), F.col("end")))
    return each.select("sim", "atom_id", "label", F.explode(inside).alias("f")).select("sim", "f.timestep", "f.frame_ord", "atom_id", "label")


def formula_smiles(mols: DataFrame) -> DataFrame:
    """(sim, timestep, mol_idx, formula, label): each molecule's formula beside its label."""
    mols = packed.formula_rows(mols) if packed.is_packed(mols) else mols
    return mols.select(*FRAME, "mol_idx", "formula", "label")


def bonds_at(frames: DataFrame, bonds: DataFrame, timestep: int) -> DataFrame:
    """The bonds of one timestep, of the first frame in file order where it repeats; a timestep that no simulation has is an error."""
    own = frames.where(F.col("timestep") == timestep)
    if own.isEmpty():
        raise LookupError(f"timestep {timestep} was not found")
    return dedupe_frames(bonds.where(F.col("timestep") == timestep), False) if "frame_ord" in bonds.columns else bonds.where(F.col("timestep") == timestep)


def adjacent_frames(frames: DataFrame) -> DataFrame:
    """(sim, t1, t2): each timestep of a simulation and the next one there is. One row per frame, no atoms."""
    each = frames.select(*FRAME).distinct()
    return each.select("sim", F.col("timestep").alias("t1"), F.lead("timestep").over(Window.partitionBy("sim").orderBy("timestep")).alias("t2")).where("t2 IS NOT NULL")
