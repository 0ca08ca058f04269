"""Side-by-side scenes of reactions: the frames before and after, as atom and bond tables of any number of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import CONTEXT_DIAMETER, DIAMETER_SCALE, ELEMENT_MASSES, ELEMENT_RADII, UNKNOWN_DIAMETER

GAP, PADDING = 0.35, 4.0
EVENT = ["sim", "t1", "t2", "cluster"]


def scene_attributes(atoms: DataFrame, elements: DataFrame) -> DataFrame:
    """Adds visual_type (1 for context, 2 and up by element), diameter and mass to atoms with element and in_reaction."""
    rank = elements.select("element").distinct().select("element", (F.dense_rank().over(Window.orderBy("element")) + 1).cast("int").alias("rank"))
    known = lambda values: F.coalesce(*(F.when(F.col("element") == e, F.lit(x)) for e, x in values.items()))
    shown = F.col("in_reaction") & F.col("element").isNotNull()
    own = atoms.join(F.broadcast(rank), "element", "left")
    return own.withColumns({
        "visual_type": F.when(shown, F.col("rank")).otherwise(1).cast("int"),
        "diameter": F.when(shown, F.coalesce(known(ELEMENT_RADII) * DIAMETER_SCALE, F.lit(UNKNOWN_DIAMETER))).otherwise(CONTEXT_DIAMETER),
        "mass": F.coalesce(known(ELEMENT_MASSES), F.lit(1.0)),
    }).drop("rank")


def reaction_scene_atoms(events: DataFrame, atoms: DataFrame, frames: DataFrame, elements: DataFrame) -> DataFrame:
    """(event, side, scene_id, atom_id, element, x, y, z, in_reaction, visual_type, diameter).

    The frame before stands to the left and the one behind to the right of the origin, each moved by half
    of the box length and gap; ids of the right one start behind the largest of both.
    """
    box = frames.groupBy("sim", "timestep").agg(F.min_by(F.col("xhi") - F.col("xlo"), "frame_ord").alias("lx"), F.min("frame_ord").alias("frame_ord"))
    own = atoms.join(box.select("sim", "timestep", "frame_ord"), ["sim", "timestep", "frame_ord"], "left_semi")
    own = own.join(F.broadcast(elements), "atom_type", "left").select("sim", "timestep", "atom_id", "element", "x", "y", "z")
    ids = events.select(*EVENT, "reactant_atom_ids", "product_atom_ids").join(box.select("sim", F.col("timestep").alias("t1"), "lx"), ["sim", "t1"])
    top = own.groupBy("sim", "timestep").agg(F.max("atom_id").alias("top"))
    ids = ids.join(top.select("sim", F.col("timestep").alias("t1"), F.col("top").alias("a")), ["sim", "t1"]).join(top.select("sim", F.col("timestep").alias("t2"), F.col("top").alias("b")), ["sim", "t2"]).withColumn("top", F.greatest("a", "b"))
    sides = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("t1").alias("timestep"), F.col("reactant_atom_ids").alias("ids")), F.struct(F.lit(2).alias("side"), F.col("t2").alias("timestep"), F.col("product_atom_ids").alias("ids"))))
    each = ids.select(*EVENT, "lx", "top", sides.alias("s")).select(*EVENT, "lx", "top", "s.*").join(own, ["sim", "timestep"])
    shift = F.col("lx") * (0.5 * (1 + GAP)) * F.when(F.col("side") == 1, -1).otherwise(1)
    placed = each.select(*EVENT, "side", (F.col("atom_id") + F.when(F.col("side") == 2, F.col("top")).otherwise(0)).alias("scene_id"), "atom_id", "element", (F.col("x") + shift).alias("x"), "y", "z", F.array_contains("ids", F.col("atom_id")).alias("in_reaction"))
    return scene_attributes(placed, elements)


def reaction_scene_bonds(events: DataFrame, bonds: DataFrame, top: DataFrame) -> DataFrame:
    """(event, bond_id, side, i, j, bond_type) of both frames; top: (sim, timestep, top), the largest atom id of each frame."""
    ids = events.select(*EVENT).join(top.select("sim", F.col("timestep").alias("t1"), F.col("top").alias("a")), ["sim", "t1"]).join(top.select("sim", F.col("timestep").alias("t2"), F.col("top").alias("b")), ["sim", "t2"]).withColumn("top", F.greatest("a", "b"))
    each = ids.select(*EVENT, "top", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("t1").alias("timestep")), F.struct(F.lit(2).alias("side"), F.col("t2").alias("timestep")))).alias("s")).select(*EVENT, "top", "s.*")
    own = each.join(bonds.select("sim", "timestep", "atom_i", "atom_j", "bond_type"), ["sim", "timestep"])
    move = F.when(F.col("side") == 2, F.col("top")).otherwise(0)
    moved = own.select(*EVENT, "side", (F.col("atom_i") + move).alias("i"), (F.col("atom_j") + move).alias("j"), "bond_type")
    return moved.withColumn("bond_id", F.row_number().over(Window.partitionBy(*EVENT).orderBy("side", "i", "j")))


def scene_bounds(scene: DataFrame) -> DataFrame:
    """(event, xlo..zhi): the scene's extent with padding."""
    return scene.groupBy(*EVENT).agg(*(f for a in "xyz" for f in ((F.min(a) - PADDING).alias(f"{a}lo"), (F.max(a) + PADDING).alias(f"{a}hi"))))
