"""One registered query per operator, over the driver's tables, and the same in SQL where that can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, smiles
from ..operators import packed, quality, rdf, reactions, scene, species, thermo, topology
from ..sources import readers, sinks, store
from ..streaming import reactions as live
from .worlds import BOX, REPLICAS, SIMS, SPECIES, World, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
A, B, WIDTH = "Li", "O", 0.5
#: Queries that stand a second time as canonical_..., with canonical SMILES for molecules: SQL has only formulas.
CANONICAL = set("""format_reaction changed_reactions find_reaction atom_membership formula_smiles reaction_events
count_reaction_paths reaction_path_table rank_reactions top_reactions first_reaction_occurrence read_reaction_counts
write_reaction_paths smiles_for_formula first_appearance atom_evolution atom_runs""".split())


def query(name: str, oracle: str | None = None):
    """Registers f; where a label counts, it is the formula in queries that SQL can follow, and canonical in others."""

    def register(f: Callable[[World], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(World(spark, sf_dir, oracle is None))
        if oracle is not None:
            ORACLE[name] = oracle
        if name in CANONICAL:
            QUERIES[f"canonical_{name}"] = lambda spark, sf_dir: f(World(spark, sf_dir, True))
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def events(w: World) -> DataFrame:
    return reactions.reaction_events(w.packed_molecules)


# Sources and sinks -----------------------------------------------------------------------------------


@query("read_species", sql("SELECT sim, timestep, species, n FROM species", "species"))
def read_species(w: World) -> DataFrame:
    return readers.read_species(w.spark, w.species_files)[0].select("sim", "timestep", "species", "n")


@query("read_thermo", sql("SELECT sim, step, parameter, round(CASE WHEN isnan(value) THEN NULL ELSE value END, 6) AS value FROM thermo", "thermo"))
def read_thermo(w: World) -> DataFrame:
    return readers.read_thermo(w.spark, w.thermo_files).select("sim", "step", "parameter", F.round(F.nanvl("value", F.lit(None)), 6).alias("value"))


@query("read_bonds", sql("SELECT sim, timestep, atom_i, atom_j, bond_order FROM bonds", "bonds"))
def read_bonds(w: World) -> DataFrame:
    return readers.read_bonds(w.spark, w.bond_files, w.elements)[2].select("sim", "timestep", "atom_i", "atom_j", "bond_order")


@query("read_trajectory", sql("SELECT sim, timestep, atom_id, atom_type, q, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM atoms", "atoms"))
def read_trajectory(w: World) -> DataFrame:
    atoms = readers.read_trajectory(w.spark, w.trajectory_files)[1]
    return atoms.select("sim", "timestep", "atom_id", "atom_type", "q", *(F.round(c, 6).alias(c) for c in "xyz"))


@query("list_timesteps", sql("SELECT DISTINCT sim, timestep FROM atoms", "atoms"))
def list_timesteps(w: World) -> DataFrame:
    return readers.list_timesteps(w.spark, w.trajectory_files).select("sim", "timestep")


@query("read_manifest", sql("SELECT sim, topic, 'run/' || path AS path FROM manifest", "manifest"))
def read_manifest(w: World) -> DataFrame:
    keys = F.coalesce(*(F.when(F.col("topic") == t, F.lit(k)) for t, k in (("bonds", "BF"), ("species", "SpeciesFile"), ("thermo", "TF"), ("trajectory", "TrajF"))))
    lines = w.manifest.select(F.explode(F.array(F.struct(F.lit(1).alias("ord"), F.concat(keys, "sim", F.lit(" = old")).alias("value")), F.struct(F.lit(2).alias("ord"), F.concat(keys, "sim", F.lit(" = '"), "path", F.lit("'")).alias("value")))).alias("l")).select("l.*")
    return readers.parse_manifest(lines, "run")[0]


@query("load_simulations", sql("SELECT 'bonds' AS topic, sim, count(*) AS n FROM bonds GROUP BY sim UNION ALL SELECT 'species', sim, count(*) FROM species GROUP BY sim UNION ALL SELECT 'thermo', sim, count(*) FROM thermo GROUP BY sim UNION ALL SELECT 'atoms', sim, count(*) FROM atoms GROUP BY sim", "bonds", "species", "thermo", "atoms"))
def load_simulations(w: World) -> DataFrame:
    parts = {"bonds": w.bond_files, "species": w.species_files, "thermo": w.thermo_files, "trajectory": w.trajectory_files}
    manifest = None
    for topic, files in parts.items():
        own = files.select("sim", F.lit(topic).alias("topic"), "path")
        manifest = own if manifest is None else manifest.unionByName(own)
    loaded = readers.load_simulations(w.spark, manifest, w.elements)
    out = [loaded[t].groupBy("sim").agg(F.count("*").alias("n")).select(F.lit(t).alias("topic"), "sim", "n") for t in ("bonds", "species", "thermo", "atoms")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


TOTALS = sql("SELECT reaction, total AS n FROM ranks", "ranks")


@query("read_reaction_counts", TOTALS)
def read_reaction_counts(w: World) -> DataFrame:
    table = reactions.rank_reactions(store.materialize(reactions.count_reaction_paths(events(w)), "counts"))
    path = store.shared_path(w.spark, "paths")
    table.orderBy("rank").select(F.col("reaction").alias("Reaction"), F.col("total").alias("Count")).coalesce(1).write.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return readers.read_reaction_counts(w.spark, path)


WIDE = sql("SELECT r.rank, r.reaction, CAST(coalesce(sum(n) FILTER (sim = 1), 0) AS BIGINT) AS sim_1, CAST(coalesce(sum(n) FILTER (sim = 2), 0) AS BIGINT) AS sim_2, CAST(coalesce(sum(n) FILTER (sim = 3), 0) AS BIGINT) AS sim_3, r.total FROM ranks r JOIN counts c ON c.reaction = r.reaction GROUP BY r.rank, r.reaction, r.total", "ranks", "counts")


@query("write_reaction_paths", f"SELECT reaction, sim_1, sim_2, sim_3, total FROM ({WIDE})")
def write_reaction_paths(w: World) -> DataFrame:
    path = store.shared_path(w.spark, "result")
    sinks.write_reaction_paths(reactions.reaction_path_table(events(w), SIMS), path, SIMS, {"input_file": "driver tables"})
    back = w.spark.read.option("header", True).option("escape", '"').csv(f"{path}/paths")
    return back.select(F.col("Reaction").alias("reaction"), *(F.col(f"Simulation {i}").cast("bigint").alias(f"sim_{i}") for i in SIMS), F.col("Sum").cast("bigint").alias("total"))


@query("write_tables", sql("SELECT sim, timestep, count(*) AS n FROM bonds GROUP BY sim, timestep", "bonds"))
def write_tables(w: World) -> DataFrame:
    path = store.shared_path(w.spark, "tables")
    sinks.write_tables({"bonds": w.bonds}, path)
    return w.spark.read.parquet(f"{path}/bonds").groupBy("sim", "timestep").agg(F.count("*").alias("n"))


# Projections -----------------------------------------------------------------------------------------


@query("map_elements", sql("SELECT sim, timestep, atom_id, element FROM bond_atoms WHERE atom_type <> 4", "bond_atoms"))
def map_elements(w: World) -> DataFrame:
    return scalars.map_elements(w.bond_atoms.drop("element"), w.elements.where("atom_type <> 4")).select("sim", "timestep", "atom_id", "element")


@query("bond_type", sql("SELECT sim, timestep, atom_i, atom_j, CASE WHEN bond_order >= 2.5 THEN 3 WHEN bond_order >= 1.5 THEN 2 ELSE 1 END AS bond_type FROM bonds", "bonds"))
def bond_type(w: World) -> DataFrame:
    return w.bonds.select("sim", "timestep", "atom_i", "atom_j", scalars.bond_type(F.col("bond_order")).alias("bond_type"))


@query("box_metrics", sql(f"SELECT sim, timestep, {BOX} AS lx, {BOX} AS ly, {BOX} AS lz, {BOX ** 3} AS volume FROM (SELECT DISTINCT sim, timestep FROM atoms)", "atoms"))
def box_metrics(w: World) -> DataFrame:
    return scalars.box_lengths(w.frames).select("sim", "timestep", "lx", "ly", "lz", "volume")


def wrapped(c: str) -> str:
    return f"{c} - {BOX} * floor({c} / {BOX})"


@query("wrap_positions", sql("SELECT sim, timestep, atom_id, " + ", ".join(f"round({wrapped(c)}, 6) AS {c}w" for c in "xyz") + " FROM atoms", "atoms"))
def wrap_positions(w: World) -> DataFrame:
    return rdf.wrap_positions(w.atoms, w.frames).select("sim", "timestep", "atom_id", *(F.round(f"{c}w", 6).alias(f"{c}w") for c in "xyz"))


def image(c: str) -> str:
    return f"(a.{c} - b.{c} - {BOX} * round_even((a.{c} - b.{c}) / {BOX}, 0))"


PAIRS = f"pair AS (SELECT a.sim, a.timestep, a.atom_id AS id_a, b.atom_id AS id_b, sqrt({image('x')} ** 2 + {image('y')} ** 2 + {image('z')} ** 2) AS d FROM atoms a JOIN atoms b ON a.sim = b.sim AND a.timestep = b.timestep WHERE a.element = '{A}' AND b.element = '{B}')"


def rdf_sql(select: str, *more: str) -> str:
    head = sql("", "atoms")
    return ",\n".join([head.rstrip(), PAIRS, *more]) + "\n" + select


@query("minimum_image_distance", sql(f"SELECT a.sim, a.timestep, a.atom_id, round(sqrt({image('x')} ** 2 + {image('y')} ** 2 + {image('z')} ** 2), 6) AS d FROM atoms a JOIN atoms b ON b.sim = a.sim AND b.timestep = a.timestep AND b.atom_id = a.atom_id + 1", "atoms"))
def minimum_image_distance(w: World) -> DataFrame:
    a = w.atoms.select("sim", "timestep", "atom_id", *(F.col(c).alias(f"{c}a") for c in "xyz"))
    b = w.atoms.select("sim", "timestep", (F.col("atom_id") - 1).alias("atom_id"), *(F.col(c).alias(f"{c}b") for c in "xyz"))
    d = [scalars.minimum_image(F.col(f"{c}a") - F.col(f"{c}b"), F.lit(BOX)) for c in "xyz"]
    return a.join(b, ["sim", "timestep", "atom_id"]).select("sim", "timestep", "atom_id", F.round(scalars.distance(*d), 6).alias("d"))


@query("hill_formula", sql("SELECT * FROM formulas", "formulas"))
def hill_formula(w: World) -> DataFrame:
    return topology.molecule_formulas(w.packed_atoms, w.bonds)


SIGNATURE = sql("""SELECT sim, timestep, mol_idx, string_agg(element, ',' ORDER BY atom_id) || '|' || coalesce(any_value(lines), '') AS signature
FROM members m JOIN bond_atoms b USING (sim, timestep, atom_id) LEFT JOIN (
  SELECT sim, timestep, mol_idx, string_agg(i || '-' || j || '-' || t, ' ' ORDER BY i, j, t) AS lines FROM (
    SELECT n1.sim, n1.timestep, n1.mol_idx, n1.pos AS i, n2.pos AS j, CASE WHEN bond_order >= 2.5 THEN 3 WHEN bond_order >= 1.5 THEN 2 ELSE 1 END AS t
    FROM bonds JOIN (SELECT *, row_number() OVER (PARTITION BY sim, timestep, mol_idx ORDER BY atom_id) - 1 AS pos FROM members) n1 ON n1.sim = bonds.sim AND n1.timestep = bonds.timestep AND n1.atom_id = atom_i
    JOIN (SELECT *, row_number() OVER (PARTITION BY sim, timestep, mol_idx ORDER BY atom_id) - 1 AS pos FROM members) n2 ON n2.sim = bonds.sim AND n2.timestep = bonds.timestep AND n2.atom_id = atom_j) GROUP BY sim, timestep, mol_idx) l USING (sim, timestep, mol_idx)
GROUP BY sim, timestep, mol_idx""", "members", "bond_atoms")


@query("molecule_signature", SIGNATURE)
def molecule_signature(w: World) -> DataFrame:
    return topology.molecule_signatures(topology.molecule_components(w.bond_atoms, w.bonds), w.bond_atoms, w.bonds).select("sim", "timestep", "mol_idx", "signature")


@query("molecule_label")
def molecule_label(w: World) -> DataFrame:
    return topology.molecules(w.packed_atoms, w.bonds).select("sim", "timestep", "mol_idx", "label", "formula")


@query("format_reaction", sql("SELECT sim, t1, t2, cluster, reaction FROM sides", "sides"))
def format_reaction(w: World) -> DataFrame:
    """Every cluster of linked molecules, changed or not."""
    return reactions.every_cluster(w.packed_molecules)


@query("smiles_formula", sql("SELECT sim, timestep, mol_idx, formula FROM formulas", "formulas"))
def smiles_formula(w: World) -> DataFrame:
    """Formulas read back from the molecules' SMILES."""
    mols = topology.molecules(w.packed_atoms, w.bonds)
    return mols.select("sim", "timestep", "mol_idx", scalars.hill(smiles.element_counts(F.col("label"))).alias("formula"))


@query("thermo_axis_label", sql("SELECT DISTINCT parameter, CASE parameter WHEN 'Temp' THEN 'Temp (K)' WHEN 'Press' THEN 'Press (atm)' ELSE parameter END AS label FROM thermo", "thermo"))
def thermo_axis_label(w: World) -> DataFrame:
    return w.thermo.select("parameter").distinct().select("parameter", scalars.thermo_axis_label(F.col("parameter")).alias("label"))


@query("series_label", sql("SELECT sim, count(*) AS n, CASE sim WHEN 1 THEN 'hot' ELSE 'Simulation ' || sim END AS label FROM thermo GROUP BY sim", "thermo"))
def series_label(w: World) -> DataFrame:
    labels = w.spark.createDataFrame([(1, " hot "), (2, "  ")], "sim int, label string")
    return thermo.series_label(w.thermo.groupBy("sim").agg(F.count("*").alias("n")), labels).select("sim", "n", "label")


@query("padded_range", sql("SELECT parameter, round(least(lo, hi) - CASE WHEN lo = hi THEN greatest(abs(lo) * 0.01, 1) ELSE 0 END, 6) AS lo, round(greatest(lo, hi) + CASE WHEN lo = hi THEN greatest(abs(lo) * 0.01, 1) ELSE 0 END, 6) AS hi FROM (SELECT parameter, max(step) AS lo, min(CASE WHEN parameter = 'Temp' THEN step ELSE 719.0 END) AS hi FROM thermo GROUP BY parameter)", "thermo"))
def padded_range(w: World) -> DataFrame:
    own = w.thermo.groupBy("parameter").agg(F.max("step").alias("a"), F.min(F.when(F.col("parameter") == "Temp", F.col("step")).otherwise(719.0)).alias("b"))
    lo, hi = scalars.padded_range(F.col("a"), F.col("b"))
    return own.select("parameter", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("scene_attributes", sql("SELECT sim, timestep, atom_id, CASE WHEN atom_id % 2 = 0 THEN CASE element WHEN 'C' THEN 2 WHEN 'H' THEN 3 WHEN 'Li' THEN 4 ELSE 5 END ELSE 1 END AS visual_type, round(CASE WHEN atom_id % 2 = 0 THEN CASE element WHEN 'C' THEN 0.85 WHEN 'H' THEN 0.6 WHEN 'Li' THEN 0.91 ELSE 0.76 END ELSE 0.55 END, 6) AS diameter, CASE element WHEN 'C' THEN 12.011 WHEN 'H' THEN 1.008 WHEN 'Li' THEN 6.94 ELSE 15.999 END AS mass FROM atoms", "atoms"))
def scene_attributes(w: World) -> DataFrame:
    own = w.atoms_named.withColumn("in_reaction", F.col("atom_id") % 2 == 0)
    return scene.scene_attributes(own, w.elements).select("sim", "timestep", "atom_id", "visual_type", F.round("diameter", 6).alias("diameter"), "mass")


# Filters ---------------------------------------------------------------------------------------------


@query("filter_timesteps", sql("SELECT sim, timestep, count(*) AS n FROM atoms WHERE timestep BETWEEN 80 AND 82 GROUP BY sim, timestep", "atoms"))
def filter_timesteps(w: World) -> DataFrame:
    return readers.filter_timesteps(w.atoms, 82, 80).groupBy("sim", "timestep").agg(F.count("*").alias("n"))


@query("frame_at", sql("SELECT sim, timestep, CAST(count(*) AS INTEGER) AS n_atoms FROM atoms WHERE timestep = 81 GROUP BY sim, timestep", "atoms"))
def frame_at(w: World) -> DataFrame:
    return rdf.frame_at(w.frames, 81).select("sim", "timestep", "n_atoms")


@query("bonds_at", sql("SELECT * FROM bonds WHERE timestep = 40", "bonds"))
def bonds_at(w: World) -> DataFrame:
    return topology.bonds_at(w.bonds.select("sim", "timestep").distinct(), w.bonds, 40).select("sim", "timestep", "atom_i", "atom_j", "bond_order")


@query("select_species", sql("SELECT sim, timestep, species, n, 'R' || sim || ' ' || species AS label FROM species WHERE species IN ('view', 'error') AND sim IN (1, 3)", "species"))
def select_species(w: World) -> DataFrame:
    return species.select_species(w.species, ["view", "error"], [1, 3])


@query("simulations_with", sql("SELECT DISTINCT sim FROM manifest WHERE topic = 'trajectory'", "manifest"))
def simulations_with(w: World) -> DataFrame:
    return reactions.simulations_with(w.manifest, "trajectory")


@query("select_thermo", sql("SELECT sim, step, round(value, 6) AS value FROM thermo WHERE parameter = 'Extra'", "thermo"))
def select_thermo(w: World) -> DataFrame:
    return thermo.select_thermo(w.thermo, "Extra").withColumn("value", F.round("value", 6))


@query("filter_range", sql("SELECT sim, step, round(value, 6) AS value FROM thermo WHERE parameter = 'Press' AND step BETWEEN 100 AND 200", "thermo"))
def filter_range(w: World) -> DataFrame:
    return thermo.filter_range(thermo.select_thermo(w.thermo, "Press"), "step", 200, 100).withColumn("value", F.round("value", 6))


@query("select_elements", sql("SELECT sim, timestep, atom_id, element FROM atoms WHERE element IN ('Li', 'O')", "atoms"))
def select_elements(w: World) -> DataFrame:
    return rdf.select_elements(w.atoms, w.elements, [A, B]).select("sim", "timestep", "atom_id", "element")


@query("changed_reactions", sql("SELECT sim, t1, t2, cluster FROM rx", "rx"))
def changed_reactions(w: World) -> DataFrame:
    return events(w).select("sim", "t1", "t2", "cluster")


@query("find_reaction", sql("SELECT sim, t1, t2, cluster FROM rx WHERE reaction = '[''CH''] -> [''C'', ''H'']'", "rx"))
def find_reaction(w: World) -> DataFrame:
    """Carbon and hydrogen parting; with canonical labels from a single bond, which they tell from others."""
    reaction = "['CH'] -> ['C', 'H']"
    if w.canonical:
        reaction = "['[H][C]'] -> ['[C]', '[H]']"
    return reactions.find_reaction(events(w), reaction).select("sim", "t1", "t2", "cluster")


# Joins -----------------------------------------------------------------------------------------------


@query("atom_membership", sql("SELECT sim, timestep, atom_id, mol_idx, label FROM labelled", "labelled"))
def atom_membership(w: World) -> DataFrame:
    return w.membership


@query("adjacent_frames", sql("SELECT sim, t1, t2 FROM pairs", "pairs"))
def adjacent_frames(w: World) -> DataFrame:
    return topology.adjacent_frames(w.bonds)


@query("link_molecules", sql("SELECT * FROM links", "links"))
def link_molecules(w: World) -> DataFrame:
    return reactions.link_molecules(w.packed_molecules, topology.adjacent_frames(w.packed_molecules))


@query("align_thermo", sql("SELECT parameter, step, sim, round(CASE WHEN isnan(value) THEN NULL ELSE value END, 6) AS value FROM (SELECT *, count(*) OVER (PARTITION BY parameter, step) AS have FROM thermo) JOIN (SELECT parameter, count(DISTINCT sim) AS want FROM thermo GROUP BY parameter) USING (parameter) WHERE have = want", "thermo"))
def align_thermo(w: World) -> DataFrame:
    return thermo.align_thermo(w.thermo).select("parameter", "step", "sim", F.round(F.nanvl("value", F.lit(None)), 6).alias("value"))


@query("pair_join", rdf_sql("SELECT sim, timestep, count(*) AS n, round(sum(d) / count(*), 5) AS mean_d, round(min(d), 6) AS min_d, round(max(d), 6) AS max_d FROM pair GROUP BY sim, timestep"))
def pair_join(w: World) -> DataFrame:
    pairs = rdf.pair_join(w.atoms_named, w.frames, A, B)
    return pairs.groupBy("sim", "timestep").agg(F.count("*").alias("n"), F.round(F.sum("d") / F.count("*"), 5).alias("mean_d"), F.round(F.min("d"), 6).alias("min_d"), F.round(F.max("d"), 6).alias("max_d"))


@query("formula_smiles", sql("SELECT sim, timestep, mol_idx, formula, formula AS label FROM formulas", "formulas"))
def formula_smiles(w: World) -> DataFrame:
    return topology.formula_smiles(w.packed_molecules)


def first_events(w: World) -> DataFrame:
    """The first event of each of the ten commonest reactions."""
    found = store.materialize(events(w), "events")
    top = reactions.top_reactions(reactions.reaction_path_table(found, SIMS), 10).select("reaction")
    first = store.materialize(reactions.first_reaction_occurrence(found.join(F.broadcast(top), "reaction", "left_semi")), "first")
    # their atoms are looked up in their own frames, at most two for each
    steps = first.select("sim", F.explode(F.array("t1", "t2")).alias("timestep")).distinct()
    own = packed.molecule_rows(w.packed_molecules.join(F.broadcast(steps), ["sim", "timestep"], "left_semi"))
    return reactions.reaction_events(own).join(F.broadcast(first.select("sim", "t1", "t2", "cluster")), ["sim", "t1", "t2", "cluster"], "left_semi")


#: Places that the atoms of the bond frames are given, by id and frame; the box is the trajectory's.
PLACES = {"x": (37, 11), "y": (53, 7), "z": (71, 3)}
FIRST_SQL = sql("", "rx", "ranks", "members", "elements").rstrip() + f""",
firsts AS (SELECT rx.* FROM rx JOIN ranks USING (reaction) WHERE ranks.rank <= 10 QUALIFY row_number() OVER (PARTITION BY reaction ORDER BY sim, t1, cluster) = 1),
ids AS (SELECT f.sim, f.t1, f.t2, f.cluster, c.side, m.atom_id FROM firsts f JOIN clusters c USING (sim, t1, t2, cluster) JOIN members m ON m.sim = f.sim AND m.mol_idx = c.mol_idx AND m.timestep = CASE c.side WHEN 1 THEN f.t1 ELSE f.t2 END),
top AS (SELECT max(atom_id) AS m FROM bond_atoms)
SELECT f.sim, f.t1, f.t2, f.cluster, s.side, a.atom_id + CASE s.side WHEN 2 THEN m ELSE 0 END AS scene_id, a.element, round((a.atom_id * 37 + a.timestep * 11) % 3500 / 100.0 + {BOX} * 0.675 * CASE s.side WHEN 1 THEN -1 ELSE 1 END, 6) AS x, i.atom_id IS NOT NULL AS in_reaction
FROM firsts f CROSS JOIN (VALUES (1), (2)) s(side) CROSS JOIN top JOIN bond_atoms a ON a.sim = f.sim AND a.timestep = CASE s.side WHEN 1 THEN f.t1 ELSE f.t2 END
LEFT JOIN ids i ON i.sim = f.sim AND i.t1 = f.t1 AND i.cluster = f.cluster AND i.side = s.side AND i.atom_id = a.atom_id"""


@query("reaction_scene_atoms", FIRST_SQL)
def reaction_scene_atoms(w: World) -> DataFrame:
    """Scenes of real events: all atoms of both frames, those that react marked."""
    at = {c: F.pmod(F.col("atom_id") * i + F.col("timestep") * t, F.lit(3500)) / 100.0 for c, (i, t) in PLACES.items()}
    atoms = w.bond_atoms.select("sim", "timestep", "frame_ord", "atom_id", "atom_type", *(v.alias(c) for c, v in at.items()))
    frames = w.bond_frames.select("*", *(F.lit(v).alias(f"{c}{s}") for c in "xyz" for s, v in (("lo", 0.0), ("hi", BOX))))
    out = scene.reaction_scene_atoms(first_events(w), atoms, frames, w.elements)
    return out.select("sim", "t1", "t2", "cluster", "side", "scene_id", "element", F.round("x", 6).alias("x"), "in_reaction")


@query("reaction_scene_bonds", sql("SELECT p.sim, t1, t2, side, atom_i + CASE side WHEN 2 THEN m ELSE 0 END AS i, atom_j + CASE side WHEN 2 THEN m ELSE 0 END AS j, CASE WHEN bond_order >= 2.5 THEN 3 WHEN bond_order >= 1.5 THEN 2 ELSE 1 END AS bond_type, row_number() OVER (PARTITION BY p.sim, t1, t2 ORDER BY side, atom_i, atom_j) AS bond_id FROM pairs p CROSS JOIN (VALUES (1), (2)) s(side) CROSS JOIN (SELECT max(atom_id) AS m FROM bond_atoms) JOIN bonds b ON b.sim = p.sim AND b.timestep = CASE side WHEN 1 THEN t1 ELSE t2 END", "pairs", "bonds", "bond_atoms"))
def reaction_scene_bonds(w: World) -> DataFrame:
    pairs = topology.adjacent_frames(w.bonds).select("sim", "t1", "t2", F.lit(0).alias("cluster"))
    top = w.bond_atoms.groupBy("sim", "timestep").agg(F.max("atom_id").alias("top"))
    bonds = w.bonds.withColumn("bond_type", scalars.bond_type(F.col("bond_order")))
    return scene.reaction_scene_bonds(pairs, bonds, top).select("sim", "t1", "t2", "side", "i", "j", "bond_type", F.col("bond_id").cast("bigint").alias("bond_id"))


# Aggregations ----------------------------------------------------------------------------------------


@query("molecule_components", sql("SELECT sim, timestep, atom_id, component, mol_idx FROM members", "members"))
def molecule_components(w: World) -> DataFrame:
    return topology.molecule_components(w.packed_atoms, w.bonds)


@query("iterative_components", sql("SELECT sim, timestep, atom_id, component FROM members", "members"))
def iterative_components(w: World) -> DataFrame:
    return topology.iterative_components(w.packed_atoms, w.bonds)


@query("reaction_clusters", sql("SELECT sim, t1, t2, side, mol_idx, cluster FROM clusters", "clusters"))
def reaction_clusters(w: World) -> DataFrame:
    """Clusters named by their smallest node, products standing behind all reactants."""
    pairs = store.materialize(topology.adjacent_frames(w.packed_molecules), "pairs")
    own = lambda t, s: pairs.join(w.molecules.select("sim", F.col("timestep").alias(t), "mol_idx"), ["sim", t]).select("sim", "t1", "t2", F.lit(s).alias("side"), "mol_idx")
    found = reactions.reaction_clusters(own("t1", 1).unionByName(own("t2", 2)), reactions.link_molecules(w.packed_molecules, pairs))
    place = F.col("mol_idx") + F.when(F.col("side") == 2, 1 << 30).otherwise(0)
    least = found.groupBy("sim", "t1", "t2", "cluster").agg(F.min(place).cast("int").alias("least"))
    return found.join(least, ["sim", "t1", "t2", "cluster"]).select("sim", "t1", "t2", "side", "mol_idx", F.col("least").alias("cluster"))


@query("reaction_events", sql("SELECT sim, t1, t2, cluster, reaction FROM rx", "rx"))
def reaction_events(w: World) -> DataFrame:
    return events(w).select("sim", "t1", "t2", "cluster", "reaction")


@query("count_reaction_paths", sql("SELECT sim, reaction, n, CAST(rank AS INTEGER) AS rank FROM counts", "counts"))
def count_reaction_paths(w: World) -> DataFrame:
    return reactions.count_reaction_paths(events(w))


@query("reaction_path_table", f"SELECT CAST(rank AS INTEGER) AS rank, reaction, sim_1, sim_2, sim_3, total FROM ({WIDE})")
def reaction_path_table(w: World) -> DataFrame:
    return reactions.reaction_path_table(events(w), SIMS)


AGGREGATED = "SELECT parameter, step, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std FROM (SELECT *, CASE WHEN isnan(value) THEN NULL ELSE value END AS v, count(*) OVER (PARTITION BY parameter, step) AS have FROM thermo) JOIN (SELECT parameter, count(DISTINCT sim) AS want FROM thermo GROUP BY parameter) USING (parameter) WHERE have = want GROUP BY parameter, step"


@query("aggregate_thermo", sql(f"SELECT step, mean, std FROM ({AGGREGATED}) WHERE parameter = 'Temp'", "thermo"))
def aggregate_thermo(w: World) -> DataFrame:
    return thermo.aggregate_thermo(w.thermo, "Temp").select("step", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("aggregate_thermo_all", sql(AGGREGATED, "thermo"))
def aggregate_thermo_all(w: World) -> DataFrame:
    return thermo.aggregate_thermo_all(w.thermo).select("parameter", "step", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("thermo_band", sql(f"SELECT parameter, step, round(mean - std, 4) AS lower, round(mean + std, 4) AS upper FROM ({AGGREGATED})", "thermo"))
def thermo_band(w: World) -> DataFrame:
    """Rounded as SQL does it: the scaled double, not its decimal digits, as halves are common at four places."""
    scaled = lambda c, places: F.round(F.col(c) * 10.0**places) / 10.0**places
    own = thermo.aggregate_thermo_all(w.thermo).select("parameter", "step", scaled("mean", 6).alias("mean"), scaled("std", 6).alias("std"))
    return thermo.thermo_band(own).select("parameter", "step", scaled("lower", 4).alias("lower"), scaled("upper", 4).alias("upper"))


@query("thermo_bounds", sql("SELECT parameter, min(step) AS step_min, max(step) AS step_max, round(min(CASE WHEN isnan(value) THEN NULL ELSE value END), 6) AS y_min, round(max(CASE WHEN isnan(value) THEN NULL ELSE value END), 6) AS y_max FROM thermo GROUP BY parameter", "thermo"))
def thermo_bounds(w: World) -> DataFrame:
    return thermo.thermo_bounds(w.thermo).select("parameter", "step_min", "step_max", F.round("y_min", 6).alias("y_min"), F.round("y_max", 6).alias("y_max"))


@query("thermo_parameters", sql("SELECT parameter, CAST(row_number() OVER (ORDER BY CASE parameter WHEN 'Temp' THEN 0 WHEN 'Press' THEN 3 ELSE 5 END) - 1 AS INTEGER) AS pos FROM (SELECT DISTINCT parameter FROM thermo) WHERE parameter IN ('Temp', 'Press', 'Density')", "thermo"))
def thermo_parameters(w: World) -> DataFrame:
    return thermo.thermo_parameters(w.thermo)


@query("rdf_rmax", sql(f"SELECT DISTINCT sim, {BOX / 2} AS r_max FROM atoms", "atoms"))
def rdf_rmax(w: World) -> DataFrame:
    return rdf.rdf_rmax(w.frames)


BINS = round(BOX / 2 / WIDTH)
BIN_SQL = f"bins AS (SELECT sim, CAST(i AS INTEGER) AS bin, i * {WIDTH} AS lo, (i + 1) * {WIDTH} AS hi, (i + 0.5) * {WIDTH} AS r FROM (SELECT DISTINCT sim FROM atoms), generate_series(0, {BINS - 1}) g(i))"


@query("rdf_bins", rdf_sql("SELECT sim, bin, lo, hi, r FROM bins", BIN_SQL))
def rdf_bins(w: World) -> DataFrame:
    return rdf.rdf_bins(rdf.rdf_rmax(w.frames), WIDTH)


HIST_SQL = f"hist AS (SELECT sim, timestep, CAST(CASE WHEN d = {BINS * WIDTH} THEN {BINS - 1} ELSE floor(d / {WIDTH}) END AS INTEGER) AS bin, count(*) AS n FROM pair WHERE d <= {BINS * WIDTH} GROUP BY ALL)"


@query("rdf_histogram", rdf_sql("SELECT sim, timestep, bin, n FROM hist", HIST_SQL))
def rdf_histogram(w: World) -> DataFrame:
    bins = rdf.rdf_bins(rdf.rdf_rmax(w.frames), WIDTH)
    return rdf.rdf_histogram(rdf.pair_join(w.atoms_named, w.frames, A, B), bins, WIDTH).select("sim", "timestep", "bin", "n")


@query("block_histogram", rdf_sql("SELECT sim, timestep, bin, n FROM hist", HIST_SQL))
def block_histogram(w: World) -> DataFrame:
    bins = rdf.rdf_bins(rdf.rdf_rmax(w.frames), WIDTH)
    return rdf.block_histogram(w.atoms_named, w.frames, bins, A, B, WIDTH).select("sim", "timestep", "bin", "n")


USED_SQL = f"used AS (SELECT sim, timestep, count(*) FILTER (element = '{A}') AS n_a, count(*) FILTER (element = '{B}') AS n_b FROM atoms GROUP BY sim, timestep HAVING n_a > 0 AND n_b > 0)"
CURVE_SQL = f"curve AS (SELECT u.sim, u.timestep, b.bin, b.r, coalesce(h.n, 0) / (u.n_a * 4 * pi() * b.r * b.r * {WIDTH}) / (u.n_b / {BOX ** 3}) AS g FROM used u JOIN bins b USING (sim) LEFT JOIN hist h ON h.sim = u.sim AND h.timestep = u.timestep AND h.bin = b.bin)"


@query("frame_rdf", rdf_sql("SELECT sim, timestep, bin, r, round(g, 6) AS g FROM curve", BIN_SQL, HIST_SQL, USED_SQL, CURVE_SQL))
def frame_rdf(w: World) -> DataFrame:
    bins = rdf.rdf_bins(rdf.rdf_rmax(w.frames), WIDTH)
    curve = rdf.frame_rdf(rdf.block_histogram(w.atoms_named, w.frames, bins, A, B, WIDTH), rdf.used_frames(w.atoms_named, w.frames, A, B), bins, WIDTH, False)
    return curve.select("sim", "timestep", "bin", "r", F.round("g", 6).alias("g"))


@query("radial_distribution", rdf_sql("SELECT sim, bin, any_value(r) AS r, round(avg(g), 6) AS g FROM curve GROUP BY sim, bin", BIN_SQL, HIST_SQL, USED_SQL, CURVE_SQL))
def radial_distribution(w: World) -> DataFrame:
    return rdf.radial_distribution(w.atoms_named, w.frames, A, B, WIDTH).select("sim", "bin", "r", F.round("g", 6).alias("g"))


@query("rdf_timesteps_used", rdf_sql("SELECT sim, min(timestep) AS first, max(timestep) AS last, count(DISTINCT timestep) AS n FROM used GROUP BY sim", USED_SQL))
def rdf_timesteps_used(w: World) -> DataFrame:
    return rdf.rdf_timesteps_used(rdf.used_frames(w.atoms_named, w.frames, A, B))


@query("species_list", sql("SELECT DISTINCT species FROM species", "species"))
def species_list(w: World) -> DataFrame:
    return species.species_list(w.species)


@query("species_wide", sql("SELECT sim, timestep, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (species = '{s}'), 0) AS BIGINT) AS {s}" for s in SPECIES) + " FROM species GROUP BY sim, timestep", "species"))
def species_wide(w: World) -> DataFrame:
    return species.species_wide(w.species, SPECIES)


@query("formulas_observed", sql("SELECT DISTINCT sim, formula FROM formulas", "formulas"))
def formulas_observed(w: World) -> DataFrame:
    return topology.formulas_observed(w.packed_molecules)


@query("smiles_for_formula", sql("SELECT DISTINCT sim, formula, formula AS label FROM formulas", "formulas"))
def smiles_for_formula(w: World) -> DataFrame:
    return topology.smiles_for_formula(w.packed_molecules)


@query("first_appearance", sql("SELECT sim, formula AS value, min(timestep) AS timestep, arg_min(mol_idx, (timestep, mol_idx)) AS mol_idx FROM formulas GROUP BY sim, formula", "formulas"))
def first_appearance(w: World) -> DataFrame:
    return topology.first_appearance(w.packed_molecules, frames=w.bond_frames)


@query("atom_evolution", sql("SELECT sim, atom_id, string_agg(label, ',' ORDER BY timestep) AS labels FROM labelled GROUP BY sim, atom_id", "labelled"))
def atom_evolution(w: World) -> DataFrame:
    return topology.atom_evolution(w.packed_molecules, w.bond_frames).select("sim", "atom_id", F.array_join(F.transform("labels", lambda x: x.label), ",").alias("labels"))


RUNS_SQL = """SELECT sim, atom_id, CAST(run AS INTEGER) AS run, any_value(label) AS label, min(timestep) AS first, max(timestep) AS last, count(*) AS n
FROM (SELECT *, sum(new) OVER (PARTITION BY sim, atom_id ORDER BY timestep) AS run FROM (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY sim, atom_id ORDER BY timestep) = label THEN 0 ELSE 1 END AS new FROM labelled)) GROUP BY sim, atom_id, run"""


@query("atom_runs", sql(RUNS_SQL, "labelled"))
def atom_runs(w: World) -> DataFrame:
    return topology.atom_runs(w.packed_molecules, w.bond_frames).drop("begin", "end")


@query("components_of_any_size", sql("SELECT sim, timestep, atom_id, component, mol_idx FROM members", "members"))
def components_of_any_size(w: World) -> DataFrame:
    """Frames above the mean size go by stars, the others by task."""
    most = w.bonds.groupBy("sim", "timestep").agg(F.count("*").alias("n")).agg(F.avg("n")).first()[0] or 0
    atoms = w.table("supplier").count() * REPLICAS
    return topology.components_of_any_size(w.bond_atoms, w.bonds, int(atoms + most))


@query("match_compositions", sql("SELECT DISTINCT reverse_name AS species, formula FROM (SELECT formula, list_aggregate(list_reverse(regexp_extract_all(formula, '[A-Z][a-z]?[0-9]*')), 'string_agg', '') AS reverse_name FROM formulas)", "formulas"))
def match_compositions(w: World) -> DataFrame:
    """Formulas with their elements written backwards, as another program might, find their Hill formulas."""
    parts = F.regexp_extract_all("formula", F.lit("[A-Z][a-z]?[0-9]*"), F.lit(0))
    known = topology.formulas_observed(w.packed_molecules)
    return species.match_compositions(known.select(F.array_join(F.reverse(parts), "").alias("species")), known)


# Windows, sorts, top-k -------------------------------------------------------------------------------


@query("dedupe_frames", sql("SELECT sim, timestep // 2 AS timestep, max(timestep) AS frame_ord FROM (SELECT DISTINCT sim, timestep FROM bonds) GROUP BY sim, timestep // 2", "bonds"))
def dedupe_frames(w: World) -> DataFrame:
    """Frames whose halved timesteps repeat."""
    frames = w.bonds.select("sim", F.floor(F.col("timestep") / 2).alias("timestep"), F.col("timestep").alias("frame_ord")).distinct()
    return topology.dedupe_frames(frames).select("sim", "timestep", "frame_ord")


@query("live_reactions")
def live_reactions(w: World) -> DataFrame:
    """The reactions of the bond files, read as a stream until its end, whose last watermark settles every frame."""
    files = w.bond_files
    folder = files.first().path.rpartition("/")[0]
    path = store.shared_path(w.spark, "live")
    stream = live.stream_reactions(w.spark, folder, w.elements, sim=r"/sim=(\d+)/")
    query = stream.writeStream.format("parquet").option("path", f"{path}/events").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return w.spark.read.schema(live.EVENTS).parquet(f"{path}/events")


@query("rank_reactions", sql("SELECT reaction, total, CAST(rank AS INTEGER) AS rank FROM ranks", "ranks"))
def rank_reactions(w: World) -> DataFrame:
    return reactions.rank_reactions(store.materialize(reactions.count_reaction_paths(events(w)), "counts"))


@query("last_timesteps", sql("SELECT min(timestep) AS first, max(timestep) AS last FROM (SELECT DISTINCT timestep FROM bonds ORDER BY timestep DESC LIMIT 5)", "bonds"))
def last_timesteps(w: World) -> DataFrame:
    return rdf.last_timesteps(w.bonds)


@query("first_reaction_occurrence", sql("SELECT reaction, sim, t1, t2, cluster FROM rx QUALIFY row_number() OVER (PARTITION BY reaction ORDER BY sim, t1, cluster) = 1", "rx"))
def first_reaction_occurrence(w: World) -> DataFrame:
    return reactions.first_reaction_occurrence(events(w)).select("reaction", "sim", "t1", "t2", "cluster")


@query("top_reactions", sql("SELECT CAST(rank AS INTEGER) AS rank, reaction, total FROM ranks WHERE rank <= 10", "ranks"))
def top_reactions(w: World) -> DataFrame:
    return reactions.top_reactions(reactions.reaction_path_table(events(w), SIMS), 10).select("rank", "reaction", "total")


# Quality ---------------------------------------------------------------------------------------------

FINDING = ["severity", "sim", "topic", "message"]


def unknown_types(w: World) -> DataFrame:
    types = w.bond_atoms.select("sim", F.lit("bonds").alias("topic"), "atom_type").unionByName(quality.first_frame_types(w.atoms))
    return quality.check_atom_types(types, w.elements.where("atom_type < 3"))


def headers(w: World) -> DataFrame:
    frames = readers.parse_frames(readers.trajectory_chunks(w.spark, w.trajectory_files))
    first = frames.groupBy("sim").agg(F.min_by("columns", "frame_ord").alias("columns"))
    return first.select("sim", F.when(F.col("sim") == 2, F.filter("columns", lambda c: ~c.isin("type", "xu"))).otherwise(F.col("columns")).alias("columns"))


TYPES_SQL = sql("SELECT 'error' AS severity, sim, topic, 'unknown atom types: ' || string_agg(atom_type, ', ' ORDER BY atom_type) AS message FROM (SELECT DISTINCT sim, 'bonds' AS topic, atom_type FROM bond_atoms UNION ALL SELECT DISTINCT sim, 'trajectory', atom_type FROM atoms JOIN (SELECT sim, min(timestep) AS timestep FROM atoms GROUP BY sim) USING (sim, timestep)) WHERE atom_type >= 3 GROUP BY sim, topic", "bond_atoms", "atoms")
TOPICS_SQL = sql("SELECT 'warning' AS severity, sim, CAST(NULL AS VARCHAR) AS topic, 'missing topics: ' || string_agg(topic, ', ' ORDER BY topic) AS message FROM (SELECT s.sim, t.topic FROM (SELECT DISTINCT sim FROM manifest) s CROSS JOIN (SELECT DISTINCT topic FROM manifest) t EXCEPT SELECT sim, topic FROM manifest) GROUP BY sim", "manifest")
FILES_SQL = sql("SELECT 'error' AS severity, sim, topic, 'missing file: ' || path AS message FROM manifest WHERE sim = 2", "manifest")
COLUMNS_SQL = sql("SELECT DISTINCT 'error' AS severity, sim, 'trajectory' AS topic, 'trajectory lacks: type, coordinates' AS message FROM atoms WHERE sim = 2", "atoms")
SYMMETRY_SQL = sql("SELECT 'error' AS severity, sim, 'bonds' AS topic, 'timestep ' || timestep || ': ' || count(*) || ' one-sided bonds, such as ' || arg_min(atom_i, (atom_i, atom_j)) || '-' || arg_min(atom_j, (atom_i, atom_j)) AS message FROM bonds WHERE bond_order = 2 GROUP BY sim, timestep", "bonds")
DANGLING_SQL = sql("SELECT 'error' AS severity, sim, 'bonds' AS topic, 'timestep ' || timestep || ': ' || count(*) || ' bonds to unknown atoms, such as ' || min(other) AS message FROM (SELECT sim, timestep, atom_j AS other FROM bonds UNION ALL SELECT sim, timestep, atom_i FROM bonds WHERE bond_order <> 2) WHERE other % 7 = 3 GROUP BY sim, timestep", "bonds")
NO_ELEMENTS_SQL = "SELECT CASE n WHEN 0 THEN 'error' ELSE 'ok' END AS severity, CAST(NULL AS INTEGER) AS sim, CAST(NULL AS VARCHAR) AS topic, CASE n WHEN 0 THEN 'element_list is empty' ELSE 'no issues found' END AS message FROM (SELECT count(*) AS n FROM supplier)"


@query("check_element_list", NO_ELEMENTS_SQL)
def check_element_list(w: World) -> DataFrame:
    """The elements that the suppliers, as atoms, are of."""
    types = w.table("supplier").select((F.col("s_suppkey") % 4 + 1).cast("int").alias("atom_type")).distinct()
    return quality.validation_report(quality.check_element_list(types.join(w.elements, "atom_type"))).select(*FINDING)


def missing_files(w: World) -> DataFrame:
    """The manifest over files that are written for all simulations but the second."""
    base = store.shared_path(w.spark, "manifest")
    w.manifest.where("sim <> 2").select(F.col("path").alias("file"), F.col("topic").alias("value")).write.partitionBy("file").text(base)
    placed = w.manifest.withColumn("path", F.concat(F.lit(f"{base}/file="), "path"))
    found = quality.check_missing_files(placed, quality.existing_files(placed))
    return found.withColumn("message", F.regexp_replace("message", "missing file: .*/file=", "missing file: "))


@query("check_missing_files", FILES_SQL)
def check_missing_files(w: World) -> DataFrame:
    return missing_files(w).select(*FINDING)


def directed(w: World) -> DataFrame:
    """Every bond as both of its atoms list it, but for those of whole tenth orders, which their upper atom leaves out."""
    one = w.bonds.select("sim", "timestep", F.col("atom_i").alias("atom_id"), F.col("atom_j").alias("other"), "bond_order")
    return one.unionByName(w.bonds.where("bond_order <> 2").select("sim", "timestep", F.col("atom_j").alias("atom_id"), F.col("atom_i").alias("other"), "bond_order"))


@query("check_bond_symmetry", SYMMETRY_SQL)
def check_bond_symmetry(w: World) -> DataFrame:
    return quality.check_bond_symmetry(directed(w)).select(*FINDING)


@query("check_dangling_bonds", DANGLING_SQL)
def check_dangling_bonds(w: World) -> DataFrame:
    """Atoms whose id leaves 3 by 7 are missing from their frames."""
    return quality.check_dangling_bonds(directed(w), w.bond_atoms.where("atom_id % 7 <> 3")).select(*FINDING)


@query("check_topic_consistency", TOPICS_SQL)
def check_topic_consistency(w: World) -> DataFrame:
    return quality.check_topic_consistency(w.manifest).select(*FINDING)


@query("check_atom_types", TYPES_SQL)
def check_atom_types(w: World) -> DataFrame:
    return unknown_types(w).select(*FINDING)


@query("check_trajectory_columns", COLUMNS_SQL)
def check_trajectory_columns(w: World) -> DataFrame:
    return quality.check_trajectory_columns(headers(w)).select(*FINDING)


@query("validation_report", " UNION ALL ".join(f"SELECT * FROM ({s})" for s in (FILES_SQL, TOPICS_SQL, TYPES_SQL, COLUMNS_SQL, SYMMETRY_SQL, DANGLING_SQL)))
def validation_report(w: World) -> DataFrame:
    found = [quality.check_element_list(w.elements), missing_files(w), quality.check_topic_consistency(w.manifest), unknown_types(w), quality.check_trajectory_columns(headers(w))]
    found += [quality.check_bond_symmetry(directed(w)), quality.check_dangling_bonds(directed(w), w.bond_atoms.where("atom_id % 7 <> 3"))]
    return quality.validation_report(*found).select(*FINDING)


