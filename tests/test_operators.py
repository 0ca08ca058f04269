import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mdspark.functions import scalars
from mdspark.functions.kernels import canonical_label, components, pair_histogram
from mdspark.operators import quality, rdf, reactions, thermo, topology
from mdspark.sources import store

MOLS = "sim int, timestep bigint, mol_idx int, label string, formula string, atom_ids array<bigint>"


def mols(spark, frames, sim=1):
    rows = [(sim, t, i, label, label, ids) for t, own in frames.items() for i, (label, ids) in enumerate(own)]
    return spark.createDataFrame(rows, MOLS)


def table(events, sims=(1,)):
    return [(r.reaction, r.total) for r in reactions.reaction_path_table(events, list(sims)).orderBy("rank").collect()]


SPLIT = {0: [("AB", [1, 2])], 1: [("A", [1]), ("B", [2])], 2: [("A", [1]), ("B", [2])], 3: [("AB", [1, 2])]}


@pytest.mark.parametrize("prune", [True, False])
def test_split_and_recombine(spark, prune):
    events = reactions.reaction_events(mols(spark, SPLIT), prune)
    assert table(events) == [("['AB'] -> ['A', 'B']", 1), ("['A', 'B'] -> ['AB']", 1)]
    first = reactions.find_reaction(events, "['AB'] -> ['A', 'B']").collect()[0]
    assert (first.t1, first.t2, first.reactant_atom_ids, first.product_atom_ids) == (0, 1, [1, 2], [1, 2])


@pytest.mark.parametrize(
    ("frames", "want"),
    [
        ({0: [("A", [1]), ("A", [2])], 1: [("A", [1, 2])]}, []),
        ({0: [("X", [1]), ("Z", [9])], 1: [("Z", [9])]}, ["['X'] -> []"]),
        ({0: [("Z", [9])], 1: [("Z", [9]), ("Y", [2])]}, ["[] -> ['Y']"]),
        ({0: [("A", [1, 2]), ("A", [3, 4])], 1: [("A", [1, 3]), ("A", [2, 4])]}, []),
        ({0: [("it's", [1])], 1: [("a\\b", [1])]}, ["[\"it's\"] -> ['a\\\\b']"]),
    ],
)
def test_reaction_cases(spark, frames, want):
    for prune in (True, False):
        assert [r.reaction for r in reactions.reaction_events(mols(spark, frames), prune).collect()] == want


def test_two_simulations(spark):
    both = mols(spark, {0: SPLIT[0], 1: SPLIT[1]}).union(mols(spark, {0: SPLIT[0], 1: SPLIT[1], 2: SPLIT[2]}, 2))
    row = reactions.reaction_path_table(reactions.reaction_events(both), [1, 2, 3]).collect()[0]
    assert (row.sim_1, row.sim_2, row.sim_3, row.total) == (1, 1, 0, 2)


def test_components_match_a_plain_search():
    r = np.random.default_rng(0)
    for _ in range(50):
        n, m = 20, int(r.integers(0, 25))
        a, b = r.integers(0, n, m), r.integers(0, n, m)
        want = list(range(n))
        for _ in range(n):
            for i, j in zip(a, b):
                want[i] = want[j] = min(want[i], want[j])
        assert components(n, a, b).tolist() == want


def test_canonical_labels():
    random.seed(4)
    shapes = set()
    for _ in range(40):
        n = random.randint(1, 7)
        el = [random.choice("CHO") for _ in range(n)]
        bonds = [(i, j, random.choice([1, 2])) for i, j in itertools.combinations(range(n), 2) if random.random() < 0.4]
        label = canonical_label(el, bonds)
        p = random.sample(range(n), n)
        moved = [el[p.index(i)] for i in range(n)]
        assert canonical_label(moved, [tuple(sorted((p[i], p[j]))) + (t,) for i, j, t in bonds]) == label
        shapes.add(label)
    ring = [(i, (i + 1) % 6, 1) for i in range(6)]
    two = [(0, 1, 1), (1, 2, 1), (0, 2, 1), (3, 4, 1), (4, 5, 1), (3, 5, 1)]
    fix = lambda e: [(min(i, j), max(i, j), t) for i, j, t in e]
    assert canonical_label(["C"] * 6, fix(ring)) != canonical_label(["C"] * 6, fix(two))


def test_thermo_mean_and_deviation(spark):
    nan = float("nan")
    rows = [(1, 0.0, 0, "Temp", 300.0), (1, 1.0, 1, "Temp", 310.0), (2, 0.0, 0, "Temp", 320.0), (2, 1.0, 1, "Temp", 330.0), (2, 2.0, 2, "Temp", 1.0), (1, 0.0, 0, "P", nan), (2, 0.0, 0, "P", 4.0), (1, 5.0, 0, "One", nan)]
    df = spark.createDataFrame(rows, "sim int, step double, row_ord int, parameter string, value double")
    got = {(r.parameter, r.step): (r["mean"], round(r["std"], 6)) for r in thermo.aggregate_thermo_all(df).collect()}
    assert got == {("Temp", 0.0): (310.0, 14.142136), ("Temp", 1.0): (320.0, 14.142136), ("P", 0.0): (4.0, 0.0), ("One", 5.0): (None, 0.0)}
    with pytest.raises(LookupError):
        thermo.aggregate_thermo(df, "Absent")


def test_repeated_steps_multiply(spark):
    rows = [(1, 0.0, 0, "T", 1.0), (1, 0.0, 1, "T", 3.0), (2, 0.0, 0, "T", 5.0)]
    df = spark.createDataFrame(rows, "sim int, step double, row_ord int, parameter string, value double")
    assert sorted(r["mean"] for r in thermo.aggregate_thermo_all(df).collect()) == [3.0, 4.0]


def rdf_world(spark, sides=(10.0,)):
    frames = spark.createDataFrame([(i + 1, 0, 0, 3, *[0.0, s] * 3) for i, s in enumerate(sides)], "sim int, timestep bigint, frame_ord bigint, n_atoms int, xlo double, xhi double, ylo double, yhi double, zlo double, zhi double")
    atoms = spark.createDataFrame([(i + 1, 0, 0, a, e, float(x), 0.0, 0.0) for i in range(len(sides)) for a, e, x in ((1, "Li", 0), (2, "O", 1.5), (3, "Li", 9))], "sim int, timestep bigint, frame_ord bigint, atom_id bigint, element string, x double, y double, z double")
    return frames, atoms


def test_rdf_grid_per_simulation(spark):
    frames, atoms = rdf_world(spark, (10.0, 8.0))
    got = rdf.radial_distribution(atoms, frames, "Li", "O", 1.0)
    last = {r.sim: r.r for r in got.groupBy("sim").agg(F.max("r").alias("r")).collect()}
    assert last == {1: 4.5, 2: 3.5}
    assert got.where("g > 0").count() > 0


def test_same_element_has_no_self_distance(spark):
    frames, atoms = rdf_world(spark)
    bins = rdf.rdf_bins(rdf.rdf_rmax(frames), 1.0)
    assert [(r.bin, r.n) for r in rdf.block_histogram(atoms, frames, bins, "Li", "Li", 1.0).collect()] == [(1, 1)]
    with pytest.raises(ValueError, match="Bin width"):
        rdf.rdf_bins(rdf.rdf_rmax(frames), 0)


def test_pair_histogram_closes_the_last_bin():
    a, b = np.array([[1, 0.0, 0, 0]]), np.array([[2, 1.0, 0, 0], [3, 2.0, 0, 0]])
    assert pair_histogram(a, b, np.array([100.0] * 3), 1.0, 2, False).tolist() == [0, 2]


def test_frames_and_labels(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 6, 3)], "sim int, timestep bigint, frame_ord bigint")
    assert {r.frame_ord for r in topology.dedupe_frames(df).collect()} == {2, 3}
    assert {r.frame_ord for r in rdf.frame_at(df, 5).collect()} == {1}
    with pytest.raises(LookupError):
        rdf.frame_at(df, 99)
    lo, hi = scalars.padded_range(F.lit(-300.0), F.lit(-300.0))
    assert spark.range(1).select(lo, hi).first()[:] == (-303.0, -297.0)


def test_validation(spark):
    elements = spark.createDataFrame([(1, "C")], "atom_type int, element string")
    types = spark.createDataFrame([(1, "bonds", 1), (1, "bonds", 3), (1, "bonds", 2)], "sim int, topic string, atom_type int")
    found = quality.validation_report(quality.check_element_list(elements), quality.check_atom_types(types, elements))
    assert [(r.severity, r.message) for r in found.collect()] == [("error", "unknown atom types: 2, 3")]
    assert quality.has_errors(found)
    clean = quality.validation_report(quality.check_element_list(elements))
    assert [r.severity for r in clean.collect()] == ["ok"]
    headers = spark.createDataFrame([(1, ["id", "type", "x", "y", "z"]), (2, ["id", "xu", "yu"]), (3, None)], "sim int, columns array<string>")
    assert sorted(r.message for r in quality.check_trajectory_columns(headers).collect()) == ["trajectory lacks: atom table", "trajectory lacks: type, coordinates"]


def test_bonds_of_a_timestep(spark):
    bonds = spark.createDataFrame([(1, 5, 0, 1, 2), (1, 5, 9, 1, 3), (1, 6, 10, 1, 2)], "sim int, timestep bigint, frame_ord bigint, atom_i bigint, atom_j bigint")
    frames = bonds.select("sim", "timestep", "frame_ord").distinct()
    assert [(r.atom_i, r.atom_j) for r in topology.bonds_at(frames, bonds, 5).collect()] == [(1, 2)]
    with pytest.raises(LookupError):
        topology.bonds_at(frames, bonds, 7)


def test_first_event_and_unknown_simulation(spark):
    events = spark.createDataFrame([(1, 4, 5, 0, "a"), (1, 2, 4, 3, "a"), (1, 2, 4, 1, "b"), (2, 9, 10, 0, "a")], "sim int, t1 bigint, t2 bigint, cluster int, reaction string")
    assert sorted(tuple(r) for r in reactions.find_reaction(events, "a", True).collect()) == [(1, 2, 4, 3, "a"), (2, 9, 10, 0, "a")]
    assert reactions.find_reaction(events).count() == 4
    manifest = spark.createDataFrame([(1, "bonds", "x")], "sim int, topic string, path string")
    assert reactions.simulation(manifest, 1).count() == 1
    with pytest.raises(LookupError):
        reactions.simulation(manifest, 2)


def test_file_order_not_time_decides(spark):
    frames = spark.createDataFrame([(1, 20, 0), (1, 10, 1)], "sim int, timestep bigint, frame_ord bigint")
    mols = spark.createDataFrame([(1, 20, 0, "A"), (1, 10, 0, "A"), (1, 10, 1, "B")], "sim int, timestep bigint, mol_idx int, label string")
    assert {r.value: r.timestep for r in topology.first_appearance(mols, frames=frames).collect()} == {"A": 20, "B": 10}
    own = spark.createDataFrame([(1, 10, 7, "B"), (1, 20, 7, "A")], "sim int, timestep bigint, atom_id bigint, label string")
    assert [x.label for x in topology.atom_evolution(own, frames).first().labels] == ["A", "B"]


def test_types_of_the_first_frame_only(spark):
    atoms = spark.createDataFrame([(1, 0, 1), (1, 0, 9), (1, 5, 8)], "sim int, frame_ord bigint, atom_type int")
    assert sorted((r.topic, r.atom_type) for r in quality.first_frame_types(atoms).collect()) == [("trajectory", 1), ("trajectory", 9)]


def test_files_that_are_there(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    manifest = spark.createDataFrame([(1, "bonds", str(tmp_path / "a")), (1, "thermo", str(tmp_path / "b"))], "sim int, topic string, path string")
    assert [r.path for r in quality.existing_files(manifest).collect()] == [str(tmp_path / "a")]


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).selectExpr("pmod(id * 7919, 1000) AS v").repartition(7)
    assert all(r.n == r.v + 1 for r in store.numbered(df, "n", "v").collect())
    assert store.numbered(df.where("v < 0"), "n", "v").collect() == []


def test_labels_of_symmetric_molecules():
    """Rings around one atom, numbered at random: one label, in little time."""
    for rings in (3, 8):
        bonds = [(0, 1 + 6 * r, 1) for r in range(rings)] + [(1 + 6 * r + k, 1 + 6 * r + (k + 1) % 6, 1) for r in range(rings) for k in range(6)]
        n, found = 1 + 6 * rings, set()
        for seed in range(4):
            p = list(range(n))
            random.Random(seed).shuffle(p)
            found.add(canonical_label(["C"] * n, [(p[i], p[j], t) for i, j, t in bonds]))
        assert len(found) == 1


def test_labels_tell_graphs_apart_and_agree_on_equal_ones():
    r = random.Random(4)
    for _ in range(300):
        n = r.randrange(1, 7)
        elements = [r.choice("CO") for _ in range(n)]
        bonds = [(i, j, r.choice([1, 2])) for i, j in itertools.combinations(range(n), 2) if r.random() < 0.5]
        p = list(range(n))
        r.shuffle(p)
        moved = [elements[p.index(i)] for i in range(n)], [(p[i], p[j], t) for i, j, t in bonds]
        assert canonical_label(elements, bonds) == canonical_label(*moved)
        plain = lambda e, b: min((tuple(e[i] for i in q), tuple(sorted((*sorted((q.index(i), q.index(j))), t) for i, j, t in b))) for q in itertools.permutations(range(n)))
        other = [(i, j, 3 - t if k == 0 else t) for k, (i, j, t) in enumerate(bonds)]
        assert (canonical_label(elements, bonds) == canonical_label(elements, other)) == (plain(elements, bonds) == plain(elements, other))
