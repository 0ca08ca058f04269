"""Components of large frames, runs of labels, bond findings, pair tiles and thermo combinations."""

import itertools

import numpy as np
import pytest

from mdspark.functions.kernels import components
from mdspark.operators import quality, rdf, thermo, topology
from mdspark.sources import readers

ATOM, BOND = "sim int, timestep bigint, atom_id bigint", "sim int, timestep bigint, atom_i bigint, atom_j bigint"


def test_rounds_do_not_follow_the_length_of_a_path(spark):
    """A path of 2000 atoms in scattered order, blocks of 16 edges."""
    n = 2000
    order = np.random.default_rng(1).permutation(n)
    atoms = spark.createDataFrame([(1, 0, i) for i in range(n + 1)], ATOM)
    bonds = spark.createDataFrame([(1, 0, int(min(a, b)), int(max(a, b))) for a, b in zip(order, order[1:])], BOND)
    found, rounds = topology.star_components(atoms, bonds, block=16)
    got = {r.atom_id: r.component for r in found.collect()}
    assert got == {**{i: 0 for i in range(n)}, n: n} and rounds <= 12


def test_components_of_any_size(spark):
    r = np.random.default_rng(2)
    atoms, bonds, want = [], [], {}
    for t, n in enumerate([5, 300, 40, 1]):
        a, b = r.integers(0, n, (2, n)) if n > 1 else np.zeros((2, 0), int)
        atoms += [(1, t, i) for i in range(n)]
        bonds += [(1, t, int(min(x, y)), int(max(x, y))) for x, y in zip(a, b) if x != y] + [(1, t, 0, 10**6)]
        root = components(n, a, b)
        rank = np.unique(root, return_inverse=True)[1]
        want |= {(t, i): (int(root[i]), int(rank[i])) for i in range(n)}
    for most in (0, 100, 10**6):
        got = topology.components_of_any_size(spark.createDataFrame(atoms, ATOM), spark.createDataFrame(bonds, BOND), most).collect()
        assert {(x.timestep, x.atom_id): (x.component, x.mol_idx) for x in got} == want and len(got) == len(want)


def test_runs_expand_to_the_evolution(spark):
    labels = {1: "AABBBA", 2: "CCCCCC", 3: "ABABAB"}
    rows = [(1, t * 10, a, c) for a, text in labels.items() for t, c in enumerate(text)]
    members = spark.createDataFrame(rows, "sim int, timestep bigint, atom_id bigint, label string")
    frames = members.selectExpr("sim", "timestep", "1000 - timestep AS frame_ord").distinct()  # the file runs backwards
    runs = topology.atom_runs(members, frames)
    assert [(r.label, r["first"], r["last"], r.n) for r in runs.where("atom_id = 1").orderBy("run").collect()] == [("A", 50, 50, 1), ("B", 40, 20, 3), ("A", 10, 0, 2)]
    assert runs.count() == 3 + 1 + 6
    got = {}
    for r in topology.expand_runs(runs, frames).orderBy("frame_ord").collect():
        got.setdefault(r.atom_id, []).append(r.label)
    old = {r.atom_id: [x.label for x in r.labels] for r in topology.atom_evolution(members, frames).collect()}
    assert got == old


def test_bond_findings(spark, tmp_path):
    text = "# Timestep 0\n# Number of particles 3\n1 1 2 2 9 0 1.0 1.0 0 0 0\n2 1 1 1 0 1.0 0 0 0\n3 1 1 1 0 1.0 0 0 0\n# Timestep 5\n# Number of particles 2\n1 1 0 0 0 0 0\n"
    (tmp_path / "b").write_text(text)
    elements = spark.createDataFrame([(1, "C")], "atom_type int, element string")
    files = spark.createDataFrame([(4, str(tmp_path / "b"))], "sim int, path string")
    frames, atoms, directed = readers.parse_rows(readers.read_frames(spark, files, readers.BOND_HEADER), elements)
    found = [quality.check_bond_symmetry(directed), quality.check_dangling_bonds(directed, atoms), quality.check_incomplete_frames(frames)]
    report = {r.ord: (r.severity, r.sim, r.message) for r in quality.validation_report(*found).collect()}
    assert report == {6: ("error", 4, "timestep 0: 2 one-sided bonds, such as 1-9"), 7: ("error", 4, "timestep 0: 1 bonds to unknown atoms, such as 9"), 8: ("warning", 4, "timestep 5: incomplete frame, 2 atoms announced")}


def test_files_that_are_there(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x").write_text("1")
    paths = [str(tmp_path / "a b" / "x"), str(tmp_path / "a b" / "y"), str(tmp_path / "a b"), str(tmp_path / "no" / "x")]
    manifest = spark.createDataFrame([(i, "bonds", p) for i, p in enumerate(paths)], "sim int, topic string, path string")
    assert sorted(r.sim for r in quality.check_missing_files(manifest, quality.existing_files(manifest)).collect()) == [1, 3]


@pytest.mark.parametrize("a,b", [("Li", "O"), ("O", "O")])
@pytest.mark.parametrize("block", [3, 4096])
def test_tiles_count_every_pair_once(spark, a, b, block):
    r = np.random.default_rng(6)
    rows = [(1, t, t, i, str(r.choice(["Li", "O"])), *map(float, r.uniform(0, 10, 3))) for t in (0, 1) for i in range(25)]
    atoms = spark.createDataFrame(rows, "sim int, timestep bigint, frame_ord bigint, atom_id bigint, element string, x double, y double, z double")
    frames = spark.createDataFrame([(1, t, t, 25, 0.0, 10.0, 0.0, 10.0, 0.0, 10.0) for t in (0, 1)], "sim int, timestep bigint, frame_ord bigint, n_atoms int, xlo double, xhi double, ylo double, yhi double, zlo double, zhi double")
    bins = rdf.rdf_bins(rdf.rdf_rmax(frames), 0.5)
    got = {(x.timestep, x.bin): x.n for x in rdf.block_histogram(atoms, frames, bins, a, b, 0.5, block).collect()}
    want = {(x.timestep, x.bin): x.n for x in rdf.rdf_histogram(rdf.pair_join(atoms, frames, a, b), bins, 0.5).collect()}
    assert got == want and sum(got.values()) > 50


def test_repeated_steps_stand_for_every_combination(spark):
    values = {1: [1.0, float("nan"), 4.0], 2: [2.5, 7.0], 3: [float("nan"), 1.5]}
    rows = [("T", 0.0, s, v) for s, own in values.items() for v in own] + [("T", 1.0, s, float(s)) for s in (1, 2, 3)] + [("T", 2.0, 1, 1.0)] + [("P", 0.0, s, v) for s in (1, 2) for v in (3.0, 5.0)]
    df = spark.createDataFrame(rows, "parameter string, step double, sim int, value double").selectExpr("*", "0L AS row_ord")
    got = sorted((r.parameter, r.step, None if r.mean is None else round(r.mean, 9), round(r.std, 9)) for r in thermo.aggregate_thermo_all(df).collect())
    want = [("T", 1.0, 2.0, 1.0)]
    for parameter, own in (("T", list(values.values())), ("P", [[3.0, 5.0], [3.0, 5.0]])):
        for combo in itertools.product(*own):
            x = [v for v in combo if v == v]
            want.append((parameter, 0.0, round(float(np.mean(x)), 9) if x else None, round(float(np.std(x, ddof=1)), 9) if len(x) > 1 else 0.0))
    key = lambda x: (x[0], x[1], x[2] is None, x[2] or 0, x[3])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_molecules_by_frame_are_molecules_by_joins(spark):
    r = np.random.default_rng(9)
    atoms = [(1, t, i, str(r.choice(["C", "H", "O"]))) for t in range(3) for i in range(40)]
    bonds = [(1, t, int(min(a, b)), int(max(a, b)), float(r.uniform(0.5, 3))) for t in range(3) for a, b in r.integers(0, 42, (30, 2)) if a != b]
    a = spark.createDataFrame(atoms, f"{ATOM}, element string")
    b = spark.createDataFrame(bonds, f"{BOND}, bond_order double").dropDuplicates(["timestep", "atom_i", "atom_j"]).cache()
    rows = lambda df: sorted((x.timestep, x.mol_idx, x.label, x.formula, x.atom_ids, x.n_atoms) for x in df.collect())
    one = rows(topology.molecules(a, b))
    assert one == rows(topology.molecules_of_members(topology.molecule_components(a, b), a, b))
    assert [x[3] for x in one] == [x[2] for x in rows(topology.molecules(a, b, "formula"))]
