"""Whole tables against plain Python on a small fixture."""

import collections
import datetime
import itertools
import random

import pytest

from mdspark.plans.queries import QUERIES

START, ELEMENTS, ATOMS, BOXES = datetime.date(1995, 1, 1), "C H Li O".split(), 6, 24


@pytest.fixture(scope="module")
def lines():
    """Light and heavy line items, most of them within six frames and one box, some years before and behind, some in other boxes."""
    r = random.Random(5)
    days = [30 * r.randrange(6) + r.randrange(30) if i % 6 else r.choice([-1100, 400, 900, 2600]) for i in range(90)]
    return [(i % 3 + 3 * (BOXES * (i // 3) + (0 if i % 7 else i % BOXES)), r.randrange(1000), r.randrange(ATOMS), r.randrange(1, 6), float(r.randrange(1, 51)), r.randrange(10000) / 100, r.randrange(11) / 100, 0.01, START + datetime.timedelta(d)) for i, d in enumerate(days)]


@pytest.fixture(scope="module")
def folder(spark, lines, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    schema = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate date"
    spark.createDataFrame(lines, schema).selectExpr("* EXCEPT (l_shipdate)", "cast(l_shipdate AS timestamp) AS l_shipdate").write.parquet(f"{out}/lineitem.parquet")
    spark.createDataFrame([(i,) for i in range(ATOMS)], "s_suppkey bigint").write.parquet(f"{out}/supplier.parquet")
    return out


def bonds_of(lines):
    """{(sim, timestep): {(i, j): order}}"""
    found, start = collections.defaultdict(dict), min(x[-1] for x in lines)
    for order, part, a, number, _, _, discount, _, day in lines:
        box = order // 3 % BOXES * ATOMS
        b = part % ATOMS + box
        a += box
        for k in range(min(4, number)) if a != b else ():
            own, key = found[order % 3 + 1, (day - start).days // 30 + k], (min(a, b), max(a, b))
            own[key] = max(own.get(key, 0), round(1 + 20 * discount, 6))
    return found


def parts(nodes, edges):
    """Connected sets of nodes, by their smallest."""
    group = {n: {n} for n in nodes}
    for a, b in edges:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for n in group[b]:
                group[n] = group[a]
    return sorted({min(g): sorted(g) for g in group.values()}.values())


@pytest.mark.parametrize("name", ["read_bonds", "bond_type"])
def test_every_line_with_two_ends_is_a_bond(spark, folder, lines, name):
    want = {(s, t, i, j, o if name == "read_bonds" else 1 + (o >= 1.5) + (o >= 2.5)) for (s, t), own in bonds_of(lines).items() for (i, j), o in own.items()}
    got = [tuple(r) for r in QUERIES[name](spark, folder).collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("name", ["molecule_components", "iterative_components", "components_of_any_size"])
def test_components_of_whole_tables(spark, folder, lines, name):
    want = {(s, t, a, own[0]) for (s, t), b in bonds_of(lines).items() for own in parts(range(ATOMS * BOXES), b) for a in own}
    got = QUERIES[name](spark, folder).collect()
    assert {(r.sim, r.timestep, r.atom_id, r.component) for r in got} == want and len(got) == len(want)


def atoms_of(lines):
    """{(sim, frame): [(type, x, y, z)]} in the order of atom ids."""
    found, start = collections.defaultdict(list), min(x[-1] for x in lines)
    for order, part, a, number, _, price, _, _, day in sorted(lines):
        at = (part * 37 % 3500 / 100 + 35 * (number % 3 - 1), round(price * 100) % 3500 / 100, order * 13 % 3500 / 100 - 35 * (a % 2))
        found[order % 3 + 1, (day - start).days // 30].append((a % 4 + 1, *at))
    return found


def test_every_line_is_an_atom(spark, folder, lines):
    want = {(s, t, i, k, *(round(c, 6) for c in at)) for (s, t), own in atoms_of(lines).items() for i, (k, *at) in enumerate(own, 1)}
    got = QUERIES["read_trajectory"](spark, folder).collect()
    assert {(r.sim, r.timestep, r.atom_id, r.atom_type, r.x, r.y, r.z) for r in got} == want and len(got) == len(want) == len(lines)
    frames = QUERIES["list_timesteps"](spark, folder).collect()
    assert sorted(map(tuple, frames)) == sorted(atoms_of(lines))


@pytest.mark.parametrize("name", ["block_histogram", "rdf_histogram"])
def test_pairs_of_every_frame_are_counted(spark, folder, lines, name):
    want = collections.Counter()
    for (s, t), own in atoms_of(lines).items():
        for _, *a in (x for x in own if ELEMENTS[x[0] - 1] == "Li"):
            for _, *b in (x for x in own if ELEMENTS[x[0] - 1] == "O"):
                d = sum((p - q - 35 * round((p - q) / 35)) ** 2 for p, q in zip(a, b)) ** 0.5
                want[s, t, min(34, int(d / 0.5))] += d <= 17.5
    got = {(r.sim, r.timestep, r.bin): r.n for r in QUERIES[name](spark, folder).collect()}
    assert got == {k: n for k, n in want.items() if n}


def plain_label(atoms, own):
    """The smallest numbering of a molecule over all orders of its atoms."""
    kind = lambda o: 1 + (o >= 1.5) + (o >= 2.5)
    inside = [(i, j, kind(o)) for (i, j), o in own.items() if i in atoms]
    outcome = lambda p: (tuple(ELEMENTS[a % ATOMS % 4] for a in p), tuple(sorted((*sorted((p.index(i), p.index(j))), t) for i, j, t in inside)))
    return min(outcome(p) for p in itertools.permutations(atoms))


def test_reactions_tell_isomers_apart(spark, folder, lines):
    frames = {}  # (sim, t): [(atoms, label)] by mol_idx
    for key, own in bonds_of(lines).items():
        frames[key] = [(atoms, plain_label(atoms, own)) for atoms in parts(range(ATOMS * BOXES), own)]
    mols = QUERIES["canonical_formula_smiles"](spark, folder).collect()
    name = {}
    for r in mols:
        assert name.setdefault(frames[r.sim, r.timestep][r.mol_idx][1], r.label) == r.label
    assert len(mols) == sum(map(len, frames.values())) and len(set(name.values())) == len(name)
    want, isomers = set(), 0
    for sim in (1, 2, 3):
        times = sorted(t for s, t in frames if s == sim)
        for t1, t2 in zip(times, times[1:]):
            one, two = frames[sim, t1], frames[sim, t2]
            links = [((1, i), (2, j)) for i, (a, _) in enumerate(one) for j, (b, _) in enumerate(two) if set(a) & set(b)]
            for nodes in parts([(1, i) for i in range(len(one))] + [(2, j) for j in range(len(two))], links):
                sides = [[own[i][1] for s, i in nodes if s == side] for side, own in ((1, one), (2, two))]
                if set(sides[0]) != set(sides[1]):
                    isomers += len({frozenset(tuple(sorted(x[0])) for x in side) for side in sides}) == 1
                    text = [", ".join(f"'{n}'" for n in sorted(name[x] for x in side)) for side in sides]
                    want.add((sim, t1, t2, nodes[0][1], f"[{text[0]}] -> [{text[1]}]"))
    got = QUERIES["canonical_reaction_events"](spark, folder).collect()
    assert isomers and {tuple(r) for r in got} == want and len(got) == len(want)
    counts = collections.Counter((x[0], x[4]) for x in want)
    assert {(r.sim, r.reaction): r.n for r in QUERIES["canonical_count_reaction_paths"](spark, folder).collect()} == counts
