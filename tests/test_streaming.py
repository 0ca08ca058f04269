"""Live reaction counts against the batch table."""

import random

import pytest

from mdspark.operators import frames, reactions
from mdspark.sources import readers
from mdspark.streaming.reactions import stream_reactions


def bond_frame(t, atoms, bonds):
    near = {a: sorted([b for x, b in bonds if x == a] + [x for x, b in bonds if b == a]) for a in atoms}
    rows = [f"{a} {a % 2 + 1} {len(near[a])} {' '.join(map(str, near[a]))} 0 {' '.join('1.0' for _ in near[a])} 0 0 0" for a in atoms]
    return f"# Timestep {t}\n#\n# Number of particles {len(atoms)}\n#\n" + "\n".join(rows) + "\n"


@pytest.fixture
def history():
    """Frames of two simulations, in which bonds come and go and an atom vanishes."""
    r = random.Random(4)
    out = {}
    for sim in (1, 2):
        bonds = set()
        for t in range(0, 120, 10):
            for _ in range(2):
                a, b = sorted(r.sample(range(1, 11), 2))
                bonds ^= {(a, b)}
            atoms = [a for a in range(1, 11) if not (sim == 2 and t == 50 and a == 3)]
            out[sim, t] = bond_frame(t, atoms, [b for b in bonds if set(b) <= set(atoms)])
    return out


def test_frame_molecules_are_the_grouped_ones(spark, tmp_path, history):
    from mdspark.operators import topology

    elements = spark.createDataFrame([(1, "C"), (2, "H")], "atom_type int, element string")
    path = tmp_path / "b_R1"
    path.write_text("".join(v for (sim, _), v in sorted(history.items()) if sim == 1))
    files = spark.createDataFrame([(1, str(path))], "sim int, path string")
    _, atoms, bonds = readers.read_bonds(spark, files, elements)
    whole = topology.molecules(atoms, bonds)
    rows = lambda df: sorted((r.timestep, r.mol_idx, r.label, r.atom_ids) for r in df.collect())
    assert rows(frames.exploded(frames.frame_molecules(readers.read_frames(spark, files, readers.BOND_HEADER), elements))) == rows(whole)


def test_live_reactions_are_the_batch_ones(spark, tmp_path, history):
    """Frames come in several files, some late but within the watermark; what is settled equals the batch table."""
    elements = spark.createDataFrame([(1, "C"), (2, "H")], "atom_type int, element string")
    folder = tmp_path / "run"
    folder.mkdir()
    # of each 30 timesteps one file, its frames shuffled, and the middle one swapped with the next file's first
    files = [[0, 20, 30], [10, 50, 40], [60, 80, 90], [70, 110, 100]]
    events = stream_reactions(spark, str(folder), elements, late=40)
    writer = lambda: events.writeStream.format("parquet").option("path", str(tmp_path / "events")).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp"))
    for k, steps in enumerate([*files, [1000]]):
        for sim in (1, 2):
            text = "".join(history[sim, t] if t < 1000 else history[sim, 110].replace("# Timestep 110", "# Timestep 1000") for t in steps)
            (folder / f"part{k}_R{sim}").write_text(text)
        query = writer().start()
        assert query.awaitTermination(120)
    seen = [(r.sim, r.t1, r.t2, r.cluster, r.reaction, r.n) for r in spark.read.parquet(str(tmp_path / "events")).collect()]
    files_ = []
    for sim in (1, 2):
        path = tmp_path / f"whole_R{sim}"
        path.write_text("".join(v for (s, _), v in sorted(history.items()) if s == sim))
        files_.append((sim, str(path)))
    batch = frames.exploded(frames.frame_molecules(readers.read_frames(spark, spark.createDataFrame(files_, "sim int, path string"), readers.BOND_HEADER), elements))
    want = sorted((r.sim, r.t1, r.t2, r.cluster, r.reaction) for r in reactions.reaction_events(batch).collect())
    assert sorted(x[:5] for x in seen) == want
    counts = {(r.sim, r.reaction): r.n for r in reactions.count_reaction_paths(reactions.reaction_events(batch)).collect()}
    last = {}
    for sim, _, _, _, reaction, n in seen:
        last[sim, reaction] = max(n, last.get((sim, reaction), 0))
    assert last == counts


def test_live_query_equals_the_batch_query(spark):
    import os

    from mdspark.plans.queries import QUERIES

    from .conftest import DATA

    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    live = sorted(tuple(r)[:5] for r in QUERIES["live_reactions"](spark, DATA).collect())
    assert live == sorted(tuple(r) for r in QUERIES["canonical_reaction_events"](spark, DATA).collect())
