import pytest
from pyspark.sql import functions as F

from mdspark.sources import readers


def files(spark, tmp_path, texts):
    listed = []
    for sim, text in texts.items():
        path = tmp_path / f"f{sim}.txt"
        path.write_text(text)
        listed.append((sim, str(path)))
    return spark.createDataFrame(listed, "sim int, path string")


def test_species_headers_change(spark, tmp_path):
    text = "# Timestep No_Moles No_Specs A B\n0 2 2 1 1\n# Timestep No_Moles No_Specs A C\n1 2 1 0 2\n"
    species, totals = readers.read_species(spark, files(spark, tmp_path, {1: text}))
    got = {(r.timestep, r.species): r.n for r in species.collect()}
    assert got == {(0, "A"): 1, (0, "B"): 1, (1, "A"): 0, (1, "C"): 2}
    assert sorted((r.timestep, r.no_moles, r.no_specs) for r in totals.collect()) == [(0, 2, 2), (1, 2, 1)]


def test_species_last_of_repeated_names_and_short_rows(spark, tmp_path):
    species, _ = readers.read_species(spark, files(spark, tmp_path, {1: "# Timestep A A B\n5 1 2\n"}))
    assert [(r.timestep, r.species, r.n) for r in species.collect()] == [(5, "A", 2)]


def test_species_row_before_header(spark, tmp_path):
    with pytest.raises(Exception, match="before any header"):
        readers.read_species(spark, files(spark, tmp_path, {1: "0 1 1\n# Timestep A\n1 2\n"}))[0].collect()


def test_thermo(spark, tmp_path):
    text = "noise\nStep Old\n9 9\nStep Temp Press\n0 300 -nan\n1 301 2 extra\n2 5\nLoop time\nStep Temp\n7 7\n"
    got = readers.read_thermo(spark, files(spark, tmp_path, {2: text})).orderBy("step", "parameter").collect()
    assert [(r.sim, r.step, r.parameter) for r in got] == [(2, 0.0, "Press"), (2, 0.0, "Temp"), (2, 1.0, "Press"), (2, 1.0, "Temp")]
    assert got[1].value == 300.0 and got[0].value != got[0].value and got[2].value == 2.0


def test_thermo_without_table(spark, tmp_path):
    with pytest.raises(Exception, match="No thermo table"):
        readers.read_thermo(spark, files(spark, tmp_path, {1: "Loop\nStep Temp\n0 1\n"})).collect()


BONDS = """# Timestep 0
#
# Number of particles 3
#
1 1 1 2 0 1.6 0 0 0
2 2 1 1 0 1.6 0 0 0
3 1 0 0 0 0 0
# Timestep 10
#
# Number of particles 2
#
1 1 1 2 0 1.0 0 0 0
"""


def test_bonds(spark, tmp_path):
    elements = spark.createDataFrame([(1, "C"), (2, "H")], "atom_type int, element string")
    frames, atoms, bonds = readers.read_bonds(spark, files(spark, tmp_path, {1: BONDS}), elements)
    assert {(r.timestep, r.complete) for r in frames.collect()} == {(0, True), (10, False)}
    assert [(r.atom_i, r.atom_j, r.bond_order) for r in bonds.collect()] == [(1, 2, 1.6)]
    assert {(r.atom_id, r.element) for r in atoms.collect()} == {(1, "C"), (2, "H"), (3, "C")}


def frame(t, columns, rows):
    return f"ITEM: TIMESTEP\n{t}\nITEM: NUMBER OF ATOMS\n{len(rows)}\nITEM: BOX BOUNDS pp pp pp\n0 20\n0 20\n0 20\nITEM: ATOMS {columns}\n" + "\n".join(rows) + "\n"


def test_trajectory_range_and_order(spark, tmp_path):
    text = frame(0, "id type q xu yu zu", ["1 1 0 1 2 3"]) + frame(10, "id type q xu yu zu", ["2 3 0.5 4 5 6"]) + frame(10, "id type q xu yu zu", ["2 3 0.5 7 5 6"])
    listed = files(spark, tmp_path, {1: text})
    frames, atoms = readers.read_trajectory(spark, listed, (10, 5))
    assert [r.timestep for r in frames.collect()] == [10, 10]
    assert [(r.atom_id, r.atom_type, r.x, r.y, r.z) for r in atoms.orderBy("frame_ord").collect()] == [(2, 3, 4.0, 5.0, 6.0), (2, 3, 7.0, 5.0, 6.0)]
    assert [r.timestep for r in readers.list_timesteps(spark, listed).orderBy("frame_ord").collect()] == [0, 10, 10]


def test_trajectory_columns(spark, tmp_path):
    _, atoms = readers.read_trajectory(spark, files(spark, tmp_path, {1: frame(0, "id xs y zu", ["7.0 1 2 3"])}))
    assert [(r.atom_id, r.atom_type, r.q, r.x) for r in atoms.collect()] == [(7, 7, None, 1.0)]
    with pytest.raises(Exception, match="columns are missing"):
        readers.read_trajectory(spark, files(spark, tmp_path, {1: frame(0, "id type vx vy vz", ["1 1 0 0 0"])}))[1].collect()


def test_split_files_keep_their_order(spark, tmp_path):
    text = "".join(frame(t, "id type x y z", [f"{i} 1 {t} 0 0" for i in range(20)]) for t in range(60))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        got = readers.list_timesteps(spark, files(spark, tmp_path, {1: text}))
        assert got.rdd.getNumPartitions() > 3
        assert [r.timestep for r in got.orderBy("frame_ord").collect()] == list(range(60))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_manifest(spark, tmp_path):
    path = tmp_path / "run.inp"
    path.write_text("# comment\n---\nelement_list = [\"C\", 'H']\nBF1 = a.reax\nBF1 = b.reax\nThermoFile2 = /x/log\nTF = c.log\nunknown = 1\n")
    manifest, elements = readers.read_manifest(spark, str(path))
    assert {(r.sim, r.topic, r.path) for r in manifest.collect()} == {(1, "bonds", f"{tmp_path}/b.reax"), (2, "thermo", "/x/log"), (1, "thermo", f"{tmp_path}/c.log")}
    assert sorted((r.atom_type, r.element) for r in elements.collect()) == [(1, "C"), (2, "H")]
    path.write_text("element_list = [C]\n")
    with pytest.raises(ValueError):
        readers.read_manifest(spark, str(path))


def test_manifest_comments_end_a_line(spark, tmp_path):
    path = tmp_path / "run.inp"
    path.write_text("element_list = [\"C\", \"H\"]  # types 1 and 2\nBF1 = a.out  # run 1\n  # BF2 = b.out\n")
    manifest, elements = readers.read_manifest(spark, str(path))
    assert [(r.sim, r.path) for r in manifest.collect()] == [(1, f"{tmp_path}/a.out")]
    assert sorted(r.element for r in elements.collect()) == ["C", "H"]


@pytest.mark.parametrize("text", ["1 1 1 2 0 1.0 0 0 0\n" + BONDS, "# note\n2 1 0 0 0 0 0\n" + BONDS, "# Timestep 5\n1 1 0 0 0 0 0\n"])
def test_bond_rows_before_a_header(spark, tmp_path, text):
    elements = spark.createDataFrame([(1, "C"), (2, "H")], "atom_type int, element string")
    with pytest.raises(Exception, match="bond data before timestep header"):
        readers.read_bonds(spark, files(spark, tmp_path, {1: text}), elements)[2].collect()


def test_rows_of_long_headers_are_told_apart(spark, tmp_path):
    text = "# Timestep A\n" + "".join(f"{i} {i}\n" for i in range(1600)) + "# Timestep A\n7 7\n"
    species, _ = readers.read_species(spark, files(spark, tmp_path, {1: text}))
    assert species.select("row_ord").distinct().count() == 1601


def test_stream_of_logs(spark, tmp_path):
    from mdspark.streaming.readers import stream_thermo

    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "log_R3.txt").write_text("Step Temp\n0 300\n1 301\nLoop\n")
    q = stream_thermo(spark, str(folder)).writeStream.format("memory").queryName("thermo_stream").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert sorted((r.sim, r.step, r.value) for r in spark.table("thermo_stream").collect()) == [(3, 0.0, 300.0), (3, 1.0, 301.0)]


def test_reaction_text(spark):
    df = spark.createDataFrame([(" ['A'] -> ['B']\t12 ",)], "t string")
    assert df.select(readers.normalize_reaction(F.col("t"))).first()[0] == "['A'] -> ['B']"


@pytest.mark.parametrize("folder", ["my run", "a%20b", "50% [x]", "plus+sign", "ünï {1}"])
def test_paths_of_any_spelling(spark, tmp_path, folder):
    (tmp_path / folder).mkdir()
    listed = files(spark, tmp_path / folder, {1: "# Timestep A\n5 1\n", 2: "# Timestep A\n6 2\n"})
    assert sorted((r.sim, r.timestep) for r in readers.read_species(spark, listed)[0].collect()) == [(1, 5), (2, 6)]
    whole = spark.createDataFrame([(4, str(tmp_path / folder))], "sim int, path string")  # a folder of files
    assert sorted((r.sim, r.timestep) for r in readers.read_species(spark, whole)[0].collect()) == [(4, 5), (4, 6)]


def test_files_that_are_not_there(spark, tmp_path):
    listed = files(spark, tmp_path, {1: "# Timestep A\n5 1\n"})
    (tmp_path / "empty").mkdir()
    for path in (tmp_path / "none.txt", tmp_path / "empty"):
        with pytest.raises(Exception, match="(?i)no file of simulation 2|does not exist"):
            readers.read_species(spark, listed.unionByName(spark.createDataFrame([(2, str(path))], "sim int, path string")))


@pytest.fixture(params=[97, 2048, 1 << 20])
def part_bytes(spark, request):
    keys = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_frames_of_any_partition_size(spark, tmp_path, part_bytes, end):
    """Bond frames with odd headers, and trajectory frames, some longer than a task's part of the file."""
    heads = ["# Timestep {}", "#Timestep {}", " #  MD  Timestep   {}"]
    bonds = "".join(heads[t % 3].format(t) + f"\n#\n# Number of particles {n}\n#\n" + "".join(f"{i} 1 1 {i + 1} 0 1.0 0 0 0\n" for i in range(1, n + 1)) for t, n in enumerate([3, 40, 1, 2, 25]))
    traj = "noise\n" + "".join(frame(t, "id type x y z", [f"{i} 1 {t} 0 0" for i in range(n)]) for t, n in enumerate([2, 30, 1, 1, 12]))
    listed = []
    for name, text in (("b", bonds), ("t", traj)):
        (tmp_path / name).write_bytes(text.replace("\n", end).encode())
        listed.append(spark.createDataFrame([(1, str(tmp_path / name)), (2, str(tmp_path / name))], "sim int, path string"))
    elements = spark.createDataFrame([(1, "C")], "atom_type int, element string")
    frames, atoms, found = readers.read_bonds(spark, listed[0], elements)
    want = [(0, 3, True), (1, 40, True), (2, 1, True), (3, 2, True), (4, 25, True)]
    for sim in (1, 2):
        assert [(r.timestep, r.n_atoms, r.complete) for r in frames.where(f"sim = {sim}").orderBy("frame_ord").collect()] == want
    assert found.groupBy("sim").count().collect()[0]["count"] == 71
    frames, atoms = readers.read_trajectory(spark, listed[1])
    assert [r.timestep for r in readers.list_timesteps(spark, listed[1]).where("sim = 1").orderBy("frame_ord").collect()] == [0, 1, 2, 3, 4]
    assert sorted((r.timestep, r["count"]) for r in atoms.where("sim = 2").groupBy("timestep").count().collect()) == [(0, 2), (1, 30), (2, 1), (3, 1), (4, 12)]


def test_trajectory_cut_off(spark, tmp_path):
    text = frame(0, "id type x y z", ["1 1 0 0 0"]) + frame(5, "id type x y z", ["1 1 0 0 0", "2 1 0 0 0"]).rsplit("2 1", 1)[0]
    with pytest.raises(Exception, match="cut off at timestep 5"):
        readers.read_trajectory(spark, files(spark, tmp_path, {1: text}))[1].collect()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_thermo_by_lines_is_thermo_by_logs(spark, tmp_path, part_bytes, end):
    log = lambda k: "noise\nStep Old\n9 9\nLooped? no\n" if k == 3 else "noise\nStep Old\n" + "".join(f"{i} 1\n" for i in range(k)) + "  Step Temp Press  \n" + "".join(f"{i} {300 + i} {'nan' if i % 7 == 0 else i * 0.5}{' extra' if i % 5 == 0 else ''}\n\n" for i in range(60)) + "60 5\nLoop time\nStep Temp\n7 7\nLoop\n"
    listed = []
    for k in (1, 2, 3):
        (tmp_path / f"log {k}").write_bytes(log(k).replace("\n", end).encode())
        listed.append((k, str(tmp_path / f"log {k}")))
    logs = spark.createDataFrame([(k, log(k).replace("\n", end)) for k in (1, 2, 3)], "sim int, value string")
    rows = lambda df: sorted((r.sim, r.step, r.parameter, str(r.value)) for r in df.collect())
    got = readers.read_thermo(spark, spark.createDataFrame(listed, "sim int, path string"))
    assert rows(got) == rows(readers.parse_thermo(logs))
    assert [r.step for r in got.where("sim = 1 AND parameter = 'Temp'").orderBy("row_ord").collect()] == [float(i) for i in range(60)]
