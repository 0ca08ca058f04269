"""Checks of inputs before analysis. Findings: (ord, severity, sim, topic, message)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COORDINATES = (("xu", "yu", "zu"), ("x", "y", "z"), ("xs", "ys", "zs"))


def finding(df: DataFrame, order: int, severity: str, message) -> DataFrame:
    sim = F.col("sim") if "sim" in df.columns else F.lit(None).cast("int")
    topic = F.col("topic") if "topic" in df.columns else F.lit(None).cast("string")
    return df.select(F.lit(order).alias("ord"), F.lit(severity).alias("severity"), sim.cast("int").alias("sim"), topic.alias("topic"), message.alias("message"))


def check_element_list(elements: DataFrame) -> DataFrame:
    return finding(elements.agg(F.count("*").alias("n")).where("n = 0"), 1, "error", F.lit("element_list is empty"))


def check_missing_files(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """existing: (path) of the files that are there."""
    return finding(manifest.join(existing.select("path").distinct(), "path", "left_anti"), 2, "error", F.concat(F.lit("missing file: "), "path"))


def existing_files(manifest: DataFrame) -> DataFrame:
    """(path) of the manifest's files that are there. Each folder that the manifest names is listed once, by the file system
    that it is in, and the listing is joined with the manifest; a path may name a folder itself."""
    spark = manifest.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    folder = F.regexp_replace("path", r"/+[^/]*/*$", "/")
    named = manifest.select("path", F.when(F.col("path").contains("/"), folder).otherwise("./").alias("folder"), F.regexp_extract("path", r"([^/]+)/*$", 1).alias("name")).distinct()
    listed = []
    for r in named.select("folder").distinct().collect():
        at = Path(r.folder)
        store = at.getFileSystem(conf)
        if store.exists(at):
            listed += [(r.folder, x.getPath().getName()) for x in store.listStatus(at)]
    there = spark.createDataFrame(listed, "folder string, name string")
    return named.join(there, ["folder", "name"], "left_semi").select("path")


def check_topic_consistency(manifest: DataFrame) -> DataFrame:
    """A warning for each simulation that lacks topics which another has."""
    topics = manifest.select("topic").distinct()
    want = manifest.select("sim").distinct().join(topics)
    lacking = want.join(manifest, ["sim", "topic"], "left_anti").groupBy("sim").agg(F.array_join(F.sort_array(F.collect_set("topic")), ", ").alias("names"))
    return finding(lacking, 3, "warning", F.concat(F.lit("missing topics: "), "names"))


def check_atom_types(types: DataFrame, elements: DataFrame) -> DataFrame:
    """types: (sim, topic, atom_type). An error for each source with types that no element has."""
    unknown = types.select("sim", "topic", "atom_type").distinct().join(F.broadcast(elements), "atom_type", "left_anti")
    listed = unknown.groupBy("sim", "topic").agg(F.array_join(F.transform(F.sort_array(F.collect_set("atom_type")), lambda x: x.cast("string")), ", ").alias("names"))
    return finding(listed, 4, "error", F.concat(F.lit("unknown atom types: "), "names"))


def first_frame_types(atoms: DataFrame) -> DataFrame:
    """(sim, topic, atom_type) of each trajectory's first frame."""
    first = atoms.groupBy("sim").agg(F.min("frame_ord").alias("frame_ord"))
    return atoms.join(first, ["sim", "frame_ord"], "left_semi").select("sim", F.lit("trajectory").alias("topic"), "atom_type").distinct()


def check_trajectory_columns(headers: DataFrame) -> DataFrame:
    """headers: (sim, columns array) of each trajectory's first frame. id, type and one whole triple of coordinates are needed."""
    whole = F.lit(False)
    for triple in COORDINATES:
        whole = whole | (F.size(F.array_except(F.array(*map(F.lit, triple)), "columns")) == 0)
    lacking = F.array_except(F.array(F.lit("id"), F.lit("type")), "columns")
    parts = F.concat(lacking, F.when(whole, F.expr("CAST(array() AS array<string>)")).otherwise(F.array(F.lit("coordinates"))))
    bad = headers.select("sim", F.lit("trajectory").alias("topic"), F.when(F.col("columns").isNull(), F.array(F.lit("atom table"))).otherwise(parts).alias("lacking")).where(F.size("lacking") > 0)
    return finding(bad, 5, "error", F.concat(F.lit("trajectory lacks: "), F.array_join("lacking", ", ")))


def check_bond_symmetry(directed: DataFrame) -> DataFrame:
    """directed: (sim, timestep, atom_id, other) of every bond as each row lists it. An error for each frame with bonds that
    only one of their atoms lists: the readers take a bond from its lower atom's row, so one listed by the upper alone is lost."""
    back = directed.select("sim", "timestep", F.col("atom_id").alias("other"), F.col("other").alias("atom_id"))
    lone = directed.join(back, ["sim", "timestep", "atom_id", "other"], "left_anti")
    counts = lone.groupBy("sim", "timestep").agg(F.count("*").alias("n"), F.min(F.struct("atom_id", "other")).alias("one"))
    said = F.concat(F.lit("timestep "), "timestep", F.lit(": "), "n", F.lit(" one-sided bonds, such as "), F.col("one.atom_id"), F.lit("-"), F.col("one.other"))
    return finding(counts.withColumn("topic", F.lit("bonds")), 6, "error", said)


def check_dangling_bonds(directed: DataFrame, atoms: DataFrame) -> DataFrame:
    """An error for each frame with bonds to atoms that it does not have; molecules are built without such bonds."""
    gone = directed.join(atoms.select("sim", "timestep", F.col("atom_id").alias("other")), ["sim", "timestep", "other"], "left_anti")
    counts = gone.groupBy("sim", "timestep").agg(F.count("*").alias("n"), F.min("other").alias("one"))
    said = F.concat(F.lit("timestep "), "timestep", F.lit(": "), "n", F.lit(" bonds to unknown atoms, such as "), "one")
    return finding(counts.withColumn("topic", F.lit("bonds")), 7, "error", said)


def check_incomplete_frames(frames: DataFrame) -> DataFrame:
    """frames: (sim, timestep, n_atoms, complete). A warning for each bond frame with other rows than it announces, which is left out."""
    own = frames.where(~F.coalesce(F.col("complete"), F.lit(False)))
    said = F.concat(F.lit("timestep "), "timestep", F.lit(": incomplete frame, "), F.coalesce(F.col("n_atoms").cast("string"), F.lit("no")), F.lit(" atoms announced"))
    return finding(own.withColumn("topic", F.lit("bonds")), 8, "warning", said)


def validation_report(*findings: DataFrame) -> DataFrame:
    """All findings, or a single 'ok'."""
    every = findings[0]
    for f in findings[1:]:
        every = every.unionByName(f)
    none = every.agg(F.count("*").alias("n")).where("n = 0")
    return every.unionByName(finding(none, 0, "ok", F.lit("no issues found")))


def has_errors(report: DataFrame) -> bool:
    return not report.where("severity = 'error'").isEmpty()
