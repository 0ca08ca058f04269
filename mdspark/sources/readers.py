"""Text files of reactive simulations as long, typed tables.

Every reader is `read text` plus a parser, so a parser can be used on any DataFrame with a `value` column (and on a
stream). Files are read by many tasks each: species files are split at '#', thermo logs are read line by line, and
frames of bond files and trajectories begin at any header line, wherever a task's part of the file begins. `frame_ord`
grows in file order: the start of the file block plus the row's number in its task. Line ends may be of either kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialize

# Topics by the beginning of a manifest key.
PREFIXES = {
    "bonds": ("BF", "BondF", "BondFile"),
    "species": ("SF", "SpeciesF", "SpeciesFile"),
    "thermo": ("ThermoF", "TF", "ThermoFile"),
    "trajectory": ("TrajF", "TrajectoryF", "TrajectoryFile"),
}
TOPICS = ("bonds", "species", "thermo", "trajectory")
#: Rows of one header that row_ord can number; places in a file then have 2^40 bytes.
ROWS_PER_HEADER = 1 << 23
#: Lines that begin a frame.
BOND_HEADER, FRAME_HEADER = r"^\s*#.*Timestep", r"^ITEM: TIMESTEP"
STATIC_SPECIES_COLUMNS = ("Timestep", "No_Moles", "No_Specs")


def tokens(line: Column) -> Column:
    """White-space separated tokens."""
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def bare_path(path: str) -> str:
    """A path without its scheme and store, as manifests and listings spell it differently."""
    return re.sub("/+", "/", re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "", path)).rstrip("/") or "/"


def literally(path: str) -> str:
    """A path that names only itself: characters that patterns use are escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def raw_text(spark: SparkSession, files: DataFrame, separator: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((file, block, ord, value), (sim, file)) of the files or folders in (sim, path): lines, or what stands between separators.

    The list of files is a manifest's and thereby small; it names what to read, and each found file is matched with it
    here. A path that names no file, and a relative path that the listing spells differently, are errors.
    """
    listed = [(r.sim, r.path) for r in files.select("sim", "path").distinct().collect()]
    once = {bare_path(p): p for _, p in listed}  # a file that several simulations name, by itself or in its folder, is read once
    raw = spark.read.text([literally(p) for own, p in once.items() if own.rpartition("/")[0] not in once], lineSep=separator)
    found = {uri: bare_path(unquote(urlparse(uri).path)) for uri in raw.inputFiles()}
    names = []
    for sim, path in listed:
        own = bare_path(path)
        mine = [uri for uri, at in found.items() if at == own or at.rpartition("/")[0] == own or not path.startswith("/") and ":" not in path and at.endswith(f"/{own.removeprefix('./')}")]
        if not mine:
            raise FileNotFoundError(f"no file of simulation {sim} was read from {path}")
        names += [(sim, bare_path(uri)) for uri in mine]
    held = spark.createDataFrame(names, "sim int, file string")
    place = F.col("block") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    encoded = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", ""), "/+", "/")  # as bare_path does
    each = raw.select("value", encoded.alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return each.select("file", "block", place.alias("ord"), "value"), F.broadcast(held)


def read_text(spark: SparkSession, files: DataFrame, separator: str | None = None) -> DataFrame:
    """(sim, file, ord, value)."""
    text, held = raw_text(spark, files, separator)
    return text.join(held, "file").select("sim", "file", "ord", "value")


def read_chunks(spark: SparkSession, files: DataFrame, separator: str) -> DataFrame:
    """(sim, frame_ord, value) of the files, split at separator."""
    return read_text(spark, files, separator).select("sim", F.col("ord").alias("frame_ord"), F.regexp_replace("value", "\r", "").alias("value"))


def read_frames(spark: SparkSession, files: DataFrame, header: str) -> DataFrame:
    """(sim, frame_ord, value) of the files, cut before every line that matches header; value begins with that line.

    A task's part of a file begins anywhere. Lines before its first header belong to a frame of an earlier part, and its
    last frame may go on in the next: these pieces, two for each part, are put together by file; all other frames
    are whole where they are read. Lines before a file's first header are a frame without one. Frames are written once,
    as every table of a file is made from them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple[int, int] | None = None
        text: list[str] = []  # of the open frame, batch by batch
        begin, headed = 0, False
        out: list[tuple[int, int, str | None, str | None]] = []

        def close(whole: bool) -> None:
            if text:
                value = "\n".join(text)
                out.append((place[0], begin, None if whole else value, value if whole else None))
                text.clear()

        def flush() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["file", "ord", "piece", "value"])
            out.clear()
            return batch

        for b in batches:
            if not b.num_rows:
                continue
            file, block, order, lines = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3)
            starts = np.flatnonzero(pc.match_substring_regex(lines, header).to_numpy(zero_copy_only=False))
            edges = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
            bounds = np.unique(np.concatenate([[0], edges, starts, [b.num_rows]])).astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), lines), "\n").to_pylist()
            first = set(starts.tolist())
            for at, value in zip(bounds[:-1].tolist(), joined):
                here = int(file[at]), int(block[at])
                if here != place:  # a part's end: its last frame may go on
                    close(False)
                    place, begin, headed = here, int(order[at]), at in first
                elif at in first:
                    close(headed)
                    begin, headed = int(order[at]), True
                text.append(value)
            if out:
                yield flush()
        close(False)
        if out:
            yield flush()

    lines, held_by = raw_text(spark, files)
    ids = held_by.select("sim", F.xxhash64("file").alias("file"))
    pieces = lines.select(F.xxhash64("file").alias("file"), "block", "ord", "value").mapInArrow(run, "file bigint, ord bigint, piece string, value string")
    pieces = materialize(pieces, "frames")
    broken = pieces.where("piece IS NOT NULL").withColumn("headed", F.col("piece").rlike(header))
    number = F.sum(F.col("headed").cast("int")).over(Window.partitionBy("file").orderBy("ord"))
    joined = broken.withColumn("frame", number).groupBy("file", "frame").agg(F.min("ord").alias("frame_ord"), F.sort_array(F.collect_list(F.struct("ord", "piece"))).alias("v"))
    text = F.array_join(F.transform("v", lambda x: x.piece), "\n")
    # pieces have no value, so that nothing a parser raises is evaluated on them
    every = pieces.where("value IS NOT NULL").select("file", F.col("ord").alias("frame_ord"), "value").unionByName(joined.select("file", "frame_ord", text.alias("value")))
    return every.join(F.broadcast(ids), "file").select("sim", "frame_ord", "value")


# Species ---------------------------------------------------------------------------------------------


def parse_species(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(species, totals) from chunks of one header and its rows (split at '#').

    species: sim, timestep, row_ord, species, n for every column of a row's header; a repeated name
    takes its last value, a short row ends the zip. totals: the No_Moles and No_Specs columns.
    """
    lines = F.split(F.regexp_replace("value", r"^#+", ""), "\n")
    cut = chunks.select("sim", "frame_ord", tokens(F.get(lines, F.lit(0))).alias("head"), F.filter(F.slice(lines, 2, 1 << 30), lambda x: F.trim(x) != "").alias("rows"), F.get(lines, F.lit(0)).alias("first"))
    blank = (F.trim("first") == "") & (F.size("rows") == 0)
    early = ~blank & ~F.col("head")[0].rlike("^[A-Za-z_]")
    cut = cut.select("sim", "frame_ord", "head", F.posexplode(F.when(early, F.raise_error(F.lit("species row before any header"))).otherwise(F.col("rows"))).alias("pos", "row"))
    row = cut.select("sim", (F.col("frame_ord") * ROWS_PER_HEADER + F.col("pos")).alias("row_ord"), "head", tokens(F.col("row")).alias("cells"))
    keep_last = lambda name, i: (i < F.size("cells")) & ~F.array_contains(F.slice("head", i + 2, F.greatest(F.lit(0), F.least(F.size("head"), F.size("cells")) - i - 1)), name)
    pairs = F.filter(F.transform("head", lambda name, i: F.struct(name.alias("k"), F.get("cells", i).alias("v"), keep_last(name, i).alias("on"))), lambda x: x.on)
    at = lambda key: F.filter("pairs", lambda x: x.k == key)[0].v.cast("bigint")
    flat = row.select("sim", "row_ord", pairs.alias("pairs")).select("sim", "row_ord", at("Timestep").alias("timestep"), "pairs")
    totals = flat.select("sim", "timestep", "row_ord", at("No_Moles").alias("no_moles"), at("No_Specs").alias("no_specs"))
    species = flat.select("sim", "timestep", "row_ord", F.explode("pairs").alias("p")).where(~F.col("p.k").isin(*STATIC_SPECIES_COLUMNS)).select("sim", "timestep", "row_ord", F.col("p.k").alias("species"), F.col("p.v").cast("bigint").alias("n"))
    return species, totals


def read_species(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parse_species(read_chunks(spark, files, "#"))


# Thermo ----------------------------------------------------------------------------------------------


def parse_thermo(logs: DataFrame, start: str = "Step", stop: str = "Loop") -> DataFrame:
    """(sim, step, row_ord, parameter, value) from whole logs.

    The table is the one behind the last header before the first stop line; rows with fewer tokens than
    columns are skipped, further tokens ignored. A log without a table is an error.
    """
    lines = F.transform(F.split("value", "\n"), lambda x: F.trim(x))
    cut = logs.select("sim", lines.alias("lines"))
    stop_at = F.array_position(F.transform("lines", lambda x: x.startswith(stop)), True)
    cut = cut.select("sim", F.when(stop_at > 0, F.slice("lines", 1, F.greatest(F.lit(0), stop_at.cast("int") - 1))).otherwise(F.col("lines")).alias("lines"))
    last = F.array_max(F.filter(F.transform("lines", lambda x, i: F.when(x.startswith(start), i)), lambda i: i.isNotNull()))
    cut = cut.select("sim", "lines", last.alias("at"))
    cut = cut.select("sim", F.when(F.col("at").isNull(), F.raise_error(F.lit("No thermo table"))).otherwise(tokens(F.get("lines", F.col("at")))).alias("head"), F.slice("lines", F.col("at") + 2, F.greatest(F.lit(0), F.size("lines") - F.col("at") - 1)).alias("rows"))
    rows = cut.select("sim", "head", F.posexplode(F.filter("rows", lambda x: x != "")).alias("row_ord", "row"))
    return thermo_values(rows.select("sim", "head", F.col("row_ord").cast("bigint").alias("row_ord"), tokens(F.col("row")).alias("cells")), start)


def thermo_values(rows: DataFrame, start: str) -> DataFrame:
    """(sim, step, row_ord, parameter, value) of (sim, head, row_ord, cells): rows shorter than their head are skipped."""
    number = lambda x: F.when(F.lower(x).isin("nan", "-nan", "+nan"), F.lit(float("nan"))).otherwise(x.cast("double"))
    step = number(F.get("cells", F.array_position("head", start).cast("int") - 1))
    long = rows.where(F.size("cells") >= F.size("head")).select("sim", step.alias("step"), "row_ord", F.explode(F.transform("head", lambda k, i: F.struct(k.alias("parameter"), number(F.get("cells", i)).alias("value")))).alias("x"))
    return long.select("sim", "step", "row_ord", "x.parameter", "x.value").where(F.col("parameter") != start)


def read_thermo(spark: SparkSession, files: DataFrame, start: str = "Step", stop: str = "Loop") -> DataFrame:
    """parse_thermo line by line, so that many tasks read one log; row_ord counts lines from the header.

    Of each file the marks (lines that begin with start or stop) are gathered first: the first stop, and the last header
    before it. The lines between the two are the table.
    """
    lines = read_text(spark, files).select("sim", "file", "ord", F.trim("value").alias("line"))
    marks = materialize(lines.where(F.col("line").startswith(start) | F.col("line").startswith(stop)), "marks")
    files_ = materialize(lines.groupBy("sim", "file").agg(F.count("*").alias("lines")).select("sim", "file"), "logs")
    ends = marks.where(~F.col("line").startswith(start)).groupBy("sim", "file").agg(F.min("ord").alias("stop_at"))
    heads = marks.where(F.col("line").startswith(start)).join(ends, ["sim", "file"], "left").where("stop_at IS NULL OR ord < stop_at")
    tables = files_.join(heads.groupBy("sim", "file").agg(F.max("ord").alias("at"), F.max_by("line", "ord").alias("head")), ["sim", "file"], "left").join(ends, ["sim", "file"], "left")
    head = F.when(F.col("head").isNull(), F.raise_error(F.lit("No thermo table"))).otherwise(tokens(F.col("head")))
    tables = materialize(tables.select("sim", "file", "at", head.alias("head"), F.coalesce("stop_at", F.lit((1 << 62))).alias("stop_at")), "tables")
    # a row for each log: as small as the manifest
    own = lines.join(F.broadcast(tables), ["sim", "file"]).where("ord > at AND ord < stop_at AND line <> ''")
    return thermo_values(own.select("sim", "head", (F.col("ord") - F.col("at")).alias("row_ord"), tokens(F.col("line")).alias("cells")), start)


# Bonds -----------------------------------------------------------------------------------------------


def parse_rows(chunks: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, bond_atoms, directed) from chunks of one frame (from its '#' line with 'Timestep' on, or from what follows that word).

    directed: (sim, timestep, frame_ord, atom_id, other, bond_order), every bond as each row lists it. Rows of fewer than three tokens are skipped; frames with
    another number of rows than they announce are reported in frames (complete = false) and left out of
    the other two. Rows before a file's first header, or of a frame that announces no number, are an error.
    """
    chunks = chunks.withColumn("value", F.regexp_replace("value", r"\A\s*#[^\n]*Timestep", ""))
    lines = F.slice(F.split("value", "\n"), 2, 1 << 30)
    rows = F.filter(F.transform(F.filter(lines, lambda x: ~F.ltrim(x).startswith("#")), lambda x: tokens(x)), lambda r: F.size(r) >= 3)
    headed = F.col("value").rlike(r"^\s*\d+\s*(\n|$)")
    loose = F.exists(F.split("value", "\n"), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#"))
    announced = F.regexp_extract("value", r"Number of particles\s+(\d+)", 1)
    early = F.when(headed, (announced == "") & (F.size(rows) > 0)).otherwise(loose)
    chunks = chunks.select("sim", "frame_ord", F.when(early, F.raise_error(F.lit("bond data before timestep header"))).otherwise(F.col("value")).alias("value")).where(headed)
    cut = chunks.select("sim", "frame_ord", F.regexp_extract("value", r"^\s*(\d+)", 1).cast("bigint").alias("timestep"), F.expr(r"try_cast(regexp_extract(value, 'Number of particles\\s+(\\d+)', 1) AS int)").alias("n_atoms"), rows.alias("rows"))
    frames = cut.select("sim", "timestep", "frame_ord", "n_atoms", (F.size("rows") == F.col("n_atoms")).alias("complete"))
    row = cut.where(F.size("rows") == F.col("n_atoms")).select("sim", "timestep", "frame_ord", F.explode("rows").alias("r")).select("sim", "timestep", "frame_ord", F.col("r")[0].cast("bigint").alias("atom_id"), F.col("r")[1].cast("int").alias("atom_type"), F.col("r")[2].cast("int").alias("nb"), "r")
    atoms = row.select("sim", "timestep", "frame_ord", "atom_id", "atom_type").join(F.broadcast(elements), "atom_type", "left").select("sim", "timestep", "frame_ord", "atom_id", "atom_type", "element")
    pairs = F.arrays_zip(F.slice("r", F.lit(4), F.col("nb")).alias("id"), F.slice("r", F.col("nb") + 5, F.col("nb")).alias("order"))
    directed = row.where("nb > 0").select("sim", "timestep", "frame_ord", "atom_id", F.explode(pairs).alias("p")).select("sim", "timestep", "frame_ord", "atom_id", F.col("p.id").cast("bigint").alias("other"), F.col("p.order").cast("double").alias("bond_order"))
    return frames, atoms, directed


def parse_bonds(chunks: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, bond_atoms, bonds): as parse_rows, each bond taken from its lower atom's row."""
    frames, atoms, directed = parse_rows(chunks, elements)
    return frames, atoms, directed.where("atom_id < other").select("sim", "timestep", "frame_ord", F.col("atom_id").alias("atom_i"), F.col("other").alias("atom_j"), "bond_order")


def read_bonds(spark: SparkSession, files: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return parse_bonds(read_frames(spark, files, BOND_HEADER), elements)


# Trajectories ----------------------------------------------------------------------------------------


def parse_frames(chunks: DataFrame) -> DataFrame:
    """(sim, timestep, frame_ord, n_atoms, xlo..zhi, columns, rows) from chunks of one frame (from its 'ITEM: TIMESTEP' line on, or
    from the line behind it). A frame with fewer rows than it announces, as where a file was cut off, is an error; what
    stands behind the rows of a frame, and before a file's first header, is ignored."""
    chunks = chunks.withColumn("value", F.regexp_replace("value", r"\A\s*ITEM: TIMESTEP[^\n]*\n", ""))
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    cut = chunks.where(F.trim("value") != "").select("sim", "frame_ord", lines.alias("l"))
    bound = lambda i, j: tokens(F.get("l", F.lit(4 + i)))[j].cast("double")
    good = F.get("l", F.lit(1)).startswith("ITEM: NUMBER OF ATOMS") & F.get("l", F.lit(3)).startswith("ITEM: BOX BOUNDS") & F.get("l", F.lit(7)).startswith("ITEM: ATOMS")
    checked = cut.select("sim", "frame_ord", F.when(F.coalesce(good, F.lit(False)), F.col("l")).when(F.col("l").isNull() | (F.size("l") == 0), None).otherwise(F.raise_error(F.lit("malformed trajectory frame"))).alias("l"))
    bounds = [bound(i, j).alias(f"{axis}{side}") for i, axis in enumerate("xyz") for j, side in enumerate(("lo", "hi"))]
    n = F.trim(F.get("l", F.lit(2))).cast("int")
    whole = F.when(F.size("l") - 8 < n, F.raise_error(F.concat(F.lit("trajectory frame cut off at timestep "), F.trim(F.get("l", F.lit(0)))))).otherwise(F.slice("l", F.lit(9), n))
    return checked.select("sim", F.trim(F.get("l", F.lit(0))).cast("bigint").alias("timestep"), "frame_ord", n.alias("n_atoms"), *bounds, tokens(F.regexp_replace(F.get("l", F.lit(7)), "^ITEM: ATOMS", "")).alias("columns"), whole.alias("rows"))


def explode_atoms(frames: DataFrame, raw_unwrapped: bool = False) -> DataFrame:
    """(sim, timestep, frame_ord, atom_id, atom_type, q, x, y, z): of each axis the first of xu, x, xs; without type the id stands in.

    raw_unwrapped: only xu, yu, zu, as wrapping needs them.
    """
    at = lambda *names: F.coalesce(*(F.when(F.array_contains("columns", c), F.array_position("columns", c).cast("int") - 1) for c in names))
    axis = {a: at(*([f"{a}u"] if raw_unwrapped else [f"{a}u", a, f"{a}s"])) for a in "xyz"}
    row = frames.select("sim", "timestep", "frame_ord", at("id").alias("i_id"), at("type", "id").alias("i_type"), at("q").alias("i_q"), *(c.alias(f"i_{a}") for a, c in axis.items()), F.explode("rows").alias("row"))
    missing = F.col("i_id").isNull() | F.col("i_x").isNull() | F.col("i_y").isNull() | F.col("i_z").isNull()
    row = row.select("*", F.when(missing, F.raise_error(F.lit("trajectory columns are missing"))).otherwise(tokens(F.col("row"))).alias("c"))
    value = lambda i: F.get("c", F.col(i)).cast("double")
    return row.select("sim", "timestep", "frame_ord", value("i_id").cast("bigint").alias("atom_id"), value("i_type").cast("int").alias("atom_type"), F.when(F.col("i_q").isNotNull(), value("i_q")).alias("q"), *(value(f"i_{a}").alias(a) for a in "xyz"))


def filter_timesteps(df: DataFrame, first: int, last: int) -> DataFrame:
    """Inclusive, in either order; use it on frames, before atoms are exploded."""
    return df.where(F.col("timestep").between(min(first, last), max(first, last)))


def trajectory_chunks(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(sim, frame_ord, value) of each frame; lines before a file's first header are left out."""
    headed = F.when(F.col("value").rlike(FRAME_HEADER), F.col("value"))
    return read_frames(spark, files, FRAME_HEADER).withColumn("value", headed).where("value IS NOT NULL")


def read_trajectory(spark: SparkSession, files: DataFrame, timestep_range: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(frames, atoms)."""
    frames = parse_frames(trajectory_chunks(spark, files))
    frames = filter_timesteps(frames, *timestep_range) if timestep_range else frames
    return frames.drop("rows"), explode_atoms(frames)


def list_timesteps(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(sim, frame_ord, timestep) of all frames in file order, duplicates kept; rows are not parsed."""
    second = F.trim(F.get(F.split("value", "\n", 3), F.lit(1)))
    return trajectory_chunks(spark, files).select("sim", "frame_ord", second.cast("bigint").alias("timestep"))


# Manifests and result tables -------------------------------------------------------------------------


def parse_manifest(lines: DataFrame, folder: str = "") -> tuple[DataFrame, DataFrame]:
    """(manifest(sim, topic, path), elements(atom_type, element)) from (ord, value) lines.

    'key = value' lines; '#' starts a comment wherever it stands, '---' lines and unknown keys are ignored, the last of
    repeated keys wins; digits behind a key are the simulation (1 without). Relative paths start at folder.
    """
    pattern = r"^\s*([A-Za-z_]\w*)\s*=\s*(.*?)\s*$"
    lines = lines.select("ord", F.substring_index("value", "#", 1).alias("value"))
    pair = lines.where(~F.trim("value").startswith("---")).select("ord", F.regexp_extract("value", pattern, 1).alias("key"), F.regexp_replace(F.regexp_extract("value", pattern, 2), "^([\"'])(.*)\\1$", "$2").alias("v")).where("key <> ''")
    digits = F.regexp_extract("key", r"(\d+)$", 1)
    topic = F.coalesce(*(F.when(F.col("key").startswith(k), F.lit(t)) for t, keys in PREFIXES.items() for k in keys))
    last = pair.select("ord", "key", "v", F.when(digits == "", 1).otherwise(digits.cast("int")).alias("sim"), topic.alias("topic"))
    files = last.where("topic IS NOT NULL").select("sim", "topic", "ord", F.when(F.col("v") == "", F.raise_error(F.concat(F.lit("empty value for "), "key"))).otherwise(F.col("v")).alias("path"))
    files = files.groupBy("sim", "topic").agg(F.max_by("path", "ord").alias("path"))
    absolute = F.when(F.col("path").rlike(r"^(/|[a-zA-Z]+:)"), F.col("path")).otherwise(F.concat(F.lit(folder.rstrip("/") + "/" if folder else ""), "path"))
    listed = last.where("key = 'element_list'").agg(F.max_by("v", "ord").alias("v")).where("v IS NOT NULL")
    elements = listed.select(F.posexplode(F.expr(r"filter(split(regexp_replace(v, '[\\[\\]\"'' ]', ''), ','), x -> x <> '')")).alias("pos", "element")).select((F.col("pos") + 1).cast("int").alias("atom_type"), "element")
    return files.select("sim", "topic", absolute.alias("path")), elements


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A manifest file; without files or without element_list it is an error."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), "value")
    manifest, elements = parse_manifest(lines, path.rpartition("/")[0])
    if manifest.isEmpty():
        raise ValueError("the manifest names no files")
    if elements.isEmpty():
        raise ValueError("element_list is required")
    return manifest, elements


def load_simulations(spark: SparkSession, manifest: DataFrame, elements: DataFrame) -> dict[str, DataFrame]:
    """Every topic's tables for all simulations at once, tagged with sim; topics that no simulation has are absent."""
    topics = {r.topic for r in manifest.select("topic").distinct().collect()}
    of = lambda t: manifest.where(F.col("topic") == t)
    out: dict[str, DataFrame] = {}
    if "bonds" in topics:
        out["bond_frames"], out["bond_atoms"], out["bonds"] = read_bonds(spark, of("bonds"), elements)
    if "species" in topics:
        out["species"], out["species_totals"] = read_species(spark, of("species"))
    if "thermo" in topics:
        out["thermo"] = read_thermo(spark, of("thermo"))
    if "trajectory" in topics:
        out["frames"], out["atoms"] = read_trajectory(spark, of("trajectory"))
    return out


def normalize_reaction(text: Column) -> Column:
    """The reaction of a pasted table row: what stands before the first tab."""
    return F.trim(F.substring_index(F.trim(text), "\t", 1))


def read_reaction_counts(spark: SparkSession, path: str) -> DataFrame:
    """(reaction, n) from a saved tab-separated table with a header."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return raw.select(normalize_reaction(F.col(raw.columns[0])).alias("reaction"), F.col(raw.columns[1]).cast("bigint").alias("n"))
