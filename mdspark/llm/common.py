"""Small helpers that the operators share."""

from __future__ import annotations

import uuid
import zlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Only (carry, doc_id, text); null texts count as empty, other columns are ignored."""
    small_batches(df.sparkSession)
    return df.select(*carry, F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


#: Rows of a batch that tasks exchange with Python; texts are long, and two batches are held at a time.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS, unless it is lower already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the session names."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.startswith("local"):  # tests: one machine, so its folder is shared
        import tempfile

        found = tempfile.mkdtemp(prefix="mdspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not found:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return found


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, least: int = 0) -> int:
    """A partition count for work keyed by hashed blocks: the session's shuffle partitions, or more if asked."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), least)


def held_out(mod: int, rest: int) -> Column:
    """Whether a row is kept out of learning: crc32 of its id as text."""
    return F.crc32(F.col("doc_id").cast("string")) % mod == rest


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], most_chars: int) -> tuple[list[Row], float]:
    """A bounded sample of labelled texts, (text, y) rows, and the share of label 1 among all labels.

    Of each class the first 2 * most ids by hash are drawn from the labels alone; the texts of those
    among them that have at most most_chars characters are fetched, at most most of them are used.
    """
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    counts = {r.y: r.n for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ids = [r for y, n in most.items() for r in labelled.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * n).collect()]
    if not ids:
        return [], 0.5
    marks: dict[int, int] = {}
    for r in ids:  # of labels that contradict each other, 1 counts
        marks[r.doc_id] = max(r.y, marks.get(r.doc_id, 0))
    small = docs.sparkSession.createDataFrame(sorted(marks.items()), "doc_id bigint, y int")
    rows = docs.where(F.length("text") <= most_chars).join(F.broadcast(small), "doc_id").select("doc_id", "text", "y").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.text))
    kept = [r for y, n in most.items() for r in [x for x in rows if x.y == y][:n]]
    return kept, counts.get(1, 0) / sum(counts.values())


#: A key of a row that needs no id: a hash of its file's path, and its place in the file.
KEY = ("_row_file", "_row_at")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with KEY. Rows of Parquet files have their own places; others are written first to have some."""
    try:
        out = docs.withColumns({KEY[0]: F.xxhash64("_metadata.file_path"), KEY[1]: F.col("_metadata.row_index")})
        out.schema
    except AnalysisException:
        return materialize(docs.withColumns({KEY[0]: F.lit(0).cast("bigint"), KEY[1]: F.monotonically_increasing_id()}), "keyed")
    return out


#: A key is hot if it has more than this share of the rows; there can only be so many of them, as its inverse.
HOT = 1 / 1000


def join_hot(left: DataFrame, right: DataFrame, key: str, size: str, total: int, small: Column | None = None) -> DataFrame:
    """left joined with right, which has each key once with the number of left's rows of it (size) among total.

    Hot keys, 1 / HOT at most of which there can be, are sent to all tasks, so that no task has all rows of
    one; the others are joined by shuffling. small: a condition that bounds the bytes of a row that is sent.
    """
    hot = F.col(size) > total * HOT
    hot = hot & small if small is not None else hot
    sent = F.broadcast(right.where(hot))
    rest = left.join(F.broadcast(right.where(hot).select(key)), key, "left_anti").join(right.where(~hot), key)
    return left.join(sent, key).select(*rest.columns).unionByName(rest)


#: Ids that are broadcast at most (16 bytes each); more are joined by shuffling.
BROADCAST_IDS = 2_000_000


def matched(docs: DataFrame, ids: DataFrame, how: str, on: str | list[str] = "doc_id") -> DataFrame:
    """docs joined with a small table by id: broadcast if its size, which is counted, allows it."""
    ids = materialize(ids, "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)
