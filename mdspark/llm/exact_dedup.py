"""Exact deduplication with content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut where its own content says so (at the first sentence mark after a least
length, or at a greatest length), so a text becomes a short list of chunks. Only chunk digests move:
each chunk is identified by a 64-bit digest and verified by its SHA-256; where one 64-bit
digest stands for several chunks, each gets its own ordinal. A text's recipe is the ordered list of
verified identifiers, and texts are equal when their recipes are.

Plan: one pass over the texts writes ids and digests to the shared folder; chunk identifiers are
found by a grouped aggregation (partial on the map side); recipes are assembled by row; groups are
counted by a second aggregation and joined back. Chunks and recipes of very many rows (a thousandth of
all, so a thousand of each at most) are joined by sending them to the rows, others by shuffling.

Defined cases: null text counts as empty; empty texts are equal to one another; rows that repeat an
id count as rows of their own, and all rows of the kept id stay; a null id is never the kept one
unless its group has no other; other columns are ignored unless carried, and with carried ones `stays`
marks one row of each group, the first of those with the smallest id; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Least and greatest length of a chunk in characters; chunks end at one of these marks and a space.
LEAST, MOST, MARKS = 512, 2048, ".!?,;"
#: Chunks of a recipe that may be sent to all tasks.
HOT_CHUNKS = 256


def normalized(text: Column) -> Column:
    """Every run of white space as one space (a lone space is left as it is, which is the same)."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """A text's content-defined chunks; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most - 1}}}?[{MARKS}] |.{{1,{most}}}"), F.lit(0))


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(carry, row, doc_id, text_sha256, chunks array<struct<short, full>>): what the rest needs of the texts."""
    norm = df.select(*carry, F.col(id_col).cast("long").alias("doc_id"), normalized(F.col(text_col).cast("string")).alias("norm"))
    parts = F.transform(chunks(F.col("norm")), lambda c: F.struct(F.xxhash64(c).alias("short"), F.unhex(F.sha2(c, 256)).alias("full")))
    return norm.select(*carry, F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("norm", 256).alias("text_sha256"), parts.alias("chunks"))


def recipes(digests: DataFrame) -> DataFrame:
    """digests' columns but chunks, and recipe: the ordered list of verified chunk identifiers."""
    kept = [c for c in digests.columns if c != "chunks"]
    used = digests.select(*kept, F.posexplode("chunks").alias("at", "chunk")).select("row", "at", F.struct("chunk.short", "chunk.full").alias("chunk"))
    store = used.groupBy("chunk").agg(F.count("*").alias("uses"))
    named = common.materialize(store.select("chunk", "uses", F.row_number().over(Window.partitionBy("chunk.short").orderBy("chunk.full")).alias("nth")), "chunks")
    total = named.agg(F.sum("uses")).first()[0] or 0
    listed = common.join_hot(used, named, "chunk", "uses", total)
    ordered = F.sort_array(F.collect_list(F.struct("at", F.col("chunk.short").alias("short"), "nth")))
    whole = listed.groupBy("row").agg(ordered.alias("found")).select("row", F.transform("found", lambda x: F.struct(x.short.alias("short"), x.nth.alias("nth"))).alias("recipe"))
    none = F.expr("CAST(array() AS array<struct<short:bigint,nth:int>>)")
    return digests.select(*kept).join(whole, "row", "left").select(*kept, F.coalesce("recipe", none).alias("recipe"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of df; (carry, stays) too if columns are carried."""
    found = common.materialize(recipes(common.materialize(digest(df, id_col, text_col, carry), "digests")), "recipes")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    groups = common.materialize(found.groupBy("recipe").agg(first.alias("first"), F.count("*").alias("group_size")), "groups")
    joined = common.join_hot(found, groups, "recipe", "group_size", found.count(), F.size("recipe") <= HOT_CHUNKS)
    keep = F.col("first.doc_id")
    out = [F.col("doc_id"), keep.alias("keep_id"), F.col("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("text_sha256")]
    return joined.select(*carry, *out, *([(F.col("row") == F.col("first.row")).alias("stays")] if carry else []))


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH norm AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM norm
"""
