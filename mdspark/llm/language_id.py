"""Language identification by Bayesian fusion of several kinds of evidence.

For each language the log posterior adds up
  - the text's likelihood under a character-trigram model (weighted down for long texts, whose
    trigrams are not independent),
  - how often pages of that language declare the language their markup declares,
  - how often that language stands under the address's suffix, and
  - the prior of the host, smoothed towards its suffix and that towards all rows.
The last three are soft counts of the text evidence, found by grouped aggregations over all rows and
joined back; missing evidence counts as none. A class 'und' with even trigram probabilities stands for
anything that is no known language. A row is accepted if its best class is a language with enough
probability and its text has letters.

Defined cases: null, empty and letterless texts are 'und' and not accepted; texts of any length are
read whole; null hosts, suffixes and declarations add nothing; repeated rows are judged each; other
columns are ignored; without labelled texts every row is 'und'; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .bytesblock import blocks

#: Hash buckets of trigrams; characters of a labelled text that training reads, and texts that it draws of one language.
BUCKETS, SAMPLE_CHARS, SAMPLE_EACH = 1 << 15, 12_000, 500
#: Trigrams that count in full; shares of 'und' and of a uniform guess in the priors; strengths of the parents' priors.
FULL, UND_SHARE, HOST_STRENGTH, SUFFIX_STRENGTH, DECLARED_STRENGTH = 150.0, 0.01, 20.0, 50.0, 5.0
#: Least probability of an accepted language.
LEAST_P = 0.5
UND = "und"

_LOW = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
_LETTER = np.array([b != 32 for b in _LOW])


def trigrams(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram that has a letter, the part it lies in)."""
    raw = b"   ".join([b"", *(p.translate(_LOW) for p in parts), b""])
    x = np.frombuffer(raw, np.uint8)
    part = np.repeat(np.arange(len(parts) + 1), [3, *(len(p) + 3 for p in parts)])[2:]
    y = x.astype(np.uint32)
    h = (y[:-2] * np.uint32(0x9E3779B1) + y[1:-1] * np.uint32(0x85EBCA6B) + y[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(12)
    letter = x != 32
    keep = np.flatnonzero(letter[1:-1] | (letter[:-2] & letter[2:]))
    return (h[keep] & np.uint32(BUCKETS - 1)).astype(np.int64), part[keep] - 1


class TextModel:
    """Log probabilities of trigram buckets by language; the last column is 'und'."""

    def __init__(self, names: list[str], table: np.ndarray):
        self.names, self.table = names, table

    def likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts by languages: summed log probabilities, numbers of trigrams)."""
        out, n = np.zeros((len(texts), len(self.names))), np.zeros(len(texts))
        for owner, parts in blocks([t.lower() for t in texts], b". ", 1):  # no trigram that counts lies across
            ids, part = trigrams(parts)
            own = np.array(owner)
            count = np.bincount(part, minlength=len(parts))
            np.add.at(n, own, count)
            for k in range(len(self.names)):
                np.add.at(out[:, k], own, np.bincount(part, self.table[k][ids], len(parts)))
        return out, n


def train(rows: list[tuple[str, str]]) -> TextModel | None:
    """rows: (text, language)."""
    names = sorted({lang for _, lang in rows})
    if not names:
        return None
    table = np.full((len(names) + 1, BUCKETS), -np.log(BUCKETS), np.float32)
    for k, name in enumerate(names):
        counts = np.full(BUCKETS, 0.05)
        for _, parts in blocks([t.lower() for t, lang in rows if lang == name], b". ", 1):
            counts += np.bincount(trigrams(parts)[0], minlength=BUCKETS)
        table[k] = np.log(counts / counts.sum())
    return TextModel([*names, UND], table)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> TextModel | None:
    """From up to SAMPLE_EACH ids of every language, the first by hash, and the first SAMPLE_CHARS of a text of each.

    Languages are counted over all rows, so a rare one has its share whatever stands beside it. The driver
    holds languages x SAMPLE_EACH texts at most.
    """
    usable = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.substring(F.col(text_col), 1, SAMPLE_CHARS).alias("text"))
    sizes = usable.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")).collect()
    if not sizes:
        return None
    # hashes up to here hold about three times the ids wanted, so that no more than those are ranked
    ends = [(r.lang, min((1 << 63) - 1, int(-(1 << 63) + (3 * SAMPLE_EACH + 100) / max(1, r.n) * 2.0**64))) for r in sizes]
    spark = labelled.sparkSession
    near = usable.join(F.broadcast(spark.createDataFrame(ends, "lang string, top bigint")), "lang").where(F.xxhash64("id") <= F.col("top")).select("lang", "id").distinct()
    first = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))).where(F.col("place") <= SAMPLE_EACH).select("lang", "id").collect()
    small = spark.createDataFrame([(r.lang, r.id) for r in first], "lang string, id bigint")
    rows = usable.join(F.broadcast(small), ["lang", "id"]).groupBy("lang", "id").agg(F.min("text").alias("text")).collect()
    return train([(r.text, r.lang) for r in sorted(rows, key=lambda r: (r.lang, r.id))])


def text_evidence(df: DataFrame, model: TextModel) -> DataFrame:
    """df's columns but text, and ev array<double> (weighted log likelihoods), letters boolean. Narrow."""
    kept = [c for c in df.columns if c != "text"]
    common.small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                t = part.column(part.num_columns - 1).to_pylist()
                ev, n = held.value.likelihoods(t)
                ev = ev * np.minimum(1, FULL / np.maximum(1, n))[:, None]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), pa.array(list(ev), pa.list_(pa.float64())), pa.array(n > 0)], names=[*kept, "ev", "letters"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema)
    return df.select(*kept, "text").mapInArrow(run, f"{schema}, ev array<double>, letters boolean")


def normalized(scores: Column) -> Column:
    """Log scores to probabilities."""
    e = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def identify(df: DataFrame, model: TextModel | None, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = None, suffix_col: str | None = None, declared_col: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(carry, id, lang, p, accepted, p_text) for every row of df."""
    name = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    rows = df.select(*carry, F.col(id_col).cast("long").alias("id"), name(host_col).alias("host"), name(suffix_col).alias("suffix"), F.lower(F.substring(name(declared_col), 1, 2)).alias("declared"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if model is None:
        return rows.select(*carry, "id", F.lit(UND).alias("lang"), F.lit(1.0).alias("p"), F.lit(False).alias("accepted"), F.lit(1.0).alias("p_text"))
    names = model.names
    size = len(names)
    found = common.materialize(text_evidence(rows, model).withColumn("q", normalized(F.col("ev"))), "evidence")
    sums = [F.sum(F.col("q")[k]).alias(f"c{k}") for k in range(size)]
    soft = found.where("letters")
    # all rows: one row of counts
    whole = soft.agg(*sums).first()
    counts = [whole[k] or 0.0 for k in range(size)]
    total = sum(counts) or 1.0
    base = [(1 - UND_SHARE) * (0.98 * c / total + 0.02 / size) + (UND_SHARE if k == size - 1 else 0.0) for k, c in enumerate(counts)]
    prior = F.array(*map(F.lit, base))

    def shares(parent: Column, strength: float) -> Column:
        n = sum((F.coalesce(F.col(f"c{k}"), F.lit(0.0)) for k in range(size)), F.lit(0.0))
        return F.array(*((F.coalesce(F.col(f"c{k}"), F.lit(0.0)) + strength * parent[k]) / (n + strength) for k in range(size)))

    suffixes = soft.where("suffix IS NOT NULL").groupBy("suffix").agg(*sums).select("suffix", shares(prior, SUFFIX_STRENGTH).alias("p_suffix"))
    hosts = soft.where("host IS NOT NULL").groupBy("host", "suffix").agg(*sums)
    # a host's counts lean on its suffix, a suffix's on all rows; with both present the host's share already holds the suffix
    hosts = hosts.join(suffixes, "suffix", "left").select("host", "suffix", shares(F.coalesce("p_suffix", prior), HOST_STRENGTH).alias("p_host"))
    declared = soft.where("declared IS NOT NULL").groupBy("declared").agg(*sums)
    said = [F.sum(F.col(f"c{k}")).alias(f"t{k}") for k in range(size)]
    # log P(declared | language), up to a constant of the declaration
    declared = declared.crossJoin(declared.agg(*said)).select("declared", F.array(*(F.log((F.col(f"c{k}") + DECLARED_STRENGTH * F.lit(base[k])) / (F.coalesce(F.col(f"t{k}"), F.lit(0.0)) + DECLARED_STRENGTH)) for k in range(size))).alias("e_declared"))
    hosts = hosts.select(F.col("host").alias("h_host"), F.col("suffix").alias("h_suffix"), "p_host")
    joined = found.join(hosts, (F.col("host") == F.col("h_host")) & F.col("suffix").eqNullSafe(F.col("h_suffix")), "left")
    joined = joined.join(suffixes, "suffix", "left").join(declared, "declared", "left")
    near = F.coalesce("p_host", "p_suffix", prior)
    fused = joined.select(*carry, "id", "letters", "q", F.array(*(F.col("ev")[k] + F.log(near[k]) + F.coalesce(F.col("e_declared")[k], F.lit(0.0)) for k in range(size))).alias("s"))
    p = fused.select(*carry, "id", "letters", "q", normalized(F.col("s")).alias("p"))
    at = F.array_position("p", F.array_max("p"))
    lang = F.when(F.col("letters"), F.element_at(F.array(*map(F.lit, names)), at.cast("int"))).otherwise(F.lit(UND))
    named = p.select(*carry, "id", "letters", lang.alias("lang"), F.array_max("p").alias("p"), F.array_max("q").alias("p_text"))
    return named.select(*carry, "id", "lang", "p", (F.col("letters") & (F.col("lang") != UND) & (F.col("p") >= LEAST_P)).alias("accepted"), "p_text")


def page_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, text, host, suffix, declared) of web pages; the suffix joins the host's last label and the path's first part if that is short."""
    html = F.coalesce(F.col("html"), F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    host = F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"(?i)^[a-z]+://(?:[^/@]*@)?([^/:?#]+)", 1)
    part = F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"(?i)^[a-z]+://[^/]+/([a-z]{2})(?:[/?#]|$)", 1)
    suffix = F.concat_ws("/", F.element_at(F.split(host, r"\."), -1), part)
    declared = F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z-]+)", 1)
    null = lambda c: F.when(c != "", c)
    return pages.select("page_id", bare.alias("text"), null(host).alias("host"), F.when(host != "", suffix).alias("suffix"), null(declared).alias("declared"))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Documents (doc_id) and web pages (page_id). A document's source stands for its host, and it has no markup
    and no address; pages have all kinds of evidence. The text model learns from the documents."""
    docs = common.table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    one = docs.select(F.lit(False).alias("page"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("source").alias("host"), none.alias("suffix"), none.alias("declared"))
    two = page_evidence(common.table(spark, sf_dir, "pages")).select(F.lit(True).alias("page"), F.col("page_id").cast("long").alias("id"), "text", "host", "suffix", "declared")
    out = identify(one.unionByName(two), fit(docs), "id", "text", "host", "suffix", "declared", ("page",))
    return out.select(F.when(~F.col("page"), F.col("id")).alias("doc_id"), F.when(F.col("page"), F.col("id")).alias("page_id"), "lang", F.round("p", 6).alias("p"), "accepted", F.round("p_text", 6).alias("p_text"))


def language_id_pages(spark, sf_dir: str) -> DataFrame:
    """Web pages, with all kinds of evidence; the text model learns from the documents."""
    pages = page_evidence(common.table(spark, sf_dir, "pages"))
    out = identify(pages, fit(common.table(spark, sf_dir, "documents")), "page_id", "text", "host", "suffix", "declared")
    return out.select(F.col("id").alias("page_id"), "lang", F.round("p", 6).alias("p"), "accepted", F.round("p_text", 6).alias("p_text"))
