"""Near-duplicate vectors by sorted projection passes.

Equal vectors are one node with a count. A pass gives every node the concatenation of random hashes (each the largest
in size of a few random projections, with its sign, so that near directions mostly share it), sorts the nodes by it
and compares each with the next WINDOW ones in order; pairs with cosine >= 0.9 in doubles are verified, and what
leaves a task is the spanning forest of its verified pairs, one edge for a node at most. The first and last rows of
a range meet those of the next in a second step. The edges of all passes are united by smallest label.

Windows are bounded, groups are not, so links are then counted exactly within each component. Vectors nearer to a
component's head than half of the threshold's angle are all linked with one another (angles obey the triangle
inequality), however many they are, and are counted without being compared. Each of the others meets all vectors of
its component, block by block. So a pair is lost only if no chain of verified pairs joins its ends: passes grow with
the logarithm of the nodes so that, measured, at least 0.9 of pairs at the threshold are found.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
their own component; so do rows without an id, whose component is null and which are kept; vectors of different
lengths never link; rows that repeat an id are linked by their vectors; copies link with each other; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import components as local_components
from . import common
from .minhash import components

#: Hashes of a key and projections of a hash (a key is 7 numbers below 64); neighbours behind a node that it is compared with.
HASHES, PROJECTIONS, WINDOW = 7, 32, 128
#: Passes at least; there are as many as the number of nodes has binary digits, less FEWER.
LEAST_PASSES, FEWER = 8, 4
#: Vectors of a block in exact counting; distance from the half angle's cosine within which a vector is compared after all.
BLOCK, MARGIN = 512, 1e-9


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one, in doubles, whatever their size."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def vectors(column: pa.Array) -> np.ndarray:
    """Rows of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def groups(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, rows) of each length among vectors."""
    sizes = np.diff(column.offsets.to_numpy())
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    return [(p := np.flatnonzero(sizes == n), flat[at[p][:, None] + np.arange(n)]) for n in np.unique(sizes)]


def keys(v: np.ndarray, passes: int) -> np.ndarray:
    """(rows, passes) sort keys of unit rows; what is drawn depends on the rows' length and the pass alone."""
    out = np.zeros((len(v), passes), np.int64)
    for p in range(passes):
        turn = np.random.default_rng([v.shape[1], p]).standard_normal((v.shape[1], HASHES * PROJECTIONS))
        y = (v @ turn).reshape(len(v), HASHES, PROJECTIONS)
        top = np.abs(y).argmax(2)
        symbol = 2 * top + (np.take_along_axis(y, top[:, :, None], 2)[:, :, 0] > 0)
        for h in range(HASHES):
            out[:, p] = (out[:, p] << 8) + symbol[:, h]
    return out


def marked(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, digest, v): digest of the vector's bytes, null where it links with nothing."""
    kind = df.schema[vec_col].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    v = F.col(vec_col).cast(kind)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) | ~F.exists(v, lambda c: c != 0)
    usable = F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True))
    own = df.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable, v).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = [None if x is None else hashlib.blake2b(np.asarray(x.values).tobytes(), digest_size=16).digest() if x.is_valid else None for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), b.column(1)], names=["vec_id", "digest", "v"])

    return own.mapInArrow(run, f"vec_id bigint, digest binary, v {kind}")


def with_keys(nodes: DataFrame, passes: int) -> DataFrame:
    """(node, id, m, digest, v, keys array<bigint>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.zeros((b.num_rows, passes), np.int64)
            for at, v in groups(b.column(4)) if b.num_rows else []:
                found[at] = keys(unit(v), passes)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(found), pa.list_(pa.int64()))], names=["node", "id", "m", "digest", "v", "keys"])

    return nodes.mapInArrow(run, f"node bigint, id bigint, m bigint, digest binary, v {nodes.schema['v'].dataType.simpleString()}, keys array<bigint>")


def near(v: list[np.ndarray], threshold: float, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of rows in order: verified pairs a < b at most WINDOW apart, with b from `least` on. Rows of one length only."""
    u = unit(np.stack(v)) if v else np.zeros((0, 1))
    one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, min(WINDOW, len(u) - 1) + 1):
        lo = max(0, least - step)
        at = np.flatnonzero((u[lo : len(u) - step] * u[lo + step :]).sum(1) >= threshold) + lo
        one.append(at)
        two.append(at + step)
    return np.concatenate(one), np.concatenate(two)


def forest(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same rows as pairs (a, b) of places: each row and the first of its component."""
    label = local_components(len(node), a, b)
    at = np.flatnonzero(label != np.arange(len(node)))
    return node[at], node[label[at]]


def sorted_pass(nodes: DataFrame, p: int, threshold: float) -> DataFrame:
    """(a, b): the edges of one pass."""
    kind = nodes.schema["v"].dataType.simpleString()
    dealt = nodes.select(F.size("v").alias("dim"), F.col("keys")[p].alias("key"), "node", "v").repartitionByRange("dim", "key", "node").sortWithinPartitions("dim", "key", "node")
    dealt = dealt.select(F.spark_partition_id().alias("part"), "dim", "node", "v")
    schema = ["a", "b", "border", "place", "node", "v"]

    def rows(part: int, held: list[tuple], places: range, vtype: pa.DataType) -> pa.RecordBatch:
        n = len(held)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array([part] * n, pa.int32()), pa.array(list(places), pa.int32()), pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], vtype)], names=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[tuple] = []
        last: list[tuple] = []  # the latest WINDOW rows: (node, v)
        part, vtype = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            part, vtype = b.column(0)[0].as_py(), b.column(3).type
            new = [(n, np.asarray(v.values)) for n, v in zip(b.column(2).to_pylist(), b.column(3))]
            for lo in range(0, len(new), 4096):
                block = last + new[lo : lo + 4096]
                found_a, found_b = [], []
                sizes = np.array([len(v) for _, v in block])
                for dim in np.unique(sizes):
                    at = np.flatnonzero(sizes == dim)
                    x, y = near([block[i][1] for i in at], threshold)
                    a, c = forest(np.array([block[i][0] for i in at]), x, y)
                    found_a.append(a)
                    found_b.append(c)
                a, c = np.concatenate(found_a), np.concatenate(found_b)
                none = pa.nulls(len(a), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), none, none, pa.nulls(len(a), pa.int64()), pa.nulls(len(a), vtype)], names=schema)
                last = block[-WINDOW:]
            if len(first) < WINDOW:
                first += new[: WINDOW - len(first)]
        if first:
            yield rows(part - 1, first, range(len(first)), vtype)
            yield rows(part, last, range(-len(last), 0), vtype)

    found = common.materialize(dealt.mapInArrow(run, f"a bigint, b bigint, border int, place int, node bigint, v {kind}"), "pass")

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by("place").combine_chunks()
        v = [np.asarray(x.values) for x in t.column("v")]
        behind = int((t.column("place").to_numpy() < 0).sum())
        sizes, node = np.array([len(x) for x in v]), t.column("node").to_numpy()
        # lengths come in order, so only those of the border's two rows can stand on both sides
        at = np.flatnonzero(sizes == sizes[min(behind, len(v) - 1)])
        least = int((at < behind).sum())
        x, y = near([v[i] for i in at], threshold, least) if 0 < least < len(at) else (np.zeros(0, np.int64),) * 2
        across = (x < least) & (y >= least)
        a, b = forest(node[at], x[across], y[across])
        return pa.table({"a": a, "b": b})

    edges = found.where("border IS NULL").select("a", "b")
    return edges.unionByName(found.where("border IS NOT NULL").select("border", "place", "node", "v").groupBy("border").applyInArrow(meet, "a bigint, b bigint"))


def counted(members: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(ball, more) of (component, node, m, v): the links that nodes near their component's head have with one another,
    as (component, ball) with the number of vectors there, (node, inside), and (node, more) of links found by comparing."""
    n = members.count()
    heads = members.where("node = component").select("component", F.col("v").alias("head"))
    heads = common.materialize(members.groupBy("component").agg(F.count("*").alias("n")).join(heads, "component"), "heads")
    both = common.join_hot(members, heads, "component", "n", n).select("component", "node", "m", "v", "head")
    half = float(np.sqrt((1 + threshold) / 2)) + MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            inside = np.zeros(b.num_rows, bool)
            for at, v in groups(b.column(3)) if b.num_rows else []:
                head = vectors(b.column(4).take(pa.array(at)))
                inside[at] = (unit(v) * unit(head)).sum(1) >= half
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(inside)], names=["component", "node", "m", "v", "inside"])

    kind = members.schema["v"].dataType.simpleString()
    placed = common.materialize(both.mapInArrow(run, f"component bigint, node bigint, m bigint, v {kind}, inside boolean"), "placed")
    balls = placed.groupBy("component").agg(F.sum(F.when(F.col("inside"), F.col("m")).otherwise(0)).alias("ball"), F.count("*").alias("n"), F.count(F.when(~F.col("inside"), 1)).alias("rest"))
    balls = common.materialize(balls, "balls")
    some = balls.where("rest > 0").select("component", "n", F.ceil(F.col("rest") / BLOCK).cast("int").alias("ones"), F.ceil(F.col("n") / BLOCK).cast("int").alias("twos"))
    each = common.join_hot(placed, common.materialize(some, "some"), "component", "n", n)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(c)).cast("int")
    cols = ["component", "one", "two", "node", "m", "v", "inside"]
    x = each.where("NOT inside").withColumns({"one": own("ones", 1)}).withColumn("two", every("twos")).select(*cols).toDF(*cols)
    y = each.withColumns({"two": own("twos", 2)}).withColumn("one", every("ones")).select(*cols).toDF(*cols)

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "more": pa.array([], pa.int64())})
        a, b = (unit(vectors(t.column("v").combine_chunks())) for t in (one, two))
        na, nb, ma, mb = (t.column(c).to_numpy() for c in ("node", "m") for t in (one, two))
        linked = (a @ b.T >= threshold) & (na[:, None] != nb[None, :])
        inside = two.column("inside").combine_chunks().to_numpy(zero_copy_only=False)
        # a compared node counts all its links here; of those inside only the ones with compared nodes are left to count
        return pa.table({"node": np.concatenate([na, nb[inside]]), "more": np.concatenate([linked @ mb, ma @ linked[:, inside]]).astype(np.int64)})

    group = ["component", "one", "two"]
    more = x.groupBy(*group).cogroup(y.groupBy(*group)).applyInArrow(meet, "node bigint, more bigint").groupBy("node").agg(F.sum("more").alias("more"))
    return common.join_hot(placed.select("component", "node", "m", "inside"), balls, "component", "n", n).select("component", "node", "m", F.when(F.col("inside"), F.col("ball")).otherwise(F.col("m")).alias("near")), more


def near_vectors(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of df."""
    rows = common.materialize(marked(df, id_col, vec_col), "vectors")
    usable = rows.where("digest IS NOT NULL")
    equal = usable.groupBy("digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"), F.first("v").alias("v"))
    nodes = common.materialize(equal.select(F.monotonically_increasing_id().alias("node"), "id", "m", "digest", "v"), "nodes")
    n = nodes.count()
    passes = max(LEAST_PASSES, n.bit_length() - FEWER)
    nodes = common.materialize(with_keys(nodes, passes), "keyed")
    edges = None
    for p in range(passes):
        found = common.materialize(sorted_pass(nodes, p, threshold), "edges")
        edges = found if edges is None else edges.unionByName(found)
    joined = components(edges.distinct()).withColumnRenamed("node", "of")
    own = nodes.select("node", "id", "m", "digest", "v")
    members = common.materialize(joined.join(own, joined.of == own.node).select("component", "node", "id", "m", "v"), "members")
    ball, more = counted(members.select("component", "node", "m", "v"), threshold)
    least = common.materialize(members.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("n")), "least")
    links = common.join_hot(ball, least, "component", "n", n).join(more, "node", "left")
    told = links.select("node", (F.col("near") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    told = nodes.select("node", "id", "m", "digest").join(told, "node", "left").select("digest", "m", F.coalesce("n_links", F.col("m") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    told = common.materialize(told, "told")
    linked = common.join_hot(usable.select("vec_id", "digest"), told, "digest", "m", rows.count()).select("vec_id", "n_links", "component_id")
    alone = rows.where("digest IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op13_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(common.table(spark, sf_dir, "embeddings"))
