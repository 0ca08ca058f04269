"""Near-duplicate detection with b-bit MinHash.

Every text becomes the set of its distinct word shingles (as 64-bit hashes). Of each set 128 minima are
taken; bands of four minima are the bucket keys, and the low 4 bits of all minima are packed into eight
64-bit words. Two signatures' similarity is estimated from the number of equal 4-bit fields (bit counts
of the XOR), corrected for the 1 in 16 that agree by chance; pairs whose estimate is not five standard
errors below the threshold are confirmed on the full sets. At Jaccard 0.8 a pair is missed with
probability below 1e-6.

Texts with equal sets are one node, named by a row of it. Only the signatures of nodes that share a
bucket move: of the others the band keys do, once or twice. In each bucket every node is first paired with the bucket's smallest
node only, then, in buckets that still hold several components, with its neighbours in a few random
orders; both are linear in the bucket and join nearly all that belongs together. Only then each node
outside a bucket's main component meets all the bucket's nodes of other components, block by block of
both, by estimate inside the join. Nothing is capped: the last step covers every pair of a bucket whose
link could still matter. Buckets with a thousandth of all entries are sent to the entries instead of the
entries to them, and a node with very many pairs meets them in parts, its set once for each.
Components spread by smallest label with pointer jumping, in the shared folder.

Defined cases: null counts as empty text; texts without words are linked with nothing and stay; rows
that repeat an id are linked by their texts alone, each by its own; rows without an id are linked with
nothing, have no component and stay; texts of any length are read whole; other columns are ignored unless
carried, and with carried ones `stays` marks one row of each component, the first of those with the
smallest id, and rows that are linked with nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .bytesblock import BLOCK, SPACE, mix64, range_hashes, spans

BANDS, ROWS, BITS = 32, 4, 4
#: Bins of the finer signature: the low 8 bits of the least hash of each range of hashes, 0 where there is none.
BINS = 512
MINIMA = BANDS * ROWS
FIELDS = 64 // BITS  # in one packed word
#: Turns of pairing in random order; entries of a large bucket that are ordered or compared together.
RANDOM_TURNS, PART = 1, 512
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: of `words` words each, or the whole text's if it has fewer."""
    place = _odd(17, words)
    block: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        data = np.frombuffer(b" ".join([b"", *block, b""]), np.uint8)
        starts, ends = spans(~SPACE[data])
        h = range_hashes(data, starts, ends)
        at = np.searchsorted(starts, np.cumsum([1, *(len(b) + 1 for b in block)]))
        n = max(0, len(h) - words + 1)
        rolled = np.zeros(n, np.uint64)
        for i in range(words):
            rolled += h[i : i + n] * place[i]
        rolled = mix64(rolled)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            elif b > a:
                yield mix64((h[a:b] * place[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)

    for text in texts:
        block.append(text.encode("utf-8", "replace").translate(_LOWER))
        size += len(block[-1])
        if size >= BLOCK:
            yield from flush()
            block, size = [], 0
    if block:
        yield from flush()


def fine_signature(shingles: np.ndarray) -> bytes:
    """One byte per range of hashes, from sorted shingle hashes."""
    out = np.zeros(BINS, np.uint8)
    if len(shingles):
        bins = (shingles >> np.uint64(64 - (BINS - 1).bit_length())).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        out[bins[first]] = mix64(shingles[first]) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def fine_enough(one: np.ndarray, two: np.ndarray, n_one: np.ndarray, n_two: np.ndarray, goal: float) -> np.ndarray:
    """Whether fine signatures (rows) agree as often as those of sets of similarity goal would, less five standard errors.

    Of n hashes spread over the bins, the used bins hold a sample without replacement; with few hashes it
    is nearly all of them, and the error nearly none.
    """
    used = np.maximum(((one | two) != 0).sum(-1), 1).astype(float)
    equal = ((one == two) & (one != 0)).sum(-1)
    union = np.maximum((n_one + n_two) / (1 + goal), 1)
    mixed = goal * (1 - goal) * np.clip(1 - used / union, 0, 1) / used
    return equal / used >= goal - 5 * np.sqrt(mixed + (1 - goal) / 255 / used) - 1 / used


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, packed low bits of the minima), as int64."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max)
    for lo in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[lo : lo + 1024, None] * a + b).min(0))
    mixed = mix64(least)
    bands = mixed.reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, i])
    low = (mixed & np.uint64((1 << BITS) - 1)).reshape(-1, FIELDS)
    packed = (low << (np.arange(FIELDS, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64)
    return keys.view(np.int64), packed.view(np.int64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """docs' columns but text, and n_shingles, digest, bands array<bigint>, packed array<bigint>, fine binary; narrow."""
    kept = [c for c in docs.columns if c != "text"]
    schema = pa.schema([("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("packed", pa.list_(pa.int64())), ("fine", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _odd(29, MINIMA), _odd(31, MINIMA)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                n, digests, bands, packed, fine = [], [], [], [], []
                for s in shingle_sets(part.column(len(kept)).to_pylist(), words):
                    k, p = signature(s, a, b) if len(s) else (np.zeros(0, np.int64),) * 2
                    n.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    bands.append(k)
                    packed.append(p)
                    fine.append(fine_signature(s))
                new = [pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, schema.field("bands").type), pa.array(packed, schema.field("packed").type), pa.array(fine, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), *new], names=[*kept, *schema.names])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return docs.select(*kept, "text").mapInArrow(run, f"{own}, n_shingles bigint, digest binary, bands array<bigint>, packed array<bigint>, fine binary")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, digest, shingles array<bigint>); narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                sets = [s.view(np.int64) for s in shingle_sets(part.column(1).to_pylist(), words)]
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "digest", "shingles"])

    return docs.mapInArrow(run, "doc_id bigint, digest binary, shingles array<bigint>")


def equal_fields(a: Column, b: Column) -> Column:
    """How many of the minima's low bits agree: fields of the XOR that are zero."""
    ones = int("1" * FIELDS, 16)
    unequal = F.lit(0)
    for i in range(MINIMA // FIELDS):
        x = a[i].bitwiseXOR(b[i])
        y = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        y = y.bitwiseOR(F.shiftrightunsigned(y, 2))
        unequal = unequal + F.bit_count(y.bitwiseAND(F.lit(ones)))
    return F.lit(MINIMA) - unequal


def estimate(a: Column, b: Column) -> Column:
    """Jaccard similarity estimated from packed signatures, corrected for chance agreement."""
    chance = 1 / (1 << BITS)
    return (equal_fields(a, b) / MINIMA - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    """Five standard errors below the threshold."""
    chance = 1 / (1 << BITS)
    p = percent / 100 * (1 - chance) + chance
    return (p - 5 * (p * (1 - p) / MINIMA) ** 0.5 - chance) / (1 - chance)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) lead to, for every node of an edge."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select(F.col("b"), F.col("a"))).where("x <> y")
    both = common.materialize(both.distinct(), "edges")
    labels = common.materialize(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("component")), "labels")
    while True:
        seen = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("component").alias("near"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        new = labels.join(jump, labels.component == jump.via, "left").join(seen, labels.node == seen.x, "left")
        new = common.materialize(new.select("node", F.least("component", "far", "near").alias("component"), F.col("component").alias("old")), "labels")
        moved = new.where("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not moved:
            return labels


def sharper(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, b, sizes n and m, fine signatures f and g) that the fine signatures allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            f, g = (np.frombuffer(b"".join(t.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (4, 5))
            ok = fine_enough(f, g, t.column(2).to_numpy(), t.column(3).to_numpy(), percent / 100)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return pairs.mapInArrow(run, "a bigint, b bigint")


def confirm(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs of nodes (a, b) whose full shingle sets are similar enough; nodes: (rep, doc_id, digest).

    Of the nodes in pairs the texts are found by id and told apart by digest. The pairs of one a are cut
    into parts of about PART; each has a's set once.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).alias("parts"))
    pairs = common.materialize(pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part")), "pairs")
    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    wanted = common.materialize(nodes.select("rep", "doc_id", "digest").join(ids, "rep", "left_semi"), "wanted")
    found = full_sets(common.matched(docs.select("doc_id", "text"), wanted.select("doc_id").distinct(), "left_semi"), words)
    sets = common.materialize(found.join(wanted, ["doc_id", "digest"]).dropDuplicates(["rep"]).select("rep", "shingles"), "sets")
    members = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("t")), "b")
    heads = pairs.select("a", "part").distinct().join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("s")), "a")
    shared = F.size(F.array_intersect("s", "t"))
    return members.join(heads, ["a", "part"]).where(100 * shared >= percent * (F.size("s") + F.size("t") - shared)).select("a", "b")


def neighbours(rest: DataFrame, turn: int) -> DataFrame:
    """(a, b): each entry of a mixed bucket and the next of another component in a random order.

    Large buckets are cut into random parts of about PART entries, so that no task orders a whole one.
    """
    draw = F.xxhash64("rep", F.lit(turn))
    part = F.pmod(F.xxhash64("rep", F.lit(-turn)), F.ceil(F.col("size") / PART))
    behind = F.lead(F.struct("rep", "c")).over(Window.partitionBy("key", part).orderBy(draw))
    near = rest.select("rep", "c", behind.alias("o")).where("c <> o.c")
    return near.select(F.least("rep", "o.rep").alias("a"), F.greatest("rep", "o.rep").alias("b")).distinct()


def meet(rest: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): all likely pairs of a node outside its bucket's main component and a node of another component.

    Outsiders and all nodes of a bucket are both cut into blocks of about PART, and each block of one meets
    each of the other. A pair is compared first by the minima's bits, then by the finer signature, whose
    error is small where bins outnumber shingles; it is kept in the first of its common buckets only.
    """
    each = rest.withColumn("outside", F.col("c") != F.col("main"))
    sizes = each.groupBy("key").agg(F.ceil(F.sum(F.col("outside").cast("int")) / PART).cast("int").alias("one"), F.ceil(F.count("*") / PART).cast("int").alias("two"), F.count("*").alias("n")).where("one > 0")
    each = common.join_hot(each, common.materialize(sizes, "sizes"), "key", "n", each.count()).join(nodes, "rep")
    cols = ["key", "one_block", "two_block", "rep", "c", "n_shingles", "bands", "packed", "fine"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    x = each.where("outside").withColumn("one_block", own("one", 1)).withColumn("two_block", every("two")).select(*cols).toDF(*cols)
    y = each.withColumn("two_block", own("two", 2)).withColumn("one_block", every("one")).select(*cols).toDF(*cols)
    chance, least = 1 / (1 << BITS), least_estimate(percent)
    most_unequal = MINIMA - int(np.ceil(MINIMA * (least * (1 - chance) + chance) - 1e-9))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    goal = percent / 100

    def arrays(t: pa.Table) -> tuple[np.ndarray, ...]:
        list_ = lambda n, w: t.column(n).combine_chunks().flatten().to_numpy().reshape(-1, w)
        fine = np.frombuffer(b"".join(t.column("fine").to_pylist()), np.uint8).reshape(-1, BINS)
        return t.column("rep").to_numpy(), t.column("c").to_numpy(), t.column("n_shingles").to_numpy().astype(float), list_("bands", BANDS), list_("packed", MINIMA // FIELDS).view(np.uint64), fine

    def run(key: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return schema.empty_table()
        xi, xc, xn, xb, xp, xf = arrays(one)
        yi, yc, yn, yb, yp, yf = arrays(two)
        band = int(np.flatnonzero(xb[0] == key[0].as_py())[0])
        ones = np.uint64(int("1" * FIELDS, 16))
        out_a, out_b = [], []
        for i in range(len(xi)):
            at = np.flatnonzero(yc != xc[i])
            d = yp[at] ^ xp[i]
            d |= d >> np.uint64(1)
            d |= d >> np.uint64(2)
            at = at[np.bitwise_count(d & ones).sum(1, dtype=np.int64) <= most_unequal]
            if not len(at):
                continue
            at = at[(yb[at] == xb[i]).argmax(1) == band]
            at = at[fine_enough(xf[i], yf[at], xn[i], yn[at], goal)]
            out_a.append(np.minimum(yi[at], xi[i]))
            out_b.append(np.maximum(yi[at], xi[i]))
        if not out_a:
            return schema.empty_table()
        return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)}, schema=schema)

    group = ["key", "one_block", "two_block"]
    return x.groupBy(*group).cogroup(y.groupBy(*group)).applyInArrow(run, "a bigint, b bigint")


def near_duplicates(df: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; links have 100 * intersection >= percent * union.

    With carried columns (carry, ..., stays).
    """
    docs = common.texts(df, id_col, text_col, carry)
    signed = common.materialize(signatures(docs, words).withColumn("row", F.monotonically_increasing_id()), "signatures")
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # equal sets are one node, named by its first row
    equal = common.materialize(some.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("copies")), "equal")
    n_nodes = equal.count()
    again = common.join_hot(some.select("digest", "row"), equal.where("copies > 1").select("digest", "copies", F.col("first.row").alias("rep")), "digest", "copies", signed.count())
    entries = common.matched(some, again.where("row <> rep").select("row"), "left_anti", "row").select(F.col("row").alias("rep"), F.explode("bands").alias("key"))
    hubs = entries.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("most"), F.count("*").alias("n")).where("hub <> most").select("key", "hub", "n")
    hubs = common.materialize(hubs, "hubs")
    shared = common.materialize(common.join_hot(entries, hubs, "key", "n", n_nodes).select("key", "rep", "hub").distinct(), "buckets")
    # signatures move and are written again for nodes that share a bucket only
    nodes = common.matched(some.withColumnRenamed("row", "rep"), shared.select("rep").distinct(), "left_semi", "rep")
    nodes = common.materialize(nodes.select("rep", "doc_id", "digest", "n_shingles", "bands", "packed", "fine"), "nodes")
    seen = nodes.select("rep", "n_shingles", "packed", "fine")
    least = least_estimate(percent)

    def likely(pairs: DataFrame) -> DataFrame:
        a, b = seen.toDF("a", "n", "s", "f"), seen.toDF("b", "m", "t", "g")
        near = pairs.join(a, "a").join(b, "b").where(estimate(F.col("s"), F.col("t")) >= least)
        return sharper(near.select("a", "b", "n", "m", "f", "g"), percent).distinct()

    tried = common.materialize(likely(shared.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()), "tried")
    links = common.materialize(confirm(tried, docs, nodes, percent, words), "links")
    turn = 0
    while True:
        turn += 1
        found = components(links)
        labelled = shared.join(found, shared.rep == found.node, "left").select("key", "rep", "hub", F.coalesce("component", "rep").alias("c"))
        mixed = labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size"), F.max(F.when(F.col("rep") == F.col("hub"), F.col("c"))).alias("main")).where("lo <> hi").select("key", "main", "size")
        mixed = common.materialize(mixed, "mixed")
        rest = common.materialize(common.join_hot(labelled, mixed, "key", "size", n_nodes).select("key", "rep", "c", "main", "size"), "rest")
        if turn <= RANDOM_TURNS:
            pairs = neighbours(rest, turn)
        else:
            pairs = meet(rest, nodes.select("rep", "n_shingles", "bands", "packed", "fine"), percent).distinct()
        new = pairs.join(tried, ["a", "b"], "left_anti")
        new = common.materialize(likely(new) if turn <= RANDOM_TURNS else new, "new")
        if new.limit(1).count():
            links = common.materialize(links.union(confirm(new, docs, nodes, percent, words)), "links")
            tried = common.materialize(tried.union(new), "tried")
        if turn > RANDOM_TURNS:  # every pair that could matter has been tried
            found = components(links)
            break
    named = equal.select("digest", "copies", "first", F.col("first.row").alias("rep")).join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    heads = named.groupBy("component").agg(F.min("first").alias("head"), F.count("*").alias("n"))
    heads = common.materialize(heads, "heads")
    # by digest, what every row of it gets
    told = common.materialize(common.join_hot(named, heads, "component", "n", n_nodes).select("digest", "copies", "head"), "told")
    linked = common.join_hot(some, told, "digest", "copies", signed.count()).select(*carry, "doc_id", "n_shingles", "row", "head")
    alone = signed.where("n_shingles = 0 OR doc_id IS NULL").select(*carry, "doc_id", "n_shingles", "row", F.struct("doc_id", "row").alias("head"))
    out = linked.unionByName(alone)
    kept = F.coalesce(F.col("doc_id") == F.col("head.doc_id"), F.lit(True)).alias("kept")
    return out.select(*carry, "doc_id", "n_shingles", F.col("head.doc_id").alias("component_id"), kept, *([(F.col("row") == F.col("head.row")).alias("stays")] if carry else []))


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), 80, 4)
