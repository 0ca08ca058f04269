"""Mixing documents to target domain weights with soft membership, in DataFrame functions only.

A classifier learnt from a labelled table gives every document a posterior over domains. Features are distinct
lower-case words, their first and last letters, the shapes of the tokens (letters as 'a' and 'A', digits as '0', all
else as it is), and the share of distinct words. Those clearly tied to a domain weigh as much as their log odds (in
TIERS steps); the logarithms of a document's weights, one for each domain but the first, go through a regularised
softmax that is fitted to the same sample.

Projected-gradient least squares then fits a rate for each document, 0 <= rate <= MOST_RATE, so that the expected token
total of each domain (sum of rate * tokens * posterior) meets its target. The gradient at a document depends on its
posterior alone, and posteriors are rounded to three decimals, so documents of equal posterior are one cell with one
rate: at most C(1000 + K - 1, K - 1) cells for K domains (501,501 for three) however many documents there are. A round
moves every cell's rate along the gradient, with momentum, or along the gradient scaled by the second moments of the
cells that are free to move, and projects it. Each round is two aggregations over the cells, which try several
lengths; only sums reach the driver. Where no rates within the bounds meet the targets, the nearest totals
are found, and `balance` reports each domain's target beside what the rates give.

copies is the rate rounded up or down by a hash of id and text, so that its expectation is the rate; no document is
written more than MOST_RATE times.

Defined cases: null and empty texts have no tokens and the features of no word; repeated rows are rated
each; a null id is rated like any other; other columns are ignored; without labels every document's
posterior is the first domain and rates follow from its target alone; of labels that contradict each other the worst
counts; a domain without any probability anywhere cannot meet its target, which is reported; with an empty table the
result is empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Features that carry weight for a domain, labelled documents that training draws from each domain, both at most.
MOST_WORDS, SAMPLE_EACH = 2000, 2000
#: Features count if the likelihood ratio of being tied to the domain is this large (half of it for counts of a
#: few documents would be chance among as many features) and their log odds this far above zero. Steps of their weights.
LEAST_RATIO, LEAST_ODDS, TIERS = 20.0, 1.5, 6
#: Production targets: shares of tokens by domain, and the domain whose present total the mix keeps.
DOMAINS = ("good", "poor", "toxic")
TARGETS, ANCHOR = {"good": 0.97, "poor": 0.02, "toxic": 0.01}, "good"
#: Most copies of a document that a mix may ask for.
MOST_RATE = 4.0
#: Rounds end when no domain's total is off by more than this share of all tokens, or ten of them lower the squared
#: error by less than this share; lengths of the plain and of the scaled steps that a round tries.
MET, STALLED, STRIDES, LENGTHS = 1e-5, 2e-2, (1.0, 4.0, 16.0), (1.0, 0.5, 0.2, 0.05, 0.01)
#: Cells that are broadcast at most; more are joined by shuffling.
MOST_SENT = 1_000_000
#: Strength of the softmax's regularisation, in documents.
RIDGE = 2.0
#: Size of a step in the share of distinct words, as its inverse; characters of a word's end and of its beginning.
REPEAT_STEPS, END, BEGINNING = 10, 3, 5
WHITE = r"[\x20\x09-\x0D]+"


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from quality and toxic marks; of rows that contradict each other the worst counts."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain")).where("doc_id IS NOT NULL AND domain IS NOT NULL")
    return marked.groupBy("doc_id").agg(F.max("domain").alias("domain"))


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(carry, doc_id, n_tokens, draw, feats): a hash of id and text, and hashes of the features; tokens are separated by runs of white space."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\p{Ll}+", "a"), r"\p{Lu}+", "A"), r"\p{N}+", "0")
    cut = df.select(*carry, F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), text, F.lit("mix")).alias("draw"), F.split(F.lower(text), r"[^\p{L}\p{N}]+").alias("w"), F.split(shape, WHITE).alias("t"))
    words, tokens = F.array_remove("w", ""), F.array_remove("t", "")
    cut = cut.select(*carry, "doc_id", "draw", F.size(tokens).cast("long").alias("n_tokens"), F.size(words).alias("n"), F.array_distinct(words).alias("d"), F.array_distinct(tokens).alias("t"))
    hashed = lambda column, kind, f: F.transform(column, lambda w: F.xxhash64(f(w), F.lit(kind)))
    # texts of few words repeat few, so the share is kept by size class
    repeat = F.xxhash64(F.floor(F.size("d") / F.greatest("n", F.lit(1)) * REPEAT_STEPS), F.least(F.lit(7), F.floor(F.log2(F.greatest("n", F.lit(1)).cast("double")) / 2)))
    parts = hashed("d", 0, lambda w: w), F.array_distinct(hashed("d", 1, lambda w: F.substring(w, -END, END))), F.array_distinct(hashed("d", 2, lambda w: F.substring(w, 1, BEGINNING))), hashed("t", 3, lambda w: w), F.array(repeat)
    return cut.select(*carry, "doc_id", "n_tokens", "draw", F.concat(*parts).alias("feats"))


class Classifier:
    """tiers: of each domain but the first, [(weight, hashes tied to it)]. turn[k]: the softmax's intercept of domain k and its factors."""

    def __init__(self, tiers: list[list[tuple[float, list[int]]]], turn: np.ndarray):
        self.tiers, self.turn = tiers, turn


def weight(tiers: list[tuple[float, list[int]]]) -> Column:
    """The logarithm of one more than the summed weights of a document's features."""
    if not tiers:
        return F.lit(0.0)
    every = np.array([w for _, words in tiers for w in words], np.int64)
    own = F.array_intersect("feats", F.lit(every))
    sizes = [F.size(F.array_intersect(own, F.lit(np.array(words, np.int64)))) * F.lit(odds) for odds, words in tiers]
    return F.log1p(sum(sizes, F.lit(0.0)))


def tied(counts: DataFrame, own: Column, rest: Column, n_own: int, n_rest: int) -> list[tuple[float, list[int]]]:
    """The MOST_WORDS strongest features of a domain, in tiers by their odds; own and rest count a feature's documents."""
    share = n_own / max(1, n_own + n_rest)
    a, c = own.cast("double"), rest.cast("double")
    part = lambda x, want: F.when(x > 0, x * F.log(x / want)).otherwise(0.0)
    ratio = 2 * (part(a, (a + c) * share) + part(c, (a + c) * (1 - share)))
    odds = F.log((a + 0.5) / (n_own + 1)) - F.log((c + 0.5) / (n_rest + 1))
    strong = counts.where(own > 0).select("word", odds.alias("odds"), ratio.alias("ratio")).where((F.col("odds") > LEAST_ODDS) & (F.col("ratio") > LEAST_RATIO))
    found = sorted((r.odds, r.word) for r in strong.orderBy(F.desc("ratio"), "word").limit(MOST_WORDS).collect())
    cut = [x for x in np.array_split(np.arange(len(found)), TIERS) if len(x)]
    return [(float(np.mean([found[i][0] for i in x])), [found[i][1] for i in x]) for x in cut]


def softmax(x: np.ndarray, y: np.ndarray, k: int, shares: np.ndarray) -> np.ndarray:
    """(k, 1 + columns): the regularised softmax of classes y by x, by Newton steps; shares: what share a class has in truth."""
    z = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    turn = np.zeros((k, z.shape[1]))
    truth = np.eye(k)[y]
    for _ in range(50):
        e = np.exp((s := z @ turn.T) - s.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        slope = (p - truth).T @ z + RIDGE * turn
        curve = np.einsum("na,nb,ni,nj->aibj", p, -p, z, z, optimize=True)
        for a in range(k):
            curve[a, :, a, :] += (z * p[:, [a]]).T @ z
        step = np.linalg.solve(curve.reshape(turn.size, turn.size) + RIDGE * np.eye(turn.size), slope.ravel()).reshape(turn.shape)
        turn -= step
        if np.abs(step).max() < 1e-9:
            break
    drawn = np.bincount(y, minlength=k) + 0.5
    turn[:, 0] += np.log(shares) - np.log(drawn / drawn.sum())  # classes are drawn in other shares than they have
    return turn


def train(df: DataFrame, domains: DataFrame, names: tuple[str, ...] = DOMAINS, id_col: str = "doc_id", text_col: str = "text") -> Classifier | None:
    """domains: (doc_id, domain). At most SAMPLE_EACH documents of a domain are drawn, the first by
    hashed id; of each domain the MOST_WORDS strongest features and the drawn documents' weights come to the driver."""
    total = {r.domain: r.n for r in domains.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    picked = [r for k in names for r in domains.where(F.col("domain") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_EACH).collect()]
    if not picked:
        return None
    small = df.sparkSession.createDataFrame(sorted({r.doc_id: r.domain for r in picked}.items()), "doc_id bigint, domain string")
    drawn = df.join(F.broadcast(small.select(F.col("doc_id").alias(id_col))), id_col)
    # of texts whose smallest feature hash is the same (mostly copies of one another) one teaches: the first by its draw
    sample = features(drawn, id_col, text_col).join(F.broadcast(small), "doc_id").groupBy("domain", F.array_min("feats").alias("least")).agg(F.min_by("feats", F.struct("draw", "doc_id", "feats")).alias("feats"))
    sample = common.materialize(sample.select("domain", "feats"), "sample")
    n = {r.domain: r.n for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    counts = sample.select("domain", F.explode("feats").alias("word")).groupBy("word").agg(*(F.count(F.when(F.col("domain") == k, 1)).alias(f"n{i}") for i, k in enumerate(names)))
    counts = common.materialize(counts, "counts")
    tiers = [tied(counts, F.col(f"n{i}"), F.col("n0"), n.get(k, 0), n.get(names[0], 0)) for i, k in enumerate(names) if i]
    drawn = [tuple(r) for r in sample.select("domain", *(weight(t).alias(f"x{i}") for i, t in enumerate(tiers))).collect()]
    drawn.sort()
    x, y = np.array([r[1:] for r in drawn], float).reshape(len(drawn), len(tiers)), np.array([names.index(r[0]) for r in drawn], int)
    shares = np.array([total.get(k, 0) + 0.5 for k in names])
    return Classifier(tiers, softmax(x, y, len(names), shares / shares.sum()))


def posteriors(feats: DataFrame, model: Classifier | None, names: tuple[str, ...] = DOMAINS) -> DataFrame:
    """feats' other columns and p: posteriors in the order of names, rounded to three decimals with sum one."""
    kept = [c for c in feats.columns if c != "feats"]
    if model is None:
        return feats.select(*kept, F.array(F.lit(1.0), *[F.lit(0.0)] * (len(names) - 1)).alias("p"))
    found = feats.select(*kept, F.array(*map(weight, model.tiers)).alias("x"))
    scores = [sum((F.lit(float(f)) * F.col("x")[i] for i, f in enumerate(row[1:])), F.lit(float(row[0]))) for row in model.turn]
    scored = found.select(*kept, F.array(*scores).alias("s"))
    top = F.array_max("s")
    e = scored.select(*kept, F.transform("s", lambda x: F.exp(x - top)).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    rounded = e.select(*kept, F.transform("e", lambda x: F.round(x / total * 1000).cast("int")).alias("m"))
    # what rounding lost or added goes to the first of the largest
    rest = 1000 - F.aggregate("m", F.lit(0), lambda a, x: a + x)
    at = F.array_position("m", F.array_max("m")) - 1
    return rounded.select(*kept, F.transform("m", lambda x, i: (x + F.when(i == at, rest).otherwise(0)) / 1000.0).alias("p"))


def solve(cells: DataFrame, targets: list[float], anchor: int, most: float = MOST_RATE) -> DataFrame:
    """cells (p array<double>, tokens, ...) and rate: accelerated projected-gradient least squares.

    Minimises sum_k (sum of rate * tokens * p_k - T_k)^2 over 0 <= rate <= most, from rate 1. T keeps the anchor's
    present total. A round moves every rate along the gradient at the point that momentum leads to, or by the gradient
    scaled with the second moments of the cells that are free to move, whichever of some lengths is best, and projects it.
    """
    size = len(targets)
    p = [F.col("p")[k] for k in range(size)]
    along = lambda h: sum((F.lit(float(x)) * q for x, q in zip(h, p)), F.lit(0.0))
    bounded = lambda r: F.least(F.lit(float(most)), F.greatest(F.lit(0.0), r))
    total = lambda r: [F.sum(r * F.col("tokens") * q) for q in p]

    def sums(state: DataFrame, columns: list[Column]) -> np.ndarray:
        return np.array([x or 0.0 for x in state.agg(*(c.alias(f"s{i}") for i, c in enumerate(columns))).first()])

    second = [F.col("tokens") * p[k] * p[j] for k in range(size) for j in range(size)]
    found = sums(cells, [*total(F.lit(1.0)), *map(F.sum, second)])
    now, whole = found[:size], found[:size].sum()
    state = cells.withColumns({"rate": F.lit(1.0), "past": F.lit(1.0)})
    if not whole:
        return state.drop("past")
    goal = (now[anchor] / targets[anchor] if targets[anchor] > 0 else whole) * np.array(targets)
    scale = np.full(size, 1 / whole)
    steep = float(np.linalg.eigvalsh(found[size:].reshape(size, size) * np.outer(scale, scale))[-1])
    value = lambda t: np.square((t - goal) * scale).sum(-1)
    worths, pace = [float(value(now))], 1.0
    while np.abs((now - goal) * scale).max() > MET:
        faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        ahead = F.col("rate") + F.lit((pace - 1) / faster) * (F.col("rate") - F.col("past"))
        slope = (now - goal) * scale * scale
        free = (F.col("rate") > 0) & (F.col("rate") < most) | (F.col("rate") <= 0) & (along(slope) < 0) | (F.col("rate") >= most) & (along(slope) > 0)
        found = sums(state, [*total(ahead), *(F.sum(F.when(free, c).otherwise(0)) for c in second)])
        there = (found[:size] - goal) * scale * scale / steep
        loose = found[size:].reshape(size, size) * np.outer(scale, scale)
        scaled = np.linalg.solve(loose + 1e-12 * max(np.linalg.eigvalsh(loose)[-1], 1e-300) * np.eye(size), (now - goal) * scale) * scale
        tries = [bounded(ahead - along(t * there)) for t in STRIDES] + [bounded(F.col("rate") - along(t * scaled)) for t in LENGTHS]
        seen = sums(state, [c for r in tries for c in total(r)]).reshape(len(tries), size)
        at = int(np.argmin(value(seen)))
        if not value(seen[at]) < worths[-1]:
            if pace == 1:
                break  # no way down: these are the nearest totals
            state, pace = state.withColumn("past", F.col("rate")), 1.0
            continue
        plain = at < len(STRIDES)
        state = common.materialize(state.withColumns({"rate": tries[at], "past": F.col("rate") if plain else tries[at]}), "rates")
        now, pace = seen[at], faster if plain else 1.0
        worths.append(float(value(now)))
        if len(worths) > 10 and worths[-1] > (1 - STALLED) * worths[-11]:
            break
    return state.drop("past")


def rates(df: DataFrame, domains: DataFrame, targets: dict[str, float] | None = None, anchor: str = ANCHOR, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents, cells): (carry, doc_id, n_tokens, p) for every row of df, and (p, tokens, rows, rate) of the distinct posteriors."""
    targets = targets or TARGETS
    names = tuple(targets)
    whole = sum(targets.values()) or 1.0
    model = train(df, domains, names, id_col, text_col)
    soft = common.materialize(posteriors(features(df, id_col, text_col, carry), model, names), "posteriors")
    cells = common.materialize(soft.groupBy("p").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "cells")
    rated = solve(cells, [targets[k] / whole for k in names], names.index(anchor))
    return soft, rated.select("p", "tokens", "rows", F.round("rate", 9).alias("rate"))


def mix(df: DataFrame, domains: DataFrame, targets: dict[str, float] | None = None, anchor: str = ANCHOR, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(carry, doc_id, n_tokens, p array, rate, copies) for every row of df.

    targets: share of tokens by domain (they need not sum to one); the mix is as large as keeps the
    anchor domain's present token total.
    """
    soft, cells = rates(df, domains, targets, anchor, id_col, text_col, carry)
    draw = F.pmod("draw", F.lit(1 << 40)) / float(1 << 40)
    cells = common.materialize(cells, "rated")
    if cells.count() <= MOST_SENT:
        rated = soft.join(F.broadcast(cells.select("p", "rate")), "p")
    else:
        rated = common.join_hot(soft, cells.select("p", "rate", "rows"), "p", "rows", soft.count())
    return rated.select(*carry, "doc_id", "n_tokens", "p", "rate", F.floor(F.col("rate") + draw).cast("int").alias("copies"))


def balance(df: DataFrame, domains: DataFrame, targets: dict[str, float] | None = None, anchor: str = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(domain, target, present, expected, met): token shares of each domain as asked for, before and after mixing, and whether
    the expected total is within a thousandth of the target's (or of all tokens, where the target is zero)."""
    targets = targets or TARGETS
    names = list(targets)
    whole = sum(targets.values()) or 1.0
    cells = rates(df, domains, targets, anchor, id_col, text_col)[1]
    each = cells.select("tokens", "rate", F.posexplode("p").alias("k", "share"))
    sums = each.groupBy("k").agg(F.sum(F.col("tokens") * F.col("share")).alias("present"), F.sum(F.col("rate") * F.col("tokens") * F.col("share")).alias("expected"))
    asked = df.sparkSession.createDataFrame([(i, k, targets[k] / whole) for i, k in enumerate(names)], "k int, domain string, target double")
    all_ = sums.agg(F.sum("present").alias("all_present"), F.sum("expected").alias("all_expected"), F.max(F.when(F.col("k") == names.index(anchor), F.col("present"))).alias("kept"))
    joined = sums.join(F.broadcast(asked), "k").crossJoin(F.broadcast(all_))
    goal = (F.col("kept") / F.lit(targets[anchor] / whole) if targets[anchor] else F.col("all_present")) * F.col("target")
    met = F.abs(F.col("expected") - goal) <= 0.001 * F.when(goal > 0, goal).otherwise(F.col("all_present"))
    return joined.select("domain", "target", (F.col("present") / F.col("all_present")).alias("present"), (F.col("expected") / F.col("all_expected")).alias("expected"), met.alias("met"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(common.table(spark, sf_dir, "documents"), label_domains(common.table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_tokens", *(F.col("p")[i].alias(f"p_{k}") for i, k in enumerate(DOMAINS)), "rate", "copies")


def mixing_balance(spark, sf_dir: str) -> DataFrame:
    """What op10_mixing's rates give beside what is asked for."""
    out = balance(common.table(spark, sf_dir, "documents"), label_domains(common.table(spark, sf_dir, "labels")))
    return out.select("domain", "target", F.round("present", 6).alias("present"), F.round("expected", 6).alias("expected"), "met")
