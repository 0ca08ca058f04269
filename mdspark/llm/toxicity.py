"""Toxicity from subword bags: character n-gram embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its hashed character n-grams (so unseen misspellings share
most of their vectors with the words they come from; the first coordinate starts at the n-gram's
log odds), a passage of up to PASSAGE words is the mean of its
words, and a linear softmax over that mean gives the passage's probability. Embeddings and softmax
are trained jointly in numpy. Labels belong to whole texts, so a text takes the score of its highest
passage: first every passage learns its text's label, then only the highest one does. A final
two-parameter fit on the training texts turns the highest logit into a probability.

Defined cases: null and empty texts score like a text without evidence (the fitted offset); texts of
any length are read whole; repeated rows are scored each; other columns of the same names are
ignored; without usable labels of both classes every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bytesblock import spans

BUCKETS, DIM, GRAMS, PASSAGE, BLOCK = 1 << 16, 8, (3, 8), 256, 400_000
#: Labelled texts that training sees at most, of each class; longer ones than this are not picked.
SAMPLE_EACH, SAMPLE_CHARS = (900, 1500), 12_000

#: n-grams less tied to the label than this (chi-square over training texts) carry nothing; weight decay; the size of the first softmax weights (means are small).
LEAST_CHI2, DECAY, SHARP = 20.0, 1e-6, 30.0

_FOLD = np.array([not chr(i).isalnum() for i in range(128)])


def grams(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """n-gram buckets, the word each belongs to, the first word of each part, the number of words.

    Words are runs of letters, digits and all non-ASCII characters; an n-gram may take in the space
    before or behind its word.
    """
    x = np.frombuffer(("  ".join(["", *parts, ""])).encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.where(x < 128, _FOLD[np.minimum(x, 127)], False)
    x = np.where(space, np.uint32(32), x)
    starts, _ = spans(~space)
    word = np.append(0, np.cumsum(space[:-1] & ~space[1:]) - 1)  # of each character; a space has that of the word before
    ids, owner = [], []
    h, ok = x[:-1] * np.uint32(0x9E3779B1) + x[1:], ~space[1:]
    for n in range(GRAMS[0], GRAMS[1] + 1):
        h = h[:-1] * np.uint32(0x85EBCA6B) + x[n - 1 :] * np.uint32(0xC2B2AE35) + np.uint32(n)
        ok = ok[:-1] & ~space[n - 2 : -1] if n > 3 else ok[:-1]  # the characters between first and last are no spaces
        at = np.flatnonzero(ok)
        v = h[at]
        ids.append(((v ^ (v >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int32) & (BUCKETS - 1))
        owner.append(word[at + 1].astype(np.int32))
    offsets = 2 + np.concatenate([[0], np.cumsum([len(p) + 2 for p in parts])[:-1]])
    return np.concatenate(ids), np.concatenate(owner), np.searchsorted(starts, offsets), len(starts)


def word_starts(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return spans(~np.where(x < 128, _FOLD[np.minimum(x, 127)], False))[0]


def blocks(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """(numbers of texts, lower-case pieces) of about BLOCK characters; a long text is cut where a passage begins."""
    owner: list[int] = []
    parts: list[str] = []
    size = 0
    for k, text in enumerate(texts):
        text = text.lower()
        most = BLOCK
        while len(text) > most:
            starts = word_starts(text[:most])
            whole = (len(starts) - 1) // PASSAGE * PASSAGE
            if whole <= 0:  # words so long that no passage ends here
                most *= 2
                continue
            yield [k], [text[: starts[whole]]]
            text, most = text[starts[whole] :], BLOCK
        if size + len(text) > BLOCK:
            yield owner, parts
            owner, parts, size = [], [], 0
        owner.append(k)
        parts.append(text)
        size += len(text)
    if parts:
        yield owner, parts


def passages(first: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each passage and the part it lies in."""
    count = np.diff(np.append(first, n_words))
    each = -(-count // PASSAGE)
    part = np.repeat(np.arange(len(first)), each)
    nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return first[part] + nth * PASSAGE, part


class Model:
    def __init__(self, table: np.ndarray, bias: float, scale: tuple[float, float]):
        self.table, self.bias, self.scale = table, bias, scale

    def highest(self, texts: list[str]) -> np.ndarray:
        """The highest passage logit of each text; one without words has the bias alone."""
        out = np.full(len(texts), -np.inf)
        for owner, parts in blocks(texts):
            ids, word, first, n = grams(parts)
            if not n:
                continue
            s = np.bincount(word, self.table[ids], n) / np.maximum(1, np.bincount(word, minlength=n))
            at, part = passages(first, n)
            logit = np.add.reduceat(s, at) / np.diff(np.append(at, n)) + self.bias
            np.maximum.at(out, np.array(owner)[part], logit)
        return np.where(np.isfinite(out), out, self.bias)

    def score(self, texts: list[str]) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.highest(texts) + b, -40, 40)))


def train(texts: list[str], labels: list[int], prior: float, rounds: int = 40, seed: int = 3) -> Model | None:
    """Joint training of n-gram embeddings and softmax; prior: the share of label 1 among all labelled texts."""
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return None
    r = np.random.default_rng(seed)
    seen = np.zeros((2, BUCKETS))
    for owner, parts in blocks(texts):
        ids, word, first, n = grams(parts)
        text_of = np.array(owner)[np.searchsorted(first, np.arange(n), side="right") - 1]
        pair = np.unique(ids.astype(np.int64) * len(y) + text_of[word])
        np.add.at(seen, (y[pair % len(y)], pair // len(y)), 1)
    # n-grams that are not clearly tied to the label stay at zero: they would only memorise texts
    df0, df1 = seen
    df, share1 = df0 + df1, y.mean()
    known = (df1 - df * share1) ** 2 > LEAST_CHI2 * np.maximum(df, 1) * share1 * (1 - share1)
    odds = np.where(known, np.log((df1 + 0.5) / (y.sum() + 1)) - np.log((df0 + 0.5) / ((1 - y).sum() + 1)), 0.0)
    # each occurrence of a known n-gram: its passage and its part of the passage's mean
    gram, home, coef, part, n_passages = [], [], [], [], 0
    for owner, parts in blocks(texts):
        ids, word, first, n = grams(parts)
        if not n:
            continue
        at, own = passages(first, n)
        size = np.diff(np.append(at, n))
        passage = np.repeat(np.arange(len(at)), size)
        keep = np.flatnonzero(known[ids])
        w = word[keep]
        gram.append(ids[keep])
        home.append(passage[w] + n_passages)
        coef.append((1.0 / (np.maximum(1, np.bincount(word, minlength=n))[w] * size[passage[w]])).astype(np.float32))
        part.append(np.array(owner)[own])
        n_passages += len(at)
    if not n_passages:
        return None
    gram, home, coef, part = map(np.concatenate, (gram, home, coef, part))
    if (np.diff(part) < 0).any():
        raise AssertionError("passages come in the order of their texts")
    docs = np.unique(part)
    begin = np.searchsorted(part, docs)
    E = (r.standard_normal((BUCKETS, DIM)) * 0.02 * known[:, None]).astype(np.float32)
    E[:, 0] = odds
    U, b = (r.standard_normal((DIM, 2)) * SHARP / 4).astype(np.float32), np.zeros(2, np.float32)
    U[0] = (-SHARP, SHARP)
    mE, vE = np.zeros_like(E), np.zeros_like(E)
    mU, vU, mb, vb = np.zeros_like(U), np.zeros_like(U), np.zeros_like(b), np.zeros_like(b)
    for step in range(1, rounds + 1):
        P = np.stack([np.bincount(home, E[gram, k] * coef, n_passages) for k in range(DIM)], axis=1).astype(np.float32)
        z = P @ U + b
        logit = z[:, 1] - z[:, 0]
        if step <= rounds // 3:
            weight = (1.0 / np.maximum(1, np.bincount(part, minlength=len(y))))[part]
        else:
            top = np.maximum.reduceat(logit, begin)
            weight = (logit >= np.repeat(top, np.diff(np.append(begin, len(part))))).astype(float)
        label = y[part]
        balance = np.where(label == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        d = ((p - label) * weight * balance).astype(np.float32)
        dz = np.stack([-d, d], axis=1)
        gU, gb = P.T @ dz, dz.sum(0)
        back = dz @ U.T
        gE = np.stack([np.bincount(gram, back[home, k] * coef, BUCKETS) for k in range(DIM)], axis=1).astype(np.float32) + DECAY * E
        for x, g, m, v, rate in ((E, gE, mE, vE, 0.15), (U, gU, mU, vU, 0.5), (b, gb, mb, vb, 0.1)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    model = Model((E @ (U[:, 1] - U[:, 0])).astype(np.float32), float(b[1] - b[0]), (1.0, 0.0))
    top = model.highest(texts)
    weight = np.where(y == 1, prior / max(1, y.sum()), (1 - prior) / max(1, (1 - y).sum()))
    a, c = 1.0, 0.0
    for _ in range(300):  # Newton steps for slope and offset, with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(a * top + c, -30, 30)))
        g = np.array([((p - y) * weight * top).sum() + 1e-4 * (a - 1), ((p - y) * weight).sum()])
        q = p * (1 - p) * weight
        H = np.array([[(q * top * top).sum() + 1e-4, (q * top).sum()], [(q * top).sum(), q.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(H, g), -0.5, 0.5)
        a, c = a - move[0], c - move[1]
    model.scale = (float(a), float(c))
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model | None:
    """Train on a bounded sample of labelled rows: the first of each class by hashed id, SAMPLE_EACH at most."""
    rows, prior = common.labelled_sample(docs, labels, label, {1: SAMPLE_EACH[0], 0: SAMPLE_EACH[1]}, SAMPLE_CHARS)
    return train([r.text for r in rows], [r.y for r in rows], prior)


def score_toxicity(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row; narrow, no shuffle. The model is a table of fixed size."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                s = held.value.score(part.column(1).to_pylist()) if held.value else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return common.texts(df, id_col, text_col).mapInArrow(run, "doc_id bigint, score double")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.texts(common.table(spark, sf_dir, "documents"))
    labels = common.table(spark, sf_dir, "labels").where(~common.held_out(3, 1))
    scored = score_toxicity(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(common.held_out(3, 1), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
