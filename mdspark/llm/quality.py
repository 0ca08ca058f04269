"""Text quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of the lines before and behind it;
forward-backward gives each line's probability of being good, and the mean of these weighted by line
length is the text's quality, mapped to a probability by a two-parameter fit. Only whole texts have
labels: lines first take their text's label, then lines of bad texts that look good on their own are
relabelled, and the field with its transitions is trained on the result.

Defined cases: null and empty texts are one empty line; texts of any length and number of lines are
read whole; repeated rows are scored each; other columns are ignored; without labels of both classes
every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bytesblock import SPACE, blocks, range_hashes, spans

#: Labelled texts that training sees at most, of each class; longer ones than this are not picked.
SAMPLE_EACH, SAMPLE_CHARS = 900, 12_000
OWN = 10  # features of a line; with those of both neighbours and a constant:
FEATURES = 3 * OWN + 1


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


# Kinds of bytes that the features count.
ODD = _class(b"#$%&*+/<=>@[\\]^_`{}~")
LETTER = _class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
UPPER = _class(bytes(range(65, 91)))
DIGIT, BANG, BAR, STOP = _class(b"0123456789"), _class(b"!"), _class(b"|"), _class(b".,;:?")


def lines_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines by OWN), lengths and the part of each line."""
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    part_end = np.cumsum([len(p) + 1 for p in parts]) - 1
    part = np.searchsorted(part_end, ends)
    n = ends - starts
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)[ends]])).astype(float)
    ws, we = spans(~SPACE[data])
    line = np.searchsorted(ends, ws)
    words = np.bincount(line, minlength=len(ends)).astype(float)
    h = range_hashes(data, ws, we)
    mixed = h * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    distinct = np.bincount(line[np.unique(mixed, return_index=True)[1]], minlength=len(ends)) if len(ws) else words
    again = np.zeros(len(ws))
    if len(ws) > 1:
        again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    again = np.bincount(line, again, len(ends))
    letters, w, length = count(LETTER[data]), np.maximum(words, 1), np.maximum(n, 1)
    upper = count(UPPER[data]) + count(np.concatenate([[False], (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)]))
    f = [
        np.minimum(1, 6 * count(ODD[data]) / length),
        upper / np.maximum(letters, 1),
        np.minimum(1, count(BANG[data]) / w),
        np.minimum(1, 2 * count(BAR[data]) / w),
        count(DIGIT[data]) / length,
        np.where(words >= 6, 1 - distinct / w, 0.0),
        again / w,
        np.minimum(1, count(STOP[data]) / w),
        np.minimum(1, letters / w / 20),
        np.minimum(1, np.log1p(words) / 6),
    ]
    return np.stack(f, axis=1), n + 1.0, part


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines by FEATURES, lengths, text of each line), lines in the order of the texts."""
    found = [(f, n, np.array(owner)[part]) for owner, parts in blocks(texts, b"\n", 0) for f, n, part in [lines_of(parts)]]
    own, n, text = (np.concatenate([x[i] for x in found]) for i in range(3))
    edge = text[1:] != text[:-1]
    before, behind = np.zeros_like(own), np.zeros_like(own)
    before[1:][~edge] = own[:-1][~edge]
    behind[:-1][~edge] = own[1:][~edge]
    return np.concatenate([own, before, behind, np.ones((len(own), 1))], axis=1), n, text


def forward_backward(node: np.ndarray, trans: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1 for every line and summed pair marginals (2 by 2).

    node: score of label 1 against 0. Chains are walked side by side, longest first.
    """
    order = np.argsort(-count, kind="stable")
    begin, count = begin[order], count[order]
    most = int(count[0]) if len(count) else 0
    live = np.searchsorted(-count, -np.arange(1, most + 1), side="right")  # chains with more than t lines
    alpha, beta = np.zeros((len(node), 2)), np.zeros((len(node), 2))
    both = np.stack([np.zeros_like(node), node], axis=1)
    e = np.exp(trans - trans.max())

    def step(x: np.ndarray, m: np.ndarray) -> np.ndarray:
        top = x.max(1, keepdims=True)
        return top + np.log(np.exp(x - top) @ m + 1e-300)

    alpha[begin] = both[begin]
    for t in range(1, most):
        at = begin[: live[t]] + t
        alpha[at] = step(alpha[at - 1], e) + both[at]
    for t in range(most - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        beta[at] = step(beta[at + 1] + both[at + 1], e.T)
    s = alpha + beta
    p = 1 / (1 + np.exp(np.clip(s[:, 0] - s[:, 1], -700, 700)))
    last = np.zeros(len(node), bool)
    last[begin + count - 1] = True
    i = np.flatnonzero(~last)
    pair = alpha[i][:, :, None] + (trans - trans.max()) + (both[i + 1] + beta[i + 1])[:, None, :]
    pair = np.exp(pair - pair.max((1, 2), keepdims=True))
    return p, (pair / pair.sum((1, 2), keepdims=True)).sum(0)


class Field:
    def __init__(self, w: np.ndarray, trans: np.ndarray, scale: tuple[float, float]):
        self.w, self.trans, self.scale = w, trans, scale

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability of good, length, text) of every line."""
        x, n, text = features(texts)
        begin = np.searchsorted(text, np.arange(len(texts)))
        count = np.diff(np.append(begin, len(text)))
        return forward_backward(x @ self.w, self.trans, begin, count)[0], n, text

    def quality(self, texts: list[str]) -> np.ndarray:
        p, n, text = self.marginals(texts)
        return np.bincount(text, p * n, len(texts)) / np.bincount(text, n, len(texts))

    def score(self, texts: list[str]) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.quality(texts) + b, -40, 40)))


def _adam(x: list[np.ndarray], gradient, rounds: int, rate: float) -> None:
    m, v = [np.zeros_like(a) for a in x], [np.zeros_like(a) for a in x]
    for step in range(1, rounds + 1):
        for k, g in enumerate(gradient()):
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            x[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)


def train(texts: list[str], labels: list[int], prior: float) -> Field | None:
    """prior: the share of label 1 among all labelled texts."""
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return None
    x, n, text = features(texts)
    begin = np.searchsorted(text, np.arange(len(texts)))
    count = np.diff(np.append(begin, len(text)))
    line = y[text].astype(float)
    weight = 1.0 / count[text]
    weight = weight * np.where(line == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, trans = np.zeros(FEATURES), np.zeros((2, 2))

    def alone() -> list[np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        return [x.T @ ((p - line) * weight) + 1e-4 * w]

    _adam([w], alone, 250, 0.1)
    for _ in range(2):  # lines of bad texts that look good are good; each bad text keeps its worst line
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        worst = np.minimum.reduceat(p, begin)
        line = np.where(y[text] == 1, 1.0, ((p > 0.5) & (p > worst[text])).astype(float))
        _adam([w], alone, 120, 0.05)
    seen = np.zeros((2, 2))
    inside = np.flatnonzero(text[1:] == text[:-1])
    np.add.at(seen, (line[inside].astype(int), line[inside + 1].astype(int)), 1)

    def field() -> list[np.ndarray]:
        p, pair = forward_backward(x @ w, trans, begin, count)
        return [x.T @ (p - line) / len(line) + 1e-4 * w, (pair - seen) / len(line) + 1e-4 * trans]

    _adam([w, trans], field, 60, 0.05)
    model = Field(w, trans, (1.0, 0.0))
    q = model.quality(texts)
    share = np.where(y == 1, prior / max(1, y.sum()), (1 - prior) / max(1, (1 - y).sum()))
    ab = np.array([6.0, -3.0])

    def fit() -> list[np.ndarray]:
        d = (1 / (1 + np.exp(-np.clip(ab[0] * q + ab[1], -30, 30))) - y) * share
        return [np.array([(d * q).sum() + 1e-4 * ab[0], d.sum()])]

    _adam([ab], fit, 600, 0.05)
    model.scale = (float(ab[0]), float(ab[1]))
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[Field | None, float]:
    """The field and the share of label 1; trained on SAMPLE_EACH texts of each class at most, the first by hashed id."""
    rows, prior = common.labelled_sample(docs, labels, label, {0: SAMPLE_EACH, 1: SAMPLE_EACH}, SAMPLE_CHARS)
    return train([r.text for r in rows], [r.y for r in rows], prior), prior


def score_quality(df: DataFrame, model: Field | None, prior: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row; narrow, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                s = model.score(part.column(1).to_pylist()) if model else np.full(part.num_rows, prior)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return common.texts(df, id_col, text_col).mapInArrow(run, "doc_id bigint, score double")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.texts(common.table(spark, sf_dir, "documents"))
    labels = common.table(spark, sf_dir, "labels").where(~common.held_out(5, 0))
    scored = score_quality(docs, *fit(docs, labels))
    return scored.select("doc_id", F.coalesce(common.held_out(5, 0), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
