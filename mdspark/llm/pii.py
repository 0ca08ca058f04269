"""Personal data: pattern spans plus a character-level BiLSTM-CRF that adds the spans they miss.

The network (embedding, one LSTM per direction, linear-chain CRF over begin/inside tags) is trained
in numpy on the driver from windows around labelled spans of a bounded sample of documents. Texts are
cut into overlapping windows on a fixed grid; each window that holds a digit or '@' is decoded (no
span of these four kinds is without one, so the others are all 'outside' by definition). A character
takes its tag from the window in whose middle it lies deepest; the tags are then read as one sequence
over the whole text, so that spans crossing window edges come out whole. Spans that touch a pattern
span or that no longer look like their kind are dropped; pattern spans always stay.

Defined cases: null and empty texts have no spans; texts of any length are read whole; repeated rows
are scored each; other columns are ignored; with an empty table or a sample without spans there is no
network and only pattern spans are returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind changes no match: one that starts inside a run of digits would start at its beginning.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")

#: Documents and windows that training sees at most; characters of a window and of the step between windows.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_WINDOWS = 900, 20_000, 1500
WINDOW, STEP = 96, 48
EMBED, HIDDEN, TAGS = 8, 16, 1 + 2 * len(KINDS)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = 2 * d if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pattern_spans(text: str) -> list[list[tuple[int, int]]]:
    """(start, end) by kind: leftmost and non-overlapping, failing matches dropped without retries."""
    out: list[list[tuple[int, int]]] = [[], [], [], []]
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            out[0].append((start, done))
        at = text.find("@", at + 1)
    if _TRIGGER.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                out[1].append(m.span())
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out[2].append(m.span())
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out[3].append(m.span())
    return out


def symbols(text: str) -> np.ndarray:
    """Small classes of characters: printable ASCII as itself, line ends, other letters, the rest."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((codes >= 32) & (codes < 127), codes - 31, np.where(codes < 32, 96, np.where(codes < 0x250, 97, 98)))


SYMBOLS = 99  # 0 pads


def window_starts(n: int, hits: np.ndarray) -> np.ndarray:
    """Starts on the grid of the windows that hold a hit."""
    last = max(0, -(-(n - WINDOW) // STEP)) * STEP
    k = hits // STEP
    starts = np.unique(np.concatenate([k, k - 1, *(k - i for i in range(2, WINDOW // STEP))])) * STEP
    starts = starts[(starts >= 0) & (starts <= last)]
    return starts if len(starts) else np.array([0])


class Tagger:
    """The network. Parameters are plain arrays, so it ships as a small closure."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        w = lambda *s: (r.standard_normal(s) * (1.0 / np.sqrt(s[0]))).astype(np.float32)
        self.p = {"E": w(SYMBOLS, EMBED) * 3, "O": w(2 * HIDDEN, TAGS), "o": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32), "S": np.zeros(TAGS, np.float32)}
        for d in "fb":
            self.p |= {"W" + d: w(EMBED, 4 * HIDDEN), "U" + d: w(HIDDEN, 4 * HIDDEN), "c" + d: np.zeros(4 * HIDDEN, np.float32)}
            self.p["c" + d][HIDDEN : 2 * HIDDEN] = 1.0

    def lstm(self, x: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """x: time, batch, EMBED. Hidden states in the order of x."""
        n, b = x.shape[:2]
        h, c = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        pre = x.reshape(n * b, -1) @ self.p["W" + d] + self.p["c" + d]
        pre = pre.reshape(n, b, -1)
        out = np.empty((n, b, HIDDEN), np.float32)
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            z = pre[t] + h @ self.p["U" + d]
            s = 1.0 / (1.0 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            c0, h0 = c, h
            c = f * c0 + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep is not None:
                keep.append((t, i, f, o, g, c0, h0, tc))
        return out

    def emissions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """x: time, batch of symbols -> time, batch, TAGS."""
        e = self.p["E"][x]
        parts = {d: [] if keep is not None else None for d in "fb"}
        h = np.concatenate([self.lstm(e, d, parts[d]) for d in "fb"], axis=2)
        if keep is not None:
            keep |= {"e": e, "h": h, **parts}
        return h @ self.p["O"] + self.p["o"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi: the best tags, time by batch."""
        em = self.emissions(x)
        score, back = self.p["S"] + em[0], []
        for t in range(1, len(em)):
            all_ = score[:, :, None] + self.p["T"]
            back.append(all_.argmax(1))
            score = all_.max(1) + em[t]
        tags = np.empty(em.shape[:2], np.int64)
        tags[-1] = score.argmax(1)
        for t in range(len(em) - 2, -1, -1):
            tags[t] = np.take_along_axis(back[t], tags[t + 1][:, None], 1)[:, 0]
        return tags

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log likelihood of tags y (time by batch)."""
        keep: dict = {}
        em = self.emissions(x, keep)
        n, b = x.shape
        T, g = self.p["T"], {k: np.zeros_like(v) for k, v in self.p.items()}
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[0] = self.p["S"] + em[0]
        for t in range(1, n):
            alpha[t] = lse(alpha[t - 1][:, :, None] + T, 1) + em[t]
        for t in range(n - 2, -1, -1):
            beta[t] = lse(T + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        dem = np.exp(alpha + beta - z[None, :, None])
        for t in range(1, n):
            pair = np.exp(alpha[t - 1][:, :, None] + T + (em[t] + beta[t])[:, None, :] - z[:, None, None])
            g["T"] += pair.sum(0)
            np.add.at(g["T"], (y[t - 1], y[t]), -1)
        tt, bb = np.meshgrid(np.arange(n), np.arange(b), indexing="ij")
        dem[tt, bb, y] -= 1
        g["S"] += dem[0].sum(0)
        g["O"] += keep["h"].reshape(n * b, -1).T @ dem.reshape(n * b, -1)
        g["o"] += dem.sum((0, 1))
        dh_all, de = dem @ self.p["O"].T, np.zeros_like(keep["e"])
        for k, d in enumerate("fb"):
            U, dz_all = self.p["U" + d], np.empty((n, b, 4 * HIDDEN), np.float32)
            dh, dc = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
            for t, i, f, o, gg, c0, h0, tc in reversed(keep[d]):
                dh = dh + dh_all[t][:, k * HIDDEN : (k + 1) * HIDDEN]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                g["U" + d] += h0.T @ dz
                dz_all[t] = dz
                dh, dc = dz @ U.T, dc * f
            flat = dz_all.reshape(n * b, -1)
            g["W" + d] += keep["e"].reshape(n * b, -1).T @ flat
            g["c" + d] += flat.sum(0)
            de += (flat @ self.p["W" + d].T).reshape(de.shape)
        np.add.at(g["E"], x.ravel(), de.reshape(n * b, -1))
        return {k: v / b for k, v in g.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 14, batch: int = 80, rate: float = 0.03, seed: int = 11) -> Tagger:
        """Adam with clipped gradients; x, y: time by windows."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        step, total = 0, epochs * -(-x.shape[1] // batch)
        for _ in range(epochs):
            for part in np.array_split(r.permutation(x.shape[1]), -(-x.shape[1] // batch)):
                g = self.gradients(x[:, part], y[:, part])
                norm = np.sqrt(sum((a * a).sum() for a in g.values()))
                step += 1
                lr = rate * (1 - step / (total + 1))
                for k, a in g.items():
                    a = a * min(1.0, 5.0 / (norm + 1e-12))
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v[k] = 0.99 * v[k] + 0.01 * a * a
                    self.p[k] = self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self


def tags_of(n: int, spans: list[list[tuple[int, int]]]) -> np.ndarray:
    """Begin/inside tags; where kinds overlap, the earlier kind keeps its characters."""
    y = np.zeros(n, np.int64)
    for k, own in enumerate(spans):
        for a, b in own:
            if not y[a:b].any():
                y[a:b] = 2 + 2 * k
                y[a] = 1 + 2 * k
    return y


def disguised(kind: int, text: str, r: np.random.Generator) -> str:
    """A span's text as it is written to be read by people only; a digit or '@' stays."""
    pick = int(r.integers(3))
    if kind == 0:
        name, domain = text.rsplit("@", 1)
        return [f"{name} @ {domain}", f"{name}@{domain.replace('.', ' . ')}", f"{name} @ {domain.replace('.', ' dot ')}"][pick]
    if kind == 1:
        return text.replace(".", ["[.]", " . ", "(.)"][pick])
    digits = re.sub("[^0-9]", "", text)
    if kind == 2:
        return [".", "/", "_"][pick].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    local = re.sub(r"^\+[0-9]{1,3}[ .-]?", "", text)
    if pick == 0 and sum("0" <= c <= "9" for c in local) >= 7:
        return local
    return "00" + text[1:] if pick == 1 else re.sub("[ -]", "/", text)


def training_windows(texts: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray] | None:
    """Windows at random offsets around the labelled spans and around other digits, as (symbols, tags).

    Half of the spans are shown a second time in a disguised form, so that the network learns what
    the patterns cannot say.
    """
    r = np.random.default_rng(seed)
    made: list[tuple[np.ndarray, np.ndarray]] = []
    for text in texts:
        spans = pattern_spans(text)
        versions = [(text, spans)]
        for k, a, b in [(k, a, b) for k, own in enumerate(spans) for a, b in own]:
            if r.random() < 0.5:
                lo, form = max(0, a - 2 * WINDOW), disguised(k, text[a:b], r)
                short = text[lo:a] + form + text[b : b + 2 * WINDOW]
                start, end = a - lo, a - lo + len(form)
                own = [[s for s in kept if s[1] <= start or end <= s[0]] for kept in pattern_spans(short)]
                own[k] = sorted([*own[k], (start, end)])
                versions.append((short, own))
        for t, own in versions:
            x, y = symbols(t), tags_of(len(t), own)
            centres = [(a + b) // 2 for s in own for a, b in s] + [m.start() for m in _TRIGGER.finditer(t) if not y[m.start()]][:2]
            for c in centres:
                lo = max(0, min(int(c - r.integers(8, WINDOW - 8)), len(t) - WINDOW))
                made.append((np.pad(x[lo : lo + WINDOW], (0, max(0, WINDOW - len(t)))), np.pad(y[lo : lo + WINDOW], (0, max(0, WINDOW - len(t))))))
    if not any(y.any() for _, y in made):
        return None
    made = [made[i] for i in r.permutation(len(made))[:SAMPLE_WINDOWS]]
    return np.array([x for x, _ in made]).T, np.array([y for _, y in made]).T


def train(docs: DataFrame) -> Tagger | None:
    """From at most SAMPLE_DOCS texts of at most SAMPLE_CHARS characters that hold a digit or '@'."""
    usable = docs.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS))
    ids = usable.where("doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()  # ids first: texts are not sorted
    if not ids:
        return None
    small = docs.sparkSession.createDataFrame(ids, "doc_id bigint").dropDuplicates()
    rows = sorted(usable.join(F.broadcast(small), "doc_id").select("doc_id", "text").collect())
    windows = training_windows([r.text for r in rows[:SAMPLE_DOCS]])
    return None if windows is None else Tagger().fit(*windows)


def plausible(kind: int, text: str) -> bool:
    """Whether an added span could be of its kind: the patterns' own checks on its digits, whatever stands between them."""
    if kind == 0:
        name, _, domain = text.partition("@")
        return bool(name.strip()) and re.search(r"[A-Za-z0-9](?: ?\. ?| dot )[A-Za-z0-9]", domain) is not None
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    digits = "".join(c for c in text if "0" <= c <= "9")
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 7 <= len(digits) <= 15


def model_spans(texts: list[str], tagger: Tagger, block: int = 1024) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) of every text, from overlapping windows read as one sequence per text."""
    plan: list[tuple[int, int]] = []
    xs: list[np.ndarray] = []
    tags: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def flush() -> None:
        if not xs:
            return
        found = tagger.decode(np.array(xs).T)
        depth = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1
        for (k, s), y in zip(plan, found.T):
            n = len(texts[k])
            if k not in tags:
                tags[k] = np.zeros(n, np.int8), np.zeros(n, np.int8)
            best, deep = tags[k]
            end = min(n, s + WINDOW)
            d = depth[: end - s].copy()
            if s == 0:
                d[: WINDOW // 2] = WINDOW
            if end == n:
                d[-(WINDOW // 2) :] = WINDOW
            better = d > deep[s:end]
            best[s:end][better] = y[: end - s][better]
            deep[s:end][better] = d[better]
        plan.clear()
        xs.clear()

    for k, text in enumerate(texts):
        if not _TRIGGER.search(text):
            continue
        x = symbols(text)
        hits = np.flatnonzero(((x >= 17) & (x <= 26)) | (x == 33))
        for s in window_starts(len(text), hits).tolist():
            w = x[s : s + WINDOW]
            plan.append((k, s))
            xs.append(np.pad(w, (0, WINDOW - len(w))))
            if len(xs) >= block:
                flush()
    flush()
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (y, _) in tags.items():
        at = np.flatnonzero(y)
        start = kind = -1
        prev = -2
        for i in [*at.tolist(), len(y) + 1]:
            tag = int(y[i]) if i < len(y) else 0
            now = (tag - 1) // 2
            if start >= 0 and (i != prev + 1 or tag % 2 == 1 or now != kind):
                a, b = start, prev + 1
                while a < b and texts[k][a] in " -.,;:!?\n":
                    a += 1
                while b > a and texts[k][b - 1] in " -.,;:!?\n":
                    b -= 1
                if b > a and plausible(kind, texts[k][a:b]):
                    out[k].append((kind, a, b))
                start = -1
            if start < 0:
                start, kind = i, now
            prev = i
    return out


def find_pii(df: DataFrame, tagger: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id and spans array<struct<kind, start, end, added>>, ordered by kind and start.

    Code points, end exclusive; added marks spans that only the network found. Narrow, no shuffle.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(1).to_pylist()
                extra = model_spans(texts, tagger) if tagger else [[] for _ in texts]
                rows = []
                for text, more in zip(texts, extra):
                    base = pattern_spans(text)
                    if not more and not any(base):
                        rows.append([])
                        continue
                    held = [s for own in base for s in own]
                    found = [(k, a, b, False) for k, own in enumerate(base) for a, b in own]
                    found += [(k, a, b, True) for k, a, b in more if not any(a < y and x < b for x, y in held)]
                    rows.append([{"kind": KINDS[k], "start": a, "end": b, "added": new} for k, a, b, new in sorted(found)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(kind))], names=["doc_id", "spans"])

    return common.texts(df, id_col, text_col).mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,added:boolean>>")


def op4_pii(spark, sf_dir: str) -> DataFrame:
    docs = common.texts(common.table(spark, sf_dir, "documents"))
    found = find_pii(docs, train(docs))
    base = F.filter("spans", lambda s: ~s.added)
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda k: F.size(F.filter(base, lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s.added)).cast("long").alias("n_added"))
