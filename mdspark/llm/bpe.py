"""BPE encoding and decoding with forced boundaries.

Two neighbouring symbols that stand next to each other inside no vocabulary token can never be
merged over, so every such pair is a certain cut. A word is cut there, the fragments are encoded
on their own and their ids are concatenated. Words are memoised per task, within a bound, so that
the merge loop runs once for each distinct one.

Defined cases: null and empty texts give no ids and decode to the empty string; texts of any
length are encoded whole; special-token strings in a text become their ids; repeated rows are
encoded each; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Words, and stretches without white space, that a worker remembers before it starts anew; characters encoded at once.
CACHE, BLOCK = 150_000, 1_000_000
#: Fragments above this length are merged with a heap; the rank of a pair that has none.
LONG, NONE = 48, 1 << 40
# The white space of the vocabulary's split pattern, and that pattern.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return [chr(b) if b in shown else chr(0x100 + [x for x in range(256) if x not in shown].index(b)) for b in range(256)]


# How a vocabulary file that this codec reads says that text is normalised, split and merged.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}


def check_spec(spec: dict) -> None:
    """An error for a vocabulary whose text is treated in another way than this codec does."""
    model = spec["model"]
    off = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    off += ["model"] * (model.get("type") != "BPE") + ["end_of_word_suffix"] * (not model.get("end_of_word_suffix"))
    off += [k for k, want in (("normalizer", NORMALIZER), ("pre_tokenizer", PRE_TOKENIZER), ("post_processor", None), ("decoder", None)) if spec.get(k) != want]
    off += ["added_tokens"] * any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if off:
        raise ValueError(f"this vocabulary is not of the kind that is encoded here: {', '.join(off)}")


class BpeCodec:
    """A word-end byte-level BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, spec: str):
        import regex

        spec = json.loads(spec)
        check_spec(spec)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab = vocab = model["vocab"]
        self.special = special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        top = max([*vocab.values(), *special.values()]) + 1
        self.base = top
        # (left id, right id) as one number -> rank; rank -> merged id
        self.ranks, merged = {}, []
        for r, m in enumerate(model["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            self.ranks[vocab[left] * top + vocab[right]] = r
            merged.append(vocab[left + right])
        self.merged = np.array(merged, np.int64)
        self.keys = np.array(sorted(self.ranks), np.int64)
        self.key_rank = np.array([self.ranks[k] for k in self.keys.tolist()], np.int64)
        self.pairs = {p for t in vocab for s in [self.split(t)] for p in zip(s, s[1:])}
        self.byte = [vocab[c] for c in byte_symbols()]
        self.last = [vocab[c + self.end] for c in byte_symbols()]
        # the same as (left id, right id) numbers
        self.inner = {vocab[a] * top + vocab[b] for a, b in self.pairs if a in vocab and b in vocab}
        self.inner_keys = np.array(sorted(self.inner), np.int64)
        self.byte_of, self.last_of = np.array(self.byte, np.int64), np.array(self.last, np.int64)
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.find = regex.compile(WORDS).findall
        self.odd = re.compile("[\x1c-\x1f]").search  # str.split() takes these for white space, the vocabulary does not
        self.white = regex.compile("[" + SPACE + "]+").split
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else None
        token = {i: t for t, i in [*vocab.items(), *special.items()]}
        self.decimal = [str(i) for i in range(top)]
        self.shown = [token.get(i, "") for i in range(top)]

    def split(self, token: str) -> list[str]:
        """A token's base symbols; the last one carries the word end."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            token = token[: -len(self.end)]
            return [*token[:-1], token[-1] + self.end]
        return list(token)

    def words_of(self, chunk: str) -> list[str]:
        """The words of a stretch without white space."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
            if chunk[-1] in ".," and chunk[:-1].isalpha():
                return [chunk[:-1].lower(), chunk[-1]]
        return self.find(self.normalize(chunk))

    def encode_words(self, words: list[str]) -> None:
        """Put the ids of all these words into the memo, in one vectorised run over their fragments."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        ends = np.cumsum([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.byte_of[data]
        symbols[ends - 1] = self.last_of[data[ends - 1]]
        cut = np.zeros(len(symbols), bool)  # a fragment ends here
        pairs = symbols[:-1] * self.base + symbols[1:]
        cut[:-1] = self._at(self.inner_keys, pairs)[1]  # forced boundaries
        cut[ends - 1] = True
        for i, out in self.merge(symbols, cut):
            symbols[i] = out
        kept = np.flatnonzero(symbols >= 0)
        ids = symbols[kept].tolist()
        to = np.searchsorted(kept, ends).tolist()
        start = 0
        for w, end in zip(words, to):
            self.words[w] = tuple(ids[start:end])
            start = end

    def _at(self, keys: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pairs stand in sorted keys, and which are missing."""
        at = np.searchsorted(keys, pairs)
        at[at == len(keys)] = 0
        return at, keys[at] != pairs

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at, missing = self._at(self.keys, left * self.base + right)
        return np.where(missing, NONE, self.key_rank[at])

    def merge(self, symbols: np.ndarray, cut: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merge each fragment in rank order, leftmost first: one merge per fragment and round.

        Yields (places, ids) to write back; a place that a merge swallowed gets -1. Long fragments
        go through a heap instead, so that rounds stay few.
        """
        last = np.flatnonzero(cut)
        first = np.concatenate([[0], last[:-1] + 1])
        size = last - first + 1
        for a, b in zip(first[size > LONG].tolist(), last[size > LONG].tolist()):
            yield np.arange(a, b + 1), self.merge_long(symbols[a : b + 1].tolist())
        where = np.flatnonzero(np.repeat((size > 1) & (size <= LONG), size))
        part, cut = symbols[where], cut[where]
        rank = np.full(len(part), NONE)
        open_ = np.flatnonzero(~cut)
        rank[open_] = self._rank(part[open_], part[open_ + 1])
        while len(part):
            starts = np.flatnonzero(np.concatenate([[True], cut[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(part)))
            done = best == NONE
            if done.any():
                over = np.repeat(done, sizes)
                yield where[over], part[over]
                part, cut, rank, where = part[~over], cut[~over], rank[~over], where[~over]
                sizes, best = sizes[~done], best[~done]
                if not len(part):
                    return
                starts = np.cumsum(sizes) - sizes
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            i = hits[np.searchsorted(hits, starts)]  # the leftmost of each fragment
            part[i] = self.merged[best]
            cut[i] = cut[i + 1]
            yield where[i + 1], np.full(len(i), -1)
            keep = np.ones(len(part), bool)
            keep[i + 1] = False
            rank[i] = NONE
            part, cut, rank, where = part[keep], cut[keep], rank[keep], where[keep]
            i = i - np.arange(len(i))
            for j in (i[~cut[i]], i[i > 0][~cut[i[i > 0] - 1]] - 1):
                rank[j] = self._rank(part[j], part[j + 1])

    def merge_long(self, part: list[int]) -> np.ndarray:
        """One fragment of any length, with a heap over a linked list."""
        base, rank, merged = self.base, self.ranks.get, self.merged
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank(part[i] * base + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = int(merged[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(part[i] * base + part[k])) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[k]))
            if (h := before[i]) >= 0 and (r := rank(part[h] * base + part[i])) is not None:
                heapq.heappush(heap, (r, h, part[h], part[i]))
        return np.array(part)

    def normalize(self, text: str) -> str:
        """NFC, then lower case one character at a time (no rule for a final sigma)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")
        return text.lower()

    def split_chunks(self, text: str) -> list[str]:
        return [c for c in self.white(text) if c] if self.odd(text) else text.split()

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text, in blocks of some million characters."""
        block: list[list[str]] = []
        size = 0
        for text in texts:
            if self.cut and "<|" in text:
                block.append([c for part in self.cut(text) for c in ([part] if part in self.special else self.split_chunks(part))])
            else:
                block.append(self.split_chunks(text))
            size += len(text)
            if size >= BLOCK:
                yield from self.encode_block(block)
                block, size = [], 0
        yield from self.encode_block(block)

    def encode_block(self, block: list[list[str]]) -> Iterator[list[int]]:
        if len(self.chunks) > CACHE:
            self.chunks = {}
        if len(self.words) > CACHE:
            self.words = {}
        found = self.chunks
        new = {c: self.words_of(c) for c in set().union(*block) if c not in found and c not in self.special}
        if words := list({w for ws in new.values() for w in ws if w not in self.words}):
            self.encode_words(words)
        word = self.words
        for c, ws in new.items():
            found[c] = word[ws[0]] if len(ws) == 1 else tuple([i for w in ws for i in word[w]])
        for s, i in self.special.items():  # only the splitter above makes a chunk of one
            found[s] = (i,)
        for chunks in block:
            yield list(chain.from_iterable(map(found.__getitem__, chunks)))

    def decode(self, ids: list[int]) -> str:
        """The vocabulary has no decoder, so tokens are joined by spaces."""
        shown = self.shown
        return " ".join([shown[i] for i in ids])


OUTPUTS = {"ids": pa.list_(pa.int32()), "decoded": pa.string(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
_TYPES = {"ids": "array<int>", "decoded": "string", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}


def _held(df: DataFrame, spec: str):
    """The codec in a task: a worker process builds it once and keeps it, with its memo, for its later tasks."""
    shared = df.sparkSession.sparkContext.broadcast({"spec": spec})
    make = BpeCodec

    def get() -> BpeCodec:
        if "codec" not in shared.value:
            shared.value["codec"] = make(shared.value["spec"])
        return shared.value["codec"]

    return get


def bpe_encode(df: DataFrame, spec: str, outputs: tuple[str, ...] = ("ids",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id and the outputs asked for (any of OUTPUTS).

    spec: the vocabulary file's text, shipped once per task as a broadcast of fixed size.
    Narrow: no shuffle, one pass over the texts.
    """
    held = _held(df, spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held()
        schema = pa.schema([("doc_id", pa.int64()), *((k, OUTPUTS[k]) for k in outputs)])
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            made: dict[str, list] = {k: [] for k in outputs}
            for ids in codec.encode(batch.column(1).to_pylist()):
                decoded = codec.decode(ids) if "decoded" in made or "decoded_sha256" in made else ""
                for k, to in made.items():
                    to.append(ids if k == "ids" else decoded if k == "decoded" else len(ids) if k == "n_tokens" else sha(decoded) if k == "decoded_sha256" else sha(" ".join([codec.decimal[i] for i in ids])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[k], OUTPUTS[k]) for k in outputs)], schema=schema)

    return common.texts(df, id_col, text_col).mapInArrow(run, "doc_id bigint, " + ", ".join(f"{k} {_TYPES[k]}" for k in outputs))


def bpe_decode(df: DataFrame, spec: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) from a column of id arrays; null arrays decode to the empty string."""
    held = _held(df, spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held()
        for batch in batches:
            out = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "decoded"])

    return df.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{ids_col}` AS ids").mapInArrow(run, "doc_id bigint, decoded string")


def read_spec(path: str | None = None) -> str:
    """A vocabulary file's text; the path is a parameter, by default the installed word-level vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return bpe_encode(common.table(spark, sf_dir, "documents"), read_spec(), ("n_tokens", "ids_sha256", "decoded_sha256"))
