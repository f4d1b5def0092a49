"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

A text is cut into words by the public byte-level pattern. Words that the worker has not met are
encoded together: their byte symbols lie in one flat array, each round finds the rank of every adjacent
pair by binary search over the sorted pair keys, takes the lowest rank of each word with a segmented
minimum, and merges its occurrences from left to right; finished words leave the array. A word takes as
many rounds as it has different merges, so a very long one without a break takes long, but the same way.
Decoding gathers the bytes of all ids at once from one table.

Defined cases: a null or empty text has no ids and decodes to the empty text; the special string of the
vocabulary is one id wherever it stands, as in the tokenizers library; repeated rows stay repeated rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

VOCABULARY = "byte_bpe_50k.json"
CACHED_WORDS = 200_000
#: For texts of these characters alone the standard library's classes mean the same as the pattern's, and are faster.
PLAIN = re.compile("[^\t\n\r -~\u00a1-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u024f\u2010-\u2027\u2030-\u205e]")
PLAIN_PATTERN = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
NONE = np.iinfo(np.int64).max

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others for the letters from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.start = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.start[byte] = vocab[letter]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in merges]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made_by_rank = keys[order], order.astype(np.int64), made
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.lengths = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, b in self.bytes_of.items():
            self.lengths[i] = len(b)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.table = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(self.lengths))), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs by binary search; NONE where there is no merge."""
        want = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and the number of ids of each word."""
        size = np.array([len(w) for w in words], np.int64)
        batch = np.flatnonzero(size > 0)
        if not len(batch):
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        done = self._rounds(batch, [words[i] for i in batch])
        own, count, flat = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(own, kind="stable")
        start = (np.cumsum(count) - count)[order]
        count = count[order]
        at = np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
        sizes = np.zeros(len(words), np.int64)
        sizes[own[order]] = count
        return flat[at], sizes

    def _rounds(self, own: np.ndarray, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        out = []
        size = np.array([len(w) for w in words], np.int64)
        sym = self.start[np.frombuffer(b"".join(words), np.uint8)]
        first = np.cumsum(size) - size
        rank = self._all_ranks(sym, first, size)
        while True:
            low = np.minimum.reduceat(rank, first)
            done = low == NONE
            if done.any():
                here = np.repeat(done, size)
                out.append((own[done], size[done], sym[here]))
                keep, here = ~done, ~here
                sym, rank, own, size, low = sym[here], rank[here], own[keep], size[keep], low[keep]
                if not len(own):
                    return out
                first = np.cumsum(size) - size
            word = np.repeat(np.arange(len(own)), size)
            hit = np.flatnonzero(rank == low[word])
            # of hits in a row, which overlap, every second one merges, from the left
            new_run = np.ones(len(hit), bool)
            new_run[1:] = (hit[1:] != hit[:-1] + 1) | (word[hit[1:]] != word[hit[:-1]])
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run_start) % 2 == 0]
            sym[hit] = self.made_by_rank[rank[hit]]
            here = np.ones(len(sym), bool)
            here[hit + 1] = False
            size = size - np.bincount(word[hit], minlength=len(own))
            moved = hit - np.arange(len(hit))  # where the merged symbols stand after the others have gone
            sym, rank = sym[here], rank[here]
            first = np.cumsum(size) - size
            last = np.zeros(len(sym), bool)
            last[first + size - 1] = True
            near = np.zeros(len(sym) + 1, bool)
            near[moved] = near[moved - 1] = True
            near[-1] = False
            redo = np.flatnonzero(near[:-1])
            right = np.minimum(redo + 1, len(sym) - 1)
            rank[redo] = np.where(last[redo], NONE, self.rank(sym[redo], sym[right]))

    def _all_ranks(self, sym: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        rank = np.full(len(sym), NONE)
        rank[:-1] = self.rank(sym[:-1], sym[1:])
        rank[first + size - 1] = NONE
        return rank

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """The bytes of each sequence of ids in a flat array."""
        size = self.lengths[ids]
        end = np.append(0, np.cumsum(size))
        flat = self.table[np.repeat(self.begins[ids] - end[:-1], size) + np.arange(end[-1])].tobytes()
        at = end[off].tolist()
        return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def parts(self, text: str) -> list[str]:
        """Words and special strings of a text, in order."""
        find = self.pattern.findall if PLAIN.search(text) else PLAIN_PATTERN.findall
        if self.cut is None or not any(s in text for s in self.special):
            return find(text)
        out: list[str] = []
        for x in self.cut.split(text):
            out += [x] if x in self.special else find(x)
        return out


class Codec:
    """Encoder with a bounded memory of words. A word is known by its ids, as text and as 32-bit integers."""

    def __init__(self, path: str):
        self.bpe = ByteBpe(path)
        self.names = {i: str(i) for i in self.bpe.bytes_of}
        self.clear()

    def clear(self) -> None:
        self.words = {s: (str(i), np.int32(i).tobytes()) for s, i in self.bpe.special.items()}

    def learn(self, new: list[str]) -> None:
        flat, sizes = self.bpe.encode_words([w.encode() for w in new])
        names, data = list(map(self.names.__getitem__, flat.tolist())), flat.astype("<i4").tobytes()
        at = 0
        for w, n in zip(new, sizes.tolist(), strict=True):
            self.words[w] = (",".join(names[at : at + n]), data[4 * at : 4 * (at + n)])
            at += n

    def known(self, texts: list[str]) -> list[list[tuple[str, bytes]]]:
        """For each text the entries whose ids, in order, are its ids."""
        parts = [self.bpe.parts(t) for t in texts]
        every = set().union(*parts)
        new = every.difference(self.words)
        if new:
            if len(self.words) + len(new) > CACHED_WORDS:
                self.clear()
                new = every.difference(self.words)
            self.learn(list(new))
        return [list(map(self.words.__getitem__, p)) for p in parts]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join([e[1] for e in found]), "<i4") for found in self.known(texts)]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, hash of the ids as text, hash of the text that the ids decode to."""
        names, data = [], []
        for found in self.known(texts):
            a, b = zip(*found, strict=True) if found else ((), ())
            names.append(",".join(a).encode())
            data.append(b"".join(b))
        ids = np.frombuffer(b"".join(data), "<i4")
        off = np.cumsum([0, *(len(x) // 4 for x in data)])
        texts = self.bpe.decode(ids, off)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return [(int(n), sha(a), sha(t.decode("utf-8", "replace").encode())) for n, a, t in zip(np.diff(off), names, texts, strict=True)]

    def decode(self, sequences: list[list[int] | np.ndarray]) -> list[str]:
        ids = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in sequences)])
        return [t.decode("utf-8", "replace") for t in self.bpe.decode(ids, np.cumsum([0, *map(len, sequences)]))]


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and token_ids (array of int) of each whole text."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codec(path).encode(texts_of(batch)), pa.list_(pa.int32()))], ["doc_id", "token_ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, token_ids array<int>")


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of token_ids; null ids are the empty text."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = codec(path).decode([x or [] for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encodes each whole text and decodes its ids; digests of both (see DIGESTS)."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        for batch in slices(batches, "text", 1 << 20):
            made = known.digests(texts_of(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, DIGESTS)
