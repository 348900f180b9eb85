"""Encoding of a whole corpus with a public byte-level BPE vocabulary (problem 6).

Method: two tiers.  A pre-token that is itself in the vocabulary is resolved by a minimal perfect
hash (hash-and-displace: one slot per key, one comparison to confirm the key).  Anything else is
merged with a heap of candidate pairs over a doubly linked list of bytes, O(n log n) in the
pre-token's length, so a run of 100,000 equal letters costs no more than its share.

Null and empty texts get an empty list; strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from tidemark.llm.common import TOKENIZER_DIR, spread

#: Fixed value: the public pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class PerfectHash:
    """Minimal perfect hash of byte strings to their values: ``len(keys)`` slots, no empty ones.

    Keys fall into buckets by one half of a 64-bit hash; buckets are placed from the fullest down by
    the first displacement that sends all their keys to free slots, and buckets of one key point at
    a free slot directly.
    """

    def __init__(self, items: dict[bytes, int]) -> None:
        keys = list(items)
        n = len(keys)
        self.n, self.m = n, max(1, n // 4)
        self.shift = np.zeros(self.m, dtype=np.int64)
        slots: list[bytes | None] = [None] * n
        buckets: list[list[tuple[bytes, int]]] = [[] for _ in range(self.m)]
        for k in keys:
            h = xxhash.xxh3_64_intdigest(k)
            buckets[(h >> 40) % self.m].append((k, h & 0xFFFFFFFFFF))
        free_at = 0
        for b in sorted(range(self.m), key=lambda i: -len(buckets[i])):
            own = buckets[b]
            if len(own) > 1:
                d = 0
                while True:
                    at = {((low ^ (d * 0x9E3779B97F)) & 0xFFFFFFFFFF) % n for _, low in own}
                    if len(at) == len(own) and all(slots[p] is None for p in at):
                        break
                    d += 1
                for k, low in own:
                    slots[((low ^ (d * 0x9E3779B97F)) & 0xFFFFFFFFFF) % n] = k
                self.shift[b] = d
            elif own:
                while slots[free_at] is not None:
                    free_at += 1
                slots[free_at] = own[0][0]
                self.shift[b] = -free_at - 1
        self.keys: list[bytes] = slots  # type: ignore[assignment]
        self.values = [items[k] for k in self.keys]
        self.shifts = self.shift.tolist()

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shifts[(h >> 40) % self.m]
        at = -d - 1 if d < 0 else (((h & 0xFFFFFFFFFF) ^ (d * 0x9E3779B97F)) & 0xFFFFFFFFFF) % self.n
        return self.values[at] if self.keys[at] == key else None


def merge_bytes(piece: bytes, rank) -> list[int]:
    """Byte-pair merges of one pre-token: lowest rank first, leftmost on ties, by a heap over linked bytes."""
    n = len(piece)
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    dead = bytearray(n)
    while heap:
        r, i, stop = heapq.heappop(heap)
        if dead[i] or nxt[i] >= n or end[nxt[i]] != stop:
            continue  # the pair has changed since it was pushed
        j = nxt[i]
        dead[j], end[i], nxt[i] = 1, stop, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            r = rank(piece[i : end[nxt[i]]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if (p := prv[i]) >= 0:
            r = rank(piece[p:stop])
            if r is not None:
                heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(rank(piece[i : end[i]]))
        i = nxt[i]
    return out


class _Lengths(dict):
    """Numbers of tokens by pre-token, remembered as an encoder's ids are."""

    def __init__(self, of: BytePairEncoder) -> None:
        self.of = of

    def __missing__(self, text: str) -> int:
        n = len(self.of.piece(text))
        if len(self) >= self.of.memo_size:
            self.clear()
        if len(text) <= 64:
            self[text] = n
        return n


class BytePairEncoder:
    """Encoder of one rank file.  ``memo`` keeps at most ``memo_size`` recent pre-tokens, then starts anew."""

    def __init__(self, path: str, memo_size: int = 1 << 17) -> None:
        with open(path, "rb") as f:
            self.ranks = PerfectHash({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})
        self.split = regex.compile(PATTERN).findall
        self.memo: dict[str, list[int]] = {}
        self.memo_size = memo_size
        self.lengths = _Lengths(self)

    def piece(self, text: str) -> list[int]:
        raw = text.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else merge_bytes(raw, self.ranks.get)
        if len(self.memo) >= self.memo_size:
            self.memo.clear()
        if len(text) <= 64:
            self.memo[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        memo, add = self.memo, out.extend
        for p in self.split(text):
            ids = memo.get(p)
            add(ids if ids is not None else self.piece(p))
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.lengths.__getitem__, self.split(text)))


class LibraryEncoder:
    """The public tokenizers that are not rank files, through their own libraries."""

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda t: list(sp.encode(t)) if t else []
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.encode_special_tokens = True
            self.encode = lambda t: tok.encode(t, add_special_tokens=False).ids if t else []

    def count(self, text: str | None) -> int:
        return len(self.encode(text))


_ENCODERS: dict[tuple[str, str], object] = {}


def encoder(name: str, folder: str = TOKENIZER_DIR):
    """One encoder per worker process and vocabulary."""
    if (folder, name) not in _ENCODERS:
        import os

        for suffix, cls in ((".tiktoken", BytePairEncoder), (".model", LibraryEncoder), (".json", LibraryEncoder)):
            if os.path.exists(path := os.path.join(folder, name + suffix)):
                _ENCODERS[folder, name] = cls(path)
                break
        else:
            raise ValueError(f"no vocabulary {name!r} in {folder}")
    return _ENCODERS[folder, name]


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``(key, ids array<int>)`` for every row of ``df``, in one narrow pass without a shuffle.

    Rows repeat as often as they do in ``df``; a null key stays null; null and empty texts give ``[]``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for b in batches:
            flat: list[np.ndarray] = []
            offsets = np.zeros(b.num_rows + 1, dtype=np.int32)
            for i, t in enumerate(b.column(1)):
                ids = np.asarray(enc.encode(t.as_py()), dtype=np.int32)
                flat.append(ids)
                offsets[i + 1] = offsets[i] + len(ids)
            values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=[key, "ids"])

    cols = spread(df.select(key, text))
    return cols.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(df: DataFrame, tokenizers: list[str], key: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``(key, tokenizer, n_tokens)``: sizes of every text by each vocabulary, read once for all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encs = [encoder(t, folder) for t in tokenizers]
        ranked = [e for e in encs if isinstance(e, BytePairEncoder)]
        for b in batches:
            counts: list[list[int]] = [[] for _ in encs]
            for t in b.column(1):
                t = t.as_py()
                parts = ranked[0].split(t) if t and ranked else ()  # rank files share the pattern: a text is split once for all of them
                for n, enc in zip(counts, encs):
                    n.append(sum(map(enc.lengths.__getitem__, parts)) if enc in ranked else enc.count(t))
            for name, n in zip(tokenizers, counts):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([name] * b.num_rows, pa.string()), pa.array(n, pa.int64())], names=[key, "tokenizer", "n_tokens"])

    cols = spread(df.select(key, text))
    return cols.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, tokenizer string, n_tokens long")
