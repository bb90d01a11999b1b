"""Byte-level BPE encoding and decoding by corpus-level merge replay.

All distinct words of a slice of texts lie in one array of symbols. An inverted index leads from each token that a pair
of neighbours would form to the positions of such pairs. The tokens are taken in rank order (a heap, since a merge may
open a pair of lower rank); each is applied to all its positions at once, and only the touched neighbours are looked up
anew. Within a word this does the same merges in the same order as merging its lowest-ranked, leftmost pair repeatedly.

Defined results. Null text: as empty, no ids. Special tokens are never formed; their strings are ordinary text.
Repeated rows: each its result. Extra columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .pretokens import WordIds
from .shared import slices, table, tidy

STEP = 12 << 20
_state: dict = {}


class MergeReplay:
    """The ranks of a tiktoken file (a token's rank is its id; every byte is a token)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the token that symbols a and b form, -1 for none (or for the gap between words, symbol -1)."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], -1)

    def encode(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        raw = [w.encode() for w in words]
        text = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        gaps = np.cumsum(sizes + 1) - 1
        sym = self.byte[text]
        sym[gaps] = -1
        n = len(sym)
        # position n is a gap too; it stands before the first symbol and after the last
        sym = np.append(sym, -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[n], before[0] = n, n
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            rank = self._rank(sym[at], sym[after[at]])
            keep = rank >= 0
            at, rank = at[keep], rank[keep]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        note(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            at = at[self._rank(sym[at], sym[after[at]]) == r]
            if not len(at):
                continue
            nxt = after[at]
            if np.isin(nxt, at, assume_unique=True).any():
                at, nxt = self._leftmost(at, nxt)
            sym[at], sym[nxt] = r, -1
            far = after[nxt]
            after[at] = far
            before[far] = at
            after[nxt], before[n] = n, n
            left = before[at]
            note(np.unique(np.concatenate((left, at))))
        # merged-away symbols are -1 as gaps are: what is left of each word stands in order
        alive = sym[:n] >= 0
        ends = np.cumsum(alive)[gaps]
        ids = sym[:n][alive].astype("<u4").tobytes()
        starts = np.concatenate(([0], ends[:-1]))
        return [ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    @staticmethod
    def _leftmost(at: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs that overlap, the leftmost counts; what it takes is gone for the next."""
        taken, keep = set(), []
        for i, (p, q) in enumerate(zip(at.tolist(), nxt.tolist(), strict=True)):
            if p not in taken:
                keep.append(i)
                taken.add(q)
        return at[keep], nxt[keep]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(path: str, pattern: str) -> tuple[MergeReplay, WordIds]:
    """One for each Python worker."""
    if (path, pattern) not in _state:
        replay = MergeReplay(path)
        _state[path, pattern] = replay, WordIds(replay.encode, pattern)
    return _state[path, pattern]


def ids_and_text(ids: list[bytes], decoded: list[bytes]) -> list[pa.Array]:
    return [pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())), pa.array(decoded, pa.binary())]


def bpe_roundtrip(
    docs: DataFrame,
    key: str = "doc_id",
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    schema: str = "ids array<bigint>, decoded binary",
    finish: Callable[[list[bytes], list[bytes]], list[pa.Array]] = ids_and_text,
) -> DataFrame:
    """``key`` and what ``finish`` makes of each text's ids (little-endian unsigned 32-bit) and the bytes decoded from
    them: by default both as they are."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, words = encoder(path, pattern)
        for part in slices(batches, "text", STEP):
            ids = words.ids([x or "" for x in part.column("text").to_pylist()])
            made = finish(ids, [replay.decode(x) for x in ids])
            yield pa.RecordBatch.from_arrays([part.column(key), *made], names)

    names = [key, *(x.strip().split(" ")[0] for x in schema.split(","))]
    whole = lambda batches: tidy(run(batches))
    return docs.select(key, "text").mapInArrow(whole, f"`{key}` {docs.schema[key].dataType.simpleString()}, {schema}")


def _digests(ids: list[bytes], decoded: list[bytes]) -> list[pa.Array]:
    sha = lambda values: pa.array([hashlib.sha256(x).hexdigest() for x in values], pa.string())
    return [pa.array([len(x) // 4 for x in ids], pa.int64()), sha(ids), sha(decoded)]


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_roundtrip(table(spark, sf_dir, "documents"), schema="n_tokens bigint, ids_sha256 string, decoded_sha256 string", finish=_digests)


QUERIES = {"op6_bpe": op6_bpe}
ORACLES: dict[str, str] = {}
