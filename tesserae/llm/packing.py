"""Best-fit packing of tokenised documents into sequences, by linear grouping.

Pieces of equal length are interchangeable, so the packing is planned on the histogram of lengths, whose size is bounded
by the capacity whatever the number of documents:

1. Large lengths are cut, from the largest down, into groups of equal cardinality and rounded up to their group's
   largest length. Few sizes remain.
2. For these sizes configurations (how many of each go into one sequence) are chosen: each time the one with the
   largest size left that fills most of the capacity (a bounded knapsack), used as often as its rarest size allows.
3. The actual lengths take the places of the rounded ones, longest first, which gives back what the rounding lost.
4. Small lengths are best-fit into what room is left, the longest first, each into the least room that holds it; the
   rest opens new sequences.

The plan is a table of runs: pieces number a to b of a length go to consecutive sequences at one offset. A piece finds
its run by its number among the pieces of its length, which is counted per block of rows and then across blocks, so
neither a frequent length nor the number of rows matters.

Defined results. Null or empty text: one piece, the end mark alone. Repeated rows: each is packed. Extra columns are
ignored. Empty table: no rows. Strings of the tokenizer's added tokens in a text become these tokens, as the library has
it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pretokens import WordIds
from .shared import materialise, slices, table, tidy

CAPACITY = 2048
END = 0
#: Lengths from this share of the capacity on are large.
LARGE = 1 / 8
#: Groups that the large lengths are rounded to.
GROUPS = 256
STEP = 12 << 20
#: Words that go to the tokenizer in one call.
JOINED = 64
_state: dict = {}


# ---------------------------------------------------------------- the plan


def _best_fill(sizes: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size (descending, at most ``left`` of it) fill most of the capacity, larger sizes preferred."""
    reach = [np.zeros(capacity + 1, bool)]
    reach[0][0] = True
    for s, n in zip(sizes.tolist(), left.tolist(), strict=True):
        now = reach[-1].copy()
        for k in range(1, min(int(n), capacity // s) + 1):
            now[k * s :] |= reach[-1][: capacity + 1 - k * s]
        reach.append(now)
    at, use = int(np.flatnonzero(reach[-1])[-1]), np.zeros(len(sizes), np.int64)
    for i in range(len(sizes) - 1, -1, -1):
        while not reach[i][at]:  # the fewest of the smaller sizes
            at -= int(sizes[i])
            use[i] += 1
    return use


class _Bins:
    """Sequences in runs: all of a run have the same contents by length. ``room``: runs by the room that is left."""

    def __init__(self, capacity: int):
        self.capacity, self.next, self.room, self.placed = capacity, 0, [[] for _ in range(capacity + 1)], []

    def open(self, n: int) -> tuple[int, int, int]:
        self.next += n
        return self.next - n, n, self.capacity

    def put(self, run: tuple[int, int, int], length: int, first: int) -> tuple[int, int, int]:
        """Pieces ``first`` on of this length, one into each sequence of the run."""
        start, n, room = run
        self.placed.append((length, first, n, start, self.capacity - room))
        return start, n, room - length


def plan(counts: np.ndarray, capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS) -> np.ndarray:
    """Runs for a histogram (``counts[length]`` pieces of each length, up to ``capacity``), as rows ``length, first
    piece, pieces, first sequence, offset``, sorted by length and piece."""
    counts = np.asarray(counts, np.int64)
    bins, used = _Bins(capacity), np.zeros(capacity + 1, np.int64)
    lengths = [x for x in range(capacity, 0, -1) if counts[x]]
    big = [x for x in lengths if x >= large * capacity]
    total = int(sum(counts[x] for x in big))
    # groups of equal cardinality over the large pieces in descending order: (length, number) runs and the rounded size
    sizes, members, have, each = [], [], 0, -(-total // groups) if total else 1
    for x in big:
        todo = int(counts[x])
        while todo:
            if have == 0:
                sizes.append(x)
                members.append([])
            take = min(todo, each - have)
            members[-1].append([x, take])
            have, todo = (have + take) % each, todo - take
    merged: dict[int, list] = {}
    for size, runs in zip(sizes, members, strict=True):
        merged.setdefault(size, []).extend(runs)
    sizes = np.array(sorted(merged, reverse=True), np.int64)
    runs = [merged[int(s)] for s in sizes]
    left = np.array([sum(n for _, n in r) for r in runs], np.int64)

    def take(i: int, most: int) -> tuple[int, int]:
        run = runs[i][0]
        n = min(run[1], most)
        run[1] -= n
        if not run[1]:
            runs[i].pop(0)
        return run[0], n

    while left.sum():
        live = np.flatnonzero(left)
        use, spare = np.zeros(len(sizes), np.int64), left.copy()
        use[live[0]] = 1  # else the small sizes would be used up among themselves
        spare[live[0]] -= 1
        use[live] += _best_fill(sizes[live], spare[live], capacity - int(sizes[live[0]]))
        times = int((left[use > 0] // use[use > 0]).min())
        left -= use * times
        parts = [bins.open(times)]
        for i in np.repeat(np.arange(len(sizes)), use).tolist():
            fresh = []
            for start, n, room in parts:
                while n:
                    length, k = take(i, n)
                    fresh.append(bins.put((start, k, room), length, int(used[length])))
                    used[length] += k
                    start, n = start + k, n - k
            parts = fresh
        for run in parts:
            bins.room[run[2]].append(run)
    for x in lengths:
        todo, room = int(counts[x] - used[x]), x
        while todo:
            while room <= capacity and not bins.room[room]:
                room += 1
            if room > capacity:
                run = bins.open(-(-todo // (capacity // x)))
            else:
                run = bins.room[room].pop()
            k = min(run[1], todo)
            if k < run[1]:
                bins.room[run[2]].append((run[0] + k, run[1] - k, run[2]))
            run = bins.put((run[0], k, run[2]), x, int(used[x]))
            used[x] += k
            todo -= k
            bins.room[run[2]].append(run)
            room = max(x, min(room, run[2])) if run[2] >= x else room
    out = np.array(bins.placed, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


# ---------------------------------------------------------------- pieces


class TextIds:
    """Ids of whole texts. Added tokens (no part of the pattern) are cut out first; what is between them is encoded word
    by word."""

    def __init__(self, words: WordIds, added: dict[str, int]):
        self.words, self.added = words, added
        longest = sorted(added, key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, longest))) if longest else None

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.cut is None or not any(x in t for t in texts for x in self.added):
            return self.words.ids(texts)
        parts, owners, marks = [], [], {}
        for i, t in enumerate(texts):
            at = 0
            for m in self.cut.finditer(t):
                parts.append(t[at : m.start()])
                marks[len(parts) - 1] = self.added[m[0]].to_bytes(4, "little")
                owners.append(i)
                at = m.end()
            parts.append(t[at:])
            owners.append(i)
        out = [[] for _ in texts]
        for k, (i, ids) in enumerate(zip(owners, self.words.ids(parts), strict=True)):
            out[i] += [ids, marks.get(k, b"")]
        return [b"".join(x) for x in out]


def text_ids(path: str) -> TextIds:
    """Ids by the ``tokenizers`` library for each distinct match of its own pattern; one for each Python worker."""
    if path not in _state:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokens = tokenizer.get_added_tokens_decoder()
        if odd := [x.content for x in tokens.values() if x.single_word or x.lstrip or x.rstrip or x.normalized]:
            raise ValueError(f"added tokens that don't stand for themselves alone: {odd}")

        sizes = np.zeros(tokenizer.get_vocab_size(), np.int64)
        for token, i in tokenizer.get_vocab().items():
            sizes[i] = len(token)  # byte-level tokens are written with a character for each byte

        def encode(words: list[str]) -> list[bytes]:
            # words that begin with a space are split again where they are joined, so many go in one call
            joined = [w for w in words if w[0] == " " and w[1:].isalpha()]
            single = [w for w in words if not (w[0] == " " and w[1:].isalpha())]
            groups = ["".join(joined[i : i + JOINED]) for i in range(0, len(joined), JOINED)]
            ids = [x.ids for x in tokenizer.encode_batch_fast(groups + single, add_special_tokens=False)]
            flat = np.fromiter(chain.from_iterable(ids), "<u4")
            ends = np.cumsum(sizes[flat])
            wanted = np.cumsum(np.fromiter((len(w.encode()) for w in chain(joined, single)), np.int64, len(words)))
            cuts = [0, *(np.searchsorted(ends, wanted) + 1).tolist()]
            raw = flat.tobytes()
            found = dict(zip(chain(joined, single), (raw[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))
            return [found[w] for w in words]

        _state[path] = TextIds(WordIds(encode), {x.content: i for i, x in tokens.items()})
    return _state[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens: whole capacities, the first takes the odd rest."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, key: str = "doc_id", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``key``, ``piece``, ``start``, ``length``, ``ids_crc32``, and the piece's number ``nth`` among the pieces of its
    length in its ``block`` (the task that made it)."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block, seen = text_ids(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for part in slices(batches, "text", STEP):
            rows: list[tuple] = []
            for i, ids in enumerate(words.ids([x or "" for x in part.column("text").to_pylist()])):
                ids += END.to_bytes(4, "little")
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((i, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), seen[length]))
                    seen[length] += 1
            cols = np.array(rows, np.int64).reshape(-1, 6).T
            made = [pa.array(cols[1].astype(np.int32)), *(pa.array(c) for c in cols[2:])]
            yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(cols[0])), *made, pa.array(np.full(len(rows), block, np.int32))], names)

    names = [key, "piece", "start", "length", "ids_crc32", "nth", "block"]
    whole = lambda batches: tidy(run(batches))
    return docs.select(key, "text").mapInArrow(whole, f"`{key}` {docs.schema[key].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, nth bigint, block int")


def pack(docs: DataFrame, key: str = "doc_id", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``. The pieces (without their ids) are written once; the driver
    gets the histogram, ``capacity`` rows at most."""
    found = materialise(pieces(docs, key, path, capacity))
    by_block = found.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    by_block = by_block.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row["length"]] = row["n"]
    runs = plan(counts, capacity)
    # runs are found by (length, number) as one integer, since numbers of a length stay below its count
    base = np.concatenate(([0], np.cumsum(counts)))
    code = base[runs[:, 0]] + runs[:, 1]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy()
            number = b.column("nth").to_numpy() + b.column("before").to_numpy()
            at = np.searchsorted(code, base[length] + number, side="right") - 1
            made = [pa.array(runs[at, 3] + number - runs[at, 1]), pa.array(runs[at, 4])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *made], [*kept, "sequence_id", "offset"])

    kept = [key, "piece", "start", "length", "ids_crc32"]
    numbered = found.join(by_block, ["length", "block"]).select(*kept, "nth", "before")
    return numbered.mapInArrow(place, f"`{key}` {docs.schema[key].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, `offset` bigint")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op7_packing": op7_packing}
ORACLES: dict[str, str] = {}
