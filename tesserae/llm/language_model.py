"""LM scoring with a gated recurrent language model in numpy.

Words are counted over all training documents (distributed, exact). The most frequent ones are the network's vocabulary;
every other string falls, by its characters, into one of ``KINDS`` rare kinds, and within a kind its probability is
(c + 0.5) / (N_kind + 0.5 (V_kind + 1)), so unseen strings have theirs too and all probabilities sum to one.

The output softmax is factored: classes of words of like frequency, then words within the class; a rare kind is a class.
It starts as the unigram model of the counts. The network is trained by truncated backpropagation in ``ROUNDS`` rounds
that share out all training documents among them by hash, each document in exactly one. A round's documents are dealt by
hash into shards, one a task, each in the order of hashes. All shards of a round start from the same weights and train on
their documents; the weights are averaged by tokens, in the order of shards. So the weights depend on the documents alone,
not on how or in what order the table's files hold them. The vocabulary grows with the corpus,
and the lanes of a training step with it, so that the cost of a token's share of an update stays the same. In scoring, the state is
carried across windows over each complete document.

Counts of the ``KNOWN`` most frequent words go to every task; the other words of each document meet their counts in a
join by hash. These are rare by construction, so no key of that join is hot.

Defined results. Null or empty text: the end token alone. Null identifiers: held out, never learnt from. Repeated rows:
each is counted and scored. Without training documents all probabilities are those of an empty count table. Extra
columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BASE, STEP_BYTES, Lookup, Words, materialise, mix64, slices, spans_of, split_words, table, tidy

#: Words of the network up to ``TOKENS`` words of training text; beyond, it grows with their cube root.
VOCABULARY, TOKENS = 1024, 10_000_000
CLASS = 64
HIDDEN = 16
KINDS = 6
KNOWN = 200_000
ROUNDS = 4
LANES, WINDOW = 256, 32
TRAIN_LANES, TRAIN_WINDOW = 128, 32
#: Tokens of a text that training takes without a fresh state.
SEGMENT = 1024
RATE = 0.04
#: Vectors that one task adds up.
FAN = 32
#: Training tokens of a shard, while a round has up to ``SHARDS`` of them; with more tokens shards grow in number and size.
SHARD_TOKENS, SHARDS = 500_000, 1000
#: The end token's key in the count table; no word hashes to it but by a chance of 2**-64.
END_KEY = np.uint64(0x51AFD7ED558CCD01)


# ---------------------------------------------------------------- words


#: By a word's last byte: 1 a full stop, 2 another sign, else 0.
_LAST = np.array([1 if c == 46 else 0 if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 2 for c in range(256)], np.int64)


def _kinds(words: Words) -> np.ndarray:
    """By characters: non-ASCII or not, and a last character that is a full stop, another sign, or neither."""
    high = np.concatenate((np.zeros(1, np.int32), np.cumsum(words.data >= 128, dtype=np.int32)))
    return 3 * (high[words.ends] > high[words.starts]) + _LAST[words.data[words.ends - 1]]


def _counted(hashes: np.ndarray, *more: np.ndarray) -> tuple:
    """Distinct hashes, where each begins in the sorted order, and ``more`` in that order."""
    order = np.argsort(hashes)
    hashes = hashes[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], first, *(x[order] for x in more)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 1, F.lit(True))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (hash), ``kind`` (-1: the end token) and its count ``c`` over all texts. A task adds up what it reads and
    sends a word on once for every million distinct ones."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(held: list) -> pa.RecordBatch:
            words, first, kinds, c = _counted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(kinds[first].astype(np.int32)), pa.array(np.add.reduceat(c, first))], ["word", "kind", "c"])

        held, n = [], 0
        for part in slices(batches, "text", STEP_BYTES // 2):
            w = split_words(part.column("text"))
            words, first, kinds = _counted(w.hashes, _kinds(w))
            held.append((words, kinds[first], np.diff(np.append(first, len(kinds)))))
            held.append((np.array([END_KEY]), np.array([-1]), np.array([part.num_rows])))
            n += len(words)
            if n > 1_000_000:
                yield batch(held)
                held, n = [], 0
        if held:
            yield batch(held)

    return docs.select("text").mapInArrow(lambda batches: tidy(run(batches)), "word bigint, kind int, c bigint").groupBy("word", "kind").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Counts:
    """What every task knows of the count table: totals, and the most frequent words (sorted by hash)."""

    n: int
    distinct: int
    words: np.ndarray
    counts: np.ndarray
    symbol: np.ndarray  # index in the vocabulary, -1: none
    size: int  # of the vocabulary; symbol 0 is the end
    unigram: np.ndarray  # counts of the vocabulary, then of the rare kinds
    rare_n: np.ndarray
    rare_distinct: np.ndarray


def most_frequent(counts: DataFrame, most: int) -> list:
    """All words above the least count that at most ``most`` of them reach: bounded by a histogram of the counts, not by a
    sort of the table."""
    level = F.floor(F.log2("c") * 16)
    histogram = sorted(((r["l"], r["n"]) for r in counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, least = 0, None
    for x, n in histogram:
        if total + n > most:
            break
        total, least = total + n, x
    return counts.where(level >= least).orderBy(F.desc("c"), "word").collect() if least is not None else []


def vocabulary_of(tokens: int, known: int = KNOWN) -> int:
    """The network's vocabulary for so many training tokens, in whole classes; at most the words that every task knows."""
    return min(max(VOCABULARY, round(VOCABULARY * (tokens / TOKENS) ** (1 / 3) / CLASS) * CLASS), max(known, VOCABULARY))


def gather(counts: DataFrame, vocabulary: int | None = None, known: int = KNOWN) -> Counts:
    totals = {r["kind"]: (r["n"], r["v"]) for r in counts.groupBy("kind").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    vocabulary = vocabulary or vocabulary_of(sum(x for x, _ in totals.values()), known)
    top = [r for r in most_frequent(counts, known) if r["kind"] >= 0]
    end = totals.get(-1, (0, 0))[0]
    inside = top[: vocabulary - 1]
    rare_n, rare_v = (np.array([totals.get(k, (0, 0))[i] for k in range(KINDS)], np.float64) for i in (0, 1))
    for r in inside:
        rare_n[r["kind"]] -= r["c"]
        rare_v[r["kind"]] -= 1
    words = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(words)
    symbol = np.where(np.arange(len(top)) < vocabulary - 1, np.arange(len(top)) + 1, -1)
    c = np.array([r["c"] for r in top], np.float64)
    unigram = np.concatenate(([end], c[: vocabulary - 1], rare_n))
    n, distinct = sum(x for x, _ in totals.values()), sum(x for _, x in totals.values())
    return Counts(n, distinct, words[order], c[order], symbol[order], len(inside) + 1, unigram, rare_n, rare_v)


# ---------------------------------------------------------------- the network


class Gated:
    """A gated recurrent unit with a class-factored softmax. Inputs: vocabulary, rare kinds, begin; outputs: vocabulary
    (classes of ``CLASS``), rare kinds (a class each). ``p`` holds all weights; the named ones are views of it."""

    def __init__(self, counts: Counts, hidden: int = HIDDEN):
        self.size, self.hidden, self.rooms = counts.size, hidden, {}
        self.classes = -(-self.size // CLASS)
        padded, n_out = self.classes * CLASS, self.classes + KINDS
        shapes = {"x": (self.size + KINDS + 1, 3 * hidden), "u": (hidden, 3 * hidden), "wc": (hidden, n_out), "bc": (n_out,), "wo": (padded, hidden), "bo": (padded,)}
        self.p = np.zeros(sum(math.prod(s) for s in shapes.values()), np.float32)
        at, self.spans = 0, {}
        for name, shape in shapes.items():
            self.spans[name] = (at, at + math.prod(shape), shape)
            at += math.prod(shape)
        self._view()
        rng = np.random.default_rng(7)
        for name in ("x", "u"):
            getattr(self, name)[...] = rng.normal(0, 0.3 if name == "u" else 0.1, getattr(self, name).shape)
        share = np.log((counts.unigram + 0.5) / (counts.unigram + 0.5).sum())
        words = np.full(padded, -30.0)
        words[: self.size] = share[: self.size]
        self.bo[...] = words
        by_class = np.exp(words.reshape(self.classes, CLASS)).sum(1)
        self.bc[...] = np.concatenate((np.log(by_class), share[self.size :]))

    def _view(self) -> None:
        for name, (a, b, shape) in self.spans.items():
            setattr(self, name, self.p[a:b].reshape(shape))

    def load(self, p: np.ndarray) -> None:
        self.p[...] = p

    def step(self, word: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The state after a word."""
        room = lambda name, width: self._room(name, (len(h), width), h.dtype)
        k = self.hidden
        return self._step(self.x[word], h, room("gate", 2 * k), room("made", k), room("part", k), np.empty_like(h))

    def _step(self, a: np.ndarray, h: np.ndarray, gates: np.ndarray, new: np.ndarray, inner: np.ndarray, out: np.ndarray) -> np.ndarray:
        """The state after inputs ``a``, into ``out``; the other arrays take what the gradient needs."""
        k = self.hidden
        b = h @ self.u
        np.add(a[:, : 2 * k], b[:, : 2 * k], out=gates)
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        inner[...] = b[:, 2 * k :]
        np.multiply(gates[:, k:], inner, out=new)
        new += a[:, 2 * k :]
        np.tanh(new, out=new)
        np.subtract(h, new, out=out)
        out *= gates[:, :k]
        out += new
        return out

    def _room(self, name: str, shape: tuple, kind: np.dtype) -> np.ndarray:
        """An array that is taken again in the next window."""
        held = self.rooms.get(name)
        if held is None or held.shape != shape or held.dtype != kind:
            self.rooms[name] = held = np.empty(shape, kind)
        return held

    def _groups(self, target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """The targets in the order of their classes of words (rare kinds last), and each class's span of that order."""
        cls = np.minimum(target // CLASS, self.classes)
        cls[target >= self.size] = self.classes
        order = np.argsort(cls.astype(np.int16), kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(self.classes + 1)).tolist()
        return order, [(c, slice(cuts[c], cuts[c + 1])) for c in range(self.classes) if cuts[c + 1] > cuts[c]]

    def _class_of(self, target: np.ndarray) -> np.ndarray:
        return np.where(target < self.size, target // CLASS, target - self.size + self.classes)

    @staticmethod
    def _bounded(logits: np.ndarray) -> np.ndarray:
        """So that no exponential overflows and no sum of them is zero; a state's logits stay far inside."""
        return np.clip(logits, -60, 60, out=logits)

    def log_probability(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithm, of a rare kind as a whole."""
        # outputs stand in columns here and below, so that sums over them run along memory
        logits = self._bounded(self.wc.T @ h.T + self.bc[:, None])
        out = logits[self._class_of(target), np.arange(len(target))] - _log_sum(logits)
        order, groups = self._groups(target)
        h, target, words = h[order], target[order], np.zeros(len(target), h.dtype)
        for c, at in groups:
            span = slice(c * CLASS, (c + 1) * CLASS)
            own = self._bounded(self.wo[span] @ h[at].T + self.bo[span][:, None])
            words[at] = own[target[at] - c * CLASS, np.arange(at.stop - at.start)] - _log_sum(own)
        out[order] += words
        return out

    def gradient(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Truncated backpropagation through a window (steps x lanes; target -1: none; fresh: the state starts anew
        before the step). Returns the gradient of the mean loss, the state after the window and the tokens."""
        k, (steps, lanes) = self.hidden, inputs.shape
        g = self._room("g", self.p.shape, self.p.dtype)
        g[...] = 0
        grad = {name: g[a:b].reshape(shape) for name, (a, b, shape) in self.spans.items()}
        room = lambda name, width: self._room(name, (steps, lanes, width), h.dtype)
        before, states, gates, new, inner = room("before", k), room("states", k), room("gates", 2 * k), room("new", k), room("inner", k)
        anew, given = fresh.any(1), np.take(self.x, inputs, 0, out=room("given", 3 * k), mode="clip")
        for t in range(steps):
            before[t] = h
            if anew[t]:
                before[t][fresh[t]] = 0
            h = self._step(given[t], before[t], gates[t], new[t], inner[t], states[t])
        z, r = gates[:, :, :k], gates[:, :, k:]
        flat = targets.ravel()
        used = np.flatnonzero(flat >= 0)
        n = max(len(used), 1)
        # targets in the order of their classes
        order, groups = self._groups(flat[used])
        used = used[order]
        hu, target = states.reshape(-1, k)[used], flat[used]
        d = _softmax(self._bounded(self.wc.T @ hu.T + self.bc[:, None]))
        d[self._class_of(target), np.arange(len(used))] -= 1
        d /= n
        grad["wc"][...], grad["bc"][...] = (d @ hu).T, d.sum(1)
        dh_used = d.T @ self.wc.T
        for c, at in groups:
            span, own = slice(c * CLASS, (c + 1) * CLASS), hu[at]
            d = _softmax(self._bounded(self.wo[span] @ own.T + self.bo[span][:, None]))
            d[target[at] - c * CLASS, np.arange(len(own))] -= 1
            d /= n
            grad["wo"][span], grad["bo"][span] = d @ own, d.sum(1)
            dh_used[at] += d.T @ self.wo[span]
        d_states = room("d_states", k)
        d_states[...] = 0
        d_states.reshape(-1, k)[used] = dh_used
        # what a step's derivatives have as factors, for all steps at once
        to_n, to_b = room("to_n", k), room("to_b", 3 * k)
        np.subtract(1, z, out=to_n)
        np.multiply(np.subtract(before, new, out=to_b[:, :, :k]), z, out=to_b[:, :, :k])
        to_b[:, :, :k] *= to_n
        other = room("other", k)
        np.multiply(new, new, out=other)
        to_n *= np.subtract(1, other, out=other)
        np.multiply(to_n, r, out=to_b[:, :, 2 * k :])
        np.multiply(to_b[:, :, 2 * k :], inner, out=to_b[:, :, k : 2 * k])
        to_b[:, :, k : 2 * k] *= np.subtract(1, r, out=other)
        back, carried, d_b, d_n = np.ascontiguousarray(self.u.T), np.zeros_like(h), room("d_b", 3 * k), room("d_n", k)
        for t in range(steps - 1, -1, -1):
            dh = d_states[t]
            dh += carried
            np.multiply(dh[:, None], to_b[t].reshape(lanes, 3, k), out=d_b[t].reshape(lanes, 3, k))
            np.multiply(dh, to_n[t], out=d_n[t])
            np.matmul(d_b[t], back, out=carried)
            carried += dh * z[t]
            if anew[t]:
                carried[fresh[t]] = 0
        grad["u"][...] = before.reshape(-1, k).T @ d_b.reshape(-1, 3 * k)
        d_b[:, :, 2 * k :] = d_n
        # running sums over the places in order of their words, and what each word adds to them
        words = inputs.ravel()
        order = np.argsort(words, kind="stable")
        last = np.flatnonzero(np.append(np.diff(words[order]) > 0, True))
        placed = np.take(d_b.reshape(-1, 3 * k), order, 0, out=given.reshape(-1, 3 * k), mode="clip")
        sums = np.cumsum(placed, 0, out=placed)[last]
        sums[1:] -= sums[:-1].copy()
        grad["x"][words[order][last]] = sums
        return g, h, len(used)


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Of each column."""
    return np.log(np.exp(x).sum(0))


def _softmax(x: np.ndarray) -> np.ndarray:
    """Of each column, in place."""
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def lay_out(lengths: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A lane and a start in it for each sequence, the longest first to the shortest lane; and the steps needed."""
    import heapq

    lanes = min(lanes, max(len(lengths), 1))
    heap, lane, start = [(0, i) for i in range(lanes)], np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        used, j = heapq.heappop(heap)
        lane[i], start[i] = j, used
        heapq.heappush(heap, (used + int(lengths[i]), j))
    return lane, start, max(x for x, _ in heap)


def grid(symbols: np.ndarray, lengths: np.ndarray, lanes: int, begin: int, opens: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences in lanes: inputs, targets (-1: none) and fresh starts (steps x lanes), and each token's cell. ``opens``
    tells which sequences open a text; the others' first input is the token before them."""
    lane, start, steps = lay_out(lengths, lanes)
    width = min(lanes, max(len(lengths), 1))
    ends = np.cumsum(lengths)
    within = np.arange(len(symbols)) - np.repeat(ends - lengths, lengths)
    cell = (np.repeat(start, lengths) + within) * width + np.repeat(lane, lengths)
    targets, inputs, fresh = np.full(steps * width, -1, np.int64), np.full(steps * width, begin, np.int64), np.zeros(steps * width, bool)
    targets[cell] = symbols
    follows = within > 0 if opens is None else (within > 0) | ~np.repeat(opens, lengths)
    inputs[cell[follows]] = symbols[np.flatnonzero(follows) - 1]
    fresh[cell[within == 0]] = True
    return inputs.reshape(steps, width), targets.reshape(steps, width), fresh.reshape(steps, width), cell


class Reader:
    """Texts as symbols of the network: words and the end of each, and what the count table says of the words."""

    def __init__(self, counts: Counts):
        self.counts, self.known, self.logs = counts, Lookup(counts.words), np.log10(counts.counts + 0.5)

    def read(self, texts: pa.Array) -> tuple:
        """Symbols and lengths (the ends included); then of the words: texts' ends, hashes, kinds, symbols and places among
        the known (-1: none)."""
        w, k = split_words(texts), self.counts
        kinds, at = _kinds(w), self.known.find(w.hashes)
        symbol = np.where(at >= 0, k.symbol[at], -1) if len(k.words) else np.full(len(at), -1)
        symbol = np.where(symbol >= 0, symbol, k.size + kinds)
        lengths = spans_of(w.text_ends)[1] + 1
        symbols = np.zeros(int(lengths.sum()), np.int64)
        is_word = np.ones(len(symbols), bool)
        is_word[np.cumsum(lengths) - 1] = False
        symbols[is_word] = symbol
        return symbols, lengths, w.text_ends, w.hashes, kinds, symbol, at


def shards_of(tokens: float) -> int:
    """Shards of a round with so many training tokens."""
    full = max(1, math.ceil(tokens / SHARD_TOKENS))
    return full if full <= SHARDS else math.ceil(math.sqrt(full * SHARDS))


def _sum_vectors(rows: DataFrame, group: Column) -> DataFrame:
    """One row for each ``group``, its ``task`` from then on: the sums of ``v`` (bytes of doubles) and ``n``, added in the
    order of tasks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, task = None, 0, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([sums.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["task", "v", "n"])
        for b in batches:
            for g, v, k in zip(*(b.column(c).to_pylist() for c in ("group", "v", "n")), strict=True):
                if g != task and sums is not None:
                    yield row()
                    sums, n = None, 0
                sums, n, task = np.frombuffer(v) + (0 if sums is None else sums), n + k, g
        if sums is not None:
            yield row()

    placed = rows.withColumn("group", group.cast("long")).repartition("group").sortWithinPartitions("group", "task")
    return placed.mapInArrow(run, "task bigint, v binary, n bigint")


def train(docs: DataFrame, counts: Counts, rounds: int = ROUNDS) -> np.ndarray:
    """The averaged weights after ``rounds`` rounds, which share out ``docs`` (``doc_id``, ``text``) among them. A task
    sends one vector on; these are added up in a tree whose nodes have ``FAN`` children."""
    weights = Gated(counts).p
    shards = shards_of(counts.n / rounds)
    levels = max(0, math.ceil(math.log(shards, FAN)) - 1)
    lanes = TRAIN_LANES * max(1, counts.size // VOCABULARY)

    def one_round(turn: int, start: np.ndarray) -> np.ndarray:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, reader, tokens = Gated(counts), Reader(counts), 0
            model.load(start)
            # the second moments' start keeps a task with few windows from large first steps
            mean, square, step, t = np.zeros_like(model.p), np.zeros_like(model.p), np.empty_like(model.p), 0
            for part in slices(batches, "text", STEP_BYTES // 2):
                symbols, lengths, *_ = reader.read(part.column("text"))
                # long texts in segments, so that all lanes are at work to the end
                parts = -(-lengths // SEGMENT)
                within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                cut = np.minimum(SEGMENT, np.repeat(lengths, parts) - within * SEGMENT)
                inputs, targets, fresh, _ = grid(symbols, cut, lanes, counts.size + KINDS, within == 0)
                h = np.zeros((inputs.shape[1], model.hidden), np.float32)
                for a in range(0, len(inputs), TRAIN_WINDOW):
                    w = slice(a, a + TRAIN_WINDOW)
                    g, h, n = model.gradient(inputs[w], targets[w], fresh[w], h)
                    t, tokens = t + 1, tokens + n
                    # running means of the gradient and its square, in place
                    mean += np.multiply(np.subtract(g, mean, out=step), np.float32(0.1), out=step)
                    g *= g
                    square += np.multiply(np.subtract(g, square, out=step), np.float32(0.01), out=step)
                    np.sqrt(square, out=step)
                    step += np.float32(1e-6)
                    np.divide(mean, step, out=step)
                    step *= np.float32(RATE / (turn + 1) / (1 - 0.9**t) * math.sqrt(1 - 0.99**t))
                    model.p -= step
            if tokens:
                v = (model.p.astype(np.float64) * tokens).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([v], pa.binary()), pa.array([tokens], pa.int64())], ["task", "v", "n"])

        chosen = docs.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("round")), F.lit(rounds)) == turn)
        # the text is hashed too: rows of one identifier need not share a shard
        placed = chosen.select("text", F.xxhash64("doc_id", "text").alias("_h"))
        shard = F.pmod(F.xxhash64("_h", F.lit("shard")), F.lit(shards)).cast("int")
        dealt = placed.repartitionById(shards, shard).sortWithinPartitions("_h")
        made = dealt.select("text").mapInArrow(lambda batches: tidy(run(batches)), "task bigint, v binary, n bigint")
        for _ in range(levels):
            made = _sum_vectors(made, F.floor(F.col("task") / FAN))
        got = _sum_vectors(made, F.lit(0)).toArrow().to_pylist()
        return (np.frombuffer(got[0]["v"]) / got[0]["n"]).astype(np.float32) if got else start

    for turn in range(rounds):
        weights = one_round(turn, weights)
    return weights


def score(docs: DataFrame, counts: Counts, weights: np.ndarray, key: str = "doc_id") -> DataFrame:
    """For each row: ``key``, ``row`` (unique), ``n_tokens``, ``n_known``, ``base`` and ``lm`` (log10 sums over what the
    tasks know), and ``words``, ``times`` of the words whose counts are still to be found."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, reader, row = Gated(counts), Reader(counts), TaskContext.get().partitionId() << 40
        model.load(weights)
        whole = math.log10(counts.n + 0.5 * (counts.distinct + 1))
        within = np.log10(counts.rare_n + 0.5 * (counts.rare_distinct + 1))
        end_c = counts.unigram[0]
        for part in slices(batches, "text"):
            symbols, lengths, ends, hashes, kinds, symbol, at = reader.read(part.column("text"))
            rows = len(lengths)
            inputs, targets, fresh, cell = grid(symbols, lengths, LANES, counts.size + KINDS)
            found = np.zeros(inputs.size, np.float64)
            h, width = np.zeros((inputs.shape[1], model.hidden), np.float32), inputs.shape[1]
            for a in range(0, len(inputs), WINDOW):
                states = []
                for word, new in zip(inputs[a : a + WINDOW], fresh[a : a + WINDOW], strict=True):
                    if new.any():
                        h = np.where(new[:, None], np.float32(0), h)
                    h = model.step(word, h)
                    states.append(h)
                flat = targets[a : a + WINDOW].ravel()
                used = np.flatnonzero(flat >= 0)
                found[a * width + used] = model.log_probability(np.concatenate(states)[used], flat[used])
            lm = np.bincount(np.repeat(np.arange(rows), lengths), found[cell], minlength=rows) / math.log(10)
            owner = np.repeat(np.arange(rows), lengths - 1)
            told = np.where(at >= 0, reader.logs[at], 0.0) if len(reader.logs) else np.zeros(len(at))
            # of a word outside the vocabulary: its probability within its kind
            lm_word = np.where(symbol >= counts.size, told - within[kinds], 0.0)
            by = lambda w: np.bincount(owner, w, minlength=rows)  # noqa: B023, E731
            base = by(told) + math.log10(end_c + 0.5) - whole * lengths
            known = by((at >= 0).astype(np.float64)).astype(np.int64) + int(end_c > 0)
            # words whose counts are not here, each once for a row, rows in order
            away = np.flatnonzero(at < 0)
            _, first, place = _counted(mix64(hashes[away] + owner[away].astype(np.uint64) * BASE), away)
            times, place = np.diff(np.append(first, len(place))), place[first]
            turn = np.argsort(place)
            times, place = times[turn], place[turn]
            offsets = pa.array(np.searchsorted(owner[place], np.arange(rows + 1)).astype(np.int32))
            listed = lambda values: pa.ListArray.from_arrays(offsets, pa.array(values))  # noqa: B023, E731
            cols = [part.column(key), pa.array(row + np.arange(rows)), pa.array(lengths), pa.array(known), pa.array(base), pa.array(lm + by(lm_word)), listed(hashes[place].view(np.int64)), listed(times.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, [key, "row", "n_tokens", "n_known", "base", "lm", "words", "times"])
            row += rows

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(lambda batches: tidy(run(batches)), f"`{key}` {kind}, `row` bigint, n_tokens bigint, n_known bigint, base double, lm double, words array<bigint>, times array<int>")


def lm_scores(docs: DataFrame, learn_from: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10) of each row of ``docs``."""
    table_ = materialise(word_counts(learn_from))
    counts = gather(table_)
    weights = train(learn_from.select(F.col(key).alias("doc_id"), "text"), counts)
    told = materialise(score(docs, counts, weights, key))
    rest = told.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    met = rest.join(table_.select("word", "c"), "word", "left").select("row", "times", F.coalesce("c", F.lit(0)).alias("c"))
    add = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("seen"))
    out = told.join(add, "row", "left")
    more, seen = F.coalesce("more", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    return out.select(key, "n_tokens", (F.col("n_known") + seen).alias("n_known"), F.lit(counts.n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("lm") + more).alias("score"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = lm_scores(docs, docs.where(~held_out(F.col("doc_id"))))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op8_language_model": op8_language_model}
ORACLES: dict[str, str] = {}
