"""The operators against brute force, round trips and held-out accuracy, on small fixtures with the awkward cases."""

import base64
import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.llm import bpe, fingerprints, language_model, licenses, near_dedup, packing, quality_model, quality_rules, registry, shared, substring_dedup, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}
SENTENCE = "the quick brown fox and the lazy dog is here with a small cat of the house"


def para(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))


LONG = para(1, 20_000) + "\n" + SENTENCE
PASSAGE = ". ".join(para(50 + i, 12).capitalize() for i in range(6)) + "."
TEXTS = {
    1: None, 2: "", 3: " \n\t ", 4: "one", 5: "a b c d", 6: "A B C d", 7: SENTENCE, 8: SENTENCE, 9: SENTENCE.upper(), 10: LONG, 11: LONG + " more", 12: para(2, 300),
    13: " ".join(w if i != 150 else "other" for i, w in enumerate(para(2, 300).split())), 14: para(3, 120) + "\n" + para(4, 60) + "\n" + para(4, 60), 15: "x y z x y z x y z " * 30,
    16: "licensed under CC BY; General Public License, all rights reserved.\nSPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0", 17: "日本語 テキスト 😀 é\x00\x1f ½ don't <|endoftext|>",
    18: f"{para(5, 30)} {PASSAGE} {para(6, 30)}", 19: f"{para(7, 20)}. {PASSAGE} {para(8, 40)}", 20: "#$% " * 40,
}
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, score double, id string, words string, removed int, kept int, row int, bucket int"


def frame(spark, texts=TEXTS, again=(7, 12)):
    rows = [(i, t, "s", "en", len(t or ""), 0.0, "x", "y", 1, 2, 3, 4) for i, t in texts.items()]
    rows += [r for r in rows if r[0] in again]
    return spark.createDataFrame(rows, SCHEMA)


def words(t):
    return WORD.findall((t or "").translate(LOW))


def shingles(t, n=5):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, {}, ())


# ---------------------------------------------------------------- shared


def test_split_words():
    texts = ["zz", " A  b\n", None, "x\x1cy z\x85\x0bq", "", "ab " * 90_000 + "É日本 Z" * 3, "y" * 300_000 + " a"]
    w = shared.split_words(pa.array(texts)[1:])
    assert w.text_ends.tolist() == np.cumsum([len(words(t)) for t in texts[1:]]).tolist()
    flat = [x for t in texts[1:] for x in words(t)]
    assert [bytes(w.data[a:b]).decode().translate(LOW) for a, b in zip(w.starts, w.ends)] == flat
    assert len(set(zip(flat, w.hashes.tolist()))) == len(set(flat)) == len(set(w.hashes.tolist()))
    assert len(shared.split_words(pa.array([], pa.string())).hashes) == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet="ab \n", max_size=40) | st.none(), max_size=6))
def test_shingle_sets(texts):
    w = shared.split_words(pa.array(texts, pa.string()))
    sets, ends = shared.shingle_sets(w.hashes, w.text_ends, 5)
    assert shared.spans_of(ends)[1].tolist() == [len(shingles(t)) for t in texts]
    named = {}
    for t, a, n in zip(texts, *shared.spans_of(ends)):
        named.setdefault(frozenset(shingles(t)), set()).add(frozenset(sets[a : a + n].tolist()))
    assert all(len(x) == 1 for x in named.values()) and len(set().union(*named.values())) == len(named)


def test_lookup():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**64, 5000, dtype=np.uint64))
    asked = np.concatenate((keys[::3], keys[::7] + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)))
    assert shared.Lookup(keys).find(asked).tolist() == [int(np.searchsorted(keys, x)) if x in keys else -1 for x in asked]
    assert shared.Lookup(keys[:0]).find(asked).max() == -1


def test_sieve_parts_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(i if i % 9 else None, f"t{i}", i) for i in range(300)], "k long, _word string, slot int")
    keys = spark.createDataFrame([(i,) for i in range(0, 300, 5)] + [(None,)], "doc long")
    for bits in (1 << 24, 128):
        monkeypatch.setattr(shared, "SIEVE", bits)
        maybe, rest = shared.sieved(rows, F.col("k"), keys, "doc")
        maybe, rest = ([tuple(r) for r in x.collect()] for x in (maybe, rest))
        assert sorted(r[2] for r in maybe + rest) == list(range(300))
        assert {r[0] for r in maybe} >= {i for i in range(0, 300, 5) if i % 9} and all(r[0] is not None for r in maybe)
    assert shared.sieved(rows, F.col("k"), keys.limit(0), "doc")[0].count() == 0


def test_word_arrays_of_slices():
    texts = pa.array(["zz", " A  b\n", None, "x\x1cy z\x85\x0bq", ""])[1:]
    codes, vocabulary, ends = shared.word_arrays(texts)
    assert [vocabulary[int(i)].as_py() for i in codes] == ["a", "b", "x\x1cy", "z\x85", "q"]
    assert ends.tolist() == [2, 2, 5, 5]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 200), (300, 301)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)} | {200: 200, 300: 300, 301: 300}
    assert got == want
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_dir_needs_a_setting_on_a_cluster():
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session)


# ---------------------------------------------------------------- 1 fingerprints


def signatures(t):
    """By definition: for each anchor the next two words that are neither stop words nor anchors."""
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if x]
    found = {tuple([y for y in w[i + 1 :] if y not in fingerprints.STOPS][:2]) for i, x in enumerate(w) if x in fingerprints.ANCHORS} - {()}
    return found or ({tuple(w)} if w else set())


def test_chains_go_over_any_number_of_anchors(spark):
    texts = ["the cat and the is dog", "the and is a cat", "the cat", "the of and is a der cat to the in the dog runs", "and the is", "cat dog", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fingerprints.signatures(F.col("t")).alias("s")).collect()
    digest = lambda c: hashlib.md5(" ".join(c).encode()).hexdigest()[:16]
    assert {r.i: set(r.s) for r in rows} == {i: {digest(c) for c in signatures(t)} for i, t in enumerate(texts)}
    assert signatures(texts[0]) == {("cat", "dog"), ("dog",)}


def jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def test_fingerprints(spark, none):
    texts = {i: t for i, t in TEXTS.items() if i != 10}
    df = fingerprints.fingerprints(frame(spark, texts, ()))
    rows = df.select("*", fingerprints.likeness(F.col("own"), F.col("changed")).alias("e"), fingerprints.likeness(F.col("own"), F.col("following")).alias("n")).collect()
    ids = sorted(texts, reverse=True)
    assert len(rows) == len(ids)
    for r in rows:
        own, after = texts[r.doc_id] or "", texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert len(r.own) == len(signatures(own))
        assert r.e == pytest.approx(jaccard(signatures(own), signatures(edited)))
        assert r.n == pytest.approx(jaccard(signatures(own), signatures(after)))
    assert fingerprints.fingerprints(none).count() == 0


def test_near_fingerprints_are_those_of_all_pairs(spark, none, monkeypatch):
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(400)}"
    texts = []
    for length in (1, 2, 3, 4, 5, 6, 9, 12, 20, 40, 80):
        base = [f"the {word()} {word()}" for _ in range(length)]
        for edits in (0, 0, 1, 1, 2, 3, max(1, length // 9), length // 5):
            copy = list(base)
            for at in rng.integers(length, size=edits):
                copy[at] = f"and {word()} {word()}"
            texts.append(" ".join(copy[: max(1, length - int(rng.integers(2)))]))
    texts += ["", None, "no spot here", "no spot here", "the end"]
    rows = [(i * 7 % 1009, x) for i, x in enumerate(texts)] + [(None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x"))
    sets = {r.doc_id: set(r.s) for r in df.where("doc_id is not null").select("doc_id", fingerprints.signatures(F.col("text")).alias("s")).collect()}
    alike = lambda a, b: bool(a) and bool(b) and 5 * len(a & b) >= 4 * len(a | b)
    wanted, pairs = {i: i for i in sets}, 0
    for _ in sets:
        wanted = {i: min([wanted[j] for j in sets if alike(sets[i], sets[j])], default=i) for i in sets}
    tested, plain = [], fingerprints.compare
    monkeypatch.setattr(fingerprints, "compare", lambda p, s, n=0: tested.append(p.count()) or plain(p, s, n))
    for large in (32, 4):
        monkeypatch.setattr(near_dedup, "LARGE", large)
        tested.clear()
        got = fingerprints.with_near(df).select("doc_id", "near_id").collect()
        assert len(got) == len(rows) and {r.doc_id: r.near_id for r in got} == wanted | {None: None}
        # far fewer than all pairs of sets are compared
        assert 0 < sum(tested) < len(sets) * (len(sets) - 1) / 2 / 8
    assert len(set(wanted.values())) < len(sets) - 20
    assert fingerprints.with_near(none).count() == 0


def test_an_identifier_with_unlike_texts_and_alike_lengths(spark):
    a, b = "the red fox is a blue whale and green sea", "the old man is a young tree and tall hill"
    df = spark.createDataFrame([(5, a), (9, a), (9, b), (7, b), (7, b)], "doc_id long, text string")
    assert sorted((r.id, r.near_id) for r in fingerprints.similar(df).collect()) == [(9, 5)]
    # alike sets have a partition in common, whatever their lengths
    sizes = spark.range(1, 3000).select("id", fingerprints.length_partitions(F.col("id")).alias("k"))
    at = {r.id: set(r.k) for r in sizes.collect()}
    assert all(at[n] & at[m] for n in at for m in (n, n + 1, 5 * n // 4) if m in at and 4 * m <= 5 * n)
    assert not at[100] & at[200]


def test_fingerprint_neighbours_over_many_ranges(spark):
    ids = sorted({int(x) for x in np.random.default_rng(0).integers(-(10**12), 10**12, 1500)} | set(range(300)))
    df = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "none")], "doc_id long, text string")
    got = {r.text: r.next_text for r in fingerprints.with_next(df, rows_each=4).collect()}
    order = [f"t{i}" for i in reversed(ids)] + ["none"]
    assert got == dict(zip(order, order[1:] + order[:1]))
    only = fingerprints.with_next(spark.createDataFrame([(None, "a")], "doc_id long, text string")).collect()
    assert [(r.text, r.next_text) for r in only] == [("a", "a")]


def test_likeness_prunes_by_size(spark):
    row = spark.range(1).select(F.array(*map(F.lit, range(10))).alias("a"), F.array(F.lit(1)).alias("b")).select(fingerprints.likeness(F.col("a"), F.col("b"), 0.5).alias("pruned"), fingerprints.likeness(F.col("a"), F.col("b")).alias("exact")).head()
    assert tuple(row) == (0.0, 0.1)


# ---------------------------------------------------------------- 2 substring dedup


def test_substring_dedup(docs, none):
    rows = substring_dedup.substring_dedup(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == docs.count() and {r.doc_id for r in rows} == set(TEXTS)
    assert by[1].text is None and by[10].text == LONG
    assert by[18].text == TEXTS[18] and by[19].removed[0].keepers == [18]
    inner = PASSAGE.split(". ")[1]
    assert inner not in by[19].text and by[19].text.startswith(para(7, 20)) and by[19].text.endswith(para(8, 40))
    assert by[14].text == TEXTS[14]  # repeats within a document stay
    assert words(by[8].text) == words(SENTENCE)  # 16 words: too short to be removed
    assert len(words(by[11].text)) <= 20
    assert len(by[13].text) < 10  # a near copy, one word changed in a single line
    assert substring_dedup.substring_dedup(none).count() == 0


def test_places_belong_to_a_text(spark):
    """Rows of one identifier with unlike texts: each loses what it repeats, and nothing where only the other does."""
    p, a, b, c, d = (para(900 + i, n) for i, n in enumerate((60, 20, 20, 120, 80)))
    rows = [(1, p), (7, f"{a}\n{p}\n{b}"), (7, c), (7, c), (8, f"{d} {c}"), (None, p), (9, f"{p}\n{a}")]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(0, p), (1, p), (7, f"{a}\n{b}"), (7, c), (7, c), (8, f"{d} "), (9, "")])


def test_passages_of_fifty_words_anywhere(spark):
    rows, left = [], {}
    for i in range(40):
        # words of one long sentence, put between other words inside a line
        passage, host = para(2000 + i, 50 + i % 3), [para(3000 + 4 * i + k, 20 + i) for k in range(4)]
        rows += [(100 + i, f"{host[0]} {passage} {host[1]}"), (200 + i, f"{host[2]} É {passage.upper()} {host[3]}")]
        left |= {100 + i: rows[-2][1], 200 + i: f"{host[2]} É  {host[3]}"}
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == left
    assert all([x.words for x in r.removed] == [50 + (r.doc_id - 200) % 3] for r in got if r.doc_id >= 200)


def test_short_lines_that_are_nearly_equal(spark):
    verse = [para(4000 + k, 16) for k in range(6)]
    other = [" ".join(["new", *x.split()[1:]]) for x in verse]  # another first word in each line
    short = [para(4100, 13), " ".join(["new", *para(4100, 13).split()[1:]])]
    rows = [(1, "\n".join(verse)), (2, "\n".join([para(4200, 9), *other, para(4201, 9)])), (3, short[0]), (4, short[1]), (5, short[0])]
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2].text == f"{para(4200, 9)}\n{para(4201, 9)}" and got[2].removed[0].words == 96
    assert all(got[i].text == rows[i - 1][1] for i in (1, 3, 4, 5))  # 13 words are too few, however they are found


def test_bands_reach_the_recall():
    n = substring_dedup.tune(80, 2, 0.995)
    assert 1 - (1 - 0.64) ** n >= 0.995 > 1 - (1 - 0.64) ** (n - 1)


def test_units_are_lines_and_anchors(spark):
    texts = {1: None, 2: "", 3: "\n \n", 4: "Éa b\n\n c\td", 5: "a b\n", 6: para(1, 200) + "\n" + para(2, 30)}
    df = spark.createDataFrame(list(texts.items()), "doc long, text string")
    rows = substring_dedup.units(df, 6).collect()
    for i, t in texts.items():
        t, lines, at = t or "", [], 0
        for x in t.splitlines(keepends=True):
            if WORD.search(x):
                lines.append((at, len(x), len(words(t[:at])), len(words(x)), len(shingles(x))))
            at += len(x)
        assert sorted((r.start, r.length, r.at, r.words, r.n) for r in rows if r.doc == i and r.line) == lines
        for r in rows:
            if r.doc == i and not r.line:
                assert words(t[r.start : r.start + r.length]) == words(t)[r.at : r.at + substring_dedup.ANCHOR] and not t[r.start + r.length : r.start + r.length + 1].strip()
    assert len({r.unit for r in rows if r.doc in (4, 5) and r.line}) == 3


@settings(deadline=None, max_examples=40)
@given(st.lists(st.sampled_from("abcd"), max_size=40), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(0, 30))
def test_any_shared_run_has_a_common_anchor(left, right, seed):
    run = [f"w{x}" for x in np.random.default_rng(seed).integers(0, 4, 7)]
    texts = [" ".join(left + run + right), " ".join(right + run + left)]
    w = shared.split_words(pa.array(texts))
    at, names = substring_dedup.anchors(w.hashes, w.text_ends, 4, 4)
    found = [{n for p, n in zip(at, names) if a <= p and p + 4 <= a + 7} for a in (len(left), int(w.text_ends[0]) + len(right))]
    assert found[0] & found[1]


def test_near_lines_of_all_lengths_are_found(spark):
    """Recall of the banding by brute force over all pairs: lines of 5 to 60 words with one or two other words."""
    rng, rows, near, n = np.random.default_rng(5), [], 0, 0
    for size in range(5, 61):
        base = para(9000 + size, size).split()
        other = list(base)
        for k in {0, size - 1} if size > 40 else {0}:
            other[k] = f"new{rng.integers(1000)}"
        rows += [(2 * size, " ".join(base)), (2 * size + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in substring_dedup.substring_dedup(df, min_words=1).where("removed is not null").collect()}
    want = set()
    for i, a in rows:
        for j, b in rows:
            if i < j and 100 * len(shingles(a) & shingles(b)) >= 80 * len(shingles(a) | shingles(b)):
                want.add(j)
    assert len(want) > 40 and len(got & want) >= 0.9 * len(want) and got <= want | {j for j, t in rows if len(t.split()) > 25}


def test_columns_may_have_any_name(spark):
    import corpus_pipeline

    names = ["_id", "_doc", "_size", "_w", "_row", "_gone", "_lost", "_word", "_mask", "slot", "doc", "removed", "gone", "lost", "unit", "row", "id"]
    rows = [(i, TEXTS[i], "en", "s", 1, *[f"{c}{i}" for c in names]) for i in (10, 12, 13, 14, 18, 19, 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    want = {i: [f"{c}{i}" for c in names] for i in (10, 12, 13, 14, 18, 19, 20)}
    for made, gone in ((substring_dedup.substring_dedup(df), "removed"), (quality_rules.quality_rules(df), None), (quality_rules.accepted(df), None), (corpus_pipeline.near(spark, df, ""), None)):
        kept = [c for c in names if c != gone]
        for r in made.collect():
            assert [r[c] for c in kept] == [x for x, c in zip(want[r.doc_id], names) if c != gone]


# ---------------------------------------------------------------- 3 near-dedup


def brute_components(texts, percent):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates(docs, none):
    rows = near_dedup.near_duplicates(docs).collect()
    want, sizes = brute_components(TEXTS, 85)
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], sizes[r.doc_id], want[r.doc_id] == r.doc_id)
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_in_a_dense_group(spark, monkeypatch):
    """Many copies with a few edits each: chains of links, and copies that are near but not linked."""
    monkeypatch.setattr(near_dedup, "LARGE", 8)
    base, rng, texts = para(9, 140).split(), np.random.default_rng(3), {}
    for i in range(160):
        w = list(base)
        for k in rng.integers(0, 140, int(rng.integers(0, 6))):
            w[k] = f"e{i}x{k}" if rng.random() < 0.7 else f"common{k % 3}"
        texts[i] = " ".join(w)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, texts, ())).collect()}
    assert got == brute_components(texts, 85)[0]


def test_repeated_rows_are_compared_once(spark):
    near = para(2, 300)
    other = " ".join(w if i != 150 else "other" for i, w in enumerate(near.split()))
    df = spark.createDataFrame([(1, near)] * 200 + [(2, other)] * 200 + [(3, other), (3, para(1, 50))], "doc_id long, text string")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    known = near_dedup.sketch(df, "doc_id").where("digest is not null")
    texts = near_dedup.texts_of(df, ids, known, "doc_id")
    assert sorted((r.id, r.text) for r in texts.collect()) == sorted([(1, near), (2, other), (3, other), (3, para(1, 50))])
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert near_dedup.compare(pairs, texts).count() == 1
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_null_identifiers_link_nothing(spark):
    df = spark.createDataFrame([(None, SENTENCE), (None, para(1, 50)), (5, SENTENCE)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.kept) for r in near_dedup.near_duplicates(df).collect()) == [(0, True), (0, True), (5, True)]


# ---------------------------------------------------------------- 4 quality rules


def brute_rules(t):
    t = t or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts(docs, none):
    rows = quality_rules.quality_rules(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(TEXTS[r.doc_id]), r.doc_id
        assert r.kept == (not r.base_failed)
    assert quality_rules.quality_rules(none).count() == 0
    kept = quality_rules.accepted(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)


def test_boilerplate_depletes_but_copies_do_not(spark):
    banner, rows = para(70, 60), []
    for i in range(40):
        rows.append((i, f"{banner}\n{para(100 + i, 20)}", "host"))  # mostly the banner
    for i in range(40, 60):
        rows.append((i, f"{banner}\n{para(100 + i, 200)}", "host"))  # the banner is a small part
    copy = "\n".join(para(300 + k, 20) for k in range(6))
    for i in range(100, 150):
        rows.append((i, copy, "host"))  # exact copies
    for i in range(200, 250):
        rows.append((i, copy + f"\nedit {i}", "host"))  # near copies
    rows += [(300, f"{banner}\n{para(400, 20)}", None), (0, rows[0][1], "host")]
    got = {r.doc_id: r.depleted for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {i for i, x in got.items() if x} == set(range(40))


@pytest.mark.parametrize(("shared", "own"), [(3, 1), (5, 1), (6, 3), (12, 4), (20, 2)])
def test_templates_of_many_lines(spark, shared, own):
    template = [para(500 + k, 20) for k in range(shared)]
    rows = [(i, "\n".join(template[: shared // 2] + [para(1000 + 10 * i + k, 20) for k in range(own)] + template[shared // 2 :]), "host") for i in range(60)]
    copy = [para(700 + k, 20) for k in range(8)]
    # near copies: one line with another word, another line for each
    rows += [(100 + i, "\n".join(x.replace(x.split()[9], f"new{i}") if k == i % 8 else x for k, x in enumerate(copy)), "host") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bad = quality_rules.frequent_lines(quality_rules.document_lines(df), df).collect()
    assert len(bad) == shared and {r.n_documents for r in bad} == {60}
    got = {r.doc_id: r.depleted for r in quality_rules.quality_rules(df).collect()}
    assert {i for i, x in got.items() if x} == set(range(60))


def test_own_lines_of_any_length(spark):
    """Pages with most boilerplate don't pass because they have little of their own. A host for each case."""
    shared = [para(1500 + k, 12) for k in range(12)]
    begin, end = " ".join(shared[0].split()[:3]) + " ", " " + " ".join(shared[5].split()[-3:])
    copy = [para(1700 + k, 12) for k in range(5)]
    rows = []
    for size in (4, 20, 34, 44, 200):
        for a, b in (("", ""), (begin, ""), ("", end), (begin, end)):
            host = f"{size}/{a}/{b}"
            rows += [(i, "\n".join([*shared[:6], a + para(1600 + i, 40)[:size].strip() + b, *shared[6:]]), host) for i in range(60)]
            # copies of an article, with a date, and one word of one line changed
            rows += [(100 + i, "\n".join([f"copy of 2024-01-{i:02}", *(x.replace(x.split()[5], f"new{i}") if k == i % 5 else x for k, x in enumerate(copy))]), host) for i in range(60)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("depleted").select("doc_id", "source").collect()
    assert {tuple(r) for r in got} == {(i, h) for i, _, h in rows if i < 60}


def test_boilerplate_lines_go(spark):
    import corpus_pipeline

    banner, own = para(70, 20), {i: para(100 + i, 70) for i in range(40)}
    rows = [(i, f"{banner}\n{x}\n\n  {banner.upper()}", "host", 0) for i, x in own.items()] + [(99, f"{banner}\n{own[0]}", "other", 7), (7, f"{banner}\n{own[7]}\n\n  {banner.upper()}", "host", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    left = {i: f"{x}\n" for i, x in own.items()} | {99: rows[40][1]}
    assert {r.doc_id: r.text for r in quality_rules.quality_rules(df).collect()} == left
    for got in (quality_rules.accepted(df), corpus_pipeline.rules(spark, df, "")):
        found = got.collect()
        assert got.columns == df.columns and len(found) == len(rows) and {r.doc_id: r.text for r in found} == left
        assert all(r.n_chars == (7 if r.doc_id == 99 else len(r.text)) for r in found)


# ---------------------------------------------------------------- 5 licences


def test_licenses(docs, none):
    rows = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    r = rows[16]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (3, 2, 7, "cc-by,gpl,reserved")
    assert r.labels == "apache-2.0,cc-by,gpl,gpl-2.0-only,mit,reserved" and r.permissive and 0 < r.score <= 1
    assert rows[1].n_words == 0 and rows[1].labels == "" and rows[1].first_word is None and rows[1].score == 0
    assert licenses.license_scan(none).count() == 0


@given(st.lists(st.sampled_from(["cc", "by", "all", "rights", "reserved", "General", "PUBLIC", "license", "x", "é"]), max_size=30), st.sampled_from([" ", "-", "\n", "\x00", ". "]))
def test_licence_places(parts, sep):
    w = [x.lower() for x in parts]
    places = [i for p in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    got = licenses.Scanner().scan(sep.join(parts))
    assert got[:4] == (len(w), len(places), min(places, default=None), max(places, default=None))


def test_licence_labels_and_scores(spark):
    parts = ["MIT License", "cc by", "Apache License", "public domain", "SPDX-License-Identifier: MIT OR Foo-1.0", "SPDX-License-Identifier: !", "words", "General Public License"]
    known = {**{k: ("notice", v) for k, v in licenses.NOTICES.items()}, **{k: ("base", v) for k, v in licenses.BASE.items()}}
    rng, rows = np.random.default_rng(2), []
    for i in range(120):
        rows.append((i, "\n".join(rng.choice(parts, rng.integers(0, 4)))))
    for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = rows[r.doc_id][1]
        plain = " " + " ".join(re.findall(r"[0-9a-z]+", text.lower())) + " "
        hits = [kind_label for phrase, kind_label in known.items() if f" {phrase} " in plain]
        labels = {label for _, label in hits}
        kinds = {kind for kind, _ in hits}
        for tag in re.findall(r"SPDX-License-Identifier: (.*)", text):
            labels |= {"mit", "foo-1.0"} if tag.startswith("MIT") else {"spdx"}
            kinds.add("tag")
        miss = math.prod(1 - licenses.WEIGHTS[k] for k in kinds)
        assert r.labels == ",".join(sorted(labels)) and r.score == pytest.approx(1 - miss if kinds else 0.0)


@pytest.mark.parametrize(
    "text,rpn,ok",
    [
        ("MIT", ["mit"], True), ("MIT AND GPL-3.0-only", ["mit", "gpl-3.0-only", "and"], False), ("GPL-3.0-only OR MIT AND ISC", ["gpl-3.0-only", "mit", "isc", "and", "or"], True),
        ("(GPL-2.0-only WITH Classpath-exception-2.0 OR MIT) AND ISC", ["gpl-2.0-only", "classpath-exception-2.0", "with", "mit", "or", "isc", "and"], True), ("MIT and", ["mit"], True), ("", [], False), ("((MIT", ["mit"], True), (") MIT", [], False), ("MIT some words", ["mit"], True),
    ],
)
def test_expressions(text, rpn, ok):
    made = licenses.parse(licenses._tokens(text, 0))
    assert made == rpn and licenses.evaluate(made)[0] is ok


# ---------------------------------------------------------------- 6 BPE


@pytest.fixture(scope="module")
def reference_encoding():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, none, reference_encoding):
    rows = bpe.bpe_roundtrip(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        t = TEXTS[r.doc_id] or ""
        assert r.ids == reference_encoding.encode_ordinary(t) and bytes(r.decoded) == t.encode()
    assert bpe.bpe_roundtrip(none).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.text(max_size=60) | st.text(alphabet="aab ='\n", max_size=120))
def test_bpe_of_any_text(reference_encoding, text):
    replay, ids = bpe.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    made = ids.ids([text])[0]
    assert np.frombuffer(made, "<u4").tolist() == reference_encoding.encode_ordinary(text) and replay.decode(made) == text.encode()


def test_long_texts_go_in_runs(monkeypatch, reference_encoding):
    from tesserae.llm import pretokens

    monkeypatch.setattr(pretokens, "RUN", 50)
    monkeypatch.setattr(pretokens, "REMEMBERED", 40)
    replay = bpe.MergeReplay(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    made = pretokens.WordIds(replay.encode).ids([para(8, 300), "a b"])
    assert [np.frombuffer(x, "<u4").tolist() for x in made] == [reference_encoding.encode_ordinary(para(8, 300)), reference_encoding.encode_ordinary("a b")]


# ---------------------------------------------------------------- 7 packing


@settings(deadline=None, max_examples=60)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " a", "b ", " ", "\n", "é", "don't"]), max_size=12))
def test_ids_with_added_tokens(parts):
    from tokenizers import Tokenizer

    path, text = public_tokenizers.path("byte_bpe_50k.json"), "".join(parts)
    got = packing.text_ids(path).ids(["x", text, "y <|endoftext|>"])
    whole = Tokenizer.from_file(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in ("x", text, "y <|endoftext|>")]


def check_packing(pieces, capacity):
    by = {}
    for r in pieces:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in by.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs).collect()
    n = check_packing(rows, 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1
    seen = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        ids = tokenizer.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids + [0]
        part = ids[r.start : r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        assert r.length == 2048 or r.piece == 0
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
    assert set(seen) == set(TEXTS) and max(len(x) for x in seen.values()) > 10
    assert packing.pack(none).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 64), max_size=150))
def test_plans_hold_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=65)
    runs, spots, seen = packing.plan(counts, 64, groups=6), {}, set()
    for length, first, n, start, offset in runs.tolist():
        for k in range(n):
            spots.setdefault(start + k, []).append((offset, length))
            assert (length, first + k) not in seen
            seen.add((length, first + k))
    assert Counter(x for x, _ in seen) == Counter(lengths)
    assert sorted(spots) == list(range(len(spots)))
    for parts in spots.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(spots) <= max(1, 2 * -(-sum(lengths) // 64))


def test_plans_are_near_the_bound():
    x = np.clip(np.random.default_rng(0).lognormal(6.2, 0.9, 20_000).astype(int), 1, 2048)
    runs = packing.plan(np.bincount(x, minlength=2049))
    assert (runs[:, 3] + runs[:, 2]).max() <= 1.01 * x.sum() / 2048


# ---------------------------------------------------------------- 8 language model


def test_base_scores_and_counts(docs, none):
    learn = docs.where(~language_model.held_out(F.col("doc_id")))
    rows = language_model.lm_scores(docs.select("doc_id", "text", "row", "words"), learn).collect()
    texts = [(i, words(t) + ["\n"]) for i, t in TEXTS.items()] + [(i, words(TEXTS[i]) + ["\n"]) for i in (7, 12)]
    c = Counter(w for i, ws in texts if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    total, distinct = sum(c.values()), len(c)
    by = {i: ws for i, ws in texts}
    assert len(rows) == len(texts)
    for r in rows:
        ws = by[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws))
        assert math.isfinite(r.score) and r.score < 0
    assert language_model.lm_scores(none, none).count() == 0
    assert language_model.lm_scores(docs, none).where("train_tokens = 0 and n_known = 0").count() == len(texts)


def small_counts(size=70):
    return language_model.Counts(100, 10, np.array([], np.uint64), np.array([]), np.array([]), size, np.arange(size + language_model.KINDS) + 1.0, np.ones(language_model.KINDS), np.ones(language_model.KINDS))


def test_every_training_document_is_learnt_from(spark):
    # each document has a word of its own: a row of the input weights that moves only if the document is seen
    rows = [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26)} " * 60) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = language_model.gather(language_model.word_counts(df))
    before, after = language_model.Gated(counts), language_model.Gated(counts)
    after.load(language_model.train(df, counts))
    assert counts.size == 201 and (before.x[:201] != after.x[:201]).any(1)[1:].all()


def test_scores_do_not_depend_on_how_the_table_is_split(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.5, 40) % 50)) for i in range(240)]
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 400)  # several shards a round, added up in a tree
    monkeypatch.setattr(language_model, "FAN", 2)
    told = []
    for parts in (1, 5):
        df = spark.createDataFrame(rows if parts == 1 else rows[::-1], "doc_id long, text string").repartition(parts)
        found = language_model.lm_scores(df, df.where(~language_model.held_out(F.col("doc_id")))).collect()
        told.append({r.doc_id: r.score for r in found})
    assert len(told[0]) == len(rows) and told[0] == pytest.approx(told[1], rel=1e-5)
    assert [language_model.shards_of(x) for x in (0, 1, 400, 401, 4e5, 1.6e6)] == [1, 1, 1, 2, 1000, 2000]


def test_the_vocabulary_grows():
    sizes = [language_model.vocabulary_of(n) for n in (0, 10**7, 8 * 10**7, 10**10, 10**18)]
    assert sizes[:3] == [1024, 1024, 2048] and sizes == sorted(sizes) and sizes[3] > 8 * 1024 and sizes[4] == language_model.KNOWN


def test_gradient():
    m = language_model.Gated(small_counts(), hidden=3)
    m.p = m.p.astype(np.float64)
    m._view()
    rng, n = np.random.default_rng(0), 70 + language_model.KINDS
    m.wc[...], m.wo[...] = rng.normal(0, 0.3, m.wc.shape), rng.normal(0, 0.3, m.wo.shape)
    inputs, targets, fresh, h0 = rng.integers(0, n + 1, (6, 4)), rng.integers(-1, n, (6, 4)), rng.random((6, 4)) < 0.2, rng.normal(0, 1, (4, 3))

    def loss():
        h, total = h0, 0.0
        for w, t, f in zip(inputs, targets, fresh, strict=True):
            h = m.step(w, np.where(f[:, None], 0, h))
            used = np.flatnonzero(t >= 0)
            total -= m.log_probability(h[used], t[used]).sum()
        return total / (targets >= 0).sum()

    g = m.gradient(inputs, targets, fresh, h0)[0]
    for i in rng.choice(len(m.p), 200, replace=False):
        old = m.p[i]
        m.p[i] = old + 1e-5
        up = loss()
        m.p[i] = old - 1e-5
        down = loss()
        m.p[i] = old
        assert g[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_probabilities_sum_to_one():
    m = language_model.Gated(small_counts())
    n = 70 + language_model.KINDS
    h = np.random.default_rng(1).normal(0, 1, (1, m.hidden)).astype(np.float32)
    assert np.exp(m.log_probability(np.repeat(h, n, 0), np.arange(n))).sum() == pytest.approx(1, abs=1e-4)


def test_scores_by_scalar_arithmetic(spark):
    """The network's score of small texts, one number at a time."""
    rows = [(1, "a b a"), (2, "b zz. É c"), (3, None), (4, "a b b a c " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = language_model.gather(language_model.word_counts(df), vocabulary=4)
    model = language_model.Gated(counts)
    model.p += np.random.default_rng(3).normal(0, 0.3, len(model.p)).astype(np.float32)
    told = {r.doc_id: r for r in language_model.score(df, counts, model.p).collect()}
    c = Counter(w for _, t in rows for w in words(t))
    top = sorted(c, key=lambda w: (-c[w], int(shared.split_words(pa.array([w])).hashes.view(np.int64)[0])))[:3]
    kind = lambda w: 3 * (not w.isascii()) + (1 if w[-1] == "." else 0 if w[-1].isalnum() else 2)
    k, sig = model.hidden, lambda x: 1 / (1 + math.exp(-x))
    for i, t in rows:
        h, before, total = [0.0] * k, counts.size + language_model.KINDS, 0.0
        for w in [*words(t), None]:
            symbol = 0 if w is None else top.index(w) + 1 if w in top else counts.size + kind(w)
            a, b = [float(x) for x in model.x[before]], [sum(h[j] * float(model.u[j, m]) for j in range(k)) for m in range(3 * k)]
            z, r = [sig(a[j] + b[j]) for j in range(k)], [sig(a[k + j] + b[k + j]) for j in range(k)]
            n = [math.tanh(a[2 * k + j] + r[j] * b[2 * k + j]) for j in range(k)]
            h = [n[j] + z[j] * (h[j] - n[j]) for j in range(k)]
            cls = [sum(h[j] * float(model.wc[j, m]) for j in range(k)) + float(model.bc[m]) for m in range(model.wc.shape[1])]
            own = symbol // language_model.CLASS if symbol < counts.size else symbol - counts.size + model.classes
            total += cls[own] - math.log(sum(map(math.exp, cls)))
            if symbol < counts.size:
                span = range(own * language_model.CLASS, (own + 1) * language_model.CLASS)
                out = {m: max(-60, sum(h[j] * float(model.wo[m, j]) for j in range(k)) + float(model.bo[m])) for m in span}
                total += out[symbol] - math.log(sum(map(math.exp, out.values())))
            else:
                rare = [x for x in c if x not in top and kind(x) == kind(w)]
                total += math.log((c[w] + 0.5) / (sum(c[x] for x in rare) + 0.5 * (len(rare) + 1)))
            before = symbol
        assert told[i].lm == pytest.approx(total / math.log(10), rel=1e-4)


def test_the_state_is_carried_over_windows(spark, monkeypatch):
    df = spark.createDataFrame([(1, para(5, 500)), (2, "a")], "doc_id long, text string")
    counts = small_counts()
    weights = language_model.Gated(counts).p + np.random.default_rng(0).normal(0, 0.2, len(language_model.Gated(counts).p)).astype(np.float32)
    one = {r.doc_id: r.lm for r in language_model.score(df, counts, weights).collect()}
    monkeypatch.setattr(language_model, "WINDOW", 7)
    assert one == pytest.approx({r.doc_id: r.lm for r in language_model.score(df, counts, weights).collect()}, rel=1e-5)


# ---------------------------------------------------------------- 9 WARC


@settings(deadline=None, max_examples=40)
@given(st.lists(st.binary(max_size=60) | st.sampled_from([b"", b"WARC/1.1\r\n\r\n", b"\r\n\r\n" * 9, b"x" * 5000]), max_size=6))
def test_archives_round_trip(tmp_path_factory, payloads):
    folder = tmp_path_factory.mktemp("warc")
    writer = warc.Writer(f"file://{folder}", limit=2000)
    for i, p in enumerate(payloads):
        writer.write(str(i), "http://a b", hashlib.sha1(p).hexdigest(), memoryview(p), None)
    writer.close()
    got, last = {}, {}
    for path, _, _ in writer.files:
        with open(path.removeprefix("file://"), "rb") as f:
            for key, kind, refers, digest, size, number, offset, data, sha, end in warc.read_chunks(f, chunk=512):
                assert len(data) <= 512 and offset == len(got.get(key, b"")) and kind == "response" and refers is None
                got[key] = got.get(key, b"") + data
                if end:
                    last[key] = (sha, size)
                    assert digest == sha
    assert got == {str(i): p for i, p in enumerate(payloads)}
    assert last == {str(i): (hashlib.sha1(p).hexdigest(), len(p)) for i, p in enumerate(payloads)}


def test_a_broken_archive_is_an_error():
    import gzip
    import io

    with pytest.raises(ValueError):
        list(warc.read_chunks(io.BytesIO(gzip.compress(b"nonsense\r\n"))))


def test_archives_with_large_payloads_and_odd_identifiers(spark):
    rng = np.random.default_rng(1)
    pages = [(f"a\r\nWARC/1.1 {i} %é", "u", "".join(map(chr, rng.integers(97, 123, int(rng.integers(1000, 30_000)))))) for i in range(30)]
    pages += [("big", "u", "0123456789" * 250_000), ("copy", "u", pages[3][2])]
    manifest = warc.archive(spark.createDataFrame(pages, "page_id string, url string, html string").repartition(3), limit=20_000)
    chunks = warc.read_archives(manifest)
    assert manifest.count() > 5 and chunks.rdd.getNumPartitions() == manifest.count()  # a task for each file
    assert max(len(set(p)) for p in chunks.select("record_id").rdd.glom().map(lambda x: [r[0] for r in x]).collect()) < 20
    rows = chunks.collect()
    top = max("copy", pages[3][0])
    for key, _, html in pages:
        own = sorted((r for r in rows if r.record_id == key), key=lambda r: r.chunk)
        assert [r.chunk for r in own] == list(range(len(own))) and all(len(r.data) <= warc.CHUNK for r in own)
        if html == pages[3][2] and key != top:
            assert own[0].record_type == "revisit" and own[0].refers_to == top
        else:
            assert b"".join(r.data for r in own) == html.encode() and own[-1].sha1 == own[-1].declared_digest == hashlib.sha1(html.encode()).hexdigest()
    assert len([r for r in rows if r.record_id == "big"]) == 3


def test_a_wrong_payload_is_an_error(tmp_path):
    writer = warc.Writer(f"file://{tmp_path}")
    with pytest.raises(ValueError):
        writer.write("1", "u", hashlib.sha1(b"x").hexdigest(), memoryview(b"y"), None)


def test_warc_query(spark, tmp_path):
    big = "é" * 700
    rows = [(1, "u", big), (5, "u", big), (3, None, big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", "z" * 1000), (5, "u", big)]
    spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in rows], "page_id long, url string, html string, size int, sha1 string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.op9_warc(spark, str(tmp_path)).collect())
    want = sorted((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if h == big and i != 5 else "response", 5 if h == big and i != 5 else 0) for i, u, h in rows)
    assert got == want
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert warc.op9_warc(spark, f"{tmp_path}/none").count() == 0


# ---------------------------------------------------------------- 10 quality classifier


def test_statistics_of_odd_texts():
    x = quality_model.statistics(pa.array(["", None, "a a b", "x" * 100_000, "\x00\xff", TEXTS[17]]))
    assert x.shape == (6, len(quality_model.FEATURES)) and np.isfinite(x).all() and (x[0] == x[1]).all()
    assert quality_model.statistics(pa.array([], pa.string())).shape[0] == 0


def test_trees_are_followed_as_one_by_one():
    rng = np.random.default_rng(4)
    x = rng.random((300, 4)).astype(np.float32)
    forest = quality_model.grow(x, (x[:, 0] + x[:, 1] > 1).astype(float), trees=9, depth=3)
    for row, got in zip(x[:60], forest.score(x[:60]), strict=True):
        total = forest.base
        for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        assert got == pytest.approx(1 / (1 + math.exp(-total)))


def test_statistics_by_definition():
    texts = ["The cat, the cat cat sat.\nOn 2 mats! #x", "É é\tDer Hund\n\n", "a"]
    for row, t in zip(quality_model.statistics(pa.array(texts)), texts, strict=True):
        raw, w = t.encode(), words(t)
        got, times = dict(zip(quality_model.FEATURES, row.tolist(), strict=True)), Counter(w)
        want = {f"share_{c}": sum(raw.count(bytes([b])) for b in m) / len(raw) for c, m in quality_model._CLASSES.items()}
        want |= {"share_high": sum(b >= 128 for b in raw) / len(raw), "log_bytes": math.log1p(len(raw)), "log_words": math.log1p(len(w)), "word_bytes": sum(len(x.encode()) for x in w) / len(w)}
        want |= {"distinct_words": len(times) / len(w), "same_as_before": sum(a == b for a, b in zip(w, w[1:])) / len(w), "common_words": sum(x in quality_model.COMMON for x in w) / len(w)}
        want |= {"longest_word": math.log1p(max(len(x.encode()) for x in w)), "words_a_line": math.log1p(len(w) / (t.count("\n") + 1)), "most_frequent": max(times.values()) / len(w)}
        assert {k: got[k] for k in want} == pytest.approx(want, rel=1e-5)


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 5)).astype(np.float32)
    y = ((x[:, 1] > 0.6) ^ (x[:, 3] > 0.4)).astype(float)
    forest = quality_model.grow(x[:2000], y[:2000])
    assert np.mean((forest.score(x[2000:]) > 0.5) == y[2000:]) > 0.97
    assert quality_model.grow(x, np.ones(3000)).score(x[:2]).tolist() == pytest.approx([1, 1], abs=1e-5)
    assert quality_model.grow(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_held_out_accuracy(spark, small):
    docs, labels = shared.table(spark, small, "documents"), shared.table(spark, small, "labels")
    scored = quality_model.quality_scores(docs, quality_model.fit(docs, labels)).join(labels, "doc_id").where(quality_model.held_out(F.col("doc_id")))
    r = scored.agg(F.avg(((F.col("score") >= 0.3).cast("int") == F.col("quality")).cast("int")).alias("a"), F.count("*").alias("n")).head()
    assert r.n > 5 and r.a > 0.8


def test_classifier_edges(spark, docs, none):
    labels = spark.createDataFrame([(7, None, 0), (None, 1, 0), (12, 1, 0), (12, 0, 0)], "doc_id long, quality int, toxic int")
    forest = quality_model.fit(docs, labels)
    assert quality_model.quality_scores(docs, forest).count() == docs.count()
    assert quality_model.quality_scores(none, forest).count() == 0
    assert quality_model.fit(docs, labels.limit(0)).score(np.zeros((1, len(quality_model.FEATURES)), np.float32)).tolist() == [0.5]


# ---------------------------------------------------------------- pipeline and queries


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = shared.table(spark, small, "documents")
    before = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.materialise(stage(spark, docs, small))
        assert docs.columns == shared.table(spark, small, "documents").columns, name
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and (before is None or set(ids) <= before) and ids
        before = set(ids)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r.doc_id for r in rows} == before
    check_packing(rows, 2048)


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    columns = ("doc_id", "text", "lang", "source", "n_chars")
    for name, texts in (("odd", TEXTS), ("none", {})):
        frame(spark, texts, (12,) if texts else ()).select(*columns).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()}
        assert got == ({10, 12, 14, 18, 19} if texts else set())


def test_registered_queries(spark, small):
    names = set(registry.queries())
    assert {n.split("_")[0] for n in names} == {*(f"op{i}" for i in range(1, 13)), "pipeline"}
    assert set(registry.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_match_their_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = registry.queries()[name](spark, small)
    cols = sorted(df.columns)
    found = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    got, want = ({tuple(r[i] for i in at) for r in rows} for at, rows in ((cols, df.collect()), ([names.index(c) for c in cols], found.fetchall())))
    assert got == want and len(got) == df.count()
