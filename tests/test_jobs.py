"""The jobs: two runs over growing input, broken-off batches, command lines; on copies of small tables."""

import json
import logging

import pytest
from pyspark.sql import functions as F

from jobs import common, evaluate, ingest
from tesserae.functions.text import tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FIRST = [(1, "a b c\nd e f g", "en", "s", 1), (2, None, "en", "s", 0), (3, "", None, "s", 0), (None, "lost words", "en", "s", 1), (4, "x " * 30, "fr", None, 60), (4, "x " * 30, "fr", None, 60), (5, "Zwei Wörter", "", "s", 1)]
SECOND = [(1, "a new text of a known one", "en", "s", 1), (6, "a b", "de", "s", 1), (6, "a c", "de", "s", 1), (7, "b b c", "en", "s", 1)]
SMALL = ingest.Settings(window=5, step=3, files_per_batch=1)


def put(spark, rows, folder):
    """A new file."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def table(spark, out, name):
    return sorted((tuple(r) for r in ingest.corpus(spark, out, name).drop("batch").collect()), key=repr)


def brute_chunks(rows, window=5, step=3):
    best = {key: (text, lang) for key, text, lang, *_ in sorted(rows, key=lambda r: r[1] or "") if key is not None}
    out = []
    for key, (text, lang) in best.items():
        words = [(w, page) for page, line in enumerate((text or "").split("\n"), 1) for w in line.split()]
        at = 0
        for k in range(len(words)):
            part = words[at : at + window]
            out.append((f"{key}::fixed::chunk{k}", key, lang, part[0][1], part[-1][1], len(part), " ".join(w for w, _ in part)))
            if at + window >= len(words):
                break
            at += step
    return out


def test_ingest_takes_what_is_new(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    put(spark, FIRST, source)
    assert ingest.ingest(spark, source, out, mark, SMALL) == 1
    once = {t: table(spark, out, t) for t in ingest.SCHEMAS}
    assert [r[:-1] for r in once["chunks"]] == sorted(brute_chunks(FIRST), key=repr)
    assert {r[0] for r in once["documents"]} == {1, 2, 3, 4, 5}
    # nothing new: nothing changes
    assert ingest.ingest(spark, source, out, mark, SMALL) == 0
    assert {t: table(spark, out, t) for t in ingest.SCHEMAS} == once
    # more files: known documents stay as they are
    put(spark, SECOND, source)
    assert ingest.ingest(spark, source, out, mark, SMALL) == 1
    new = [r for r in SECOND if r[0] != 1]
    assert [r[:-1] for r in table(spark, out, "chunks")] == sorted(brute_chunks(FIRST + new), key=repr)
    assert ingest.corpus(spark, out, "documents").where("batch = 1").count() == 2
    # figures of the batches add up to those of all chunks
    chunks = ingest.corpus(spark, out, "chunks")
    held = chunks.select("lang", "chunk_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("lang", "term").agg(F.countDistinct("chunk_id").alias("df"), F.count(F.lit(1)).alias("tf"))
    assert sorted(map(repr, held.collect())) == sorted(map(repr, ingest.term_statistics(spark, out).collect()))


def test_files_go_in_batches_and_equal_one_run(spark, tmp_path):
    source, whole, parts = (str(tmp_path / x) for x in ("in", "whole", "parts"))
    for i in range(4):
        put(spark, [(i * 10 + j, f"word{j} " * (j + 1), "en", "s", 1) for j in range(5)], source)
    assert ingest.ingest(spark, source, parts, str(tmp_path / "m1"), SMALL) == 4
    assert ingest.ingest(spark, source, whole, str(tmp_path / "m2"), ingest.Settings(5, 3, 100)) == 1
    for name in ("documents", "chunks"):
        assert table(spark, parts, name) == table(spark, whole, name)
    assert sorted(map(repr, ingest.term_statistics(spark, parts).collect())) == sorted(map(repr, ingest.term_statistics(spark, whole).collect()))


def test_a_batch_that_broke_off_is_done_again(spark, tmp_path, monkeypatch):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    put(spark, FIRST, source)
    put(spark, SECOND, source)
    made = ingest.terms_of
    monkeypatch.setattr(ingest, "terms_of", lambda chunks: 1 / 0)
    with pytest.raises(Exception, match="ZeroDivisionError"):
        ingest.ingest(spark, source, out, mark, SMALL)
    monkeypatch.setattr(ingest, "terms_of", made)
    assert ingest.ingest(spark, source, out, mark, SMALL) == 2
    other = str(tmp_path / "other")
    ingest.ingest(spark, source, other, str(tmp_path / "m2"), SMALL)
    for name in ingest.SCHEMAS:
        assert table(spark, out, name) == table(spark, other, name)


def test_ingest_of_an_empty_table(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, [], source)
    ingest.ingest(spark, source, out, str(tmp_path / "mark"), SMALL)
    assert [table(spark, out, t) for t in ingest.SCHEMAS] == [[], [], []]


def test_command_line(spark, tmp_path, monkeypatch, caplog):
    """The session of the tests stays: the command line would stop its own."""
    source, config = str(tmp_path / "in"), tmp_path / "c.json"
    put(spark, FIRST, source)
    monkeypatch.setattr(common, "session", lambda name: spark)
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    config.write_text(json.dumps({"window": 5, "step": 3}))
    given = ["--documents", source, "--output", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "mark"), "--config", str(config)]
    with caplog.at_level(logging.INFO, "jobs"):
        common.main("ingest", ingest.__doc__, ingest.Settings, ("documents", "output", "checkpoint"), ingest.ingest, given)
    assert "read 7 rows, took 5 documents, left out 2" in caplog.text and "chunks and" in caplog.text
    config.write_text('{"windows": 5}')
    with pytest.raises(ValueError, match="windows"):
        common.settings_from(spark, str(config), ingest.Settings)


def test_shipped_settings_are_known(spark):
    from pathlib import Path

    here = Path(common.__file__).parent
    assert common.settings_from(spark, str(here / "ingest.json"), ingest.Settings) == ingest.Settings()
    assert common.settings_from(spark, str(here / "evaluate.json"), evaluate.Settings) == evaluate.Settings()


ASKED = [(1, "quick brown fox"), (2, "nowhere to be found"), (3, None), (None, "quick"), (4, "lazy dog sleeps"), (4, "lazy dog sleeps")]
TEXTS = [(1, "the quick brown fox jumps", "en", "s", 1), (2, "brown quick fox " * 9 + "the lazy dog sleeps", "fr", "s", 1), (3, None, None, "s", 0), (4, "filler " * 40, "", "s", 1), (None, "quick brown fox", "en", "s", 1), (5, "a b c", "en", "s", 1), (5, "a b", "en", "s", 1)]
TWO = evaluate.Settings([{"name": "whole", "window": 0, "step": 0}, {"name": "w5", "window": 5, "step": 3}], 3)


def test_evaluation_reruns_and_keeps_other_configurations(spark, tmp_path):
    docs, asked, out = (str(tmp_path / x) for x in ("docs", "asked", "out"))
    put(spark, TEXTS, docs)
    spark.createDataFrame(ASKED, "item_id long, text string").write.parquet(asked)
    read = lambda name, schema: sorted(map(repr, common.stored(spark, f"{out}/{name}", schema).collect()))
    assert evaluate.evaluate(spark, docs, asked, out, TWO) == ["whole", "w5"]
    ranks, scores = read("rankings", evaluate.RANKINGS), read("scores", evaluate.SCORES)
    rows = common.stored(spark, f"{out}/rankings", evaluate.RANKINGS).collect()
    assert {(r.config, r.query_id, r.doc) for r in rows if r.is_right} == {(c, *x) for c in ("whole", "w5") for x in ((1, 1), (4, 2))}
    assert {(r.n_queries, r.n_with_gold) for r in common.stored(spark, f"{out}/scores", evaluate.SCORES).collect()} == {(4, 2)}
    evaluate.evaluate(spark, docs, asked, out, TWO)
    assert (read("rankings", evaluate.RANKINGS), read("scores", evaluate.SCORES)) == (ranks, scores)
    # one configuration anew, over less: the other keeps what it has, and nothing of the old one is left
    put(spark, [r for r in TEXTS if r[0] != 2], str(tmp_path / "less"))
    evaluate.evaluate(spark, str(tmp_path / "less"), asked, out, evaluate.Settings(TWO.configs[1:], 3))
    after = common.stored(spark, f"{out}/rankings", evaluate.RANKINGS).collect()
    assert {r.doc for r in after if r.config == "w5"} == {1} and sorted(repr(r) for r in after if r.config == "whole") == [r for r in ranks if "config='whole'" in r]
    assert sorted(r.config for r in spark.read.option("header", True).csv(f"{out}/report/csv").collect()) == ["w5", "whole"]


def test_a_rerun_reads_the_index_that_stands(spark, tmp_path):
    """Until the files, or the windows, are others; one that broke off is made anew."""
    docs, asked, out = (str(tmp_path / x) for x in ("docs", "asked", "out"))
    put(spark, TEXTS, docs)
    spark.createDataFrame(ASKED, "item_id long, text string").write.parquet(asked)
    made = lambda name: sorted(spark.read.parquet(f"{out}/{name}/postings").inputFiles())
    names = ("whole", "index/config=w5")
    evaluate.evaluate(spark, docs, asked, out, TWO)
    first = [made(n) for n in names]
    evaluate.evaluate(spark, docs, asked, out, TWO)
    assert [made(n) for n in names] == first
    evaluate.evaluate(spark, docs, asked, out, evaluate.Settings([TWO.configs[0], {"name": "w5", "window": 4, "step": 3}], 3))
    assert made(names[0]) == first[0] and made(names[1]) != first[1]
    put(spark, [(8, "the quick brown fox again", "en", "s", 1)], docs)
    evaluate.evaluate(spark, docs, asked, out, TWO)
    assert made(names[0]) != first[0]
    assert {r.doc for r in common.stored(spark, f"{out}/rankings", evaluate.RANKINGS).where("is_right and query_id = 1").collect()} == {1, 8}


def test_a_rerun_leaves_what_stands(spark, tmp_path, monkeypatch):
    """Rankings and scores of the same files, settings and questions; what broke off, or is of others, is made anew."""
    docs, asked, out = (str(tmp_path / x) for x in ("docs", "asked", "out"))
    put(spark, TEXTS, docs)
    spark.createDataFrame(ASKED, "item_id long, text string").write.parquet(asked)
    ranks = lambda name: sorted(spark.read.parquet(f"{out}/rankings/config={name}").inputFiles())
    evaluate.evaluate(spark, docs, asked, out, TWO)
    first = [ranks(c["name"]) for c in TWO.configs]
    evaluate.evaluate(spark, docs, asked, out, TWO)
    assert [ranks(c["name"]) for c in TWO.configs] == first
    evaluate.evaluate(spark, docs, asked, out, evaluate.Settings([TWO.configs[0], {"name": "w5", "window": 4, "step": 3}], 3))
    assert ranks("whole") == first[0] and ranks("w5") != first[1]
    monkeypatch.setattr(evaluate.metrics, "summary", lambda rows: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        evaluate.evaluate(spark, docs, asked, out, evaluate.Settings(TWO.configs[:1], 2))
    monkeypatch.undo()
    evaluate.evaluate(spark, docs, asked, out, TWO)
    assert ranks("whole") != first[0] and max(r["rank"] for r in common.stored(spark, f"{out}/rankings", evaluate.RANKINGS).collect()) <= 3
    spark.createDataFrame([(9, "a b c")], "item_id long, text string").write.mode("append").parquet(asked)
    evaluate.evaluate(spark, docs, asked, out, TWO)
    rows = common.stored(spark, f"{out}/rankings", evaluate.RANKINGS).where("query_id = 9").collect()
    assert {(r.config, r.doc) for r in rows if r.is_right} == {("whole", 5), ("w5", 5)}
    assert {r.n_queries for r in common.stored(spark, f"{out}/scores", evaluate.SCORES).collect()} == {5}


def test_an_index_that_broke_off_is_made_anew(spark, tmp_path, monkeypatch):
    docs, path = spark.createDataFrame(TEXTS, SCHEMA).where("doc_id is not null"), str(tmp_path / "index")
    write = evaluate.retrieval.write_index

    def broken(cut, *args, **kw):
        write(cut.limit(1), *args, **kw)
        raise ZeroDivisionError

    evaluate.indexed(docs, path, 0, 0, "one")
    monkeypatch.setattr(evaluate.retrieval, "write_index", broken)
    with pytest.raises(ZeroDivisionError):
        evaluate.indexed(docs, path, 0, 0, "two")
    monkeypatch.setattr(evaluate.retrieval, "write_index", write)
    assert evaluate.indexed(docs, path, 0, 0, "one").n_docs == docs.count()


def test_names_that_no_folder_can_have(spark):
    with pytest.raises(ValueError, match="folders"):
        evaluate.evaluate(spark, "x", "y", "z", evaluate.Settings([{"name": "a/b", "window": 0, "step": 0}]))
