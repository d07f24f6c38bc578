"""Texts, ids and pages that are long, broken or repeated."""

from __future__ import annotations

import contextlib
import io
import itertools
import json
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from parcelwise.llm import common, decontamination, html_extraction, perplexity, quality_nbsvm, queries, token_histogram, tool_calls, toxicity
from tests.llm.test_pairs import prose

LARGER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def some_pages(spark):
    if not os.path.isdir(LARGER):
        pytest.skip("no larger sample")
    pages = spark.read.parquet(f"{LARGER}/pages.parquet").limit(300)
    return pages, {r.url: r.text for r in html_extraction.main_texts(pages).collect()}


@pytest.mark.parametrize("page_id,copies", [(7, 1), (None, 4)])
def test_pages_under_one_id(spark, some_pages, page_id, copies):
    pages, want = some_pages
    same = pages.select(F.lit(page_id).cast("long").alias("page_id"), "url", "html")
    trees = html_extraction.fit(same.select("*", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("col"), sample=100)
    assert len(trees) == 24
    got = {r.url: r.text for r in html_extraction.extracted(same, trees).collect()}
    assert sum(got[u] == t for u, t in want.items()) > 0.97 * len(want)


def test_sample_is_bounded_and_steady(spark):
    rows = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), (F.col("id") % 3000).cast("string").alias("text"))
    chosen = common.bounded_sample(rows, ["doc_id", "text"], 400)
    assert chosen.count() == 400 == chosen.distinct().count()
    again = common.bounded_sample(rows.repartition(7), ["doc_id", "text"], 400)
    assert sorted(r.text for r in chosen.collect()) == sorted(r.text for r in again.collect())
    assert common.bounded_sample(rows, ["doc_id", "text"], 5000).count() == 5000
    assert common.bounded_sample(rows, ["doc_id"], 400).count() == 1
    assert common.bounded_sample(rows.limit(0), ["doc_id"], 400).count() == 0


def many_labelled(spark):
    """Documents with ids and texts that repeat or are NULL, and marks that repeat and contradict each other."""
    words = [prose(i, 30) for i in range(40)]
    rows = [(i % 250 if i % 11 else None, words[i % 37] + str(i % 150) if i % 13 else None, "x") for i in range(900)]
    marks = [(i % 260 if i % 17 else None, i // 7 % 3 if i % 5 else None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    return docs, spark.createDataFrame([(i, q, q) for i, q in marks], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("most", [50, 700, 100_000])
def test_labelled_sample_is_that_of_the_join(spark, most):
    docs, labels = many_labelled(spark)
    marks = labels.where("toxic in (0, 1)").selectExpr("doc_id", "toxic as label")
    joined = docs.select("doc_id", "text").join(marks, "doc_id")
    want = common.bounded_sample(joined, ["doc_id", "text", "label"], most).collect()
    assert len(want) == min(most, joined.count()) or len(want) == min(most, joined.distinct().count())
    found = common.labelled_sample(docs, marks, most)
    assert found.columns == ["doc_id", "text", "label"] and sorted(map(repr, found.collect())) == sorted(map(repr, want))
    assert common.labelled_sample(docs, marks.where("false"), most).count() == common.labelled_sample(docs.where("false"), marks, most).count() == 0


@pytest.mark.parametrize("module", [quality_nbsvm, toxicity])
@pytest.mark.parametrize("sample", [60, 100_000])
def test_texts_stay_where_labels_are_joined(spark, monkeypatch, module, sample):
    plans = []

    def noted(df, keep=common.stored):
        with contextlib.redirect_stdout(io.StringIO()) as told:
            df.explain(mode="formatted")
        plans.append(told.getvalue())
        return keep(df)

    monkeypatch.setattr(common, "stored", noted)
    monkeypatch.setattr(module, "stored", noted)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs, labels = many_labelled(spark)
        assert module.classified(docs, labels, sample=sample).count() == docs.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    dealt = re.findall(r"Exchange\nInput \[\d+\]: (\[.*\])\nArguments: hashpartitioning\(doc_id", "\n".join(plans))
    assert dealt and not [columns for columns in dealt if "text#" in columns]


@pytest.mark.parametrize(
    "page",
    ["<a " + "x " * 100_000, "<script " * 25_000, "<b>x" * 50_000, "<i><div>" + "<b>" * 30_000 + "</i>" * 30_000, "<a \"'" * 40_000,
     "<article " * 20_000, "<" * 200_000, "<script>" + "</script " * 25_000, "&" * 200_000],
    ids=["tag", "script", "nested", "unclosed", "quotes", "article", "angles", "closers", "references"],
)
def test_broken_pages_take_linear_time(page):
    start = time.process_time()
    root, pieces = html_extraction.parsed(page)
    nodes = html_extraction.summed(root)
    html_extraction.text_of(pieces, html_extraction.decoded(nodes, np.full(len(nodes), 0.9)))
    html_extraction.MAIN_PART.findall(page) if len(html_extraction.OPENING.findall(page)) <= html_extraction.MOST_OPENINGS else []
    assert time.process_time() - start < 5


def test_exported_trees_predict_as_spark_does(spark):
    pages = spark.read.parquet(f"{os.environ.get('TEST_SF_DIR', '/root/testdata/sf0.001')}/pages.parquet")
    rows = html_extraction.training_rows(pages).select("label", array_to_vector("x").alias("features"), "x").cache()
    model = GBTClassifier(labelCol="label", maxIter=6, maxDepth=4, stepSize=0.25, seed=3).fit(rows)
    trees = html_extraction.exported(model)
    told = model.transform(rows).select("x", "probability").collect()
    assert len(trees) == 6 and len(told) > 50
    ours = html_extraction.probabilities(trees, np.array([r.x for r in told]))
    assert np.allclose(ours, [r.probability[1] for r in told], atol=1e-9)


# --- stages judge rows, not ids


def twins(spark, bad, good):
    """Bad and good texts under one id, and without an id, with a column that clashes with the stages' own."""
    rows = [(d, t, "en", "s") for d in (None, 5) for t in [bad, *good]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, block string")


def test_decontamination_removes_rows(spark):
    passage = prose(50, 60)
    docs = twins(spark, prose(51, 20) + " " + passage + " " + prose(52, 20), [prose(53, 80), None, ""])
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = decontamination.keep_clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in docs.collect() if r.text is None or passage not in r.text)
    assert decontamination.keep_clean(docs, items.limit(0)).count() == docs.count()


def test_rules_remove_rows(spark):
    good = [prose(i, 200) for i in range(60, 90)]
    docs = twins(spark, "too short", good)
    kept = perplexity.keep_good(docs)
    found = sorted(map(repr, kept.collect()))
    assert "too short" not in {r.text for r in kept.collect()} and len(found) > 40
    wanted = perplexity.verdicts(docs).where("kept").count()
    assert len(found) == wanted and {r.doc_id for r in kept.collect()} == {None, 5}


def test_classifier_removes_rows(spark):
    clean = [prose(i, 60) for i in range(100, 140)]
    junk = ["buy now " * 30 + prose(i, 5) for i in range(140, 180)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string, block string")
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    mixed = docs.unionByName(twins(spark, junk[0], clean[:3]))
    kept = quality_nbsvm.keep_good(mixed, labels)
    rows = kept.where("doc_id is null or doc_id = 5").collect()
    assert kept.columns == docs.columns
    assert sorted(r.text for r in rows if r.doc_id is None) == sorted(clean[:3])
    assert junk[0] not in {r.text for r in rows}


# --- token counts of any text


def test_long_runs_do_not_change_tokens():
    own = token_histogram.encoder(token_histogram.VOCABULARY)
    blanks = [" ", "\n", " \t", "\u2003 ", "\r\n"]
    ends = ["", "x", " x", "!", "9", "\x1c"]
    for blank, start, end in itertools.product(blanks, ["", "word", "9 "], ends):
        text = start + blank * 3000 + blank * 3000 + end + " tail" * bool(end)
        assert token_histogram.tokens(own, text) == len(own.encode_ordinary(text))


def test_texts_of_millions(spark):
    own = token_histogram.encoder(token_histogram.VOCABULARY)
    texts = [" " * 1_000_000, " " * 1_000_000 + "end", "a" * 1_000_000, "😀" * 250_000, ("word " * 1000 + "\n" * 5000) * 800]
    parts = [len(own._encode_single_piece(b" " * 1_000_000)), len(own._encode_single_piece(b" " * 999_999)) + len(own.encode_ordinary(" end"))]
    assert [token_histogram.tokens(own, t) for t in texts[:2]] == parts
    found = token_histogram.histogram(spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string"))
    assert sorted(r.length for r in found.collect() for _ in range(r.n_docs)) == sorted([*(token_histogram.tokens(own, t) for t in texts), 0, 0])


# --- tool calls


def slow_links(calls):
    """(depth, position) by following each call, over calls with unique (conv, id)."""
    after = {(c, i): (c, a) for c, i, *_, a in calls}

    def depth(key):
        seen, n = set(), 0
        while after[key] in after:
            if key in seen:
                return -1
            seen.add(key)
            key, n = after[key], n + 1
        return n

    depths = {(c, i): depth((c, i)) for c, i, *_ in calls}
    turn = {(c, i): t for c, i, t, *_ in calls}
    places = {}
    for conv in {c for c, _ in depths}:
        mine = sorted((d, turn[k], k[1]) for k, d in depths.items() if k[0] == conv and d >= 0)
        places |= {(conv, i): n for n, (_, _, i) in enumerate(mine)}
    return {k: (d, places.get(k)) for k, d in depths.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_links_on_random_graphs(spark, monkeypatch, seed):
    monkeypatch.setattr(tool_calls, "TURNS", 3)
    draw = random.Random(seed)
    calls = []
    for conv in range(6):
        n = draw.choice([1, 5, 40])
        ids = [f"c{i}" for i in range(n)]
        for i in ids:
            calls.append((conv, i, draw.randrange(12), "count", '{"query": "q"}', draw.choice([None, "nowhere", i, *ids, *ids])))
    schema = "conv_id long, call_id string, turn long, name string, arguments string, after string"
    frame = spark.createDataFrame(calls, schema).selectExpr("*", "1 as depth", "2 as position", "3 as block")
    results = spark.createDataFrame([(c, i, 1, "r", 0) for c, i, *_ in calls[::2]], "conv_id long, call_id string, turn long, content string, depth int")
    want = slow_links(calls)
    found = {(r.conv_id, r.call_id): r for r in tool_calls.linked(frame, results, queries.SCHEMAS).collect()}
    assert {k: (r.depth, r.position) for k, r in found.items()} == want
    answered = {(c, i) for c, i, *_ in calls[::2]}
    for k, r in found.items():
        assert r.status == ("cycle" if want[k][0] < 0 else "ok" if k in answered else "no result")
    assert tool_calls.linked(frame, results.limit(0), queries.SCHEMAS).where("status = 'ok'").count() == 0
    # each call comes after the one it rests on
    for c, i, *_, a in calls:
        if want[c, i][1] is not None and (c, a) in want:
            assert want[c, a][1] < want[c, i][1]


def test_arguments_of_any_kind(spark):
    long = "x" * 1_000_000
    told = ['{"query": "\\ud800"}', json.dumps({"query": long}), json.dumps({"query": "é" * 400, "limit": 1}), '{"query": 1e400}', "[" * 100_000, None, "9" * 5000]
    schema = "conv_id long, call_id string, turn long, name string, arguments string, after string"
    calls = spark.createDataFrame([(1, str(i), i, "search", a, None) for i, a in enumerate(told)], schema)
    results = spark.createDataFrame([(1, "1", 1, long)], "conv_id long, call_id string, turn long, content string")
    rows = {int(r.call_id): r for r in tool_calls.linked(calls, results, queries.SCHEMAS).collect()}
    assert rows[0].status == "invalid: $: not Unicode" and json.loads(rows[0].message)["arguments"] == told[0]
    assert "too long" in rows[1].status and json.loads(rows[1].message)["result"] == long
    assert rows[2].status == "no result"
    assert all(rows[i].status == "invalid: $: not JSON" for i in (3, 4, 5, 6))


def test_query_reads_whole_turns(spark):
    talks = spark.createDataFrame([(1, 1, "assistant", "a" * 90), (1, 2, "user", "b" * 90)], "conv_id long, turn long, role string, text string")
    calls, _ = queries.calls_of(talks)
    assert json.loads(calls.first().arguments)["query"] == "a" * 90
