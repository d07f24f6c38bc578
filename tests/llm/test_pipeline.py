"""The corpus pipeline on small tables: every stage's decisions take effect, odd rows do not break it."""

from __future__ import annotations

import pytest

import corpus_pipeline
from parcelwise.llm import decontamination, mixing, perplexity, quality_nbsvm, simhash
from tests.llm.test_pairs import prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    item = prose(900, 30)
    docs = [(i, prose(i, 90 + i), "en", f"s{i % 3}") for i in range(80)]
    docs += [(100 + i, prose(7, 97), "en", "s1") for i in range(5)]
    docs += [(200, prose(50, 60) + " " + item + " " + prose(51, 60), "en", "s2"), (201, "few words only", None, "s2")]
    docs += [(300 + i, " ".join(w + "###" for w in prose(300 + i, 90).split()), "en", "s0") for i in range(12)]
    docs += [(400, None, "en", None), (401, "", None, "s0"), (None, prose(600, 95), "en", "s1"), (402, prose(601, 4000), "en", None)]
    rows = [(d, t, la, s, len(t or ""), "clash", 1.0) for d, t, la, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, item_id string, score double").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(d, 0 if d is not None and 300 <= d < 312 else 1, 0) for d, *_ in docs if d is not None and d % 3 and (t := d) is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "near duplicates", "benchmark decontamination", "mixing"]
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert sorted(docs.columns) == sorted(columns), name
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    classified, ruled, single, clean = ids
    assert not {300 + i for i in range(12)} & classified and set(range(80)) <= classified and {400, 401, None} <= classified
    assert ruled == classified - {201, 400, 401}
    assert single == ruled - {100, 101, 102, 103, 104}
    assert clean == single - {200}
    assert {402, None, *range(80)} <= clean


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    found = {r.doc_id for r in rows}
    assert set(range(80)) <= found and not found & {100, 200, 201, 300, 400, 401}
    assert all(0 <= r.taken <= 3 * r.size for r in rows)


def test_each_operator_takes_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    labels, items = (spark.read.parquet(f"{folder}/{n}.parquet").where("false") for n in ("labels", "benchmark"))
    assert quality_nbsvm.keep_good(docs, labels).count() == perplexity.keep_good(docs).count() == simhash.keep_one(docs).count() == 0
    assert decontamination.keep_clean(docs, items).count() == mixing.mixed(docs).count() == 0
