"""Registered queries and the pipeline on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recollect.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    plain = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    result = con.execute(registry.oracle_sql()[name])
    at = [d[0] for d in result.description]
    assert got == sorted(tuple(plain(r[at.index(c)]) for c in columns) for r in result.fetchall())


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for _, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stage(spark, docs, SF).cache()
        sizes.append(docs.count())
        assert docs.columns[: len(before)] == before
    assert sizes[0] >= sizes[1] >= sizes[2] == sizes[3] >= sizes[4] > 0
    assert docs.where("text RLIKE 'AKIA[A-Z0-9]{12}'").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == sizes[-1]


def test_stages_with_awkward_rows(spark, corpus, tmp_path):
    """Nulls in all columns, empty and long texts, repeated rows and ids, clashing names, empty tables."""
    names = ["times", "_t", "row", "content", "node", "label", "size", "id", "h1", "_n"]
    docs = corpus.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(f"own {n}").alias(n) for n in names])
    docs = docs.unionByName(spark.createDataFrame([(None,) * 5], "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(None).cast("string").alias(n) for n in names]))
    item = corpus.where("doc_id = 12").first()["text"]
    spark.createDataFrame([(1, item), (2, None), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        none = stage(spark, docs.where("false"), str(tmp_path))
        assert none.count() == 0 and none.columns[: len(docs.columns)] == docs.columns, name
        after = stage(spark, docs, str(tmp_path))
        more = [] if k < 4 else ["times_", "taken"]
        assert after.columns == [*docs.columns, *more], name
        same = after.select("doc_id", *names).exceptAll(docs.select("doc_id", *names))
        assert same.count() == 0, name
        docs = after.drop(*more).cache()
        sizes.append(docs.count())
    assert 60 < sizes[0] and sizes[0] > sizes[1] > sizes[2] == sizes[3] >= sizes[4] > 20
    assert docs.where("doc_id = 12").count() == 0 and docs.where("doc_id IS NULL").count() <= 1
