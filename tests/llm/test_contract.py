"""The registered queries against their SQL, and the pipeline against its parts."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfwise.llm import catalog, mixing
from shelfwise.session import cuts_since, cuts_so_far
from tests.llm import cases
from tools.check import canonical, same_kind

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = catalog.queries()[name](spark, FOLDER)
    result = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    assert sorted(names) == sorted(df.columns)
    assert all(same_kind(k, kinds[c]) for c, k in df.dtypes)
    assert canonical(df.columns, df.collect()) == canonical(names, result.fetchall())


def stages(spark, docs, folder, tmp_path):
    """Each stage's name, what it got and what it gave."""
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        yield name, docs, out
        docs = out


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = {}
    for name, before, after in stages(spark, docs, FOLDER, tmp_path):
        seen[name] = after
        if name != "bpe":
            assert after.columns == docs.columns
            ids = {r["doc_id"] for r in before.select("doc_id").collect()}
            assert {r["doc_id"] for r in after.select("doc_id").collect()} <= ids
    mixed = Counter(r["doc_id"] for r in seen["mixing"].collect())
    assert Counter(r["doc_id"] for r in seen["bpe"].collect()) == mixed and max(mixed.values()) <= 2
    whole = Counter(tuple(r) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert whole == Counter(tuple(r) for r in seen["bpe"].collect())


@pytest.mark.parametrize("rows", [cases.ROWS, []])
def test_pipeline_on_awkward_rows(spark, tmp_path, rows):
    docs = cases.documents(spark, rows)
    docs = spark.read.parquet(cases.saved(spark, tmp_path / "in", documents=docs) + "/documents.parquet")
    *kept, last = [after for _, _, after in stages(spark, docs, "", tmp_path)]
    own = docs.columns[len(cases.ROWS[0]) :]
    for after in kept:
        # columns named like those of the stages come through as they were
        assert after.columns == docs.columns
        assert all(set(r) == {"own"} for r in after.select(*[f"`{c}`" for c in own]).collect())
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert (last.count() > 0) == bool(rows)


def test_stages_leave_the_copies_of_others(spark, tmp_path):
    """A result that has not been read yet stays readable while the pipeline runs."""
    docs = spark.createDataFrame(cases.ROWS, cases.SCHEMA)
    other = mixing.weighted_mix(docs.select("doc_id", "source", F.length("text").alias("size")))
    before = cuts_so_far(spark)
    list(stages(spark, docs, "", tmp_path))
    assert other.count() == docs.count()
    # of its own copies only those of the last stages are left
    left = {p.rpartition("/")[2].rpartition("-")[0] for p in cuts_since(spark, before)}
    assert not left & {"llm-lines-banded", "llm-simhash-docs", "llm-mix-queue"}
