"""The pipeline over small tables: every stage's decisions, from its own input, and the registration of the queries."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from poseweave.llm import jaccard, mixing, passages, toxicity
from poseweave.llm.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


def test_every_operator_has_its_query():
    assert [int(name[2:].split("_")[0]) for name in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 11))
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    outs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(DATA)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        outs.append(docs)
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    clean, distinct, cut, mixed, packed = outs
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.fit(source, spark.read.parquet(f"{DATA}/labels.parquet"))
    kept = {r.doc_id for r in toxicity.score(source, model).where("predicted = 0").collect()}
    assert {r.doc_id for r in clean.collect()} == kept and 0 < len(kept) < source.count()
    classes = jaccard.link(clean, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    assert {r.doc_id for r in distinct.collect()} == {r.component_id for r in classes.collect()}
    touched = {r.doc_id for r in passages.repeats(distinct).select("doc_id").distinct().collect()}
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in (distinct, cut))
    assert all(after[i] == t for i, t in before.items() if i not in touched)
    assert all(len(after.get(i, "")) < len(before[i]) for i in touched)
    copies = {r.doc_id: r.copies for r in mixing.mix(cut).collect()}
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {i: c for i, c in copies.items() if c}
    tokens = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    assert {r.doc_id: r.n // r.d for r in tokens} == got and all(r.n % r.d == 0 for r in tokens)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from read_parquet('{DATA}/{table}.parquet')")
    want = con.execute(SQL[name]).df()
    got = QUERIES[name](spark, str(DATA)).select(*want.columns).toPandas()
    rows = [sorted(map(tuple, d.itertuples(index=False))) for d in (got, want)]
    assert rows[0] == rows[1]
