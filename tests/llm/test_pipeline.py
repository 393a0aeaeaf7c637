import corpus_pipeline
import __spark_entry__
from tests.conftest import DATA


def test_stages_one_by_one(spark, docs, tmp_path):
    docs.select("doc_id").selectExpr("doc_id", "cast(doc_id % 5 <> 0 as int) as quality", "0 as toxic").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / name))
        before, now = now, spark.read.parquet(str(tmp_path / name))
        assert 0 < now.count() <= before.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in now.collect()}


def test_empty_tables(spark, no_docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, str(tmp_path)).count() == 0


def test_run(spark):
    assert __spark_entry__.queries()["pipeline"](spark, DATA).count() > 100


def test_every_operator_is_registered():
    names = set(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_against_sql(spark, duck):
    from assayer.llm import catalogue

    for name, sql in catalogue.ORACLE_SQL.items():
        df = catalogue.QUERIES[name](spark, DATA)
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(tuple, df.select(*names).collect())) == sorted(found.fetchall()), name
