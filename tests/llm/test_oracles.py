import pytest

from shalebed.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    assert differences(spark, SF, QUERIES[name], ORACLE_SQL[name]) == ""


def test_pipeline_keeps_clean_documents(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.good_quality(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    assert labels.join(good, "doc_id", "left_anti").count() <= 0.03 * labels.count()
    assert corpus_pipeline.run(spark, SF).where("not round_trip").count() == 0
