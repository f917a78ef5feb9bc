import pytest
from compare import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from harborline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    assert compare(spark, connect(SF), name, QUERIES[name], ORACLES.get(name), SF) == ""


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "secrets", "packing"]
    extra = docs.limit(3).withColumns({"doc_id": F.col("doc_id") + 10**6, "text": F.lit("token = abcdefgh12345678 and more words here")})
    docs = docs.union(extra)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        if name == "near_duplicates":
            assert out.filter("doc_id >= 1000000").count() == 1
        if name == "secrets":
            assert {r[0] for r in out.filter("doc_id >= 1000000").select("text").collect()} == {"[SECRET] and more words here"}
        if name == "lines":
            assert out.filter("doc_id >= 1000000 and text <> ''").count() == 1
    assert corpus_pipeline.packing(spark, docs, SF).agg(F.countDistinct("doc_id")).first()[0] == docs.select("doc_id").distinct().count()
