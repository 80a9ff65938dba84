import pytest
from compare import assert_same
from conftest import SF

from docpair.plans import analysis, texts
from docpair.plans.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", ORACLE)
def test_matches_sql(spark, name):
    assert_same(spark, SF, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", analysis.ORACLE)
def test_analysis_matches_sql(spark, name):
    assert_same(spark, SF, analysis.QUERIES[name], analysis.ORACLE[name])


@pytest.mark.parametrize("name", texts.ORACLE)
def test_texts_match_sql(spark, name):
    assert_same(spark, SF, texts.QUERIES[name], texts.ORACLE[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
