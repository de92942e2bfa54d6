"""Every registered query of the scoring engine against its SQL."""

import pytest
from conftest import SF, same_rows

from knnscore.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df())


def test_ml_kmeans_covers_all_vectors(spark):
    got = QUERIES["ml_kmeans_index"](spark, SF).toPandas()
    assert got["size"].sum() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
