"""Every query against its SQL; those without SQL must return rows."""

import oracle
import pytest

from kgspark.plans import registry

#: queries without SQL, because DuckDB's patterns have no look-around, the steps (or matches) are sequential or no SQL peels a graph
NO_SQL = {"term_match_full", "vocabulary_match", "first_fit_rows", "cycle_check"}


@pytest.fixture(scope="module")
def duck(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_agrees_with_sql(spark, sf, duck, name):
    assert oracle.differences(spark, sf, registry.QUERIES[name], registry.ORACLES[name], duck) == ""


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_has_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).limit(1).count() == 1


def test_no_query_is_left_out():
    assert set(registry.QUERIES) - set(registry.ORACLES) == NO_SQL


@pytest.mark.parametrize("name", ["degrees", "power_budget", "where_used", "status_tally"])
def test_oracle_notices_what_is_wrong(spark, sf, duck, name):
    """A query of each plan module with a row less, a row more and a changed value."""
    from pyspark.sql import functions as F

    run, sql = registry.QUERIES[name], registry.ORACLES[name]
    df = run(spark, sf)
    rows = df.collect()
    number = next(c for c, k in df.dtypes if k in ("bigint", "int", "double"))
    wrong = {
        "less": lambda s, d: s.createDataFrame(rows[1:], df.schema),
        "more": lambda s, d: run(s, d).union(s.createDataFrame(rows[:1], df.schema)),
        "other": lambda s, d: s.createDataFrame(rows[1:], df.schema).union(s.createDataFrame(rows[:1], df.schema).withColumn(number, (F.coalesce(F.col(number), F.lit(0)) + 1).cast(dict(df.dtypes)[number]))),
    }
    assert oracle.differences(spark, sf, run, sql, duck) == ""
    for what, query in wrong.items():
        assert oracle.differences(spark, sf, query, sql, duck) != "", what
