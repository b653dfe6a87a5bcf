import __spark_entry__ as entry


def test_entry_and_registry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_scan_only_what_they_need(spark, sf):
    from kgspark.plans import registry

    plan = registry.QUERIES["status_tally"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan
