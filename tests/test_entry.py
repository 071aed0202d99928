import __spark_entry__ as e


def test_entry_and_names(spark):
    assert e.entry(spark).limit(5).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
