import __spark_entry__ as e


def test_registered():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_runs(spark):
    assert e.entry(spark).count() == 10
