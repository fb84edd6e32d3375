import __spark_entry__ as entry


def test_contract(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 70
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["unit_id", "code", "severity"]
