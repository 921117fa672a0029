import __spark_entry__ as contract


def test_contract(spark, data):
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries)
    assert contract.entry(spark).count() > 0
