import __spark_entry__ as contract


def test_flagship(spark):
    df = contract.entry(spark)
    assert df.count() == 1500
    assert sorted(df.columns) == sorted(["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])


def test_every_sql_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 150
