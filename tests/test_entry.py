import __spark_entry__ as entry


def test_every_statement_belongs_to_a_query():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and all(isinstance(s, str) for s in oracle.values()) and all(callable(q) for q in queries.values())
