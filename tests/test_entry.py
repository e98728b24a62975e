import re

import __spark_entry__


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    if __spark_entry__.LLM:
        assert {n.split("_")[0] for n in queries if re.match(r"op\d+_", n)} == {f"op{i}" for i in range(1, 14)}
    assert ("pipeline" in queries) == __spark_entry__.PIPELINE
