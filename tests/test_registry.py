"""Registry integrity and the driver contract."""

import re

import __spark_entry__ as E
from docweave.registry import all_queries


def test_every_oracle_has_a_query():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 100


def test_reserved_names_are_free():
    for name in all_queries():
        assert name != "pipeline" and not re.match(r"^op\d+_", name)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["conv_id", "turn", "question", "prompt"]
    assert all("Question:" in r.prompt for r in rows)
