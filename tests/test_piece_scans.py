"""Pieces are judged in few passes over the documents."""

import __spark_entry__

from test_queries import SF


def test_documents_are_read_a_few_times(spark):
    plan = __spark_entry__.queries()["q_piece_issues"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("Relation [") <= 3
