from pyspark.sql import functions as F

from stringloom.llm.components import components
from stringloom.session import MOST_BYTES, cut, estimated_bytes


def test_estimates_do_not_grow_from_cut_to_cut(spark):
    """Joins multiply the planner's sizes; kept from cut to cut, their digits would double each round."""
    rows = spark.createDataFrame([(i, f"t{i}", None if i % 3 else i) for i in range(20)], "id bigint, text string, other bigint")
    assert estimated_bytes(cut(spark.range(20))) == 160  # one that says something stays
    left = cut(rows)
    for _ in range(8):
        left = cut(left.join(left.select(F.col("id").alias("_id")), F.col("id") == F.col("_id")).drop("_id"))
        assert estimated_bytes(left) <= MOST_BYTES
    assert left.schema == rows.schema and sorted(left.collect()) == sorted(rows.collect())


def test_components_of_a_long_chain_leave_a_small_plan(spark):
    chain = [(i, i + 1) for i in range(300)] + [(i, i + 1) for i in range(1000, 1040)]
    found = components(spark.createDataFrame(chain, "a bigint, b bigint"))
    assert estimated_bytes(found) <= MOST_BYTES
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(301)} | {(i, 1000) for i in range(1000, 1041)}
