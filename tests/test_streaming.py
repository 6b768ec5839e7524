"""A workflow over a stream gives what it gives over the whole table."""

import pytest

from tidewright.plans.workflow import Workflow
from tidewright.streaming import over_stream

STEPS = [
    {"operation_id": "text_lowercase", "parameters": {"columns": ["o_orderpriority"]}},
    {"operation_id": "data_filter_by_value", "parameters": {"column": "o_totalprice", "operator": ">=", "value": 100000}},
    {"operation_id": "text_left", "parameters": {"column": "o_orderpriority", "length": 3, "new_column": "p"}},
]


def test_stream_and_table_agree(spark, tmp_path):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_orderpriority", "o_totalprice")
    orders.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = over_stream(stream, STEPS).writeStream.trigger(availableNow=True).format("parquet").option("checkpointLocation", str(tmp_path / "at")).start(str(tmp_path / "out"))
    query.awaitTermination(120)
    got, want = spark.read.parquet(str(tmp_path / "out")), Workflow(STEPS, []).run(orders)
    assert got.count() > 0 and got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_steps_across_rows_are_refused(spark):
    with pytest.raises(ValueError):
        over_stream(spark.range(1).toDF("x"), [{"operation_id": "data_sort", "parameters": {"columns": ["x"]}}])
