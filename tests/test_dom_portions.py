import pyarrow as pa
from pyspark.sql import functions as F

from hirelake.sources import dom


def test_portions_are_bounded_by_rows_and_bytes_and_lose_nothing():
    values = ["a" * n for n in (5, 0, 30, 4, 4, 4, 4)] + [None, "b"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(values)], ["k", "html"])
    parts = list(dom.portions(batch, 1, rows=3, size=12))
    assert [p.num_rows for p in parts] == [2, 1, 3, 3]
    assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(9))
    assert list(dom.portions(batch.slice(0, 0), 1)) == []


def test_a_task_never_holds_the_trees_of_a_whole_batch(spark):
    """Rows of one Arrow batch arrive in the order and number given, cut into small batches on the way."""
    pages = spark.range(300, numPartitions=1).select("id", F.format_string("<p class='c'>page %s</p>", "id").alias("html"))
    sizes = dom.with_nodes(pages).mapInArrow(
        lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")
    assert sizes.agg(F.sum("n")).first()[0] == 300
    rows = dom.with_nodes(pages).select("id", "texts", F.expr("nodes[0].attrs['class']").alias("c")).collect()
    assert [(r["id"], r["texts"], r["c"]) for r in rows] == [(i, [f"page {i}"], "c") for i in range(300)]
