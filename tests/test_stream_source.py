import shutil

from pyspark.sql import functions as F

import __spark_entry__ as entry


def test_stream_reads_a_table_kept_as_one_file_or_as_a_folder(spark, tmp_path):
    rows = spark.range(24).select(
        F.col("id").alias("doc_id"), F.format_string("text %s", "id").alias("text"), F.lit("en").alias("lang"),
        F.lit("web").alias("source"), F.lit(6).cast("long").alias("n_chars"))
    folder, single = tmp_path / "folder", tmp_path / "single"
    rows.repartition(3).write.parquet(str(folder / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "part"))
    single.mkdir()
    shutil.copy(next((tmp_path / "part").glob("part-*")), single / "documents.parquet")
    found = [sorted(map(tuple, entry.queries()["ingest_stream"](spark, str(d)).collect())) for d in (folder, single)]
    assert found[0] == found[1] and found[0]
