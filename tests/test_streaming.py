import tempfile

from pyspark.sql import functions as F

from tessera.streaming.folder_split import manifest, reconciliation, split_stream

SF = "/root/testdata/sf0.001"


def test_folder_split_stream_matches_batch(spark):
    src = tempfile.mkdtemp(prefix="tessera-stream-src-")
    out = tempfile.mkdtemp(prefix="tessera-stream-out-")
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    status = F.when(F.col("o_orderstatus") == "P", F.lit("  ")).otherwise(F.col("o_orderstatus"))
    data = orders.select("o_orderkey", status.alias("status"))
    data.filter(F.col("o_orderkey") % 2 == 0).write.parquet(f"{src}/part1")
    data.filter(F.col("o_orderkey") % 2 == 1).write.parquet(f"{src}/part2")
    q = split_stream(spark, f"{src}/*", data.schema, ["status"], out, blank_policy="skip", max_files_per_trigger=1)
    q.awaitTermination(300)
    got = {r["split_label"]: r["row_count"] for r in manifest(spark, out).collect()}
    want = {r["status"]: r["count"] for r in data.filter(F.col("status") != "  ").groupBy("status").count().collect()}
    assert got == want
    rec = reconciliation(spark, out).collect()[0]
    total = data.count()
    assert rec["input_rows"] == total and rec["output_rows"] + rec["excluded_rows"] == total
    written = spark.read.parquet(f"{out}/data")
    assert written.count() == rec["output_rows"]
