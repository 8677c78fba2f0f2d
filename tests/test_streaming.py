import datetime as dt

from pyspark.sql import functions as F

from fleetstats.streaming import dtu_stream, resource_fit_stream

START = dt.datetime(2024, 5, 1)
DDL = "server_id string, end_time timestamp, avg_cpu_percent double, avg_data_io_percent double, avg_log_write_percent double"


def minutes(spark, first, last):
    data = [(s, START + dt.timedelta(minutes=m), float((m * 7) % 100), None if m % 3 else 50.0, float(m % 90))
            for m in range(first, last) for s in ("a", "b")]
    return spark.createDataFrame(data, DDL)


def run(spark, tmp_path, make):
    """Three files, one per micro-batch, then everything that is there."""
    for i in range(3):
        minutes(spark, i * 100, (i + 1) * 100).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    (make(stream).writeStream.outputMode("append").format("parquet")
     .option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out")
     .trigger(availableNow=True).start().awaitTermination())
    batch = make(minutes(spark, 0, 300))
    closed = F.lit(START + dt.timedelta(minutes=299 - 15))
    key = ["server_id", "window_start"]
    got = spark.read.parquet(f"{tmp_path}/out").orderBy(*key).collect()
    want = batch.filter(F.col("window_end") <= closed).orderBy(*key).collect()
    return got, want


def test_fit_stream_equals_batch_for_closed_windows(spark, tmp_path):
    got, want = run(spark, tmp_path, resource_fit_stream)
    assert got == want and len(got) > 20


def test_dtu_stream_equals_batch_for_closed_windows(spark, tmp_path):
    got, want = run(spark, tmp_path, dtu_stream)
    assert got == want and len(got) == 2 * 56
