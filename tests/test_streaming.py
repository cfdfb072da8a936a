from pyspark.sql import functions as F

from folioflow.streaming import piece_stream, sentence_uses


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "One. Two.", "2024-01-01 00:00:00"), (2, "", "2024-01-01 00:01:00"), (3, "One.", "2024-01-01 00:02:00")], "doc_id long, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("doc_id long, text string, ts timestamp").parquet(str(tmp_path / "in"))
    for name, df, mode in (("pieces", piece_stream(source()), "append"), ("uses", sentence_uses(source()), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
    assert {(r.doc_id, r.text) for r in spark.table("pieces").filter("translatable").collect()} == {(1, "One."), (1, "Two."), (3, "One.")}
    assert {(r.sentence, r.uses) for r in spark.table("uses").collect()} == {("One.", 2), ("Two.", 1)}


def test_late_rows_are_dropped_and_windows_close(spark, tmp_path):
    """A window is given out once the watermark has passed it; a row that comes after that counts nowhere."""
    batches = [[("One.", "2024-01-01 00:01:00"), ("One. Two.", "2024-01-01 00:02:00")], [("Three.", "2024-01-01 01:00:00")], [("One.", "2024-01-01 00:03:00"), ("Four.", "2024-01-01 00:58:00")], [("Five.", "2024-01-01 03:00:00")], [("Six.", "2024-01-01 03:00:00")]]
    schema = "text string, ts timestamp"
    out, name = [], str(tmp_path / "state")
    for rows in batches:
        spark.createDataFrame(rows, "text string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        # Each run goes on from the state that the one before has left.
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        sentence_uses(source).writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", name).start(str(tmp_path / "out")).awaitTermination()
        out.append(spark.read.parquet(str(tmp_path / "out")).count() if (tmp_path / "out").exists() and any((tmp_path / "out").glob("*.parquet")) else 0)
    got = {(r.window.start.isoformat(), r.sentence, r.uses) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {(s, n) for _, s, n in got} == {("One.", 2), ("Two.", 1), ("Three.", 1), ("Four.", 1)}
    assert out == sorted(out)
