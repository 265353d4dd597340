"""The crop as a streaming aggregate."""

from turfline.operators import tracking as tr


def test_crop_runs_on_a_stream(spark, tmp_path, rows):
    schema = "gameid int, playid int, frameid int, event string"
    parts = [[(1, 1, 5, "ball_snap"), (1, 1, 9, "run")], [(1, 1, 3, "ball_snap"), (1, 2, 4, "run")]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    job = (
        tr.play_crop(stream).writeStream.outputMode("complete").format("memory").queryName("crops")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    job.awaitTermination(120)
    assert rows(spark.table("crops")) == [(1, 1, 3, 9), (1, 2, None, 4)]
