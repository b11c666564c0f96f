"""The files of tables that arrive in parts."""

from pyspark.sql import functions as F

from fleetseal.plans import inputs


def test_parts_arrive_in_as_many_files_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inputs, "_FILE_ROWS", 100)
    df = spark.range(1001).filter("id < 900 OR id = 1000")
    part = F.when(F.col("id") < 900, 0).when(F.col("id") == 1000, 2)
    files = inputs.arriving(df, part, 4, f"{tmp_path}/in")
    assert files == 9
    whole = spark.read.schema(df.schema).parquet(f"{tmp_path}/in")
    assert len(whole.inputFiles()) == 4 * files and sorted(r.id for r in whole.collect()) == [*range(900), 1000]
    assert whole.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 110
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{tmp_path}/in")
    query = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [p["numInputRows"] for p in query.recentProgress][:4] == [900, 0, 1, 0]
