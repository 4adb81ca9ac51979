from railspoke.streaming.positions import snap_positions


def test_snap(spark, tmp_path):
    pings = spark.createDataFrame([("a", 48.0, 8.0), ("b", 48.01, 8.0), ("c", 10.0, 10.0)], "ping string, lat double, lon double")
    pings.write.parquet(str(tmp_path / "in"))
    nodes = spark.createDataFrame([(1, 48.0, 8.0001), (2, 48.0101, 8.0)], "osmid long, lat double, lon double")
    stream = spark.readStream.schema(pings.schema).parquet(str(tmp_path / "in"))
    snap_positions(stream, nodes, "ping", str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(120)
    got = {(r["ping"], r["osmid"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 1), ("b", 2)}
