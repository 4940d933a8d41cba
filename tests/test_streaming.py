from netloom.streaming.ingest import append_layer, windowed_arcs

SCHEMA = "row_id long, src long, dst long, value double, at timestamp"


def test_windows_and_layer(spark, tmp_path):
    source = str(tmp_path / "in")
    day = "timestamp'2024-01-0{} 00:10:00'"
    rows = [(1, 1, 2, 5.0, 1), (1, 1, 2, 5.0, 1), (2, 1, 2, 1.0, 1), (3, 2, 1, 1.0, 1), (4, None, 1, 1.0, 1), (5, 1, 2, None, 1), (6, 9, 9, 1.0, 5)]
    for k, part in enumerate((rows[:4], rows[4:], [(7, 8, 8, 1.0, 9)])):
        values = ", ".join(f"({r}, {s or 'null'}, {d}, {'null' if v is None else v}, {day.format(t)})" for r, s, d, v, t in part)
        spark.sql(f"select cast(col1 as bigint) row_id, cast(col2 as bigint) src, cast(col3 as bigint) dst, cast(col4 as double) value, col5 at from values {values}").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = windowed_arcs(stream()).writeStream.format("memory").queryName("sums").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["src"], r["dst"], r["value"], r["arcs"]) for r in spark.table("sums").collect())
    assert (1, 2, 6.0, 2) in got and (2, 1, 1.0, 1) in got
    append_layer(stream(), str(tmp_path / "layer"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "layer")).count() == 8
