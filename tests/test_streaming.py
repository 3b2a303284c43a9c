from datetime import datetime

from pressloom.streaming import twins


def stream(spark, tmp_path, batches, schema):
    src = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src / f"b={k}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src) + "/*")


def run(df, spark, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_first_seen_and_volumes(spark, tmp_path):
    schema = "url string, at timestamp"
    t = [datetime(2026, 3, 1, h) for h in (0, 1, 2)]
    df = stream(spark, tmp_path, [[("u", t[0]), ("v", t[1])], [("u", t[2])]], schema)
    assert sorted(r["url"] for r in run(twins.first_seen(df, "url", "at"), spark, "seen", tmp_path)) == ["u", "v"]
    counts = run(twins.volumes(df, "at", "url", "2 hours", "1 hour"), spark, "vols", tmp_path, "complete")
    assert {(r["url"], r["start"].hour): r["n"] for r in counts}[("u", 0)] == 1


def test_stories_close_after_silence(spark, tmp_path):
    schema = "story long, at timestamp"
    df = stream(spark, tmp_path, [[(1, datetime(2026, 3, 1))], [(2, datetime(2026, 3, 20))], [(2, datetime(2026, 3, 21))]], schema)
    rows = run(twins.story_states(df, "story", "at"), spark, "states", tmp_path)
    assert (1, "live") in {(r["story_id"], r["status"]) for r in rows}
    assert (1, "closed") in {(r["story_id"], r["status"]) for r in rows}
