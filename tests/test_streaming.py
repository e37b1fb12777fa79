import datetime as dt

from pyspark.sql import functions as F

from tidemark.streaming import jobs


def test_tumbling_and_once_on_a_stream(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    src = str(tmp_path / "in")
    spark.read.parquet(f"{data}/events.parquet").write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    counts = jobs.tumbling(stream, "ts", "1 hour", ["event_type"], "1 hour", [F.count("*").alias("n")])
    q = counts.writeStream.outputMode("complete").format("memory").queryName("tumble").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    total = spark.read.parquet(src).count()
    assert spark.sql("SELECT sum(n) AS s FROM tumble").first().s == total
    batch = jobs.tumbling(spark.read.parquet(src), "ts", "1 hour", ["event_type"], "1 hour", [F.count("*").alias("n")])
    assert {(r.window.start, r.event_type, r.n) for r in batch.collect()} == {(r.window.start, r.event_type, r.n) for r in spark.table("tumble").collect()}
    q = jobs.once(stream, "ts", ["user_id", "event_type"], "3650 days").writeStream.format("memory").queryName("first").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("first").count() == spark.read.parquet(src).select("user_id", "event_type").distinct().count()


def test_ingest_twice_adds_nothing(spark, tmp_path):
    schema = "url string, canonical_url string, title string, body string, content_hash string"
    rows = [("https://A.example/x/?utm_source=q", None, "t", "one two", None), ("https://a.example/x", None, "t2", "other", None), ("https://a.example/y", None, "T!", "one two.", None), ("https://a.example/z", None, "new", "text", None)]
    src, table, seen = (str(tmp_path / n) for n in ("src", "table", "seen"))
    spark.createDataFrame(rows, schema).coalesce(1).write.json(src)
    for n in (1, 2):
        q = jobs.ingest(spark.readStream.schema(schema).json(src), table, seen, str(tmp_path / f"c{n}"))
        q.awaitTermination()
        if n == 1:
            first = spark.read.parquet(table)
            assert first.count() in (2, 3) and first.select("canonical_url").distinct().count() == first.count()
            kept = {r.content_hash for r in first.collect()}
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
            jobs.ingest(spark.readStream.schema(schema).json(src), table, seen, str(tmp_path / "c1")).awaitTermination()
            assert {r.content_hash for r in spark.read.parquet(table).collect()} == kept
    assert dt


def test_assign_stream_is_a_column(spark):
    cents = spark.createDataFrame([(3, [1.0, 0.0]), (7, [0.0, 1.0])], "topic long, centroid array<double>")
    v = spark.createDataFrame([(1, [0.9, 0.1]), (2, [0.5, 0.5]), (3, [-1.0, -1.0])], "id long, v array<double>")
    got = {r.id: r.topic for r in jobs.assign_stream(v, cents, 0.4).collect()}
    assert got == {1: 3, 2: 3, 3: None}
    assert jobs.assign_stream(v, cents.limit(0), 0.4).count() == 0


def test_assign_on_a_stream_with_many_topics(spark, tmp_path):
    cents = spark.range(1200).select(F.col("id").alias("topic"), F.array(*[F.when(F.col("id") % 7 == k, 1.0).otherwise(F.col("id") / 1e6) for k in range(7)]).alias("centroid"))
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, [0.0] * 3 + [1.0] + [0.0] * 3), (2, None), (3, [1.0, 2.0])], "id long, v array<double>").write.parquet(src)
    stream = spark.readStream.schema("id long, v array<double>").parquet(src)
    q = jobs.assign_stream(stream, cents, 0.4).writeStream.format("memory").queryName("topic_of").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.id, r.topic) for r in spark.table("topic_of").collect()] == [(1, 3)]


def test_rolling_table_of_a_stream(spark, tmp_path):
    from tidemark.sources.store import SCHEMAS, make_store

    store, src = make_store("folder", spark, str(tmp_path / "store")), str(tmp_path / "in")
    for first in (0, 6):
        rows = spark.range(first, first + 8).select("id", *[F.lit(None).cast(k).alias(c) for c, k in spark.createDataFrame([], SCHEMAS["articles"]).dtypes if c != "id"])
        rows.coalesce(1).write.mode("append").parquet(src)
        jobs.roll(spark.readStream.schema(rows.schema).parquet(src), store, "articles", 10, str(tmp_path / "c")).awaitTermination()
    assert sorted(r.id for r in store.read("articles").collect()) == list(range(4, 14))


def test_repeat_and_drain(spark):
    naps, calls = [], iter([1, ValueError("x"), 3])

    def job():
        c = next(calls)
        if isinstance(c, Exception):
            raise c
        return c

    got = jobs.repeat(job, 10, 3, naps.append, seed=1)
    assert got[0] == 1 and isinstance(got[1], ValueError) and got[2] == 3 and len(naps) == 2 and all(540 <= n <= 660 for n in naps)
    left = [5, 3, 0]
    assert jobs.drain(lambda: spark.range(left.pop(0))) == 8 and left == []
    try:
        jobs.repeat(job, 1)
        raise AssertionError
    except ValueError:
        pass


def test_near_duplicates_over_batches(spark, tmp_path):
    schema = "k long, simhash long, seen_at timestamp"
    d = lambda n: dt.datetime(2026, 1, n)
    src, kept, ck = (str(tmp_path / n) for n in ("src", "kept", "ck"))
    run = lambda: jobs.near_duplicates(spark.readStream.schema(schema).parquet(src), kept, ck).awaitTermination()
    spark.createDataFrame([(1, 0, d(1)), (2, 1, d(2)), (3, 0b11111, d(2)), (4, None, d(2))], schema).coalesce(1).write.parquet(src)
    run()
    assert {r.k for r in spark.read.parquet(kept).collect()} == {1, 3}
    spark.createDataFrame([(5, 0b1111111, d(3)), (6, 0, d(20)), (7, 1 << 40, d(20)), (8, -1, d(20))], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    # 5 repeats 3; 6 is too late for 1; 7 repeats 6
    assert {r.k for r in spark.read.parquet(kept).collect()} == {1, 3, 6, 8}


def test_history_outlives_batches(spark, tmp_path):
    src, history = str(tmp_path / "src"), str(tmp_path / "history")
    schema = "day date, cluster_id int, n long"
    live = lambda df: df.groupBy("day", "cluster_id").agg(F.sum("n").alias("article_count")).select("day", "cluster_id", F.lit(1).alias("model_id"), F.lit("x").alias("label"), "article_count", F.lit(0.5).alias("avg_sentiment"))
    for k, rows in enumerate([[(dt.date(2026, 1, 1), 1, 5)], [(dt.date(2026, 1, 1), 1, 3), (dt.date(2026, 1, 2), 1, 4)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        jobs.keep_history(spark.readStream.schema(schema).parquet(src), live, history, str(tmp_path / "ck")).awaitTermination()
        got = {(r.day.day, r.article_count) for r in spark.read.parquet(f"{history}/version={k}").collect()}
    assert got == {(1, 5), (2, 4)}
