import datetime as dt

from weftline.operators import flow
from weftline.streaming import flows


def items(spark, start):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(f"id{n}", None if n % 4 == 0 else f"L{n % 5}", t + dt.timedelta(minutes=n)) for n in range(start, start + 20)], "id string, link string, fetched_at timestamp")


def test_stream_of_new_items_equals_batch(spark, tmp_path):
    for k in (0, 20):
        items(spark, k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = flows.new_items(flows.poll_folder(spark, str(tmp_path / "in"), "id string, link string, fetched_at timestamp", files=1))
    flows.log_to(stream.select("id", "link", "seen_key"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    every = spark.read.parquet(str(tmp_path / "in"))
    want = flow.first_wins(every, flow.seen_key(every.link, every.id), ["fetched_at"])
    assert got.count() == want.count() and {r.seen_key for r in got.collect()} == {r.link or r.id for r in want.collect()}


def test_each_new_calls_once_per_batch(spark, tmp_path):
    items(spark, 0).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    s = flows.poll_folder(spark, str(tmp_path / "in"), "id string, link string, fetched_at timestamp")
    flows.each_new(s, lambda df, k: seen.append(df.count()), str(tmp_path / "ck")).awaitTermination()
    assert sum(seen) == 20
