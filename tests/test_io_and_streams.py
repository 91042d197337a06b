"""Sources, and streams that give what a table gives."""

import pytest

from vakya.operators import gatelog
from vakya.plans.pipeline import analyze
from vakya.sources import io
from vakya.streaming import analyze as streams


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿id,post_text,ground_truth_sentiment,extra\n1,"two\nlines, and ""quotes""",pos,x\nq,b,neg,y\n', encoding="utf-8")
    got = io.read_posts_csv(spark, str(p)).collect()
    assert [tuple(r) for r in got] == [(1, 'two\nlines, and "quotes"', "pos", "x"), (None, "b", "neg", "y")]
    with pytest.raises(FileNotFoundError):
        io.read_posts_csv(spark, str(tmp_path / "none.csv"))
    p.write_text("post_text,ground_truth_sentiment\n")
    with pytest.raises(ValueError):
        io.read_posts_csv(spark, str(p))
    p.write_text("other\n1\n")
    with pytest.raises(ValueError, match="missing"):
        io.read_posts_csv(spark, str(p))


def test_other_sources(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('{"posts": [{"id": "x", "post_text": "a"}, {"id": "y", "post_text": null}]}')
    assert rows(io.read_posts_json(spark, str(p))) == [("x", "a"), ("y", None)]
    assert rows(io.from_texts(spark, ["a", "b"])) == [(0, "a"), (1, "b")] and rows(io.from_texts(spark, [])) == []
    df = spark.range(100)
    s = rows(io.seeded_sample(df, 10, "id"))
    assert len(s) == 10 and s == rows(io.seeded_sample(df.repartition(5), 10, "id")) and io.seeded_sample(df, 1000, "id").count() == 100
    assert io.resolve("/x/y", "/b") == "/x/y" and io.resolve("nowhere.csv", "/b") == "/b/nowhere.csv"


def test_stream_gives_what_a_table_gives(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/dataset.parquet").select("id", "post_text")
    src.repartition(4).write.parquet(str(tmp_path / "in"))
    cols = ["id", "language", "sentiment", "confidence"]
    stream = streams.analyzed_stream(spark, str(tmp_path / "in"), "id bigint, post_text string", files_per_trigger=2).select(*cols)
    streams.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    streams.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))  # nothing twice
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(analyze(src).select(*cols))


def test_replayed_stream(spark, tmp_path):
    data = [(k, float(i), i + 0.5, i % 10 != 9) for k in (1, 2) for i in range(30)]
    df = spark.createDataFrame(data, "k int, a double, b double, bad boolean")
    df.where("a < 15").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: streams.replayed_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "a", "b", "bad")
    streams.run_available(stream(), str(tmp_path / "out"), str(tmp_path / "cp"))
    df.where("a >= 15").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streams.run_available(stream(), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).where("k = 2").orderBy("a").collect()
    assert [r["decision"] for r in got] == gatelog._replay([d[1:] for d in data if d[0] == 2], 2, 8, 30.0)[0]


def test_windows_and_first_seen(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "cast(ts as timestamp) as ts", "event_type")
    e.write.parquet(str(tmp_path / "in"))
    s = lambda: spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    streams.run_available(streams.first_seen(s(), "ts", "1 hour", "event_type"), str(tmp_path / "f"), str(tmp_path / "fc"))
    assert spark.read.parquet(str(tmp_path / "f")).select("event_type").distinct().count() == e.select("event_type").distinct().count()
    streams.run_available(streams.counts_by_window(s(), "ts", "1 day", "1 minute", "event_type").selectExpr("window.start as start", "event_type", "n"), str(tmp_path / "w"), str(tmp_path / "wc"))
    assert 0 < spark.read.parquet(str(tmp_path / "w")).selectExpr("sum(n)").first()[0] <= e.count()
