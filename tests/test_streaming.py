import pytest

from rowsmith.errors import ParsingError
from rowsmith.streaming.stream import query_stream, windowed


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    kinds = events.select("event_type").distinct().selectExpr("event_type as kind", "upper(event_type) as label")
    out = query_stream(spark, "select a.event_id, b.label, unnest([1, 2]) as k join b on a.event_type == b.kind where a.value > 50", stream, {"b": kinds}).df
    q = out.writeStream.format("memory").queryName("picked").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("picked").count() == 2 * events.filter("value > 50").count()
    w = windowed(stream, "ts", "1 hour", "1 day", ["event_type"], "value")
    q = w.writeStream.format("memory").queryName("hours").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hours").groupBy().sum("n").first()[0] == events.count()


@pytest.mark.parametrize("text", ["select a1 order by a1", "select top 2 a1", "select distinct a1", "select count(1)", "select NR, a1", "select a1 strict left join b on a1 == b1"])
def test_refused(spark, text):
    with pytest.raises(ParsingError):
        query_stream(spark, text, spark.readStream.format("rate").load())
