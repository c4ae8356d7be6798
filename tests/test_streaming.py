"""Streams and SQL functions."""

from datetime import datetime

from mini import tokenizer

from tessera import streaming
from tessera.operators import encode as E
from tessera.plans import sql


def test_encoding_a_stream_equals_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["hi 🤔", "this is a", None, ""] * 5)], "k int, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streaming.start(streaming.encode(stream, tokenizer()), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = {r.k: r.encoded.token_ids for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.k: r.encoded.token_ids for r in E.encode(rows, tokenizer()).collect()}


def test_token_counts(spark, tmp_path):
    day = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(day.replace(minute=m), "hi hi this") for m in (1, 2, 15, 59)], "ts timestamp, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streaming.token_counts(stream, tokenizer(), "text", "ts").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = {(r.start.minute, r.token): r.n for r in spark.table("counts").collect()}
    assert found[(0, "▁hi")] == 4 and found[(10, "▁this")] == 1 and found[(50, "▁hi")] == 2


def test_sql_functions(spark):
    sql.register(spark, tokenizer(), "mini_")
    assert spark.sql("SELECT mini_token_ids('hi 🤔') AS x").first().x == [1274, 6, 243691]
    assert spark.sql("SELECT mini_tokenize('this').tokens AS x").first().x == ["▁this"]
    assert spark.sql("SELECT mini_decode_ids(mini_token_ids('hi this')) AS x").first().x == " hi this"
    rows = spark.sql("SELECT * FROM mini_tokens('is th!s')").collect()
    assert [(r.pos, r.token, r.begin, r.end) for r in rows][1:] == [(1, "▁th", 2, 5), (2, "!", 5, 6), (3, "s", 6, 7)]
