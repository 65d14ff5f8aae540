from conftest import rows, stream

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyferry.operators import counts
from keyferry.sources.tables import channels, records, with_hot_key


def repeated():
    return [k for i, k in enumerate("abcdefgh") for _ in range(10 + i)]


def test_final_counts_of_repeated_keys(spark):
    counted = counts.running_count(stream(spark, repeated()))
    final = counted.groupBy("key").agg(F.max("n").alias("n"))
    assert rows(final) == [(k, 10 + i) for i, k in enumerate("abcdefgh")]
    assert counted.count() == 108


def test_every_key_once_counts_one(spark):
    counted = counts.running_count(stream(spark, [f"key-{i}" for i in range(200)]))
    assert counted.where("n <> 1").count() == 0


def test_varied_counts(spark):
    keys = [f"key-{i}" for i in range(200) for _ in range(1 + i % 7)]
    got = dict(rows(counts.key_counts(stream(spark, keys))))
    assert got == {f"key-{i}": 1 + i % 7 for i in range(200)}


def test_words_split_and_drop_empties(spark):
    docs = spark.createDataFrame(
        [(1, "Real-time  STREAM, real time!"), (2, ""), (3, "--")], "doc_id long, text string"
    )
    assert rows(counts.tokens(docs)) == [(1, "real", 2), (1, "stream", 1), (1, "time", 2)]
    assert rows(counts.word_count(docs)) == [("real", 2), ("stream", 1), ("time", 2)]


def test_hot_keys_split_by_blocks_give_the_same_numbers(spark, data):
    """A key with over a third of all rows, and blocks of 50 sequence numbers."""
    base = records(spark, data).select("seq", "key")
    skewed = base.withColumn("key", F.when(F.col("seq") % 5 < 2, "hot").otherwise(F.col("key")))
    plain = skewed.withColumn(
        "n", F.row_number().over(W.partitionBy("key").orderBy("seq")).cast("long")
    )
    split = counts.running_count(skewed, hot_rows=20, block=50).select("seq", "key", "n")
    assert rows(split) == rows(plain)


def test_hot_key_fixture(spark):
    base = stream(spark, [f"key-{i}" for i in range(20)])
    total = counts.hot_key_totals(with_hot_key(base, "key-7", 30))
    assert rows(total, "records", "hot_key", "hot_records") == [(50, "key-7", 31)]


def test_channels_carry_their_name(spark):
    one = stream(spark, [f"key-{i}" for i in range(20)])
    both = channels({"left": one, "right": one})
    assert rows(both.groupBy("channel").count()) == [("left", 20), ("right", 20)]
