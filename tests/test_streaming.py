import datetime

import pytest

from fringelake.streaming import incremental

SCHEMA = ("antenna1 long, antenna2 long, ts timestamp, freq double, re double, im double, "
          "weight double")


def rows(minutes, freq, antenna=0):
    start = datetime.datetime(2024, 1, 1)
    return [(antenna, 1, start + datetime.timedelta(minutes=m), freq, float(m), 0.0, 1.0 + m % 2)
            for m in minutes]


@pytest.fixture
def feed(spark, tmp_path):
    path = str(tmp_path / "in")

    def add(data):
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)

    return path, add


def test_average_stream(spark, feed, tmp_path):
    path, add = feed
    add(rows(range(0, 20), 1e8))
    schema = spark.read.parquet(path).schema
    samples = incremental.read_samples(spark, path, schema)
    means = incremental.average_stream(samples, ["antenna1", "antenna2"], "ts", "10 minutes",
                                       "5 minutes")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        q = (means.writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", check).trigger(availableNow=True).start())
        q.awaitTermination(120)

    run()
    add(rows(range(20, 40), 1e8))
    run()
    got = spark.read.parquet(out).orderBy("start").toPandas()
    want = [sum(m * (1 + m % 2) for m in span) / sum(1 + m % 2 for m in span)
            for span in (range(0, 10), range(10, 20), range(20, 30))]
    assert got["re"].tolist()[:3] == pytest.approx(want) and (got["n"][:3] == 10).all()


def test_append_stream(spark, feed, tmp_path):
    path, add = feed
    add(rows(range(5), 1e8))
    schema = spark.read.parquet(path).schema
    out, check = str(tmp_path / "stored"), str(tmp_path / "check")

    def run(number):
        samples = incremental.read_samples(spark, path, schema)
        q = incremental.append_new_frequencies(samples, out, f"{check}{number}").trigger(
            availableNow=True).start()
        q.awaitTermination(120)

    run(0)
    assert spark.read.parquet(out).count() == 5
    run(1)                                   # replay of the same batch number
    assert spark.read.parquet(out).count() == 5
    add(rows(range(5), 1e8) + rows(range(3), 2e8))
    run(0)                                   # next batch: one channel is known
    got = spark.read.parquet(out)
    assert got.count() == 8 and got.where("freq = 2e8").count() == 3
    add(rows(range(5, 9), 1e8))              # later times of a known channel
    run(0)
    assert spark.read.parquet(out).where("freq = 1e8").count() == 9


def test_average_of_the_open_windows(spark, feed, tmp_path):
    path, add = feed
    add(rows(range(0, 25), 1e8))
    df = spark.read.parquet(path)
    done = spark.createDataFrame([(datetime.datetime(2024, 1, 1), 10)], "start timestamp, n long")
    rest = incremental.average_rest(df, done, ["antenna1"], "ts", "10 minutes").orderBy("start")
    assert [r.n for r in rest.collect()] == [10, 5]
    everything = incremental.average_rest(df, done.limit(0), ["antenna1"], "ts", "10 minutes")
    assert everything.count() == 3
