"""Records with line breaks in quoted fields, at any place of a split."""

import random

import pytest
from pyspark.sql import functions as F

from taskatlas.sources import readers, records, writers
from taskatlas.sources.storage import scratch_dir

SCHEMA = "a string, b string, n long"


def rows_of(seed, count):
    rng = random.Random(seed)
    bits = ["x", "é", ",", '"', "\n", "\n\n", '""', " ", "text ", "\t", "'", "end."]
    make = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) or None
    return [(make(), make(), i) for i in range(count)]


@pytest.fixture
def tiny_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("suffix", [".csv", ".tsv"])
def test_split_reading_equals_whole_files(spark, tiny_splits, suffix):
    path = scratch_dir(spark, "records") + suffix
    writers.save_table(spark.createDataFrame(rows_of(2, 150), SCHEMA).repartition(3), path)
    schema = spark.createDataFrame([], SCHEMA).schema
    whole = sorted(map(str, readers.read_delimited(spark, path, schema, multi_line=True).collect()))
    split = readers.read_delimited(spark, path, schema)
    assert sorted(map(str, split.collect())) == whole
    assert len(whole) == 150
    assert records._lines(spark, path).rdd.getNumPartitions() > 20
    untyped = readers.read_delimited(spark, path)
    assert untyped.columns == ["a", "b", "n"] and untyped.select(F.sum(F.col("n").cast("long"))).first()[0] == sum(range(150))


def test_more_splits_than_a_broadcast_takes(spark, tiny_splits, monkeypatch):
    path = scratch_dir(spark, "records") + ".csv"
    writers.save_table(spark.createDataFrame(rows_of(5, 120), SCHEMA).repartition(2), path)
    schema = spark.createDataFrame([], SCHEMA).schema
    expected = sorted(map(str, readers.read_delimited(spark, path, schema).collect()))
    monkeypatch.setattr(records, "BROADCAST_SPLITS", 3)
    assert sorted(map(str, readers.read_delimited(spark, path, schema).collect())) == expected


def test_a_record_longer_than_many_splits(spark, tiny_splits):
    path = scratch_dir(spark, "records") + ".csv"
    long = "line\n" * 400
    writers.save_table(spark.createDataFrame([("before", None, 1), (long + "end", 'say "x"', 2), ("after\n", "z", 3)], SCHEMA).coalesce(1), path)
    found = {r["n"]: (r["a"], r["b"]) for r in readers.read_delimited(spark, path, spark.createDataFrame([], SCHEMA).schema).collect()}
    assert found == {1: ("before", None), 2: (long + "end", 'say "x"'), 3: ("after\n", "z")}


def test_a_field_that_never_ends_is_an_error(spark):
    path = scratch_dir(spark, "records") + ".csv"
    spark.createDataFrame([('a,b\n1,"x\n2,y',)], "value string").coalesce(1).write.text(path)
    with pytest.raises(ValueError, match="does not end"):
        readers.read_delimited(spark, path)


def test_windows_line_ends(spark):
    path = scratch_dir(spark, "records") + ".csv"
    spark.createDataFrame([('a,b\r\n1,"x\ny"\r\n\r\n2,z\r',)], "value string").coalesce(1).write.text(path)
    assert sorted(map(tuple, readers.read_delimited(spark, path).collect())) == [("1", "x\ny"), ("2", "z")]
