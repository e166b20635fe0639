"""Tables that are replaced whole: failing and competing writers."""

import threading

import pytest
from pyspark.sql import functions as F

from limnospark.sources import files as FS


def numbers(spark, n, boom=False):
    df = spark.range(n).repartition(4)
    return df.select(F.when(F.col("id") == 3, F.raise_error(F.lit("half-way"))).otherwise(F.col("id")).alias("id")) if boom else df


def test_a_failing_writer_changes_nothing(spark):
    root = FS.scratch_path(spark, "published")
    assert FS.read_published(spark, root) is None
    FS.publish(numbers(spark, 10), root)
    with pytest.raises(Exception, match="half-way"):
        FS.publish(numbers(spark, 20, boom=True), root)
    assert FS.read_published(spark, root).count() == 10
    FS.publish(numbers(spark, 30), root)
    assert FS.read_published(spark, root).count() == 30


def test_a_reader_stays_with_its_version(spark):
    root = FS.scratch_path(spark, "published")
    FS.publish(numbers(spark, 10), root)
    reader = FS.read_published(spark, root)
    FS.publish(numbers(spark, 20).withColumn("more", F.lit(1)), root)
    assert reader.count() == 10 and reader.columns == ["id"]
    assert FS.read_published(spark, root).columns == ["id", "more"]
    FS.expire(spark, root)
    assert FS.read_published(spark, root).count() == 20


def test_two_builders_leave_one_whole_version(spark):
    root = FS.scratch_path(spark, "published")
    sizes = [100 + i for i in range(6)]
    errors = []

    def build(n):
        try:
            FS.publish(numbers(spark, n), root)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=build, args=(n,)) for n in sizes]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not errors and FS.read_published(spark, root).count() in sizes


def test_named_tables(spark):
    schema = FS.raw_schema(spark, "limno_test")
    assert spark.sparkContext.applicationId.replace("-", "_") in schema and FS.raw_schema(spark, "limno_test") == schema
    FS.create_or_replace_table(numbers(spark, 5), f"{schema}.t")
    with pytest.raises(Exception, match="half-way"):
        FS.create_or_replace_table(numbers(spark, 5, boom=True), f"{schema}.t")
    assert spark.table(f"{schema}.t").count() == 5
    FS.create_or_replace_table(numbers(spark, 7).withColumn("x", F.lit("a")), f"{schema}.t")
    assert spark.table(f"{schema}.t").count() == 7 and spark.table(f"{schema}.t").columns == ["id", "x"]


def test_cache_is_built_once(spark, tmp_path):
    numbers(spark, 3).write.parquet(str(tmp_path / "in"))
    built = []

    def build():
        built.append(1)
        return numbers(spark, 8)

    name = f"c{tmp_path.name}"
    for _ in range(2):
        assert FS.cached(spark, name, [str(tmp_path / "in")], build).count() == 8
    assert len(built) == 1
    numbers(spark, 4).write.mode("append").parquet(str(tmp_path / "in"))
    FS.cached(spark, name, [str(tmp_path / "in")], build)
    assert len(built) == 2
