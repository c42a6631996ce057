"""LAS inventories, the data source, and incremental loads."""

import os

import pytest
from pyspark.sql import functions as F

from pointloom.operators import loading
from pointloom.sources import las
from pointloom.sources.points import points

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def folder(spark, tmp_path):
    """Files that lie apart: one for each band of x."""
    p = points(spark, SF).withColumn("file_id", F.floor(F.col("x") / 100).cast("int"))
    las.write_las(p, str(tmp_path / "las")).count()
    return tmp_path / "las"


def spoil(path):
    """Garbage of the same size and time."""
    path = path.removeprefix("file:")
    was = os.stat(path)
    with open(path, "wb") as f:
        f.write(b"x" * was.st_size)
    os.utime(path, ns=(was.st_atime_ns, was.st_mtime_ns))


def test_inventory_opens_new_files_only(spark, folder, tmp_path):
    at = str(tmp_path / "headers")
    first = las.inventory(spark, str(folder), at).collect()
    assert sum(r.num for r in first) == points(spark, SF).count() and {r.source for r in first} == set(range(10))
    spoil(first[0].path)
    os.rename(first[1].path.removeprefix("file:"), tmp_path / "gone.las")
    again = las.inventory(spark, str(folder), at).collect()
    assert {r.path for r in again} == {r.path for r in first} - {first[1].path}
    os.rename(tmp_path / "gone.las", folder / "other.las")
    assert len(las.inventory(spark, str(folder), at).collect()) == len(first)


def test_source_opens_chosen_files_only(spark, folder, tmp_path):
    heads = las.inventory(spark, str(folder), str(tmp_path / "headers"))
    want = points(spark, SF).filter("x > 210 and x <= 380 and y >= 300").count()
    for r in heads.collect():
        if r.maxx < 210 or r.minx > 380:
            spoil(r.path)
    df = las.scan(spark, heads, "xyzi")
    assert df.filter("x > 210 and x <= 380 and y >= 300").count() == want > 0
    assert df.filter("x > 5000").count() == 0
    assert df.filter("x = 250 and intensity >= 0").count() == points(spark, SF).filter("x = 250").count()
    assert las.records(heads.filter("minx < 380 and maxx > 210"), "x").filter("x > 210").count() > want


def test_load_in_batches(spark, folder, tmp_path):
    target, heads = str(tmp_path / "target"), las.inventory(spark, str(folder), str(tmp_path / "headers"))
    some = heads.filter("source < 4")
    n = some.agg(F.sum("num")).first()[0]
    made = loading.load(spark, some, target, points=n // 3)
    assert made in (3, 4)
    assert loading.loaded_blocks(spark, target).agg(F.sum("n")).first()[0] == n
    for r in some.collect():
        spoil(r.path)
    assert loading.load(spark, some, target) == 0  # nothing is opened
    assert loading.load(spark, heads, target) == 1
    every = points(spark, SF).count()
    assert loading.loaded_blocks(spark, target).agg(F.sum("n")).first()[0] == every
    sizes = loading.manifest(spark, target).groupBy("batch").agg(F.sum("num").alias("n"), F.count("*").alias("files")).collect()
    assert sum(r.n for r in sizes) == every and sum(r.files for r in sizes) == heads.count()


def test_half_a_batch_does_not_count(spark, folder, tmp_path, monkeypatch):
    target, heads = str(tmp_path / "target"), las.inventory(spark, str(folder), str(tmp_path / "headers"))
    assert loading.load(spark, heads.filter("source = 1"), target) == 1
    n = loading.loaded_blocks(spark, target).agg(F.sum("n")).first()[0]

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(loading, "_commit", lost)
        with pytest.raises(RuntimeError, match="lost"):
            loading.load(spark, heads.filter("source > 5"), target)
    assert len(os.listdir(f"{target}/blocks")) >= 2
    assert loading.loaded_blocks(spark, target).agg(F.sum("n")).first()[0] == n
    assert loading.load(spark, heads, target) == 1
    assert loading.loaded_blocks(spark, target).agg(F.sum("n")).first()[0] == points(spark, SF).count()


def test_nothing_to_load(spark, folder, tmp_path):
    heads = las.inventory(spark, str(folder), str(tmp_path / "headers"))
    assert loading.load(spark, heads.limit(0), str(tmp_path / "target")) == 0
    with pytest.raises(ValueError):
        loading.loaded_blocks(spark, str(tmp_path / "target"))


def test_stream_of_inventories(spark, folder, tmp_path):
    """Batches that a stream hands on, some files named twice; a second run finds nothing new."""
    heads = las.inventory(spark, str(folder), str(tmp_path / "headers")).select(*[x.split()[0] for x in las.HEADER.split(", ")])
    feed, target = str(tmp_path / "feed"), str(tmp_path / "target")
    for part in ("source_ < 3", "source_ < 6", "source_ >= 6"):
        named = heads.withColumn("source_", F.regexp_extract("path", r"part_(\d+)_", 1).cast("int"))
        named.filter(part).drop("source_").coalesce(1).write.mode("append").parquet(feed)
    for _ in range(2):
        loading.load_stream(spark, feed, target, str(tmp_path / "checkpoint"), heads.schema)
    assert loading.loaded_blocks(spark, target).agg(F.sum("n")).first()[0] == points(spark, SF).count()
    assert loading.manifest(spark, target).count() == heads.count()


def test_device_lines(spark, tmp_path):
    from pointloom.sources import text

    (tmp_path / "a.txt").write_text("#sda sdb\n1 10 20 30 40\n#sda sdb\n2 1 2 3 4\n")
    got = sorted(map(tuple, text.read_io(spark, str(tmp_path / "a.txt")).collect()))
    assert got == [(1.0, "sda", 10.0, 20.0), (1.0, "sdb", 30.0, 40.0), (2.0, "sda", 1.0, 2.0), (2.0, "sdb", 3.0, 4.0)]
    (tmp_path / "b.txt").write_text("#sda\n1 10 20\n#sdb\n2 1 2\n")
    with pytest.raises(Exception, match="two device lines"):
        text.read_io(spark, str(tmp_path / "b.txt")).collect()


def test_large_groups_are_dealt(spark):
    from pointloom.operators import blocks as B

    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 900, 0).otherwise(F.col("id") % 5))
    dealt = B.by_group(df, "g", ("id",), rows=100)
    assert dealt.columns == df.columns and dealt.count() == 1000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a few rows would make one partition
    try:
        assert dealt.filter("g = 0").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_arriving_files_are_cut(spark, monkeypatch):
    """A file_id of many points arrives in several parts, all of its points once."""
    from pointloom.plans import pipelines
    from pointloom.sources.points import points

    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(pipelines, "ARRIVING_ROWS", 50, raising=False)
    held = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for c, v in zip(held, ("64", "false")):
            spark.conf.set(c, v)
        a = pipelines._arriving(spark, d)
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
    sizes = {(r[0], r.file_id): r["count"] for r in a.groupBy("_metadata.file_path", "file_id").count().collect()}
    assert sum(sizes.values()) == points(spark, d).count()
    assert len(sizes) > 20 and max(sizes.values()) < 400


def test_ranges_of_files_are_many_tasks(spark, folder, monkeypatch):
    """Spark would put the few bytes that name them into one."""
    monkeypatch.setattr(las, "RANGE", 100)
    got = las.read_las(spark, str(folder), "XYZ")
    assert got.count() == points(spark, SF).count()
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_batches_that_wait_are_one_pass(spark, folder, tmp_path, monkeypatch):
    """Batches keep their size and folders, a file named twice is loaded once, and the points are numbered once."""
    target, heads = str(tmp_path / "target"), las.inventory(spark, str(folder), str(tmp_path / "headers"))
    passes, numbered = [], loading.B.numbered_within
    monkeypatch.setattr(loading.B, "numbered_within", lambda *a: passes.append(1) or numbered(*a))
    every = points(spark, SF).count()
    made = loading.load(spark, heads.unionByName(heads), target, points=every // 5)
    assert made > 3 and len(passes) == 1
    assert loading.loaded_blocks(spark, target).agg(F.sum("n")).first()[0] == every
    assert len([n for n in os.listdir(f"{target}/blocks") if n.startswith("batch=")]) == loading.manifest(spark, target).select("batch").distinct().count() == made
