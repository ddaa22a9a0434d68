"""Tables of versions: merging, replay, compaction, and the upsert on top of them."""

import os
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from feedloom.operators.reshape import normalise_schema
from feedloom.plans.ingest import (
    deduplicate_table, metadata_versions, read_metadata_table, upsert_metadata,
)
from feedloom.sources import versions as v
from feedloom.sources.versions import (
    Versions, all_runs, append_version, claim, compact, has_batch, live_runs, newest, read_versions,
    stored_rows, summed, unmerged,
)


def meta(spark, items):
    names = "paper_id string, published_at string, updated_at string, comment string"
    return normalise_schema(spark.createDataFrame(items, names))


def files(folder):
    return {str(p) for p in Path(folder).rglob("*.parquet") if "_aside" not in str(p)}


def test_newest_row_of_each_key(spark, folder):
    table = Versions(f"{folder}/t", newest(["k"], ["v"]))
    assert read_versions(spark, table) is None
    for batch in ([("a", 1, "x"), ("b", 5, "x")], [("a", 1, "y"), ("b", 4, "y")], [(None, None, "z")]):
        append_version(spark.createDataFrame(batch, "k string, v int, w string"), table)
    want = [("a", 1, "y"), ("b", 5, "x"), (None, None, "z")]
    assert rows(read_versions(spark, table)) == sorted(want, key=lambda r: tuple(map(str, r)))
    compact(spark, table, whole=True)
    assert rows(read_versions(spark, table)) == sorted(want, key=lambda r: tuple(map(str, r)))
    assert len(live_runs(spark, table.path)) == 1


def test_batches_count_once_through_every_compaction(spark, folder):
    table = Versions(f"{folder}/t", summed(["k"], ["n"], ["top"]), fan=3)
    most = 0
    for batch in range(20):
        for _ in range(2):  # each batch is delivered twice
            df = spark.createDataFrame([("a", 1, batch), (f"k{batch % 3}", 2, batch)], "k string, n long, top int")
            append_version(df.coalesce(1), table, batch)
            compact(spark, table)
            assert has_batch(spark, table.path, batch)
        most = max(most, len(all_runs(spark, table.path)))
    assert rows(read_versions(spark, table)) == [("a", 20, 19), ("k0", 14, 18), ("k1", 14, 19), ("k2", 12, 17)]
    # At most two runs of each level, three that were just replaced, and the batch itself.
    assert most <= 10 and len(live_runs(spark, table.path)) <= 6
    assert [r["_batch"] for r in stored_rows(spark, table).where("top = 19").select("_batch").distinct().collect()] == [19]


def test_compaction_that_ends_halfway_changes_nothing(spark, folder, monkeypatch):
    table = Versions(f"{folder}/t", summed(["k"], ["n"]), fan=2)
    one = spark.createDataFrame([("a", 1)], "k string, n long")
    append_version(one, table)
    append_version(one, table)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(v, "_publish", fail)
        with pytest.raises(OSError):
            compact(spark, table)
    assert rows(read_versions(spark, table)) == [("a", 2)]
    compact(spark, table)  # published, the two runs are still there
    assert len(all_runs(spark, table.path)) == 3 and len(live_runs(spark, table.path)) == 1
    assert rows(read_versions(spark, table)) == [("a", 2)]
    compact(spark, table)
    assert len(all_runs(spark, table.path)) == 1


def test_partitions_and_empty_batches(spark, folder):
    from pyspark.sql import types as T

    table = Versions(f"{folder}/t", unmerged, ("day",), T.StructType.fromDDL("k int, day string"))
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "k int, day string")
    append_version(df.where("k > 5"), table)
    assert read_versions(spark, table).count() == 0
    append_version(df, table)
    assert rows(read_versions(spark, table).where("day = '2024-01-02'")) == [(2, "2024-01-02")]
    plan = read_versions(spark, table).where("day = '2024-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_a_table_belongs_to_one_stream(spark, folder):
    claim(spark, f"{folder}/t", "checkpoint 1")
    claim(spark, f"{folder}/t", "checkpoint 1")
    with pytest.raises(ValueError, match="another checkpoint"):
        claim(spark, f"{folder}/t", "checkpoint 2")


def test_upsert_leaves_stored_files_alone(spark, folder):
    ids = [(f"p{i}", f"20{20 + i % 3}-01-01", "1", "") for i in range(60)]
    upsert_metadata(meta(spark, ids), folder)
    before = {f: os.stat(f).st_mtime_ns for f in files(folder)}
    assert len(before) >= 6
    upsert_metadata(meta(spark, [("p4", "2021-01-01", "2", "new"), ("q", "2021-01-01", "1", "")]), folder)
    assert {f: os.stat(f).st_mtime_ns for f in files(folder) if f in before} == before
    added = files(folder) - set(before)
    assert 1 <= len(added) <= 2 and all("year=2021" in f for f in added)
    got = read_metadata_table(spark, folder)
    assert got.count() == 61 and rows(got.where("comment = 'new'"), "paper_id", "updated_at") == [("p4", "2")]
    for i in range(3, 9):
        upsert_metadata(meta(spark, [("p4", "2021-01-01", str(i), f"v{i}")]), folder)
    assert rows(read_metadata_table(spark, folder).where("paper_id = 'p4'"), "comment") == [("v8",)]
    assert read_metadata_table(spark, folder).count() == 61
    assert len(live_runs(spark, folder)) <= 4


def test_upsert_into_a_table_of_year_folders(spark, folder):
    old = meta(spark, [("a", "2022-01-01", "1", "old"), ("b", "2022-01-01", "3", "old"), ("c", "2023-01-01", "1", "old")])
    old.withColumn("year", F.substring("published_at", 1, 4).cast("int")).write.mode("append").partitionBy("year").parquet(folder)
    upsert_metadata(meta(spark, [("a", "2022-01-01", "2", "new"), ("b", "2022-01-01", "2", "late")]), folder)
    want = [("a", "new", 2022), ("b", "old", 2022), ("c", "old", 2023)]
    assert rows(read_metadata_table(spark, folder), "paper_id", "comment", "year") == want
    report = deduplicate_table(spark, folder)
    assert rows(report, "year", "removed") == [("2022", 2), ("2023", 0), ("total", 2)]
    assert rows(read_metadata_table(spark, folder), "paper_id", "comment", "year") == want
    assert not [name for name in os.listdir(folder) if name.startswith("year=")]
    assert rows(deduplicate_table(spark, folder).where("removed > 0")) == []


def test_reading_a_year_reads_its_folders_only(spark, folder):
    upsert_metadata(meta(spark, [("a", "2022-01-01", "1", ""), ("b", "2023-01-01", "1", "")]), folder)
    found = read_metadata_table(spark, folder).where("year = 2022")
    assert "PartitionFilters: [isnotnull(year" in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found, "paper_id") == [("a",)] and metadata_versions(folder).partition_by == ("year", "bucket")
