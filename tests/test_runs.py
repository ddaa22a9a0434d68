"""Jobs that end with stored results: migration, summaries, ranking."""

import json
import os
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from feedloom.plans import summarise as summarise_plan
from feedloom.plans.migrate import LegacyInputs, migrate_all
from feedloom.plans.recommend import RecommendParams, recommend_run
from feedloom.plans.summarise import StubModel, summarise_run
from feedloom.sources.staged import discard, partitions, publish, stage

WIDE = (
    "id string, title string, abstract string, categories array<string>, authors array<string>, created string, "
    "updated string, m1 array<double>"
)


def put(folder, name, text):
    path = f"{folder}/{name}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def legacy(spark, folder):
    one = ("1", "T", "A", ["cs.AI"], ["X"], "2024-01-01", "2024-02-01", [1.0, 2.0])
    two = ("2", "T2", None, ["cs.AI"], ["X"], "2025-01-01", "2025-02-01", [3.0])
    spark.createDataFrame([one], WIDE).write.parquet(f"{folder}/wide/2024.parquet")
    spark.createDataFrame([two], WIDE).drop("updated", "m1").withColumn("updated", F.lit("2025-02-01")).write.parquet(f"{folder}/wide/2025.parquet")
    put(folder, "p/2024-01.csv", "id,preference\na,like\nb,skip\n,ignored\n")
    put(folder, "p/2025-02.csv", "id,preference\na,dislike\n")
    put(folder, "p/init.csv", "id,preference\nc,star\n")
    put(folder, "raw/x.json", json.dumps({"id": "x", "summary": "S", "summary_time": "2024-02-03T08:00:00Z"}))
    put(folder, "raw/bad.json", "{broken")
    put(folder, "more/y.jsonl", json.dumps({"id": "x b", "summary": "Z", "updated": "2024-02-01"}) + "\nnot json\n[1]\n")
    folders = [(f"{folder}/raw", "raw"), (f"{folder}/more", "more")]
    return LegacyInputs(f"{folder}/wide", f"{folder}/p", folders, models=["m1", "m2"])


def report(run):
    return {(r["section"], r["key"], r["note"]): r["value"] for r in run.report.collect()}


def test_migration_of_everything(spark, folder):
    inputs, out = legacy(spark, folder), f"{folder}/out"
    assert migrate_all(spark, inputs, out, "NOW", dry_run=True).published == () and not os.path.exists(out)
    run = migrate_all(spark, inputs, out, "NOW")
    assert rows(spark.read.parquet(f"{out}/metadata"), "paper_id", "year") == [("1", 2024), ("2", 2025)]
    assert rows(spark.read.parquet(f"{out}/embeddings"), "model", "year", "paper_id") == [("m1", 2024, "1")]
    assert rows(spark.read.csv(f"{out}/preferences", header=True), "paper_id", "year") == [("a", "2024"), ("a", "2025"), ("b", "2024"), ("c", "unknown")]
    lines = spark.read.text(f"{out}/summaries").where("month = '2024-02'").collect()
    assert [json.loads(line["value"])["id"] for line in lines] == ["x", "x b"]
    assert spark.read.csv(f"{out}/latest", header=True).count() == 2 and not os.path.exists(f"{out}/_aside/x")
    got = report(run)
    for key, value in {
        ("metadata", "total", None): 2, ("metadata", "input_files", None): 2, ("metadata", "output_files", None): 2,
        ("embeddings", "m1/2024", None): 1, ("embeddings", "output_files", None): 1,
        ("preferences", "rows", None): 4, ("preferences", "skipped_rows", None): 1, ("preferences", "unique_ids", None): 3,
        ("preferences", "input_files", None): 3, ("preferences", "output_files", None): 3,
        ("summaries", "records", None): 2, ("summaries", "input_files", None): 3, ("summaries", "output_files", None): 1,
        ("validation", "metadata-2024", "ok"): 1, ("validation", "preferences-unknown", "ok"): 1,
        ("validation", "summaries-2024-02", "ok"): 2, ("validation", "embeddings-m1-2024", "ok"): 1,
        ("warnings", "embeddings-m1-2025", "no vector column"): 1, ("warnings", "embeddings-m2-2024", "no vector column"): 1,
        ("warnings", "bad.json", "records that are not JSON"): 1, ("warnings", "y.jsonl", "records that are not JSON"): 2,
        ("warnings", "metadata", "rows without abstract"): 1,
    }.items():
        assert got.get(key) == value, key
    stored = spark.read.json(f"{out}/migration-report")
    assert stored.count() == run.report.count()


def test_migrated_years_are_replaced_only_on_demand(spark, folder):
    inputs, out = legacy(spark, folder), f"{folder}/out"
    migrate_all(spark, inputs, out, "NOW")
    put(folder, "again/2024-03.csv", "id,preference\nz,like\n")
    put(folder, "again/2026-03.csv", "id,preference\nz,like\n")
    later = LegacyInputs(preferences=f"{folder}/again")
    run = migrate_all(spark, later, out, "NOW")
    assert run.published == ("preferences/year=2026",) and run.skipped == ("preferences/year=2024",)
    assert report(run)[("warnings", "preferences/year=2024", "exists already and was left as it is")] == 1
    found = spark.read.csv(f"{out}/preferences", header=True)
    assert rows(found.where("year = '2024'"), "paper_id") == [("a",), ("b",)] and found.count() == 5
    assert migrate_all(spark, later, out, "NOW", force=True).skipped == ()
    assert rows(spark.read.csv(f"{out}/preferences", header=True).where("year = '2024'"), "paper_id") == [("z",)]


def test_nothing_is_published_if_a_check_fails(spark, folder):
    inputs, out = legacy(spark, folder), f"{folder}/out"
    spark.createDataFrame([], WIDE).write.parquet(f"{folder}/wide/2023.parquet")
    with pytest.raises(ValueError, match="metadata-2023 validation failed: no rows produced"):
        migrate_all(spark, inputs, out, "NOW")
    assert partitions(spark, f"{out}/metadata", 1) == [] and not os.listdir(f"{out}/_aside")
    run = migrate_all(spark, inputs, out, "NOW", strict=False)
    assert report(run)[("validation", "metadata-2023", "warning: no rows produced")] == 0
    put(folder, "raw/z.json", json.dumps({"id": "z", "summary_time": "2020-01-01"}))
    with pytest.raises(ValueError, match="summaries-2020-01 validation failed: missing keys -> z: summary"):
        migrate_all(spark, LegacyInputs(summaries=inputs.summaries), f"{folder}/out2", "NOW")


def test_wide_years_without_vectors(spark, folder):
    row = ("1", "T", "A", ["c"], ["X"], "2024-01-01", "2024-02-01", None)
    spark.createDataFrame([row], WIDE).drop("m1").write.parquet(f"{folder}/wide/2024.parquet")
    run = migrate_all(spark, LegacyInputs(f"{folder}/wide"), f"{folder}/out", "NOW")
    assert run.published == ("metadata/year=2024",) and report(run)[("metadata", "2024", None)] == 1


def test_staging_counts_what_it_writes(spark, folder):
    df = spark.createDataFrame([(1, "x", 2024), (None, "y", 2024), (3, None, None)], "a int, `b c` string, year int")
    staged = stage(df, "t", f"{folder}/aside", f"{folder}/t", ["a", "b c", "d"], partition_by=["year"], sort_by=["a"])
    assert (staged.rows, staged.nulls, staged.missing) == (3, {"a": 1, "b c": 1}, ("d",))
    done, skipped = publish(spark, staged)
    assert done == ["year=2024", "year=__HIVE_DEFAULT_PARTITION__"] and skipped == []
    assert rows(spark.read.parquet(f"{folder}/t"), "a") == [(1,), (3,), (None,)]
    discard(spark, f"{folder}/aside")
    assert not os.path.exists(f"{folder}/aside")
    empty = stage(df.where("a > 5"), "e", f"{folder}/aside", f"{folder}/e", ["a"], partition_by=["year"])
    assert empty.rows == 0 and publish(spark, empty) == ([], [])


SOURCES = "paper_id string, title string, abstract string, language string, context string, score double, categories array<string>"


def sources(spark):
    items = [(f"p{i}", f"T{i}", "A.", "en", None if i == 2 else "First. Second.", None if i == 4 else i / 10, ["c"] if i else []) for i in range(5)]
    return spark.createDataFrame(items, SOURCES)


def test_a_summary_run_is_stored_once(spark, folder, monkeypatch):
    at = datetime(2025, 3, 4, 5, 6, 7)
    calls, inner = [], summarise_plan.summarise
    monkeypatch.setattr(summarise_plan, "summarise", lambda *a, **k: calls.append(1) or inner(*a, **k))
    for _ in range(2):
        manifest = summarise_run(sources(spark), StubModel, "m", "stub", folder, at).collect()
        assert [(r["run_id"], r["total_sources"], r["summarized"], r["skipped"], r["alias"]) for r in manifest] == [("20250304-050607", 5, 4, 1, "stub")]
    assert len(calls) == 1
    records = spark.read.json(f"{folder}/summaries")
    assert rows(records, "id", "month", "lang") == [(f"p{i}", "2025-03", "en") for i in (0, 1, 3, 4)]
    assert records.where("id = 'p0'").first()["source_file"] == "pages/run_id=20250304-050607/p0.md"
    summarise_run(sources(spark), StubModel, "m", "stub", folder, datetime(2025, 3, 5), limit=2)
    assert spark.read.json(f"{folder}/summaries").count() == 5  # the two best, of which p2 has no content
    assert rows(spark.read.parquet(f"{folder}/pages"), "paper_id").count(("p3",)) == 2


def test_a_summary_run_goes_on_where_it_ended(spark, folder, monkeypatch):
    at = datetime(2025, 3, 4)
    with monkeypatch.context() as patched:
        patched.setattr(summarise_plan, "summary_records", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            summarise_run(sources(spark), StubModel, "m", "stub", folder, at)
    monkeypatch.setattr(summarise_plan, "summarise", lambda *_: 1 / 0)  # the pages are there
    manifest = summarise_run(sources(spark), StubModel, "m", "stub", folder, at)
    assert rows(manifest, "summarized") == [(4,)] and spark.read.json(f"{folder}/summaries").count() == 4


def test_a_source_column_may_be_called_row(spark):
    done = summarise_plan.summarise(sources(spark).withColumn("_row", F.lit("mine")), StubModel, "m", "stub")
    assert set(rows(done, "_row")) == {("mine",)} and done.where("markdown IS NOT NULL").count() == 4


def test_a_ranking_run_is_stored_once(spark, folder):
    items = [(f"p{i}", ["cs.AI"], "2025-09-20", [float(i), 1.0], "like" if i < 3 else None) for i in range(8)]
    meta = spark.createDataFrame([(i, i, i, c, u) for i, c, u, *_ in items], "id string, title string, abstract string, categories array<string>, updated string")
    vectors = {"a": spark.createDataFrame([(p[0], p[3]) for p in items], "id string, a array<float>")}
    prefs = spark.createDataFrame([(p[0], p[4], "2025") for p in items if p[4]], "id string, preference string, recorded_at string")
    params = RecommendParams(categories=["cs.AI"], sample_rate=0.5, last_n_days=30, now=datetime(2025, 10, 1))
    args = (meta, vectors, prefs, None, params, f"{folder}/runs", datetime(2025, 10, 1, 2, 3, 4), {"metadata": "m.csv"})
    first = recommend_run(*args).collect()
    assert recommend_run(*args).collect() == first
    row = first[0]
    assert (row["run_id"], row["preferred"], row["background"], row["scored"]) == ("20251001-020304", 3, 5, 5)
    assert json.loads(row["data_sources"]) == {"categories": ["cs.AI"], "vectors": ["a"], "metadata": "m.csv"}
    assert json.loads(row["thresholds"])["high"] == 0.8
    run = f"{folder}/runs/run_id=20251001-020304"
    assert sorted(n for n in os.listdir(run) if not n.startswith((".", "_"))) == ["manifest.parquet", "predictions.parquet", "recommended.parquet"]
    assert spark.read.parquet(f"{run}/recommended.parquet").count() == row["recommended"]
