"""Readers on small files."""

import json
import os
from datetime import datetime

import pytest
from conftest import rows

from feedloom.operators.feedback import label_paged_threads
from feedloom.operators.summaries import normalise_summaries
from feedloom.plans.feedback import sync_feedback, update_preferences
from feedloom.plans.ingest import harvest, read_metadata_table, upsert_metadata
from feedloom.plans.migrate import migrate_preferences, migrate_summaries, migrate_wide
from feedloom.sources import readers
from feedloom.streaming.jobs import file_stream
from feedloom.suite import feedback


def put(folder, name, content):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(content)
    return path


RECORD = """
<record><header{status}><identifier>oai:{id}</identifier></header>{body}</record>"""
BODY = """<metadata><arXiv xmlns="http://arxiv.org/OAI/arXiv/"><id>{id}</id><created>2023-01-01</created>
<updated>2023-01-02</updated><authors><author><keyname>Berg</keyname><forenames>Ida</forenames></author>
<author><keyname>Smith</keyname></author><author/></authors><title> A title
 in two lines </title><categories>cs.AI  cs.CL</categories><comments>10 pages</comments>
<journal-ref>J 1</journal-ref><license>{license}</license><abstract> Text </abstract></arXiv></metadata>"""


def page(*records):
    return (
        '<?xml version="1.0"?><OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords>'
        + "".join(records)
        + "<resumptionToken>x</resumptionToken></ListRecords></OAI-PMH>"
    )


def record(id_, status="", body=None, license_=""):
    return RECORD.format(id=id_, status=status, body=BODY.format(id=id_, license=license_) if body is None else body)


def test_harvest_records(spark, folder):
    put(folder, "a/1.xml", page(record("2302.11801", license_=" L "), record("2302.11802", ' status="deleted"')))
    put(folder, "a/2.xml", page(record("2302.11803"), record("2302.11804", body="")))
    got = harvest(spark, [f"{folder}/a", f"{folder}/missing"])
    assert rows(got, "paper_id", "license") == [("2302.11801", "L"), ("2302.11803", "")]
    first = got.where("paper_id = '2302.11801'").first()
    assert first["categories"] == "cs.AI;cs.CL" and first["primary_category"] == "cs.AI"
    assert first["authors"] == "Ida Berg;Smith" and first["title"] == "A title\n in two lines"
    assert first["comment"] == "10 pages" and first["journal_ref"] == "J 1" and first["doi"] == ""
    assert harvest(spark, [f"{folder}/a"], limit=1).count() == 1
    upsert_metadata(got, f"{folder}/table")
    assert rows(read_metadata_table(spark, f"{folder}/table"), "paper_id", "year") == [("2302.11801", 2023), ("2302.11803", 2023)]


def test_license_attribute(spark, folder):
    body = BODY.format(id="1", license="").replace("<license></license>", '<license uri="http://l"/>')
    put(folder, "a/1.xml", page(record("1", body=body)))
    assert harvest(spark, [f"{folder}/a"]).first()["license"] == "http://l"


def test_csv_metadata_keeps_ids_and_line_breaks(spark, folder):
    header = ",".join(readers.schemas.METADATA_COLUMNS)
    row = '2301.00010,"A ""quoted"" title","line one\nline two",cs.AI; cs.LG,,,,2024-01-01,,,,,\n'
    put(folder, "metadata-2023.csv", header + "\n" + row)
    df = readers.metadata_view(readers.read_metadata(spark, f"{folder}/metadata-*.csv"))
    got = df.first()
    assert (got.id, got.title, got.abstract) == ("2301.00010", 'A "quoted" title', "line one\nline two")
    assert got.categories == ["cs.AI", "cs.LG"] and got.updated == "2024-01-01"


def test_preferences_with_either_key(spark, folder):
    put(folder, "a.csv", "id,preference\n2301.00010,like\n")
    put(folder, "sub/b.csv", "extra,paper_id,preference,recorded_at\n9,p2,dislike,2024\n")
    got = readers.read_preferences(spark, folder)
    assert rows(got) == [("2301.00010", "like", None), ("p2", "dislike", "2024")]


@pytest.mark.parametrize("content", ["", "name,preference\nx,like\n", "id,other\nx,y\n"])
def test_unusable_preferences(spark, folder, content):
    put(folder, "good.csv", "id,preference\np,like\n")
    put(folder, "bad.csv", content)
    with pytest.raises(ValueError):
        readers.read_preferences(spark, folder)


def test_no_preferences(spark, folder):
    put(folder, "x.txt", "")
    with pytest.raises(ValueError):
        readers.read_preferences(spark, folder)
    with pytest.raises(ValueError):
        readers.preference_view(spark.range(1))


def test_summary_ids_skip_bad_lines(spark, folder):
    put(folder, "2024-01.jsonl", '{"id": "a", "x": 1}\nnot json\n{"y": 2}\n')
    assert rows(readers.read_summary_ids(spark, f"{folder}/*.jsonl")) == [("a",)]


def test_shortlists(spark, folder):
    path = put(folder, "r.jsonl", json.dumps({"id": "", "paper_id": "2301.00010", "categories": " a; ;b", "score": 0.5}) + "\n"
               + json.dumps({"title": "no id"}) + "\n")
    got = readers.load_shortlist(spark, path)
    assert rows(got) == [("2301.00010", "", "", ["a", "b"], 0.5)]
    mixed = put(folder, "m.ndjson", "\n".join(json.dumps(r) for r in (
        {"id": "a", "score": "0.9", "categories": ["x", "y"]}, {"id": "b", "score": 1}, {"id": "c", "score": 0.25}, {"id": 7})))
    assert rows(readers.load_shortlist(spark, mixed), "paper_id", "categories", "score") == [
        ("7", None, None), ("a", ["x", "y"], None), ("b", None, 1.0), ("c", None, 0.25)
    ]
    assert rows(readers.load_shortlist(spark, mixed, limit=2), "paper_id") == [("b",), ("c",)]
    table = spark.createDataFrame([("x", "high", ["c"])], "id string, score string, categories array<string>")
    table.write.parquet(f"{folder}/r.parquet")
    assert rows(readers.load_shortlist(spark, f"{folder}/r.parquet", limit=5)) == [("x", "", "", ["c"], None)]
    with pytest.raises(ValueError):
        readers.load_shortlist(spark, f"{folder}/r.txt")


def test_line_numbers_across_read_blocks(spark, folder):
    content = "".join(f"line {n}\n" if n % 7 else "\n" for n in range(1, 4001))
    put(folder, "a.txt", content)
    put(folder, "b.txt", "only\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = readers.with_line_numbers(spark.read.text(folder))
        assert lines.select("path").distinct().count() == 2
        wrong = lines.where("path LIKE '%a.txt' AND value <> '' AND value <> 'line ' || line")
        assert lines.count() == 4001 and wrong.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_year_files_and_ids(spark, folder):
    spark.range(2).write.parquet(f"{folder}/2023.parquet")
    spark.range(3).write.parquet(f"{folder}/2024.parquet")
    got = readers.read_year_files(spark, folder).groupBy("year").count()
    assert rows(got) == [("2023", 2), ("2024", 3)]
    assert readers.read_year_files(spark, folder, [2024]).count() == 3


THREADS = {"data": {"repository": {"discussions": {"nodes": [
    {"id": "1", "title": "Reading group: arXiv:2406.07731", "updatedAt": "2024-01-01", "url": "u", "number": 1,
     "reactions": {"nodes": [{"content": "THUMBS_UP", "user": {"login": "a"}}, {"content": "THUMBS_UP", "user": None}]}},
    {"id": "2", "title": "Rules of this forum", "updatedAt": "2024-01-01", "url": "u", "number": 2, "reactions": {"nodes": []}},
    {"id": "3", "title": "arXiv:1.1", "updatedAt": "2024-01-01", "url": "u", "number": 3,
     "reactions": {"nodes": [{"content": "THUMBS_UP"}, {"content": "THUMBS_DOWN"}]}},
    {"id": "4", "title": "arXiv:1.2", "updatedAt": "2024-01-01", "url": "u", "number": 4, "reactions": {"nodes": []}},
]}}}}


def test_feedback(spark, folder):
    path = put(folder, "threads.json", json.dumps(THREADS))
    existing = spark.createDataFrame([("2406.07731", "neutral"), ("9.9", "like")], "arxiv_id string, preference string")
    labels, updated = update_preferences(spark, path, existing)
    assert rows(labels, "arxiv_id", "preference", "discussion_id") == [
        ("1.1", "dislike", 3), ("1.2", "neutral", 4), ("2406.07731", "like", 1)
    ]
    assert rows(updated) == [("2406.07731", "like"), ("9.9", "like")]
    _, upserted = update_preferences(spark, path, existing, insert_new=True)
    assert upserted.count() == 4
    assert update_preferences(spark, path, None)[1].count() == 3


def test_feedback_is_stored(spark, folder):
    path, at = put(folder, "threads.json", json.dumps(THREADS)), datetime(2024, 5, 6, 7, 8, 9)
    labels, preferences = sync_feedback(spark, path, f"{folder}/out", at)
    want = [("1.1", "dislike"), ("1.2", "neutral"), ("2406.07731", "like")]
    assert rows(labels, "arxiv_id", "preference") == want and rows(preferences, "arxiv_id", "preference") == want
    changed = json.loads(json.dumps(THREADS))
    changed["data"]["repository"]["discussions"]["nodes"][0]["reactions"]["nodes"] = []
    changed["data"]["repository"]["discussions"]["nodes"][3]["title"] = "arXiv:7.7"
    put(folder, "threads.json", json.dumps(changed))
    for _ in range(2):
        _, preferences = sync_feedback(spark, path, f"{folder}/out", datetime(2024, 5, 7))
        assert rows(preferences, "arxiv_id", "preference") == [("1.1", "dislike"), ("1.2", "neutral"), ("2406.07731", "neutral")]
    _, preferences = sync_feedback(spark, path, f"{folder}/out", datetime(2024, 5, 8), insert_new=True)
    assert preferences.count() == 4 and len(os.listdir(f"{folder}/out/feedback")) == 3
    assert sync_feedback(spark, path, f"{folder}/out", datetime(2024, 6, 1))[1].count() == 3


def test_threads_in_pages(spark):
    kind = "title string, number int, reactions array<struct<content:string>>, updated_at string, url string"
    pages = [("arXiv:1.1", 1, [("THUMBS_DOWN",)], "1", "u"), ("arXiv:1.1", 1, [("THUMBS_UP",), ("THUMBS_UP",)], "2", "u"),
             ("arXiv:1.1", 2, [], "3", "u"), ("none", 3, [("THUMBS_UP",)], "3", "u")]
    got = label_paged_threads(spark.createDataFrame(pages, kind))
    assert rows(got, "discussion_id", "preference", "updated_at") == [(1, "like", "2"), (2, "neutral", "3")]


def test_replies_are_as_many_as_their_reactions_need(spark, folder, monkeypatch):
    kinds = {0: "click", 1: "error", 2: "view"}
    events = [(20_000 * i, datetime(2024, 1, 1), 700 * (i % 20), kinds[i % 20 % 3]) for i in range(60)]
    events = spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string")
    events.write.parquet(f"{folder}/events.parquet")
    labels = {0: "like", 1: "dislike", 2: "neutral"}
    want = sorted((f"{700 * i}.{700 * i}", 700 * i, labels[i % 3]) for i in range(20))
    found = feedback.read_thread_replies(spark, folder)
    assert rows(found) == want and len(found.inputFiles()) == 1
    # Small replies: several files, each a whole document, and threads with pages in more than one.
    monkeypatch.setattr(feedback, "REPLY", 10)
    found = feedback.read_thread_replies(spark, folder)
    files = found.inputFiles()
    assert rows(found) == want and 3 <= len(files) <= 7
    assert all(len(open(f.removeprefix("file://")).readlines()) == 1 for f in files)


def test_summary_migration(spark, folder):
    put(folder, "raw/2024/memo-111.json", json.dumps({"id": "memo-111", "summary": "S1", "summary_time": "2024-02-03T08:00:00Z"}))
    put(folder, "raw/2024/memo-112.json", "{broken")
    put(folder, "raw/2024/memo-114.json", json.dumps({"zeta": [1, {"a": 2.5}], "summary": "é\n\"q\"", "updated": "2024-03-01"}))
    put(folder, "summarized/memo-113.jsonl", json.dumps({"id": "memo-113", "summary": "S3", "summary_time": "2024-02-10T09:00:00Z"})
        + "\n\nbad line\n" + json.dumps({"summary": "no id"}) + "\n" + json.dumps({"id": "memo-111", "summary": "newer", "summary_time": "2024-02-04"}) + "\n")
    records = readers.read_summaries(spark, [(f"{folder}/raw", "raw"), (f"{folder}/summarized", "action")])
    assert records.where("payload IS NULL").count() == 2
    merged = normalise_summaries(records, "NOW")
    assert rows(merged, "id", "month") == [
        ("memo-111", "2024-02"), ("memo-113", "2024-02"), ("memo-113-4", "unknown"), ("memo-114", "2024-03")
    ]
    got = {r.id: r.json for r in merged.collect()}
    first = json.loads(got["memo-111"])
    assert list(first) == ["id", "summary", "summary_time", "migrated_at", "source", "source_file"]
    assert first["summary"] == "newer" and first["source"] == "action" and first["migrated_at"] == "NOW"
    irregular = json.loads(got["memo-114"])
    assert list(irregular)[-1] == "zeta" and irregular["zeta"] == [1, {"a": 2.5}] and irregular["summary"] == "é\n\"q\""
    assert irregular["summary_time"] == "2024-03-01T00:00:00" and json.loads(got["memo-113-4"])["summary_time"] == ""
    migrate_summaries(merged, f"{folder}/dry", dry_run=True)
    assert not os.path.exists(f"{folder}/dry")
    migrate_summaries(merged, f"{folder}/out")
    stored = spark.read.text(f"{folder}/out/summaries")
    assert stored.where("month = '2024-02'").count() == 2 and stored.count() == 4


def test_wide_migration(spark, folder):
    wide = spark.createDataFrame(
        [("1", "T", "A", ["cs.AI"], ["X"], "2024-01-01", "2024-02-01", [1.0, 2.0])],
        "id string, title string, abstract string, categories array<string>, authors array<string>, "
        "created string, updated string, m1 array<double>",
    )
    wide.write.parquet(f"{folder}/in/2024.parquet")
    read = readers.read_year_files(spark, f"{folder}/in")
    migrate_wide(read, f"{folder}/out", dry_run=True)
    assert not os.path.exists(f"{folder}/out")
    migrate_wide(read, f"{folder}/out", models=["m1", "m2"])
    assert rows(spark.read.parquet(f"{folder}/out/metadata"), "paper_id", "year") == [("1", 2024)]
    assert rows(spark.read.parquet(f"{folder}/out/embeddings"), "model", "year", "model_dim") == [("m1", 2024, 2)]
    latest = spark.read.csv(f"{folder}/out/latest", header=True)
    assert latest.columns == readers.schemas.METADATA_COLUMNS and latest.count() == 1


def test_preference_migration(spark, folder):
    put(folder, "p/2024-01.csv", "id,preference\nmemo-111,like\nmemo-112,skip\n,ignored\n")
    put(folder, "p/init.csv", "id,preference\nmemo-113,star\n")
    months = readers.read_preference_months(spark, f"{folder}/p")
    events = migrate_preferences(months, folder, "NOW")
    assert rows(events, "paper_id", "recorded_at", "year") == [
        ("memo-111", "2024-01-01T00:00:00+00:00", "2024"), ("memo-112", "2024-01-01T00:00:00+00:00", "2024"),
        ("memo-113", "NOW", "unknown"),
    ]
    stored = spark.read.csv(f"{folder}/preferences", header=True)
    assert sorted(stored.columns) == ["paper_id", "preference", "recorded_at", "year"] and stored.count() == 3
    # One month again: the year keeps its events unless it is to be replaced.
    migrate_preferences(months.where("paper_id = 'memo-112'"), folder, "NOW")
    assert spark.read.csv(f"{folder}/preferences", header=True).count() == 3
    migrate_preferences(months.where("paper_id = 'memo-112'"), folder, "NOW", force=True)
    assert rows(spark.read.csv(f"{folder}/preferences", header=True), "paper_id") == [("memo-112",), ("memo-113",)]


def test_file_stream_reads_harvest_pages(spark, folder):
    put(folder, "in/1.xml", page(record("1"), record("2", ' status="deleted"')))
    put(folder, "in/ignored.txt", "x")
    stream = readers.parse_harvest(
        file_stream(spark, f"{folder}/in", readers.schemas.HARVEST_DDL, "xml", "*.xml", rowTag="record", ignoreNamespace="true")
    )
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/c")
    job = writer.format("parquet").start(f"{folder}/out")
    job.awaitTermination()
    assert rows(spark.read.parquet(f"{folder}/out"), "paper_id") == [("1",)]
