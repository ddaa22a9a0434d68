"""Whole runs: ranking, embedding, summaries, streaming."""

import glob
import json
import os
import sys
import time
from dataclasses import replace
from datetime import datetime

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import rows
from pyspark import cloudpickle
from pyspark.sql import functions as F

from feedloom.operators import inference
from feedloom.operators.candidates import join_vectors, lookup_by_id, lookup_listed
from feedloom.operators.inference import HashingEmbedder, dimension_report, embed_texts, run_model
from feedloom.operators.ranking import fit_ranker, score, score_with_weights, training_set
from feedloom.operators.reports import run_manifest, summary_manifest
from feedloom.operators.summaries import (
    article_text, body_text, build_prompts, extract_content, parse_model_output, plain_markdown,
    render_markdown, reply_content, sections, split_extracted, stub_summary, summary_records,
)
from feedloom.plans.embed import embed_missing, pending_inputs
from feedloom.plans.recommend import RecommendParams, candidates, recommend
from feedloom.plans.ingest import read_metadata_table
from feedloom.plans.summarise import StubModel, summarise
from feedloom.sources.versions import Versions, newest, stored_rows
from feedloom.sources.writers import save_bucketed, write_run, write_vectors
from feedloom.streaming import jobs
from feedloom.streaming.jobs import (
    feedback_state, latest_state, preference_windows, rejected_ids, stream_backlog, stream_feedback, stream_job_metrics,
    stream_preference_counts, stream_upsert,
)
from feedloom.suite import QUERIES

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers cannot import tests

PAPERS = [
    ("p1", ["cs.AI"], "2025-09-20", [2.0, 2.0], [2.1, 1.8], "like"),
    ("p2", ["cs.LG"], "2025-09-18", [1.9, 2.2], [1.8, 2.3], "like"),
    ("p3", ["cs.AI"], "2025-09-21", [1.5, 1.6], [1.4, 1.7], None),
    ("p4", ["cs.AI"], "2023-09-16", [0.4, 0.5], [0.4, 0.5], None),
    ("p5", ["math.ST"], "2025-09-22", [0.1, 0.2], [0.1, 0.2], None),
    ("p_nan", ["cs.AI"], "2025-09-22", [float("nan"), 0.0], [0.1, 0.2], None),
]
PARAMS = RecommendParams(
    categories=["cs.AI", "cs.LG"], start_year=2024, background_rate=2.0, sample_rate=0.5, high=0.8,
    boundary=0.6, last_n_days=30, now=datetime(2025, 10, 1),
)


@pytest.fixture
def feed(spark):
    meta = spark.createDataFrame(
        [(i, i, i, c, u) for i, c, u, *_ in PAPERS],
        "id string, title string, abstract string, categories array<string>, updated string",
    )
    a = spark.createDataFrame([(p[0], p[3]) for p in PAPERS], "id string, a array<float>")
    b = spark.createDataFrame([(p[0], p[4]) for p in PAPERS], "id string, b array<double>")
    prefs = spark.createDataFrame(
        [(p[0], p[5], "2025") for p in PAPERS if p[5]], "id string, preference string, recorded_at string"
    )
    return meta, {"a": a, "b": b}, prefs


def test_recommendation_run(spark, feed, folder):
    meta, vectors, prefs = feed
    run = recommend(meta, vectors, prefs, None, PARAMS)
    assert rows(run.preferred, "id") == [("p1",), ("p2",)]
    assert rows(run.background, "id") == [("p3",)]
    assert run.scored.count() == 1 and run.recommended.count() == 1 and run.rejected.count() == 0
    assert "a" not in run.recommended.columns and "a" in run.scored.columns
    counts = dict(rows(run_manifest(run.preferred, run.background, run.scored, run.recommended)))
    assert counts == {"preferred": 2, "background": 1, "scored": 1, "recommended": 1}
    write_run(run.scored, run.recommended, folder, "r1")
    assert spark.read.parquet(f"{folder}/run_id=r1/recommended.parquet").count() == 1


def test_vectors_of_another_length_are_set_aside(spark, feed):
    meta, vectors, prefs = feed
    odd = spark.createDataFrame([("p6", "p6", "p6", ["cs.AI"], "2025-09-22")], meta.schema)
    short = {m: df.union(spark.createDataFrame([("p6", [1.0])], df.schema)) for m, df in vectors.items()}
    with pytest.raises(ValueError, match="unequal"):
        recommend(meta.union(odd), short, prefs, None, PARAMS)
    run = recommend(meta.union(odd), short, prefs, None, replace(PARAMS, set_aside_unequal=True))
    assert rows(run.rejected, "id", "lengths") == [("p6", "1,1")] and rows(run.background, "id") == [("p3",)]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_bucketed_tables_join_without_shuffle(spark, feed, folder):
    meta, vectors, _ = feed
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = {**vectors, "meta": meta}
        assert exchanges(join_vectors(meta, vectors)) == 3
        for name, df in tables.items():
            save_bucketed(df, f"bucketed_{name}", "id", 4, f"{folder}/{name}")
        stored = {name: spark.table(f"bucketed_{name}") for name in tables}
        joined = join_vectors(stored.pop("meta"), stored)
        assert exchanges(joined) == 0 and joined.count() == 6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{name}")


def test_listed_ids_filter_the_scan(spark, folder):
    df = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.array(F.col("id").cast("float")).alias("v"))
    save_bucketed(df, "bucketed_lookup", "id", 16, f"{folder}/t")
    try:
        stored, ids = spark.table("bucketed_lookup"), spark.createDataFrame([("7",), ("7",), (None,), ("x",)], "id string")
        found = lookup_listed(stored, ["7", "x", None, "7"], "id")
        assert rows(found) == [("7", [7.0])]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "PushedFilters: [In(id, [7,x])]" in plan
        assert rows(lookup_by_id(stored, ids, "id")) == [("7", [7.0])]
        assert rows(lookup_listed(stored, [], "id")) == []
    finally:
        spark.sql("DROP TABLE IF EXISTS bucketed_lookup")


def test_stored_vectors_are_sorted_and_have_bloom_filters(spark, folder):
    items = [("m", "2024", f"p{i * 7919 % 5000:05d}", [float(i)], "t", 1, "s") for i in range(3000)]
    df = spark.createDataFrame(items, "model string, year string, paper_id string, embedding array<float>, generated_at string, model_dim int, source string")
    write_vectors(df.repartition(8), folder)
    files = glob.glob(f"{folder}/model=m/year=2024/*.parquet")
    for name in files:
        ids = pq.read_table(name, columns=["paper_id"]).column(0).to_pylist()
        assert ids == sorted(ids)
        # The filter's place in the file is not zero; ids of random order would be told apart by it alone.
        column = pq.ParquetFile(name).metadata.row_group(0).column(0)
        assert column.path_in_schema == "paper_id" and os.path.getsize(name) > column.total_compressed_size
    # A query for an absent id inside the range of every row group reads no row of them.
    spark.conf.set("spark.sql.parquet.filterPushdown", "true")
    found = lookup_listed(spark.read.parquet(folder), ["p00001x"])
    assert found.collect() == []
    metrics = found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    assert metrics.apply("numOutputRows").value() == 0
    assert lookup_listed(spark.read.parquet(folder), ["p00007"]).count() <= 1


def test_one_model_per_worker(spark, folder):
    before = glob.glob(f"{folder}/*")
    df = spark.range(200).select(F.col("id").cast("string").alias("text")).repartition(50)
    got = embed_texts(df, Recording(folder), batch_size=3, rebalance=False)
    assert got.count() == 200 and embed_texts(df, Recording(folder), rebalance=False).count() == 200
    made = [name for name in glob.glob(f"{folder}/*") if name not in before]
    workers = {name.rsplit("/", 1)[1].split("-")[0] for name in made}
    assert 1 <= len(made) == len(workers) <= 8  # 100 tasks


def test_models_make_room_for_each_other():
    closed = []

    class Model:
        def __init__(self, name):
            self.name = name

        def run(self, texts):
            return texts

        def close(self):
            closed.append(self.name)

    sys.modules.pop("_feedloom_backends", None)
    try:
        first = inference.worker_backend("a", lambda: Model("a"), 2)
        inference.worker_backend("b", lambda: Model("b"), 2)
        assert inference.worker_backend("a", lambda: Model("other"), 2) is first
        inference.worker_backend("c", lambda: Model("c"), 2)
        assert closed == ["b"]
    finally:
        sys.modules.pop("_feedloom_backends", None)


def test_candidates_shuffle_each_table_once(spark, feed):
    meta, vectors, _ = feed
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        known = spark.createDataFrame([("p3",)], "id string")
        assert exchanges(candidates(meta, vectors, known, PARAMS)) == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_known_ids_are_left_out(spark, feed):
    meta, vectors, prefs = feed
    known = spark.createDataFrame([("p3",)], "id string")
    assert rows(candidates(meta, vectors, known, PARAMS), "id") == [("p1",), ("p2",)]
    with pytest.raises(ValueError):
        recommend(meta, vectors, prefs, known, PARAMS)


def test_training_ignores_dislikes(spark):
    preferred = spark.createDataFrame([("a", "like"), ("b", "dislike"), ("c", "neutral")], "id string, preference string")
    rest = spark.range(10).select(F.col("id").cast("string").alias("id"), F.lit("unrated").alias("preference"))
    train = training_set(preferred, rest, 2.7, 1)
    assert rows(train.groupBy("label").count()) == [(0, 2), (1, 1)]
    assert training_set(preferred, rest, 0.1, 1).where("label = 0").count() == 1
    assert training_set(preferred, rest, 100.0, 1).where("label = 0").count() == 10
    with pytest.raises(ValueError):
        training_set(preferred.where("id <> 'a'"), rest, 1.0, 1)


def newton(x, y, C):
    """Independent solution of the same objective."""
    n, w = len(y), np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    X = np.hstack([x, np.ones((n, 1))])
    ridge = np.diag([1.0] * x.shape[1] + [0.0])
    beta = np.zeros(X.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-X @ beta))
        gradient = ridge @ beta + C * X.T @ (w * (p - y))
        beta -= np.linalg.solve(ridge + C * (X * (w * p * (1 - p))[:, None]).T @ X, gradient)
    return beta


def test_model_equals_an_independent_solver(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 5))
    y = (x[:, 0] + rng.normal(size=120) > 1).astype(int)
    df = spark.createDataFrame([(str(i), v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))],
                               "id string, features array<double>, label int")
    model = fit_ranker(df, C=0.7)
    beta = newton(x, y, 0.7)
    assert np.allclose(model.coefficients.toArray(), beta[:-1], atol=1e-4)
    assert model.intercept == pytest.approx(beta[-1], abs=1e-4)
    by_model = dict(rows(score(model, df), "id", "score"))
    by_weights = dict(rows(score_with_weights(df, list(model.coefficients), model.intercept), "id", "score"))
    assert all(by_model[i] == pytest.approx(by_weights[i], abs=1e-9) for i in by_model)


class Recording:
    """A factory whose models leave a file named by their process."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self):
        open(f"{self.folder}/{os.getpid()}-{time.time_ns()}", "w").close()
        return HashingEmbedder(4)


class Counting:
    """Reports the size of each batch it gets."""

    def run(self, texts):
        return [[float(len(texts)), float(len(t))] for t in texts]


def test_embedding_batches(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "yy"), ("c", None)], "id string, text string").coalesce(1)
    got = embed_texts(df, Counting, batch_size=2, rebalance=False)
    assert sorted(r.embedding[0] for r in got.collect()) == [1.0, 2.0, 2.0]
    assert embed_texts(df.where("false"), Counting).count() == 0
    assert rows(dimension_report(got, 3)) == [(2, 3, True)]
    with pytest.raises(ValueError):
        embed_texts(df, Counting, batch_size=0)


def test_hashing_embedder_is_deterministic(spark):
    texts = ["A b a", "a B A", "", "other words"]
    one = HashingEmbedder(16).run(texts)
    two = [HashingEmbedder(16).run([t])[0] for t in texts]
    assert all(np.array_equal(p, q) for p, q in zip(one, two)) and np.array_equal(one[0], one[1])
    assert np.linalg.norm(one[0]) == pytest.approx(1) and not one[2].any() and one[0].dtype == np.float32
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.embedding for r in embed_texts(df, batch_size=3).collect()}
    assert got["other words"] == pytest.approx(HashingEmbedder(64).run(["other words"])[0].tolist())


def test_backend_registry():
    inference.register_backend("counting", Counting)
    assert inference.get_backend("counting") is Counting and "hashing" in inference.list_backends()
    with pytest.raises(KeyError):
        inference.get_backend("absent")


def test_embed_missing(spark, folder):
    meta = spark.createDataFrame(
        [("2401.00001", "Title", "Abstract"), ("2401.00002", "Another", "Summary"), ("2301.00003", "T", "S")],
        "paper_id string, title string, abstract string",
    )
    embed_missing(meta, folder, "m", Counting, "t1", limit=1)
    assert rows(spark.read.parquet(folder), "paper_id") == [("2301.00003",)]
    embed_missing(meta, folder, "m", Counting, "t2")
    assert pending_inputs(meta, folder, "m").count() == 0 and pending_inputs(meta, folder, "other").count() == 3
    embed_missing(meta, folder, "m", Counting, "t3")
    stored = spark.read.parquet(folder)
    assert rows(stored, "paper_id", "generated_at", "model_dim") == [
        ("2301.00003", "t1", 2), ("2401.00001", "t2", 2), ("2401.00002", "t2", 2)
    ]
    embed_missing(meta.where("paper_id LIKE '24%'"), folder, "m", Counting, "t4", overwrite=True)
    assert rows(spark.read.parquet(folder), "generated_at") == [("t1",), ("t4",), ("t4",)]


class Failing:
    def run(self, texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no answer")
        return [t.upper() for t in texts]


def test_a_failing_call_keeps_to_its_row(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "bad"), ("c", "y")], "id string, prompt string")
    assert rows(run_model(df.coalesce(1), Failing)) == [
        ("a", "X", None), ("b", None, "RuntimeError: no answer"), ("c", "Y", None)
    ]


def source(spark, **changes):
    base = {"paper_id": "p", "title": "T", "abstract": " One. Two. Three. ", "language": "en", "context": None, "score": 0.99}
    schema = "paper_id string, title string, abstract string, language string, context string, score double"
    return spark.createDataFrame([tuple({**base, **changes}.values())], schema)


def test_stub_summary(spark):
    got = stub_summary(source(spark), "m", "a").first()
    assert got.highlights == "One.\nTwo." and "Key observations:\n- One.\n- Two.\n\nFull abstract:\nOne. Two. Three." in got.detail
    got = stub_summary(source(spark, abstract=" ", context="c$ " + "x" * 3000), "m", "a").first()
    assert "No abstract provided." in got.detail and "$" not in got.detail
    assert got.detail.endswith("Context excerpt:\nc " + "x" * 1997)
    assert "$" in stub_summary(source(spark, context="c$"), allow_latex=True).first().detail


def test_prompts(spark):
    got = build_prompts(source(spark, context=" body ")).first()
    assert got.user == "Language: en\nPaper ID: p\nTitle: T\nAbstract: One. Two. Three.\nPaper Content:\nbody"
    assert got.system.endswith("prefer plain text.") and [m.role for m in got.messages] == ["system", "user"]
    assert "Paper Content" not in build_prompts(source(spark)).first().user


@pytest.mark.parametrize(
    "raw, highlights, body",
    [
        ('{"highlights": [" a ", "", 3], "summary": " S "}', "a\n3", "S"),
        ('{"highlights": "a\\n\\n b", "detailed_summary": "D"}', "a\nb", "D"),
        ('{"highlights": [], "summary": "", "full_summary": " ", "content": "C"}', None, "C"),
        ('{"text": "X. Y. Z. W."}', None, "X. Y. Z. W."),
        ("One. Two. Three. Four.", "One.\nTwo.\nThree.", "One. Two. Three. Four."),
        ("...", "No highlights available.", "..."),
        ("[1, 2]", "[1, 2].", "[1, 2]"),
    ],
)
def test_model_output(spark, raw, highlights, body):
    df = spark.createDataFrame([(raw, "en")], "output string, language string")
    got = parse_model_output(df, "m", "a").first()
    if highlights is not None:
        assert got.highlights == highlights
    assert got.detail == f"This summary was generated by m (alias a).\nDetected language: en.\n\n{body}"


def test_reply_content(spark):
    def reply(content):
        return json.dumps({"choices": [{"message": {"content": content}}]})

    values = [reply(" a "), reply([" a ", "", "b"]), reply(None), '{"choices": []}', "junk"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    assert [r[0] for r in df.orderBy("i").select(reply_content(F.col("v"))).collect()] == ["a", "a\nb", "", "", ""]


def test_rendering(spark):
    df = source(spark).withColumns(
        {"authors": F.lit("A"), "updated_at": F.lit("2024"), "draft": F.lit(True),
         "sections": sections(("Highlights", F.lit(" h ")), ("Method", F.lit("m")))}
    )
    assert render_markdown(df).first().markdown == (
        '---\ntitle: "T"\ndate: 2024\ndraft: true\n---\n\n# T\n**Paper ID:** p\n**Language:** en\n**Authors:** A\n'
        "**Abstract:**  One. Two. Three. \n\n## Highlights\n\nh\n\n## Method\n\nm\n\n\n"
        "[Read full paper](https://arxiv.org/abs/p)\n"
    )
    assert plain_markdown(df).first().markdown == (
        "# T\n\n**Paper ID:** p\n\n**Language:** en\n\n## Highlights\n\nh\n\n## Method\n\nm"
    )


def test_records_leave_absent_keys_out(spark):
    df = source(spark, score=None, language="").withColumns(
        {"markdown": F.lit("# T"), "categories": F.array().cast("array<string>")}
    )
    got = summary_records(df, F.lit("2024-03-05T00:00:00+00:00"), "s", "pages").drop("month")
    record = json.loads(got.select(F.to_json(F.struct("*"))).first()[0])
    assert list(record) == ["id", "title", "abstract", "summary", "summary_time", "migrated_at", "source", "source_file"]


def test_extraction_order(spark):
    pages = ["<body><article>A <b>x</b></article> rest</body>", "<body>B &amp;lt; &lt;b&gt;&nbsp;&#39;q&#39;<script>no</script><!-- c --></body>", "<p>none</p>", None,
             "<body>C<article> </article></body>"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    chain = [("article", article_text(F.col("html"))), ("body", body_text(F.col("html")))]
    ok, rejected = split_extracted(extract_content(df, chain))
    assert rows(ok, "i", "content", "origin") == [(0, "A x", "article"), (1, "B &lt; <b> 'q'", "body"), (4, "C", "body")]
    assert rows(rejected, "i", "reason") == [(2, "no text in article or body"), (3, "no text in article or body")]


class Silent:
    def run(self, texts):
        return [" " for _ in texts]


def test_summarise_run(spark):
    both = source(spark, context="Body text. More.").union(source(spark, paper_id="q"))
    done = summarise(both, StubModel, "m", "a")
    assert rows(summary_manifest(done, "markdown")) == [(2, 1, 1)]
    got = {r.paper_id: r for r in done.collect()}
    assert "# T" in got["p"].markdown and "## Highlights" in got["p"].markdown and got["p"].error is None
    assert got["q"].markdown is None and got["q"].error == "no content"
    failed = summarise(both, Failing, "m", "a").where("paper_id = 'p'").first()
    assert failed.error is None and failed.markdown
    twice = summarise(both.union(both), StubModel, "m", "a")
    assert rows(twice.groupBy("paper_id").count()) == [("p", 2), ("q", 2)]
    silent = summarise(both, Silent, "m", "a").where("paper_id = 'p'").first()
    assert silent.markdown is None and silent.error == "empty reply"
    bad = summarise(source(spark, context="bad"), Failing, "m", "a").first()
    assert bad.markdown is None and bad.error == "RuntimeError: no answer"


def test_full_run(spark):
    """Three papers, one liked: the others are all recommended, then summarised."""
    ids = ["a", "b", "c"]
    meta = spark.createDataFrame([(i, f"Title {i}", "Text. More.", ["cs"], "2025-09-01") for i in ids],
                                 "id string, title string, abstract string, categories array<string>, updated string")
    vectors = {m: spark.createDataFrame([(i, [float(n), 1.0, k]) for n, i in enumerate(ids)], f"id string, {m} array<float>")
               for m, k in (("m1", 0.5), ("m2", 0.1))}
    prefs = spark.createDataFrame([("a", "like", "1")], "id string, preference string, recorded_at string")
    run = recommend(meta, vectors, prefs, None, RecommendParams(include_all=True, last_n_days=60, now=datetime(2025, 10, 1)))
    assert rows(run.recommended, "id") == [("b",), ("c",)]
    sources = run.recommended.select(
        F.col("id").alias("paper_id"), "title", "abstract", F.lit("en").alias("language"), F.col("abstract").alias("context"), "score"
    )
    pages = summarise(sources, StubModel, "m", "a").collect()
    assert len(pages) == 2 and all(f"Title {p.paper_id}" in p.markdown and "Highlights" in p.markdown for p in pages)


def landing(spark, folder, name, df):
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    return lambda: spark.readStream.schema(df.schema).parquet(f"{folder}/{name}")


def test_streamed_metrics_follow_new_runs(spark, folder):
    schema = "job string, status string, error string, start_time int, end_time int, duration double, seq int"
    first = spark.createDataFrame([("j", "success", None, 1, 2, 1.0, 1), ("k", "failure", "e", 1, 2, 1.0, 2)], schema)
    stream = landing(spark, folder, "runs", first)
    stream_job_metrics(stream(), f"{folder}/out", f"{folder}/c").awaitTermination()
    landing(spark, folder, "runs", spark.createDataFrame([("j", "failure", "boom", 3, 4, 1.0, 3)], schema))
    stream_job_metrics(stream(), f"{folder}/out", f"{folder}/c").awaitTermination()
    got = rows(latest_state(spark, f"{folder}/out", "job"), "job", "total_runs", "last_error")
    assert got == [("j", 2, "boom"), ("k", 1, "e")]
    table = Versions(f"{folder}/out", newest(["job"]))
    assert stored_rows(spark, table).where("_batch = 1").count() == 1


def test_streamed_upsert_can_be_replayed(spark, folder):
    schema = "paper_id string, published_at string, updated_at string, title string"
    stream = landing(spark, folder, "in", spark.createDataFrame([("a", "2023-01-01", "1", "old"), ("b", "2024-01-01", "1", "x")], schema))
    landing(spark, folder, "in", spark.createDataFrame([("a", "2023-01-01", "2", "new")], schema))
    for checkpoint in ("c1", "c2"):
        stream_upsert(stream(), f"{folder}/out", f"{folder}/{checkpoint}").awaitTermination()
        assert rows(read_metadata_table(spark, f"{folder}/out"), "paper_id", "title") == [("a", "new"), ("b", "x")]


def test_streamed_backlog_adds_only_missing_vectors(spark, folder):
    schema = "paper_id string, title string, abstract string"
    stream = landing(spark, folder, "in", spark.createDataFrame([("2401.00001", "T", "A")], schema))
    stream_backlog(stream(), f"{folder}/out", f"{folder}/c", "m", Counting, "t1").awaitTermination()
    landing(spark, folder, "in", spark.createDataFrame([("2401.00001", "T", "A"), ("2401.00002", "T", "A")], schema))
    stream_backlog(stream(), f"{folder}/out", f"{folder}/c", "m", Counting, "t2").awaitTermination()
    stream_backlog(stream(), f"{folder}/out", f"{folder}/again", "m", Counting, "t3").awaitTermination()
    assert rows(spark.read.parquet(f"{folder}/out"), "paper_id", "generated_at") == [("2401.00001", "t1"), ("2401.00002", "t2")]


def test_a_bad_id_does_not_stop_the_backlog(spark, folder):
    schema = "paper_id string, title string, abstract string"
    stream = landing(spark, folder, "in", spark.createDataFrame([("2401.00001", "T", "A"), ("nobody knows", "T", "A")], schema))
    stream_backlog(stream(), f"{folder}/out", f"{folder}/c", "m", Counting, "t1").awaitTermination()
    landing(spark, folder, "in", spark.createDataFrame([("nobody knows", "T", "A"), ("", "T", "A"), ("x", "T", "A"), ("2402.00001", "T", "A")], schema))
    stream_backlog(stream(), f"{folder}/out", f"{folder}/c", "m", Counting, "t2").awaitTermination()
    assert rows(spark.read.parquet(f"{folder}/out"), "paper_id") == [("2401.00001",), ("2402.00001",)]
    assert rows(rejected_ids(spark, f"{folder}/out", "m")) == [("nobody knows",), ("x",)]


def test_streams_of_tables_that_are_folders(spark, folder):
    documents = [(i, f"text {i}", "en", "web", 6) for i in range(20)]
    documents = spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long")
    documents.repartition(3).write.parquet(f"{folder}/documents.parquet")
    vectors = spark.createDataFrame([(i, [0.5] * 64, 0) for i in (1, 2)], "vec_id long, embedding array<float>, label int")
    vectors.repartition(2).write.parquet(f"{folder}/embeddings.parquet")
    got = QUERIES["stream_backlog_of_bad_ids"](spark, folder)
    assert rows(got.where("place = 'rejected'"), "paper_id") == [("no year 13",), ("no year 4",)]
    assert got.where("place = 'stored'").distinct().count() == 18 and got.count() == 20
    added = QUERIES["stream_backlog"](spark, folder).groupBy("source").count()
    assert rows(added, "source", "count") == [("embedding", 18), ("stored", 2)]


def test_streamed_feedback_counts_an_event_once(spark, folder):
    items = [("t", "THUMBS_UP", "2024-01-01 00:00:00", 1), ("t", "THUMBS_UP", "2024-01-01 00:00:00", 1),
             ("t", "THUMBS_DOWN", "2024-01-01 01:00:00", 2), ("s", "THUMBS_UP", "2024-01-01 01:00:00", 3)]
    df = spark.createDataFrame(items, "thread string, content string, updated_at string, event_id int")
    df = df.withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    stream = landing(spark, folder, "in", df)
    stream_feedback(stream(), f"{folder}/out", f"{folder}/c").awaitTermination()
    landing(spark, folder, "in", df)
    stream_feedback(stream(), f"{folder}/out", f"{folder}/c").awaitTermination()
    got = rows(feedback_state(spark, f"{folder}/out"), "thread", "likes", "dislikes", "preference")
    assert got == [("s", 1, 0, "like"), ("t", 1, 1, "dislike")]


def test_late_feedback_counts_without_state(spark, folder):
    def reactions(*items):
        df = spark.createDataFrame(list(items), "thread string, content string, updated_at string, event_id int")
        return df.withColumn("updated_at", F.col("updated_at").cast("timestamp"))

    stream = landing(spark, folder, "in", reactions(("t", "THUMBS_UP", "2024-01-01 00:00:00", 1), ("t", "EYES", "2024-03-01 00:00:00", 2)))
    stream_feedback(stream(), f"{folder}/out", f"{folder}/c").awaitTermination()
    # Months late: one that counted, one that did not, one without a time, and two without an id.
    landing(spark, folder, "in", reactions(
        ("t", "THUMBS_UP", "2024-01-01 00:00:00", 1), ("t", "THUMBS_UP", "2024-01-01 00:00:00", 3), ("t", "THUMBS_UP", None, 4),
        ("s", "THUMBS_DOWN", "2024-01-01 00:00:00", None), ("s", "THUMBS_DOWN", "2024-01-01 00:00:00", None)))
    for _ in range(2):
        query = stream_feedback(stream(), f"{folder}/out", f"{folder}/c")
        query.awaitTermination()
        assert all(not progress["stateOperators"] for progress in query.recentProgress)
        landing(spark, folder, "in", reactions(("t", "THUMBS_UP", None, 4)))
    got = rows(feedback_state(spark, f"{folder}/out"), "thread", "likes", "dislikes", "preference")
    assert got == [("s", 0, 2, "dislike"), ("t", 3, 0, "like")]


def test_streamed_feedback_survives_a_batch_that_got_halfway(spark, folder, monkeypatch):
    df = spark.createDataFrame([("t", "THUMBS_UP", "2024-01-01", 1), ("t", "THUMBS_UP", "2024-01-02", 2)], "thread string, content string, updated_at string, event_id int")
    stream = landing(spark, folder, "in", df.withColumn("updated_at", F.col("updated_at").cast("timestamp")))
    write, calls = jobs.append_version, []

    def fails_once(rows, table, batch):
        calls.append(table.path)
        if len(calls) == 2:
            raise OSError("lost between events and counts")
        return write(rows, table, batch)

    monkeypatch.setattr(jobs, "append_version", fails_once)
    with pytest.raises(Exception, match="lost"):
        stream_feedback(stream(), f"{folder}/out", f"{folder}/c").awaitTermination()
    stream_feedback(stream(), f"{folder}/out", f"{folder}/c").awaitTermination()
    assert len(calls) == 4 and rows(feedback_state(spark, f"{folder}/out"), "thread", "likes") == [("t", 2)]


def test_late_events_are_counted_apart(spark, folder):
    def events(*items):
        df = spark.createDataFrame(list(items), "recorded_at string, preference string")
        return df.withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))

    stream = landing(spark, folder, "in", events(("2024-01-01 10:00:00", "like"), ("2024-01-09 00:00:00", "like")))
    stream_preference_counts(stream(), f"{folder}/out", f"{folder}/c").awaitTermination()
    landing(spark, folder, "in", events(("2024-01-01 11:00:00", "like"), ("2024-01-08 00:00:00", "like"), ("2024-01-09 01:00:00", "like")))
    stream_preference_counts(stream(), f"{folder}/out", f"{folder}/c").awaitTermination()
    in_time, late = preference_windows(spark, f"{folder}/out")
    assert rows(in_time, "window_start", "n") == [("2024-01-01 00:00:00", 1), ("2024-01-08 00:00:00", 1), ("2024-01-09 00:00:00", 2)]
    assert rows(late, "window_start", "n") == [("2024-01-01 00:00:00", 1)]
    with pytest.raises(Exception, match="another checkpoint"):
        stream_preference_counts(stream(), f"{folder}/out", f"{folder}/c2").awaitTermination()
