"""Summaries of a shortlist: content, model call, parsing, rendering, records."""

import json
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.inference import BackendFactory, run_model
from ..operators.candidates import limit_ordered
from ..operators.reports import summary_manifest
from ..operators.summaries import (
    build_prompts, parse_model_output, render_markdown, summary_records, summary_sections,
)
from ..functions.text import strip
from ..session import materialise
from ..sources.staged import publish, stage
from ..sources.writers import path_exists


@dataclass(frozen=True)
class StubModel:
    """A stand-in model: answers each prompt with JSON made from the prompt's own sentences."""

    def run(self, texts):
        return [_stub_answer(text) for text in texts]


def _stub_answer(prompt: str) -> str:
    chunks = [part.strip() for part in prompt.replace("\n", " ").split(".")]
    sentences = [part + "." for part in chunks if part][:2]
    return json.dumps({"highlights": sentences, "summary": prompt}, ensure_ascii=False)


def summarise(
    sources: DataFrame,
    backend: BackendFactory,
    model: str,
    alias: str,
    batch_size: int = 16,
) -> DataFrame:
    """Sources with `markdown`, or with an `error` where there is no content or the call failed.

    `sources`: paper_id, title, abstract, language, context (null when extraction failed). Each row
    stands alone: a failing one neither ends the run nor affects others, ids may repeat, and an empty
    reply is an error.
    """
    # Rows have a number of their own, stored with them, since ids are no key.
    row = "_row"
    while row in sources.columns:
        row = "_" + row
    numbered = sources.withColumn(row, F.monotonically_increasing_id())
    sources = materialise(numbered, "summary-sources")
    ready = sources.where(F.col("context").isNotNull())
    texts = build_prompts(ready, keep=[row])
    prompts = texts.select(F.col(row).alias("id"), F.concat_ws("\n", "system", "user").alias("prompt"))
    # Model calls are expensive and must not be repeated by later passes.
    outputs = materialise(run_model(prompts, backend, batch_size), "model-output")
    empty = strip(F.coalesce("output", F.lit(""))) == ""
    outputs = outputs.withColumn("error", F.coalesce("error", F.when(empty, F.lit("empty reply"))))
    parsed = parse_model_output(
        ready.join(outputs.withColumnRenamed("id", row), row), model, alias
    )
    page = (
        parsed.withColumn("sections", summary_sections())
        .withColumn("draft", F.lit(False))
        .withColumn("authors", F.lit(""))
        .withColumn("updated_at", F.lit(""))
    )
    done = render_markdown(page).select(
        row, F.when(F.col("error").isNull(), F.col("markdown")).alias("markdown"), "error"
    )
    return sources.join(done, row, "left").drop(row).withColumn(
        "error",
        F.when(F.col("context").isNull(), F.lit("no content")).otherwise(F.col("error")),
    )


def summarise_run(
    sources: DataFrame,
    backend: BackendFactory,
    model: str,
    alias: str,
    root: str,
    run_at: datetime,
    limit: int | None = None,
    batch_size: int = 16,
) -> DataFrame:
    """A whole run: model calls, pages, records and manifest below `root`; returns the manifest.

    A run has the id of its time and is stored under it, each of its tables by one rename and the manifest last. A run that
    is tried again goes on where it ended: pages that are there are not asked of the model again, records are there once,
    and a finished run returns its manifest. A limit takes the sources with the highest scores. `sources`: as for `summarise`,
    with `score` and `categories`.
    """
    spark, run_id = sources.sparkSession, run_at.strftime("%Y%m%d-%H%M%S")
    folders = {name: f"{root}/{name}/run_id={run_id}" for name in ("pages", "manifests")}
    if not path_exists(spark, folders["manifests"]):
        if not path_exists(spark, folders["pages"]):
            if limit is not None:
                sources = limit_ordered(sources.withColumn("_best", -F.coalesce("score", F.lit(float("-inf")))), ["_best", "paper_id"], limit).drop("_best")
            done = summarise(sources, backend, model, alias, batch_size)
            _publish(done, folders["pages"], f"{root}/_aside", "parquet")
        pages = spark.read.parquet(folders["pages"])
        stamp = F.lit(run_at.isoformat())
        records = summary_records(pages.where("markdown IS NOT NULL"), stamp, "summary", f"pages/run_id={run_id}")
        month = f"{root}/summaries/month={run_at:%Y-%m}/run_id={run_id}"
        if not path_exists(spark, month):
            _publish(records.drop("month"), month, f"{root}/_aside", "json")
        manifest = summary_manifest(pages, "markdown").select(
            F.lit(run_id).alias("run_id"), stamp.alias("generated_at"), "*", F.lit(month).alias("records"),
            F.lit(folders["pages"]).alias("pages"), F.lit(alias).alias("alias"),
        )
        _publish(manifest.coalesce(1), folders["manifests"], f"{root}/_aside", "parquet")
    return spark.read.parquet(folders["manifests"])


def _publish(df: DataFrame, final: str, aside: str, fmt: str) -> None:
    publish(df.sparkSession, stage(df, uuid.uuid4().hex, aside, final, fmt=fmt))
