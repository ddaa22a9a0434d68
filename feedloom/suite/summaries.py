"""Content extraction, prompts, parsing, rendering and merging."""

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import functions as F

from ..operators.reports import summary_manifest
from ..operators.summaries import (
    ENTITIES, HEADER, NO_ABSTRACT, NO_HIGHLIGHTS, NO_LATEX_PROMPT, SYSTEM_PROMPT, article_text, body_text,
    build_prompts, extract_content, json_in_key_order, merge_summaries, normalise_summaries, parse_model_output,
    plain_markdown, render_article, render_markdown, reply_content, stub_summary, summary_records, summary_sections,
)
from ..plans.summarise import StubModel, summarise, summarise_run
from ..session import scratch_path
from ..sources.readers import read_summaries
from ..sources.writers import append_summaries
from .registry import query
from .views import (
    JSON_TEXT_SQL, NOW_TEXT, day, day_sql, json_escape, model_outputs, name_parts, strip_sql, table, with_views,
)


def md5(name):
    return F.md5(F.col(name).cast("binary"))


def _html_sql(x: str) -> str:
    bare = f"regexp_replace({x}, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g')"
    text = f"regexp_replace({bare}, '(?s)<[^>]*>', ' ', 'g')"
    for name, character in ENTITIES:
        text = f"replace({text}, '{name}', '{character.replace(chr(39), chr(39) * 2)}')"
    squeezed = f"regexp_replace({text}, '\\s+', ' ', 'g')"
    return f"nullif({strip_sql(squeezed)}, '')"


ARTICLE_SQL = _html_sql(r"nullif(regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article>', 1), '')")
BODY_SQL = _html_sql(r"nullif(regexp_extract(html, '(?is)<body\b[^>]*>(.*)</body>', 1), '')")


def extracted(spark, folder):
    chain = [("article", article_text(F.col("html"))), ("body", body_text(F.col("html")))]
    return extract_content(table(spark, folder, "pages"), chain)


@query(f"""
SELECT page_id, md5(coalesce(article, body)) AS content_md5, length(coalesce(article, body)) AS n_chars,
  CASE WHEN article IS NOT NULL THEN 'article' WHEN body IS NOT NULL THEN 'body' END AS origin,
  CASE WHEN coalesce(article, body) IS NULL THEN 'no text in article or body' END AS reason
FROM (SELECT page_id, {ARTICLE_SQL} AS article, {BODY_SQL} AS body FROM pages)""", name="extract_with_fallback")
def extract_page_content(spark, folder):
    return extracted(spark, folder).select(
        "page_id", md5("content").alias("content_md5"), F.length("content").cast("long").alias("n_chars"),
        "origin", "reason",
    )


def _sources(spark, folder):
    """Documents as summary sources; some have no abstract, some no context."""
    c = F.col("doc_id")
    return table(spark, folder, "documents").select(
        c.cast("string").alias("paper_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(c % 7 == 0, F.lit("  ")).otherwise(F.col("text")).alias("abstract"),
        F.col("lang").alias("language"),
        F.when(c % 3 > 0, F.concat(F.col("text"), F.lit(" costs 5$. "))).alias("context"),
    )


SOURCES_SQL = """sources AS (SELECT CAST(doc_id AS VARCHAR) AS paper_id, split_part(text, chr(10), 1) AS title,
  CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE text END AS abstract, lang AS language,
  CASE WHEN doc_id % 3 > 0 THEN text || ' costs 5$. ' END AS context FROM documents)"""


def _sentences_sql(x: str, n: int) -> str:
    return (
        f"list_filter(list_transform(string_split(replace({x}, chr(10), ' '), '.'), lambda x: {strip_sql('x')}),"
        f" lambda x: x <> '')[1:{n}]"
    )


def _header_sql(model="m", alias="a", language="language") -> str:
    before, after = HEADER.format(model=model, alias=alias, language="\0").split("\0")
    return f"'{before}' || {language} || '{after}'"


@query(f"""
WITH {SOURCES_SQL},
parts AS (SELECT *, coalesce(nullif({strip_sql('abstract')}, ''), '{NO_ABSTRACT}') AS clean FROM sources),
lines AS (SELECT *, list_transform({_sentences_sql(f"coalesce({strip_sql('context')}, clean)", 2)},
  lambda x: x || '.') AS items FROM parts)
SELECT paper_id, coalesce(nullif(array_to_string(items, chr(10)), ''), '{NO_HIGHLIGHTS}') AS highlights,
  md5(replace({_header_sql()} || chr(10) || 'Key observations:' || chr(10) ||
    coalesce(array_to_string(list_transform(items, lambda x: '- ' || x), chr(10)), '') ||
    chr(10) || chr(10) || 'Full abstract:' || chr(10) || clean ||
    coalesce(chr(10) || chr(10) || 'Context excerpt:' || chr(10) || substr(context, 1, 2000), ''), '$', '')) AS detail_md5
FROM lines""", name="stub_summary")
def make_stub_summaries(spark, folder):
    rows = stub_summary(_sources(spark, folder), "m", "a")
    return rows.select("paper_id", "highlights", md5("detail").alias("detail_md5"))


@query(f"""
WITH {SOURCES_SQL}
SELECT paper_id AS id, md5('{(SYSTEM_PROMPT + NO_LATEX_PROMPT).replace("'", "''")}') AS system_md5,
  md5('Language: ' || language || chr(10) || 'Paper ID: ' || paper_id || chr(10) || 'Title: ' || title || chr(10) ||
    'Abstract: ' || {strip_sql('abstract')} ||
    coalesce(chr(10) || 'Paper Content:' || chr(10) || {strip_sql('context')}, '')) AS user_md5,
  2 AS n_messages FROM sources""", name="build_prompts")
def assemble_prompts(spark, folder):
    return build_prompts(_sources(spark, folder)).select(
        "id", md5("system").alias("system_md5"), md5("user").alias("user_md5"),
        F.size("messages").alias("n_messages"),
    )


@query(with_views("model_outputs", f"""
, parts AS (SELECT conv_id, turn, role, turn % 4 AS kind, text, output FROM model_outputs),
parsed AS (SELECT *, CASE kind WHEN 0 THEN ['first point', 'second point'] WHEN 1 THEN ['one', 'two']
    ELSE list_transform({_sentences_sql('output', 3)}, lambda x: x || '.') END AS lines,
  CASE WHEN kind = 1 AND {strip_sql('text')} = '' THEN output WHEN text = '' THEN output ELSE text END AS body FROM parts)
SELECT conv_id, turn, coalesce(nullif(array_to_string(lines, chr(10)), ''), '{NO_HIGHLIGHTS}') AS highlights,
  md5({strip_sql(f"{_header_sql(language='role')} || chr(10) || {strip_sql('body')}")}) AS detail_md5
FROM parsed"""), name="parse_model_output")
def parse_model_outputs(spark, folder):
    rows = model_outputs(spark, folder).withColumn("language", F.col("role"))
    return parse_model_output(rows, "m", "a").select(
        "conv_id", "turn", "highlights", md5("detail").alias("detail_md5")
    )


@query(f"""
SELECT conv_id, turn, md5(CASE turn % 3 WHEN 0 THEN {strip_sql('text')}
  WHEN 1 THEN 'part' || CASE WHEN {strip_sql('text')} = '' THEN '' ELSE chr(10) || {strip_sql('text')} END
  ELSE '' END) AS content_md5 FROM conversations""")
def read_model_replies(spark, folder):
    """Replies with text content, with a list of parts, and without any choice."""
    text, kind = json_escape(F.col("text")), F.col("turn") % 3
    open_, close = '{"choices": [{"message": {"content": ', "}}, {}]}"
    reply = (
        F.when(kind == 0, F.concat(F.lit(open_ + '"'), text, F.lit('"' + close)))
        .when(kind == 1, F.concat(F.lit(open_ + '[" part ", "", "'), text, F.lit('"]' + close)))
        .otherwise('{"choices": []}')
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", reply_content(reply).alias("content"))
    return rows.select("conv_id", "turn", md5("content").alias("content_md5"))


def _pages(spark, folder):
    rows = _sources(spark, folder).withColumns(
        {
            "highlights": F.col("title"), "detail": F.col("abstract"), "authors": F.lit("A; B"),
            "updated_at": day(F.col("paper_id").cast("long")),
            "draft": F.col("paper_id").cast("long") % 2 == 1,
        }
    )
    return render_markdown(rows.withColumn("sections", summary_sections()))


PAGE_SQL = f"""{SOURCES_SQL},
pages_made AS (SELECT *, '---' || chr(10) || 'title: "' || title || '"' || chr(10) ||
  'date: ' || {day_sql('CAST(paper_id AS BIGINT)')} || chr(10) ||
  'draft: ' || CASE WHEN CAST(paper_id AS BIGINT) % 2 = 1 THEN 'true' ELSE 'false' END || chr(10) ||
  '---' || chr(10) || chr(10) || '# ' || title || chr(10) || '**Paper ID:** ' || paper_id || chr(10) ||
  '**Language:** ' || language || chr(10) || '**Authors:** A; B' || chr(10) || '**Abstract:** ' || abstract || chr(10) ||
  chr(10) || '## Highlights' || chr(10) || chr(10) || {strip_sql('title')} || chr(10) || chr(10) ||
  '## Detailed Summary' || chr(10) || chr(10) || {strip_sql('abstract')} || chr(10) || chr(10) || chr(10) ||
  '[Read full paper](https://arxiv.org/abs/' || paper_id || ')' || chr(10) AS markdown FROM sources)"""


@query(f"WITH {PAGE_SQL} SELECT paper_id, length(markdown) AS n_chars, md5(markdown) AS markdown_md5 FROM pages_made", name="render_markdown")
def render_pages(spark, folder):
    return _pages(spark, folder).select(
        "paper_id", F.length("markdown").cast("long").alias("n_chars"), md5("markdown").alias("markdown_md5")
    )


@query(f"""
WITH {SOURCES_SQL}
SELECT paper_id, md5({strip_sql(f"'# ' || title || chr(10) || chr(10) || '**Paper ID:** ' || paper_id || chr(10) || chr(10) || '**Language:** ' || language || chr(10) || chr(10) || '## Highlights' || chr(10) || chr(10) || {strip_sql('title')} || chr(10) || chr(10) || '## Detailed Summary' || chr(10) || chr(10) || {strip_sql('abstract')}")})
  AS markdown_md5 FROM sources""")
def render_plain_documents(spark, folder):
    rows = _sources(spark, folder).withColumns({"highlights": F.col("title"), "detail": F.col("abstract")})
    return plain_markdown(rows.withColumn("sections", summary_sections())).select(
        "paper_id", md5("markdown").alias("markdown_md5")
    )


@query(f"""
WITH {PAGE_SQL}
SELECT paper_id AS id, md5(markdown) AS summary_md5, '{NOW_TEXT}' AS summary_time, 'summary' AS source,
  'pages/' || paper_id || '.md' AS source_file, language AS lang, '2025-12' AS month,
  CASE WHEN CAST(paper_id AS BIGINT) % 2 = 0 THEN CAST(0.5 AS DOUBLE) END AS score,
  CASE WHEN CAST(paper_id AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END AS has_categories FROM pages_made""", name="summary_records")
def make_summary_records(spark, folder):
    c = F.col("paper_id").cast("long")
    rows = _pages(spark, folder).withColumns(
        {
            "score": F.when(c % 2 == 0, 0.5),
            "categories": F.when(c % 3 == 0, F.array("language")).otherwise(F.array()),
        }
    )
    path = scratch_path(spark, "summary-records")
    records = summary_records(rows, F.lit(NOW_TEXT), "summary", "pages")
    append_summaries(records, path)
    return spark.read.schema(records.schema).json(path).select(
        "id", md5("summary").alias("summary_md5"), "summary_time", "source", "source_file", "lang", "month",
        "score", F.when(F.col("categories").isNotNull(), 1).otherwise(0).alias("has_categories"),
    )


@query(f"""
SELECT conv_id, turn, md5('{{"id":"' || CAST(conv_id AS VARCHAR) || '","summary":"' || {JSON_TEXT_SQL} ||
  '","lang":"' || role || '","alpha":null,"zeta":[' || CAST(turn AS VARCHAR) || ']}}') AS json_md5 FROM conversations""", name="summary_key_order")
def order_summary_keys(spark, folder):
    """Irregular records: known keys first, the others by name, none lost."""
    raw = F.concat(
        F.lit('{"zeta": ['), F.col("turn").cast("string"), F.lit('], "lang": "'), F.col("role"),
        F.lit('", "alpha": null, "summary": "'), json_escape(F.col("text")), F.lit('", "id": "'),
        F.col("conv_id").cast("string"), F.lit('"}'),
    )
    payload = F.from_json(raw, "map<string,variant>")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", json_in_key_order(payload).alias("json"))
    return rows.select("conv_id", "turn", md5("json").alias("json_md5"))


@query("""
SELECT CAST(conv_id AS VARCHAR) AS id, md5(text) AS summary_md5, role AS source,
  CASE turn % 3 WHEN 2 THEN 'unknown' ELSE '2024-0' || CAST(1 + turn % 9 AS VARCHAR) END AS month FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY
  CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END DESC, turn DESC) = 1""")
def merge_summaries_last_wins(spark, folder):
    """Turns as summary records: the role ranks the source, the turn is the line."""
    turn, role = F.col("turn"), F.col("role")
    stamp = F.concat(F.lit("2024-0"), (1 + turn % 9).cast("string"), F.lit("-03T08:00:00Z"))
    rows = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("id"),
        F.col("text").alias("summary"),
        F.when(role == "system", 0).when(role == "user", 1).otherwise(2).alias("source_rank"),
        role.alias("source"),
        turn.alias("line"),
        F.when(turn % 3 == 0, stamp).otherwise("").alias("summary_time"),
        F.when(turn % 3 == 1, stamp).alias("updated"),
        F.when(turn % 3 == 2, F.lit("soon")).alias("created"),
    )
    merged = merge_summaries(rows, ["source_rank", "line"], NOW_TEXT)
    return merged.select("id", md5("summary").alias("summary_md5"), "source", "month")


PROMPT_SQL = f"""'{(SYSTEM_PROMPT + NO_LATEX_PROMPT).replace("'", "''")}' || chr(10) ||
  'Language: ' || language || chr(10) || 'Paper ID: ' || paper_id || chr(10) || 'Title: ' || title || chr(10) ||
  'Abstract: ' || {strip_sql('abstract')} || chr(10) || 'Paper Content:' || chr(10) || {strip_sql('context')}"""


@query(f"""
WITH {SOURCES_SQL},
prompts AS (SELECT *, {PROMPT_SQL} AS prompt FROM sources),
answers AS (SELECT *, array_to_string(list_transform({_sentences_sql('prompt', 2)}, lambda x: x || '.'), chr(10)) AS lines,
  {strip_sql(f"{_header_sql()} || chr(10) || {strip_sql('prompt')}")} AS detail FROM prompts)
SELECT paper_id, CASE WHEN context IS NULL THEN 'no content' END AS error, md5('---' || chr(10) ||
  'title: "' || title || '"' || chr(10) || 'date: ' || chr(10) || 'draft: false' || chr(10) || '---' || chr(10) || chr(10) ||
  '# ' || title || chr(10) || '**Paper ID:** ' || paper_id || chr(10) || '**Language:** ' || language || chr(10) ||
  '**Authors:** ' || chr(10) || '**Abstract:** ' || abstract || chr(10) || chr(10) ||
  '## Highlights' || chr(10) || chr(10) || lines || chr(10) || chr(10) ||
  '## Detailed Summary' || chr(10) || chr(10) || detail || chr(10) || chr(10) || chr(10) ||
  '[Read full paper](https://arxiv.org/abs/' || paper_id || ')' || chr(10)) AS markdown_md5 FROM answers""")
def summarise_batch(spark, folder):
    """Prompts through a batch model, parsed and rendered; sources without content are skipped."""
    done = summarise(_sources(spark, folder), StubModel, "m", "a")
    return done.select("paper_id", "error", md5("markdown").alias("markdown_md5"))


@query(f"""
WITH {SOURCES_SQL}
SELECT count(*) AS total_sources, count(context) AS summarized, CAST(count_if(context IS NULL) AS BIGINT) AS skipped
FROM sources""", name="summary_manifest")
def count_summaries(spark, folder):
    return summary_manifest(_sources(spark, folder), "context")


@query("""
SELECT conv_id, turn, md5('---' || chr(10) || 'title: "' || role || '"' || chr(10) || 'slug: "' ||
  CAST(conv_id AS VARCHAR) || '"' || chr(10) || 'description: "' || replace(text, '"', '\\"') || '"' || chr(10) ||
  'tags: ["' || role || '","b"]' || chr(10) || 'author: "m"' || chr(10) || 'pubDatetime: 2024-01-01' || chr(10) ||
  'preference: "like"' || chr(10) || 'score: 0.5' || chr(10) || 'featured: false' || chr(10) ||
  'draft: ' || CASE WHEN turn > 2 THEN 'true' ELSE 'false' END || chr(10) || '---' || chr(10) || chr(10) ||
  '> ' || text || chr(10) || chr(10) || '> ' || role || ', b' || chr(10) || chr(10) || '> ' || role || chr(10) || chr(10) ||
  '> ' || chr(10) || chr(10) || '> Generated by m' || chr(10) || chr(10) ||
  '## Background Problem' || chr(10) || chr(10) || text || chr(10) || chr(10) || '## Method' || chr(10) || chr(10) || role ||
  chr(10) || chr(10) || '## Experiment' || chr(10) || chr(10) || chr(10) || chr(10) ||
  '## Further Thoughts' || chr(10) || chr(10) || 'x') AS markdown_md5 FROM conversations""")
def render_articles(spark, folder):
    rows = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.col("conv_id").cast("string").alias("id"), F.col("role").alias("title"),
        F.col("text").alias("one_sentence_summary"), F.array("role", F.lit("b")).alias("keywords"),
        F.array("role").alias("authors"), F.array().cast("array<string>").alias("institution"),
        F.lit("m").alias("model"), F.lit("2024-01-01").alias("summary_time"), F.lit("like").alias("preference"),
        F.lit(0.5).alias("score"), (F.col("turn") > 2).alias("draft"), F.col("text").alias("problem_background"),
        F.col("role").alias("method"), F.lit(None).cast("string").alias("experiment"), F.lit("x").alias("further_thoughts"),
    )
    return render_article(rows).select("conv_id", "turn", md5("markdown").alias("markdown_md5"))


@query(f"""
WITH {SOURCES_SQL}, best AS (SELECT * FROM sources ORDER BY length(abstract) DESC, paper_id LIMIT 60)
SELECT '20250102-030405' AS run_id, count(*) AS total_sources, count(context) AS summarized,
  CAST(count_if(context IS NULL) AS BIGINT) AS skipped, count(context) AS records, 'a' AS alias FROM best""", name="summarise_run")
def run_summaries_twice(spark, folder):
    """A whole run over the best sources, tried again after its end: its records are there once."""
    rows = _sources(spark, folder).withColumns({"score": F.length("abstract").cast("double"), "categories": F.array("language")})
    root, at = scratch_path(spark, "summary-run"), datetime(2025, 1, 2, 3, 4, 5)
    for _ in range(2):
        manifest = summarise_run(rows, StubModel, "m", "a", root, at, limit=60)
    records = spark.read.json(f"{root}/summaries").agg(F.count("*").alias("records"))
    return manifest.select("run_id", "total_sources", "summarized", "skipped", "alias").join(records)


@dataclass(frozen=True)
class SilentModel:
    """Answers like the stub, but says nothing about prompts with an even number of characters."""

    def run(self, texts):
        return [answer if len(text) % 2 else " " for text, answer in zip(texts, StubModel().run(texts))]


@query(f"""
WITH {SOURCES_SQL}, twice AS (SELECT paper_id, language, title, abstract, context, n FROM sources, range(2) AS copies(n)),
prompts AS (SELECT paper_id, context, {PROMPT_SQL} AS prompt FROM twice)
SELECT paper_id, CASE WHEN context IS NULL THEN 'no content' WHEN length(prompt) % 2 = 0 THEN 'empty reply' END AS error,
  context IS NOT NULL AND length(prompt) % 2 = 1 AS has_page FROM prompts""")
def summarise_with_empty_replies(spark, folder):
    """Every source comes twice, and the model says nothing about some: each row has its own page or error."""
    rows = _sources(spark, folder)
    done = summarise(rows.union(rows), SilentModel, "m", "a")
    return done.select("paper_id", "error", F.col("markdown").isNotNull().alias("has_page"))


LEGACY_SQL = f"""
WITH lines AS (SELECT *, CASE WHEN turn % 3 = 2 THEN 'unknown' ELSE '2024-0' || CAST(1 + turn % 9 AS VARCHAR) END AS month,
  CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS source_rank FROM conversations WHERE conv_id % 10 <> 9)
SELECT CAST(conv_id AS VARCHAR) AS id, month, role AS source, md5(text) AS summary_md5, '{NOW_TEXT}' AS migrated_at FROM lines
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY source_rank DESC, turn DESC) = 1"""


@query(LEGACY_SQL)
def read_legacy_summaries(spark, folder):
    """Summary lines of three folders in rising priority, read by line number; some lines are no JSON."""
    root, turn = scratch_path(spark, "legacy"), F.col("turn")
    stamp = F.concat(F.lit("2024-0"), (1 + turn % 9).cast("string"), F.lit("-03T08:00:00Z"))
    record = F.struct(
        F.col("conv_id").cast("string").alias("id"), F.col("text").alias("summary"),
        F.when(turn % 3 == 0, stamp).otherwise("").alias("summary_time"), F.when(turn % 3 == 1, stamp).alias("updated"),
        F.when(turn % 3 == 2, F.lit("soon")).alias("created"),
    )
    value = F.when(F.col("conv_id") % 10 == 9, F.lit("no JSON")).otherwise(F.to_json(record))
    rows = table(spark, folder, "conversations").orderBy("conv_id", "turn")
    folders = []
    for role in ("system", "user", "assistant"):
        part = rows.where(F.col("role") == role).select(value.alias("value"))
        part.write.text(f"{root}/{role}")
        name_parts(spark, f"{root}/{role}", f"{root}/named/{role}", ".jsonl")
        folders.append((f"{root}/named/{role}", role))
    merged = normalise_summaries(read_summaries(spark, folders), NOW_TEXT)

    def said(key):
        return F.try_variant_get(F.col("payload")[key], "$", "string")

    return merged.select("id", "month", said("source").alias("source"), F.md5(said("summary").cast("binary")).alias("summary_md5"), said("migrated_at").alias("migrated_at"))
