"""Content extraction, prompts, model output parsing, rendering and merging of summaries."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.ids import iso_instant, month_bucket
from ..functions.text import blank, computed_once, first_sentences, join_list, non_empty, strip
from .dedup import keep_last

# The wording and layout of prompts, stub summaries and rendered pages.
SYSTEM_PROMPT = (
    "You are an assistant that produces structured academic paper summaries. "
    "Return valid JSON with two keys: 'highlights' (array of concise bullet sentences) and "
    "'summary' (paragraph string). Respond in the requested language."
)
NO_LATEX_PROMPT = (
    " Do not use LaTeX or math markup in the response; prefer plain text."
)
USER_LABELS = ("Language: ", "Paper ID: ", "Title: ", "Abstract: ", "Paper Content:\n")
NO_ABSTRACT = "No abstract provided."
NO_HIGHLIGHTS = "No highlights available."
HEADER = "This summary was generated by {model} (alias {alias}).\nDetected language: {language}.\n"
OBSERVATIONS = "\nKey observations:\n"
FULL_ABSTRACT = "\n\nFull abstract:\n"
EXCERPT = "\n\nContext excerpt:\n"
EXCERPT_LENGTH = 2000
HIGHLIGHTS_HEADING, DETAIL_HEADING = "Highlights", "Detailed Summary"
PAGE_LINK = "https://arxiv.org/abs/"


# Named characters of HTML; the ampersand is last, so what it spells is not read again.
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"),
)


def html_text(c: Column) -> Column:
    """Readable text of an HTML fragment: no scripts, styles, comments or tags, named characters read, spaces squeezed."""
    bare = F.regexp_replace(c, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for name, character in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(character))
    return computed_once(strip(F.regexp_replace(text, r"\s+", " ")))


def article_text(c: Column) -> Column:
    """Text of the first article element, null when there is none."""
    return html_text(F.regexp_extract(c, r"(?is)<article\b[^>]*>(.*?)</article>", 1))


def body_text(c: Column) -> Column:
    """Text of the whole body, null when there is none."""
    return html_text(F.regexp_extract(c, r"(?is)<body\b[^>]*>(.*)</body>", 1))


def extract_content(df: DataFrame, chain: Sequence[tuple[str, Column]]) -> DataFrame:
    """Add `content` and `origin` from the first source that has text, else `reason`.

    Each row is decided on its own; one that fails does not affect later ones. A later source is
    only worked out where the earlier ones gave nothing, and each at most once: the result is one
    struct per row, so that no filter or column repeats the extraction.
    """
    def labelled(name: str, source: Column) -> Column:
        def entry(text: Column) -> Column:
            return F.struct(text.alias("content"), F.lit(name).alias("origin"))

        kept = F.filter(F.array(source), lambda text: text.isNotNull())
        return F.get(F.transform(kept, entry), F.lit(0))

    found = F.coalesce(*[labelled(name, source) for name, source in chain])
    reason = F.lit("no text in " + " or ".join(name for name, _ in chain))
    return (
        df.withColumn("_found", found)
        .withColumn("content", F.col("_found.content"))
        .withColumn("origin", F.col("_found.origin"))
        .withColumn("reason", F.when(F.col("_found").isNull(), reason))
        .drop("_found")
    )


def split_extracted(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ok, rejected) rows of `extract_content`. Materialise it first when both are used."""
    ok = F.col("reason").isNull()
    return df.where(ok).drop("reason"), df.where(~ok).drop("content", "origin")


def build_prompts(df: DataFrame, allow_latex: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """(id, system, user, messages) and the columns of `keep` from paper_id, title, abstract, language and context."""
    system = F.lit(SYSTEM_PROMPT + ("" if allow_latex else NO_LATEX_PROMPT))
    label = [F.lit(text) for text in USER_LABELS]
    user = F.concat_ws(
        "\n",
        F.concat(label[0], F.col("language")),
        F.concat(label[1], F.col("paper_id")),
        F.concat(label[2], F.col("title")),
        F.concat(label[3], strip(F.col("abstract"))),
        F.concat(label[4], strip(non_empty(F.col("context")))),
    )

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return df.select(
        F.col("paper_id").alias("id"),
        system.alias("system"),
        user.alias("user"),
        F.array(message("system", system), message("user", user)).alias("messages"),
        *keep,
    )


def _header(model: str, alias: str, language: Column) -> Column:
    before, after = HEADER.format(model=model, alias=alias, language="\0").split("\0")
    return F.concat(F.lit(before), language, F.lit(after))


def stub_summary(
    df: DataFrame, model: str = "stub", alias: str = "stub", allow_latex: bool = False
) -> DataFrame:
    """Add `highlights` and `detail` made from the text alone, in place of a model call.

    Needs abstract, language and context.
    """
    abstract = F.coalesce(non_empty(strip(blank(F.col("abstract")))), F.lit(NO_ABSTRACT))
    context = non_empty(F.col("context"))
    base = F.coalesce(non_empty(strip(context)), abstract)
    lines = first_sentences(base, 2)
    bullets = F.array_join(F.transform(lines, lambda s: F.concat(F.lit("- "), s)), "\n")
    body = F.concat(
        _header(model, alias, F.col("language")),
        F.lit(OBSERVATIONS),
        bullets,
        F.lit(FULL_ABSTRACT),
        abstract,
        blank(F.concat(F.lit(EXCERPT), F.substring(context, 1, EXCERPT_LENGTH))),
    )
    return df.withColumns(
        {
            "highlights": F.coalesce(non_empty(F.array_join(lines, "\n")), F.lit(NO_HIGHLIGHTS)),
            "detail": body if allow_latex else F.replace(body, F.lit("$"), F.lit("")),
        }
    )


def reply_content(c: Column) -> Column:
    """Text of the first choice of a model reply: a string, or list parts joined by newlines."""
    reply = F.try_parse_json(c)
    where = "$.choices[0].message.content"
    parts = F.try_variant_get(reply, where, "array<string>")
    cleaned = F.filter(F.transform(parts, lambda p: strip(blank(p))), lambda p: p != "")
    listed = F.when(parts.isNotNull(), F.array_join(cleaned, "\n"))
    return strip(F.coalesce(listed, F.try_variant_get(reply, where, "string"), F.lit("")))


def parse_model_output(
    df: DataFrame, model: str = "stub", alias: str = "stub", raw: str = "output"
) -> DataFrame:
    """Add `highlights` and `detail` from raw model output; needs `language`.

    Output that is not JSON, or lacks a part, falls back to the raw text for that part.
    """
    text = F.col(raw)
    payload = F.try_parse_json(text)

    def field(name: str, kind: str = "string") -> Column:
        return F.try_variant_get(payload, f"$.{name}", kind)

    def stripped_lines(items: Column) -> Column:
        kept = F.filter(F.transform(items, lambda s: strip(blank(s))), lambda s: s != "")
        return F.when(F.size(kept) > 0, kept)

    listed = field("highlights", "array<string>")
    single = F.when(listed.isNull(), F.split(field("highlights"), "\n"))
    lines = F.coalesce(stripped_lines(listed), stripped_lines(single), first_sentences(text, 3))
    spare = [F.when(strip(field(n)) != "", field(n)) for n in ("full_summary", "content", "text")]
    detail = F.coalesce(
        non_empty(field("summary")), non_empty(field("detailed_summary")), *spare, text
    )
    header = _header(model, alias, F.col("language"))
    return df.withColumns(
        {
            "highlights": F.coalesce(non_empty(F.array_join(lines, "\n")), F.lit(NO_HIGHLIGHTS)),
            "detail": strip(F.concat(header, F.lit("\n"), strip(detail))),
        }
    )


def sections(*pairs: tuple[str, Column]) -> Column:
    """Ordered (heading, body) sections from columns."""
    return F.array(
        *[F.struct(F.lit(h).alias("heading"), body.alias("body")) for h, body in pairs]
    )


def summary_sections() -> Column:
    return sections((HIGHLIGHTS_HEADING, F.col("highlights")), (DETAIL_HEADING, F.col("detail")))


def plain_markdown(df: DataFrame) -> DataFrame:
    """Add `markdown`: title, id, language and sections, without front matter."""
    parts = F.transform(
        "sections",
        lambda s: F.concat(F.lit("## "), s["heading"], F.lit("\n\n"), strip(s["body"]), F.lit("\n")),
    )
    language = F.when(
        F.length("language") > 0, F.concat(F.lit("**Language:** "), F.col("language"), F.lit("\n"))
    )
    head = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n**Paper ID:** "), F.col("paper_id"), F.lit("\n"))
    return df.withColumn("markdown", strip(F.concat_ws("\n", head, language, parts)))


def render_markdown(df: DataFrame) -> DataFrame:
    """Add `markdown`, a page with front matter, head lines, sections and a link.

    Needs paper_id, title, language, authors, abstract, updated_at, draft and sections. The pages
    stay rows of a table; a file per row would not scale.
    """
    parts = F.array_join(
        F.transform(
            "sections",
            lambda s: F.concat(
                F.lit("## "), s["heading"], F.lit("\n\n"), strip(s["body"]), F.lit("\n\n")
            ),
        ),
        "",
    )
    page = F.concat(
        F.lit('---\ntitle: "'), F.col("title"),
        F.lit('"\ndate: '), F.col("updated_at"),
        F.lit("\ndraft: "), F.col("draft").cast("string"),
        F.lit("\n---\n\n# "), F.col("title"),
        F.lit("\n**Paper ID:** "), F.col("paper_id"),
        F.lit("\n**Language:** "), F.col("language"),
        F.lit("\n**Authors:** "), F.col("authors"),
        F.lit("\n**Abstract:** "), F.col("abstract"),
        F.lit("\n\n"), parts,
        F.lit("\n[Read full paper](" + PAGE_LINK), F.col("paper_id"), F.lit(")\n"),
    )
    return df.withColumn("markdown", F.concat(strip(page), F.lit("\n")))


# The layout of a full article page.
ARTICLE_HEAD = (
    ("title", True), ("slug", True), ("description", False), ("tags", True), ("author", True),
    ("pubDatetime", False), ("preference", True), ("score", True), ("featured", False),
    ("draft", False),
)
ARTICLE_SECTIONS = (
    ("Background Problem", "problem_background"), ("Method", "method"),
    ("Experiment", "experiment"), ("Further Thoughts", "further_thoughts"),
)


def render_article(df: DataFrame) -> DataFrame:
    """Add `markdown`, the full page of a detailed summary with JSON values in its front matter.

    Needs id, title, one_sentence_summary, keywords, authors, institution (lists), model,
    summary_time, preference, score, draft and the section texts.
    """
    def quoted(c: Column) -> Column:
        """The JSON form of one value."""
        text = F.to_json(F.array(c))
        return F.coalesce(F.substring(text, F.lit(2), F.length(text) - 2), F.lit("null"))

    sentence = blank(F.col("one_sentence_summary"))
    described = F.concat(F.lit('"'), F.replace(sentence, F.lit('"'), F.lit('\\"')), F.lit('"'))
    values = {
        "title": F.col("title"), "slug": F.col("id"), "description": described,
        "tags": F.col("keywords"), "author": F.col("model"), "pubDatetime": F.col("summary_time"),
        "preference": F.col("preference"), "score": F.col("score"), "featured": F.lit("false"),
        "draft": F.col("draft").cast("string"),
    }
    head = [
        F.concat(F.lit(f"{name}: "), quoted(values[name]) if as_json else blank(values[name]))
        for name, as_json in ARTICLE_HEAD
    ]
    notes = [
        sentence,
        *[join_list(F.col(name), ", ") for name in ("keywords", "authors", "institution")],
        F.concat(F.lit("Generated by "), blank(F.col("model"))),
    ]
    texts = [
        F.concat(F.lit(f"## {heading}\n\n"), blank(F.col(name)))
        for heading, name in ARTICLE_SECTIONS
    ]
    blocks = [*[F.concat(F.lit("> "), note) for note in notes], *texts]
    front = F.concat_ws("\n", F.lit("---"), *head, F.lit("---"))
    return df.withColumn("markdown", F.concat_ws("\n\n", front, *blocks))


def summary_records(df: DataFrame, run_at: Column, source: str, folder: str) -> DataFrame:
    """Stored summary rows from rendered ones; optional keys are null, so JSON leaves them out."""
    categories = F.when(F.size("categories") > 0, F.col("categories"))
    return df.select(
        F.col("paper_id").alias("id"),
        "title",
        "abstract",
        F.col("markdown").alias("summary"),
        run_at.alias("summary_time"),
        run_at.alias("migrated_at"),
        F.lit(source).alias("source"),
        F.concat(F.lit(f"{folder}/"), F.col("paper_id"), F.lit(".md")).alias("source_file"),
        "score",
        categories.alias("categories"),
        non_empty(F.col("language")).alias("lang"),
        F.substring(run_at, 1, 7).alias("month"),
    )


def order_summary_columns(df: DataFrame) -> DataFrame:
    """Known columns first in their fixed order, then all others by name; none is dropped."""
    known = [c for c in schemas.SUMMARY_FIELD_ORDER if c in df.columns]
    return df.select(*known, *sorted(set(df.columns) - set(known)))


def json_in_key_order(payload: Column) -> Column:
    """JSON text of a map of variants: known keys first, then the others by name.

    For irregular records, whose keys are not columns.
    """
    known = F.array(*[F.lit(k) for k in schemas.SUMMARY_FIELD_ORDER])

    def entry(e: Column) -> Column:
        position = F.array_position(known, e["key"])
        rank = F.when(position > 0, position).otherwise(F.lit(len(schemas.SUMMARY_FIELD_ORDER) + 1))
        quoted = F.to_json(F.array(e["key"]))
        name = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
        text = F.concat(name, F.lit(":"), F.coalesce(F.to_json(e["value"]), F.lit("null")))
        return F.struct(rank.alias("rank"), e["key"].alias("key"), text.alias("text"))

    entries = F.array_sort(F.transform(F.map_entries(payload), entry))
    return F.concat(F.lit("{"), F.array_join(entries["text"], ","), F.lit("}"))


def merge_summaries(df: DataFrame, order: Sequence[str], migrated_at: str) -> DataFrame:
    """One record per id, the last by `order` (source rank first), with its month.

    Needs id, summary_time, updated and created.
    """
    latest = keep_last(df.where(F.length("id") > 0), "id", order)
    when = month_bucket(F.col("summary_time"), F.col("updated"), F.col("created"))
    return latest.withColumn("month", when).withColumn("migrated_at", F.lit(migrated_at))


def normalise_summaries(records: DataFrame, migrated_at: str) -> DataFrame:
    """Merged records of `read_summaries`: (id, month, payload, json in key order)."""
    def text(name: str) -> Column:
        return F.try_variant_get(F.col("payload")[name], "$", "string")

    keyed = records.where(F.col("payload").isNotNull()).select(
        F.coalesce(non_empty(text("id")), F.col("fallback_id")).alias("id"),
        *[text(n).alias(n) for n in ("summary_time", "updated", "created")],
        "source_rank", "kind", "path", "line", "source", "payload",
    )
    merged = merge_summaries(keyed, ["source_rank", "kind", "path", "line"], migrated_at)
    default_time = F.when(
        ~F.map_contains_key("payload", F.lit("summary_time")),
        iso_instant(F.col("updated"), F.col("created")),
    )
    fixed = {
        "id": F.col("id"),
        "source": F.col("source"),
        "source_file": F.col("path"),
        "migrated_at": F.col("migrated_at"),
        "summary_time": default_time,
    }
    own = F.create_map(
        *[x for k, v in fixed.items() for x in (F.lit(k), F.to_variant_object(F.array(v)))]
    )
    own = F.map_filter(
        F.transform_values(own, lambda _, v: F.variant_get(v, "$[0]", "variant")),
        lambda k, v: v.isNotNull() & ~F.is_variant_null(v),
    )
    names = F.array(*[F.lit(k) for k in fixed if k != "summary_time"])
    rest = F.map_filter("payload", lambda k, _: ~F.array_contains(names, k))
    payload = F.map_concat(rest, own)
    return merged.select(
        "id", "month", payload.alias("payload"), json_in_key_order(payload).alias("json")
    )
