"""Secret scans (10): an incremental blob ledger in DataFrame operations only.

Every version of a text is addressed by its SHA-256. The ledger holds one row per blob, rule and rule version that was ever
scanned, with or without findings; a run scans only pairs the ledger lacks, appends them, and joins the findings of the
current rule versions back to every path of a blob. Copies and unchanged versions are therefore scanned once.

Null texts are empty. Repeated rows each get their row; null ids are kept. An empty table gives an empty result. Other
columns of the input are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedloom.session import scratch_path

LEDGER = "address string, rule string, version int, spans array<struct<start:int, end:int>>"


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if the given group has at least `least` characters. Ties of spans go by `rank`."""

    kind: str
    pattern: str
    group: int
    least: int
    rank: int
    version: int = 1


# The base rules. Long runs need no check afterwards, as a run is one match with or without the bound.
RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
        rank=0,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}", group=0, least=20, rank=1),
    Rule("hex", r"[0-9a-f]{24,}", group=0, least=24, rank=2),
)


def addressed(versions: DataFrame) -> DataFrame:
    """(doc_id, address, text), a null text as an empty one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return versions.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", F.sha2("text", 256).alias("address"), "text"
    )


def _pieces(text: Column, rule: Rule) -> Column:
    """Per match: (rule, characters before it since the last match, its characters, whether it counts)."""
    before = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    tested = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
    rows = F.transform(
        F.arrays_zip(before.alias("before"), whole.alias("whole"), tested.alias("tested")),
        lambda x: F.struct(
            F.lit(rule.kind).alias("rule"),
            x["before"].alias("before"),
            x["whole"].alias("whole"),
            (x["tested"] >= rule.least).alias("counts"),
        ),
    )
    # The part behind the last match has no match of its own.
    return F.filter(rows, lambda x: x["whole"].isNotNull())


def _scan(todo: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Spans (address, rule, start, end) of the rules that each row of (address, rules, text) asks for."""
    none = F.array().cast("array<struct<rule:string, before:int, whole:int, counts:boolean>>")
    asked = [
        F.when(F.array_contains("rules", r.kind) & F.col("text").rlike(r.pattern), _pieces(F.col("text"), r)).otherwise(none)
        for r in rules
    ]
    rows = todo.select("address", F.posexplode(F.concat(*asked)).alias("i", "m")).select("address", "i", "m.*").distinct()  # rows repeated whole are one version
    end = F.expr("sum(before + whole) OVER (PARTITION BY address, rule ORDER BY i)").cast("int")
    return (
        rows.withColumn("end", end)
        .where("counts")
        .select("address", "rule", (F.col("end") - F.col("whole")).alias("start"), "end")
    )


def scan_history(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of every distinct blob of `versions` (doc_id, text): address, spans sorted by start and rank of the rule.

    `ledger` is the folder of the ledger table, made at its first use; without one the run keeps its own. The result is
    read from the ledger, so that blobs of earlier runs are not read again.
    """
    spark = versions.sparkSession
    path = ledger or scratch_path(spark, "ledger")
    have = _read_ledger(spark, path)
    rows = addressed(versions)
    first = rows.groupBy("address").agg(F.min("doc_id").alias("doc_id"))
    current = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    pairs = first.select("address", "doc_id", F.explode(current).alias("r")).select("address", "doc_id", "r.*")
    unseen = pairs.join(have.select("address", "rule", "version"), ["address", "rule", "version"], "left_anti")
    todo = unseen.groupBy("address", "doc_id").agg(F.collect_set("rule").alias("rules"))
    texts = rows.alias("v").join(
        todo.alias("t"),
        (F.col("v.address") == F.col("t.address")) & F.col("v.doc_id").eqNullSafe(F.col("t.doc_id")),
    )
    spans = _scan(texts.select("v.address", "rules", "text"), rules)
    found = spans.groupBy("address", "rule").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:int, end:int>>")
    (
        unseen.select("address", "rule", "version")
        .join(found, ["address", "rule"], "left")
        .select("address", "rule", "version", F.coalesce("spans", none).alias("spans"))
        .write.mode("append")
        .parquet(path)
    )
    return _current(_read_ledger(spark, path), rules)


def _read_ledger(spark, path: str) -> DataFrame:
    schema = StructType.fromDDL(LEDGER)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def _current(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """One row per blob with findings under the current rule versions, spans as (start, rank, kind, end)."""
    known = [F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules]
    rank = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.rank)]), F.col("rule"))
    return (
        ledger.where(F.struct("rule", "version").isin(known) & (F.size("spans") > 0))
        .select("address", "rule", rank.alias("rank"), F.explode("spans").alias("s"))
        .groupBy("address")
        .agg(F.sort_array(F.collect_set(F.struct("s.start", "rank", F.col("rule").alias("kind"), "s.end"))).alias("spans"))
    )


def scan_secrets(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of `versions` as doc_id, address and the spans of its blob (none: an empty array)."""
    found = scan_history(versions, ledger, rules)
    none = F.array().cast("array<struct<start:int, rank:int, kind:string, end:int>>")
    paths = addressed(versions).select("doc_id", "address")
    return paths.join(found, "address", "left").select("doc_id", "address", F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with each stretch of secrets in `text` replaced by `mark`; overlapping spans become one stretch.

    Columns, other values and rows stay as they are, null texts included.
    """
    found = scan_history(docs, ledger, rules).select("address", F.explode("spans").alias("s")).select("address", "s.start", "s.end")
    # A span opens a stretch if no earlier one reaches it; the stretch ends where the next one's predecessors end.
    reach = "max(end) OVER (PARTITION BY address ORDER BY start, end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    cuts = (
        found.withColumn("reach", F.expr(reach))
        .withColumn("last", F.expr("max(end) OVER (PARTITION BY address)"))
        .where("reach IS NULL OR start > reach")
        .groupBy("address")
        .agg(
            F.sort_array(F.collect_list(F.struct("start", F.coalesce("reach", F.lit(0)).alias("reach")))).alias("cuts"),
            F.first("last").alias("last"),
        )
    )
    kept = F.transform("cuts", lambda c: F.substring(F.col("text"), c["reach"] + 1, c["start"] - c["reach"]))
    tail = F.expr("substring(text, last + 1)")
    text = F.array_join(F.concat(kept, F.array(tail)), mark)
    names = docs.columns
    address = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").alias("text"), address.alias("address"))
    out = tagged.join(cuts, "address", "left").select(
        "row", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(text).alias("redacted")
    )
    return out.select(*[F.col("redacted").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in names])
