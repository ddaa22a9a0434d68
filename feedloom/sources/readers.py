"""Readers. Every text source has an explicit schema, so ids stay strings."""

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.text import blank, clean_list, non_empty, split_list, strip

# Quoted fields may hold line breaks and doubled quotes.
CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def read_csv_by_header(
    spark: SparkSession, path, columns: Sequence[str], required: Sequence[set[str]] = ()
) -> DataFrame:
    """CSV files whose columns may differ in order and number, matched by header name.

    A given schema is applied by position, so each distinct header line (there are only ever a few)
    gets its own read of the files that carry it: rows are read once. The driver holds the file names, as for any scan.
    Columns a file lacks come back as null.
    Each set in `required` names columns of which every file must have at least one.
    """
    options = {"recursiveFileLookup": True, "pathGlobFilter": "*.csv"}
    heads = (
        spark.read.options(**options)
        .text(path)
        .where(F.col("_metadata.file_block_start") == 0)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("value").alias("line"),
            F.monotonically_increasing_id().alias("seq"),
        )
        .groupBy("file")
        .agg(F.min_by("line", "seq").alias("header"))
    )
    files: dict[str, list[str]] = {}
    for row in heads.orderBy("file").collect():
        files.setdefault(row.header, []).append(unquote(row.file))
    if not files:
        raise ValueError(f"no CSV file with content below {path}")
    frames = []
    for header, paths in files.items():
        names = header_names(header)
        for choice in required:
            if not choice & set(names):
                raise ValueError(f"CSV header {header!r} has none of {sorted(choice)}")
        layout = T.StructType([T.StructField(n, T.StringType()) for n in names])
        frame = spark.read.options(**CSV_OPTIONS).schema(layout).csv(paths)
        frames.append(
            frame.select(
                *[
                    (F.col(f"`{c}`") if c in names else F.lit(None).cast("string")).alias(c)
                    for c in columns
                ]
            )
        )
    return reduce(DataFrame.unionByName, frames)


def header_names(line: str) -> list[str]:
    """Column names of a CSV header line."""
    cells = (line or "").lstrip("\ufeff").split(",")
    return [cell.strip().strip('"') for cell in cells if cell.strip()]


def metadata_view(df: DataFrame) -> DataFrame:
    """Stored metadata as the ranking jobs see it: id, title, abstract, categories list, updated."""
    return df.select(
        F.col("paper_id").alias("id"),
        blank(F.col("title")).alias("title"),
        blank(F.col("abstract")).alias("abstract"),
        split_list(F.col("categories")).alias("categories"),
        blank(F.col("updated_at")).alias("updated"),
    )


def read_metadata(spark: SparkSession, glob: str, schema=schemas.METADATA) -> DataFrame:
    """All metadata CSV files below a glob, in the stored column layout."""
    return spark.read.options(**CSV_OPTIONS).schema(schema).csv(glob)


def read_vectors(spark: SparkSession, path, alias: str) -> DataFrame:
    """All vectors of one model as (id, alias); only these two columns are read."""
    return vector_view(spark.read.schema(schemas.VECTORS).parquet(path), alias)


def vector_view(df: DataFrame, alias: str) -> DataFrame:
    return df.select(F.col("paper_id").alias("id"), F.col("embedding").alias(alias))


def preference_view(df: DataFrame) -> DataFrame:
    """(id, preference, recorded_at) from a table keyed by `id` or `paper_id`."""
    names = df.columns
    key = next((F.col(n) for n in ("id", "paper_id") if n in names), None)
    if key is None or "preference" not in names:
        raise ValueError("preferences need an 'id' or 'paper_id' column and a 'preference' column")
    stamp = F.col("recorded_at") if "recorded_at" in names else F.lit(None)
    return df.select(
        key.cast("string").alias("id"), "preference", stamp.cast("string").alias("recorded_at")
    )


def read_preferences(spark: SparkSession, path: str) -> DataFrame:
    """Preference CSV files below a folder; each file may call its key `id` or `paper_id`."""
    if not list_files(spark, path, pathGlobFilter="*.csv").where("size = 0").isEmpty():
        raise ValueError(f"empty preference CSV below {path}")
    raw = read_csv_by_header(
        spark,
        path,
        ["id", "paper_id", "preference", "recorded_at"],
        required=[{"id", "paper_id"}, {"preference"}],
    )
    return raw.select(F.coalesce("id", "paper_id").alias("id"), "preference", "recorded_at")


def read_summary_lines(spark: SparkSession, path: str) -> DataFrame:
    """The id of every summary line, null where a line has none or is not JSON; `reports.line_counts` counts those."""
    return spark.read.schema("id string").json(path)


def read_summary_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids that already have a summary; lines that are not JSON are left out."""
    return read_summary_lines(spark, path).where(F.col("id").isNotNull())


def read_harvest_xml(spark: SparkSession, path: str) -> DataFrame:
    """Landed harvest pages, one row per record element."""
    return (
        spark.read.format("xml")
        .options(rowTag="record", ignoreNamespace="true")
        .schema(schemas.HARVEST_DDL)
        .load(path)
    )


def parse_harvest(df: DataFrame, source: str = "harvest") -> DataFrame:
    """Harvest records as canonical metadata rows; deleted and unusable records are left out."""
    doc = "metadata.arXiv"
    people = F.transform(
        F.coalesce(F.col(f"{doc}.authors.author"), F.array()),
        lambda a: strip(F.concat(blank(a["forenames"]), F.lit(" "), blank(a["keyname"]))),
    )
    categories = F.filter(
        F.split(blank(F.col(f"{doc}.categories")), r"\s+"), lambda part: part != ""
    )
    license_text = non_empty(strip(F.col(f"{doc}.license._VALUE")))
    live = ~F.coalesce(F.col("header._status") == "deleted", F.lit(False))
    return df.where(live & (F.length(f"{doc}.id") > 0)).select(
        F.col(f"{doc}.id").alias("paper_id"),
        strip(blank(F.col(f"{doc}.title"))).alias("title"),
        strip(blank(F.col(f"{doc}.abstract"))).alias("abstract"),
        F.array_join(categories, ";").alias("categories"),
        blank(F.get(categories, F.lit(0))).alias("primary_category"),
        F.array_join(F.filter(people, lambda p: p != ""), ";").alias("authors"),
        blank(F.col(f"{doc}.created")).alias("published_at"),
        blank(F.col(f"{doc}.updated")).alias("updated_at"),
        blank(F.col(f"{doc}.doi")).alias("doi"),
        blank(F.col(f"{doc}.comments")).alias("comment"),
        blank(F.col(f"{doc}.journal-ref")).alias("journal_ref"),
        blank(F.coalesce(license_text, F.col(f"{doc}.license._uri"))).alias("license"),
        F.lit(source).alias("source"),
    )


def _year_glob(years: Sequence[int] | None) -> str:
    return "{" + ",".join(str(y) for y in years) + "}" if years else "[0-9][0-9][0-9][0-9]"


def year_files(spark: SparkSession, path: str, years: Sequence[int] | None = None) -> dict[str, str]:
    """Path of the wide parquet file (or folder) of each year."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{_year_glob(years)}.parquet")
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target) or []
    names = sorted(str(f.getPath().toString()) for f in found)
    return {n[-len("2000.parquet"):-len(".parquet")]: n for n in names}


def read_year_files(spark: SparkSession, path: str, years: Sequence[int] | None = None) -> DataFrame:
    """Wide parquet files (or folders) named `<year>.parquet`, with the year as a column.

    Each year is read by its own schema: a model's column that only some years have is null in the others, and
    vectors of different float widths are read as doubles. The driver lists one path per year.
    """
    names = list(year_files(spark, path, years).values())
    if not names:
        return spark.read.parquet(f"{path}/{_year_glob(years)}.parquet").withColumn("year", F.lit(""))
    parts = [spark.read.parquet(n).withColumn("year", F.lit(n[-len("2000.parquet"):-len(".parquet")])) for n in names]
    kinds: dict[str, set[str]] = {}
    for part in parts:
        for column, kind in part.dtypes:
            kinds.setdefault(column, set()).add(kind)
    wide = {c: "array<double>" if all(k.startswith("array") for k in kind) else "string" for c, kind in kinds.items() if len(kind) > 1}
    parts = [p.withColumns({c: F.col(f"`{c}`").cast(k) for c, k in wide.items() if c in p.columns}) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_preference_months(spark: SparkSession, paths) -> DataFrame:
    """Monthly preference files as (paper_id, preference, month); the file stem is the month."""
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")
    return (
        spark.read.options(**CSV_OPTIONS, pathGlobFilter="*.csv")
        .schema("id string, preference string")
        .csv(paths)
        .select(F.col("id").alias("paper_id"), "preference", F.url_decode(stem).alias("month"))
    )


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """Line numbers for `spark.read.text` rows; neither a file nor a line is moved.

    A task reads whole blocks, one after the other, so a line's place in its block is its running number in the task less
    the first one of the block. A first pass gets that number and the line count of each block, a few bytes per block. Both
    passes plan the same files in the same way, so the running numbers are the same.
    """
    tagged = lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )
    blocks = tagged.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "path", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1 - F.col("first")).alias("shift")
    )
    return tagged.join(blocks, ["path", "block"]).select(
        "path", (F.col("seq") + F.col("shift")).alias("line"), "value"
    )


def read_summaries(spark: SparkSession, ranked_dirs: Sequence[tuple[str, str]]) -> DataFrame:
    """Summary records from several folders in rising priority: *.json documents, *.jsonl lines.

    `ranked_dirs` holds (folder, source label). Text that is not JSON gives a null `payload`, so bad
    lines can be counted instead of ending the run.
    """
    frames = []
    for rank, (folder, label) in enumerate(ranked_dirs):
        nested = {"recursiveFileLookup": True}
        documents = (
            spark.read.options(**nested, wholetext=True, pathGlobFilter="*.json")
            .text(folder)
            .select(
                F.col("_metadata.file_path").alias("path"),
                F.lit(0).cast("long").alias("line"),
                F.lit(0).alias("kind"),
                "value",
            )
        )
        lines = with_line_numbers(
            spark.read.options(**nested, pathGlobFilter="*.jsonl").text(folder)
        ).select("path", "line", F.lit(1).alias("kind"), "value")
        frames.append(
            documents.unionByName(lines).select(
                F.lit(rank).alias("source_rank"), F.lit(label).alias("source"), "*"
            )
        )
    records = reduce(DataFrame.unionByName, frames)
    stem = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    fallback = F.when(F.col("kind") == 0, stem).otherwise(
        F.concat_ws("-", stem, F.col("line").cast("string"))
    )
    return parse_summaries(
        records.where(F.length(strip(F.col("value"))) > 0).withColumn("fallback_id", fallback)
    )


def parse_summaries(records: DataFrame) -> DataFrame:
    """Add the `payload` of each record's text, null if it is no JSON object."""
    return records.withColumn("payload", F.from_json("value", "map<string,variant>"))


NUMBER_KINDS = ["BIGINT", "DOUBLE", "FLOAT"]  # decimals carry their precision


def shortlist_view(df: DataFrame) -> DataFrame:
    """A recommendation table as summary sources; rows without any id are left out."""
    names = df.columns

    def text(name: str) -> Column:
        return F.col(name).cast("string") if name in names else F.lit(None).cast("string")

    if "categories" not in names:
        categories = F.lit(None).cast("array<string>")
    elif isinstance(df.schema["categories"].dataType, T.StringType):
        categories = F.when(F.col("categories").isNotNull(), clean_list(F.col("categories")))
    else:
        categories = F.col("categories")
    score_is_number = "score" in names and isinstance(df.schema["score"].dataType, T.NumericType)
    return df.select(
        F.coalesce(non_empty(text("id")), non_empty(text("paper_id"))).alias("paper_id"),
        blank(text("title")).alias("title"),
        blank(text("abstract")).alias("abstract"),
        categories.alias("categories"),
        (F.col("score") if score_is_number else F.lit(None)).cast("double").alias("score"),
    ).where(F.col("paper_id").isNotNull())


def read_json_shortlist(spark: SparkSession, path: str) -> DataFrame:
    """A shortlist in JSON lines, whose values may differ in type from line to line.

    Read as variants: no pass over the data to infer a layout, and ids stay text.
    """
    lines = spark.read.text(path).select(F.try_parse_json("value").alias("v"))

    def field(name: str, kind: str = "string") -> Column:
        return F.try_variant_get("v", f"$.{name}", kind)

    kind = F.schema_of_variant(field("score", "variant"))
    numeric = kind.isin(NUMBER_KINDS) | kind.startswith("DECIMAL")
    listed = field("categories", "array<string>")
    joined = field("categories")
    return lines.select(
        *[field(n).alias(n) for n in ("id", "paper_id", "title", "abstract")],
        F.coalesce(listed, F.when(joined.isNotNull(), clean_list(joined))).alias("categories"),
        F.when(numeric, field("score", "double")).alias("score"),
    )


def load_shortlist(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Summary sources from a recommendation file or table, chosen by its suffix.

    A limit takes the best scores, in a fixed order; files have no row order to rely on.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        sources = shortlist_view(spark.read.parquet(path))
    elif suffix in ("json", "jsonl", "ndjson"):
        sources = shortlist_view(read_json_shortlist(spark, path))
    else:
        raise ValueError(f"unsupported recommendation file format: {suffix}")
    if limit is None:
        return sources
    return sources.orderBy(F.desc_nulls_last("score"), "paper_id").limit(limit)


def read_threads(spark: SparkSession, path: str) -> DataFrame:
    """Discussion threads of landed query replies, one row each with its reactions."""
    reply = spark.read.option("multiLine", True).schema(schemas.THREADS_DDL).json(path)
    return (
        reply.select(F.inline("data.repository.discussions.nodes"))
        .withColumn("reactions", F.col("reactions.nodes"))
        .withColumnRenamed("updatedAt", "updated_at")
    )


def existing_vector_ids(spark: SparkSession, path: str, model: str) -> DataFrame | None:
    """(year, paper_id) of a model's stored vectors, None without a table.

    The model is a partition, so only its files are read, and of those only the ids.
    """
    stored = read_if_present(spark, path, schemas.VECTOR_TABLE)
    return None if stored is None else stored.where(F.col("model") == model).select("year", "paper_id")


def read_if_present(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """A stored parquet table, or None when nothing has been stored there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def list_files(spark: SparkSession, roots, **options) -> DataFrame:
    """Path, size and modification time of files; contents are not read.

    Spark plans no task for an empty file, so those are added from its file index (the names the
    driver holds for any scan); their modification time is not known there.
    """
    found = (
        spark.read.format("binaryFile").options(recursiveFileLookup=True, **options).load(roots)
    )
    files = found.select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")
    )
    names = found.inputFiles()
    if files.count() == len(names):
        return files
    known = spark.createDataFrame([(n,) for n in names], "path string").select(
        F.regexp_replace("path", "^file:///", "file:/").alias("path")
    )
    empty = known.join(files, "path", "left_anti").withColumn("size", F.lit(0).cast("long"))
    return files.unionByName(empty, allowMissingColumns=True)
