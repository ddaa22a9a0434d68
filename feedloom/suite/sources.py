"""Readers and writers: the given tables are written in a stored format and read back."""

from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import join_list
from ..operators.candidates import drop_known
from ..operators.dedup import keep_latest_any
from ..operators.files import exclude_globs, file_manifest, latest_run
from ..operators.reports import harvest_counts, line_counts, year_counts
from ..operators.reshape import normalise_schema, split_by_year
from ..plans.vectors import clean_stored_vectors
from ..session import scratch_path
from ..sources.readers import (
    list_files, load_shortlist, metadata_view, parse_harvest, read_harvest_xml, read_metadata,
    read_preferences, read_summary_ids, read_summary_lines, read_vectors,
)
from ..sources.writers import write_metadata, write_run, write_table, write_vectors
from .registry import query
from .views import day, day_sql, done, papers, prefs, strip_sql, table, vec_a, with_views

@query(with_views("papers", f"""
SELECT paper_id AS id, title, md5(abstract) AS abstract_md5,
  array_to_string(list_transform(string_split(categories, ';'), lambda x: {strip_sql('x')}), '|')
    AS categories, updated_at AS updated FROM papers"""))
def scan_metadata(spark, folder):
    """Whole texts, line breaks and quotes included, through the CSV metadata table."""
    path = scratch_path(spark, "metadata")
    write_table(normalise_schema(papers(spark, folder)), path, fmt="csv")
    rows = metadata_view(read_metadata(spark, path))
    return rows.select(
        "id", "title", F.md5(F.col("abstract").cast("binary")).alias("abstract_md5"),
        join_list(F.col("categories"), "|").alias("categories"), "updated",
    )


@query("""
SELECT CAST(vec_id AS VARCHAR) AS id, len(embedding) AS dim, CAST(embedding[1] AS DOUBLE) AS first,
  CAST(embedding[-1] AS DOUBLE) AS last FROM embeddings""")
def scan_embedding(spark, folder):
    path = scratch_path(spark, "vectors")
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("paper_id"), "embedding",
        F.lit("2024").alias("generated_at"), F.lit(64).alias("model_dim"), F.lit("x").alias("source"),
    )
    write_table(rows, path, compression="zstd")
    return read_vectors(spark, path, "v").select(
        "id",
        F.size("v").cast("long").alias("dim"),
        F.get("v", F.lit(0)).cast("double").alias("first"),
        F.element_at("v", -1).cast("double").alias("last"),
    )


@query(with_views("prefs", "SELECT id, preference, recorded_at FROM prefs"))
def load_preferences(spark, folder):
    """Two files with different headers; the older entry of each id is outdated."""
    path = scratch_path(spark, "preferences")
    new = prefs(spark, folder)
    old = new.select(
        F.lit("neutral").alias("preference"), F.lit("2023-01-01").alias("recorded_at"),
        F.col("id").alias("paper_id"),
    )
    write_table(new, f"{path}/new", fmt="csv")
    write_table(old, f"{path}/old", fmt="csv")
    return keep_latest_any(read_preferences(spark, path), "id", ["recorded_at", "preference"])


@query(with_views("papers done", """
SELECT paper_id AS id, title, updated_at AS updated FROM papers
WHERE paper_id NOT IN (SELECT id FROM done)"""))
def drop_already_summarised(spark, folder):
    path = scratch_path(spark, "summaries")
    write_table(done(spark, folder), path, fmt="json")
    rows = metadata_view(papers(spark, folder))
    return drop_known(rows, read_summary_ids(spark, path)).select("id", "title", "updated")


CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"  # not allowed in XML
CLEAN_SQL = f"regexp_replace(text, '{CONTROL}', ' ', 'g')"


@query(f"""
SELECT CAST(doc_id AS VARCHAR) AS paper_id, {strip_sql(f"split_part({CLEAN_SQL}, chr(10), 1)")} AS title,
  md5({strip_sql(CLEAN_SQL)}) AS abstract_md5, source || ';' || lang AS categories,
  source AS primary_category, source || ' ' || lang || ';' || lang AS authors,
  {day_sql('doc_id')} AS published_at, {day_sql('doc_id', '2025-01-01')} AS updated_at,
  '10.1/' || CAST(doc_id AS VARCHAR) AS doi, 'http://example.org/' || lang AS license, 'harvest' AS source
FROM documents WHERE lang <> 'de' AND source <> 'src7'""")
def parse_harvest_records(spark, folder):
    """Harvest pages made from the documents: deleted records in one language, empty ones in one source."""
    rows = parse_harvest(read_harvest_xml(spark, _landed_harvest(spark, folder)))
    return rows.select(
        "paper_id", "title", F.md5(F.col("abstract").cast("binary")).alias("abstract_md5"),
        "categories", "primary_category", "authors", "published_at", "updated_at", "doi", "license",
        "source",
    )


def _landed_harvest(spark, folder):
    text = F.regexp_replace("text", CONTROL, " ")
    key = F.col("doc_id").cast("string")

    def author(keyname, forenames):
        return F.struct(keyname.alias("keyname"), forenames.alias("forenames"))

    document = F.struct(
        key.alias("id"),
        day(F.col("doc_id")).alias("created"),
        day(F.col("doc_id"), "2025-01-01").alias("updated"),
        F.struct(
            F.array(
                author(F.col("lang"), F.col("source")),
                author(F.col("lang"), F.lit(None).cast("string")),
            ).alias("author")
        ).alias("authors"),
        F.substring_index(text, "\n", 1).alias("title"),
        F.concat_ws(" ", "source", "lang").alias("categories"),
        F.concat(F.lit("10.1/"), key).alias("doi"),
        F.struct(F.concat(F.lit("http://example.org/"), F.col("lang")).alias("_uri")).alias("license"),
        text.alias("abstract"),
    )
    records = table(spark, folder, "documents").select(
        F.struct(F.when(F.col("lang") == "de", "deleted").alias("_status"), key.alias("identifier")).alias(
            "header"
        ),
        F.when(F.col("source") != "src7", F.struct(document.alias("arXiv"))).alias("metadata"),
    )
    path = scratch_path(spark, "harvest")
    records.write.format("xml").options(rowTag="record", rootTag="ListRecords").save(path)
    return path


@query("""
SELECT count(*) AS records, CAST(count_if(lang = 'de') AS BIGINT) AS deleted,
  CAST(count_if(lang <> 'de' AND source = 'src7') AS BIGINT) AS unusable,
  CAST(count_if(lang <> 'de' AND source <> 'src7') AS BIGINT) AS kept FROM documents""")
def count_harvest_records(spark, folder):
    """The same pages: how many records were deleted, and how many cannot be used."""
    return harvest_counts(read_harvest_xml(spark, _landed_harvest(spark, folder)))


@query("""
SELECT count(*) AS lines, CAST(count_if(conv_id % 7 = 0 OR turn = 2) AS BIGINT) AS unusable FROM conversations""")
def count_summary_lines(spark, folder):
    """Summary lines, some without an id and some that are no JSON."""
    path, key = scratch_path(spark, "lines"), F.col("conv_id")
    record = F.to_json(F.struct(F.when(key % 7 != 0, key.cast("string")).alias("id"), "role"))
    lines = table(spark, folder, "conversations").select(F.when(F.col("turn") == 2, F.lit("{broken")).otherwise(record).alias("value"))
    lines.write.text(path)
    return line_counts(read_summary_lines(spark, path))


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS paper_id, c_name AS title, '' AS abstract,
  c_mktsegment AS categories, '' AS primary_category, '' AS authors, '' AS published_at,
  '' AS updated_at, '' AS doi, CAST(c_nationkey AS VARCHAR) AS comment, '' AS journal_ref,
  '' AS license, '' AS source FROM customer""", name="normalise_schema")
def normalise_metadata_schema(spark, folder):
    rows = table(spark, folder, "customer").select(
        F.col("c_mktsegment").alias("categories"), F.col("c_nationkey").alias("comment"),
        F.col("c_name").alias("title"), F.col("c_custkey").alias("paper_id"),
    )
    return normalise_schema(rows, schemas.METADATA_COLUMNS)


@query(with_views("papers", """
, counted AS (SELECT substr(published_at, 1, 4) AS year, count(*) AS n FROM papers GROUP BY 1)
SELECT year, n AS rows FROM counted
UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT) FROM counted"""))
def metadata_year_counts(spark, folder):
    path = scratch_path(spark, "metadata-table")
    accepted, _ = split_by_year(papers(spark, folder))
    write_metadata(accepted, path)
    return year_counts(spark.read.parquet(path))


@query("""
SELECT CAST(doc_id AS VARCHAR) AS paper_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS title,
  array_to_string(list_filter([source, lang], lambda x: x <> ''), '|') AS categories,
  CAST(n_chars AS DOUBLE) / 4 AS score, md5(coalesce(text, '')) AS abstract_md5 FROM documents""", name="load_shortlist")
def load_summary_shortlist(spark, folder):
    """A JSON shortlist whose id is in either of two columns; categories are one text."""
    c = F.col("doc_id")
    rows = table(spark, folder, "documents").select(
        F.when(c % 2 == 0, c.cast("string")).alias("id"),
        F.when(c % 2 == 1, c.cast("string")).otherwise("other").alias("paper_id"),
        F.when(c % 3 != 0, F.col("lang")).alias("title"),
        F.concat(F.lit(" "), F.col("source"), F.lit(" ;; "), F.col("lang"), F.lit(";")).alias("categories"),
        (F.col("n_chars") / 4).alias("score"),
        F.col("text").alias("abstract"),
    )
    path = scratch_path(spark, "shortlist") + "/recommended.jsonl"
    write_table(rows, path, fmt="json")
    return load_shortlist(spark, path).select(
        "paper_id", "title", join_list(F.col("categories"), "|").alias("categories"), "score",
        F.md5(F.col("abstract").cast("binary")).alias("abstract_md5"),
    )


@query("""
SELECT count(DISTINCT (lang, source)) AS files, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents
WHERE lang <> 'de' AND source NOT LIKE 'src1%'""", name="file_manifest")
def list_and_exclude_files(spark, folder):
    """Texts written to a file per language and source; count and size of the files that no pattern leaves out."""
    path = scratch_path(spark, "files")
    rows = table(spark, folder, "documents").select(
        "lang", "source", F.translate(F.coalesce("text", F.lit("")), "\r\n", "  ").alias("value")
    )
    rows.repartition("lang", "source").write.partitionBy("lang", "source").text(path)
    files = exclude_globs(list_files(spark, path), ["*/lang=de/*", "*/source=src1*", "_SUCCESS", "*.crc"])
    return file_manifest(files)


@query("""
WITH rows AS (SELECT CASE WHEN vec_id % 2 = 0 THEN '2024' ELSE '2025' END AS year, vec_id, label FROM embeddings)
SELECT 'report' AS part, year, CASE WHEN label = 9 THEN 16 ELSE 64 END AS dim, count(*) AS rows, label <> 9 AS kept FROM rows GROUP BY ALL
UNION ALL SELECT 'stored', year, 64, count(*), true FROM rows WHERE label <> 9 GROUP BY year
UNION ALL SELECT 'manifest', year, 64, count(*), true FROM rows WHERE label <> 9 GROUP BY GROUPING SETS ((year), ())""", name="clean_stored_vectors")
def clean_vector_folder(spark, folder):
    """Stored vectors of two lengths, cleaned into another folder with a manifest."""
    path, out = scratch_path(spark, "vectors"), scratch_path(spark, "cleaned")
    vector = F.when(F.col("label") == 9, F.slice("embedding", 1, 16)).otherwise(F.col("embedding"))
    rows = table(spark, folder, "embeddings").select(
        F.lit("m").alias("model"), F.when(F.col("vec_id") % 2 == 0, "2024").otherwise("2025").alias("year"),
        F.col("vec_id").cast("string").alias("paper_id"), vector.alias("embedding"), F.lit("t").alias("generated_at"),
        F.size(vector).alias("model_dim"), F.lit("s").alias("source"),
    )
    write_vectors(rows, path)
    report = clean_stored_vectors(spark, path, "m", out).select(F.lit("report").alias("part"), "year", "dim", "rows", "kept")
    stored = spark.read.schema(schemas.VECTOR_TABLE).parquet(out).groupBy("year", F.size("embedding").alias("dim")).agg(F.count("*").alias("rows"))
    manifest = spark.read.schema("model string, year string, rows long, dimension int").json(f"{out}/_manifest/m")
    manifest = manifest.select(F.nullif("year", F.lit("total")).alias("year"), F.col("dimension").alias("dim"), "rows")
    for name, part in (("stored", stored), ("manifest", manifest)):
        report = report.unionByName(part.withColumns({"part": F.lit(name), "kept": F.lit(True)}))
    return report


@query("""
SELECT '20240202-000000' AS run_id, 'recommended.parquet' AS file, count(*) AS rows FROM embeddings""", name="latest_run")
def find_latest_run(spark, folder):
    """Two runs are written; the newer one has both outputs, a third folder has none."""
    root = scratch_path(spark, "runs")
    rows = vec_a(spark, folder)
    write_run(rows, rows.select("id"), root, "20240101-000000")
    write_run(rows, rows.select("id"), root, "20240202-000000")
    write_table(rows.select("id"), f"{root}/run_id=20240303-000000/notes.parquet")
    where = r"run_id=([^/]*)/([^/]*)/"
    files = list_files(spark, root).select(
        F.regexp_extract("path", where, 1).alias("run_id"),
        F.regexp_extract("path", where, 2).alias("file"),
    )
    best = latest_run(files.distinct()).first()
    output = spark.read.parquet(f"{root}/run_id={best['run_id']}/{best['file']}")
    return output.agg(F.count("*").alias("rows")).select(
        F.lit(best["run_id"]).alias("run_id"), F.lit(best["file"]).alias("file"), "rows"
    )
