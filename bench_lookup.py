"""Time the lookup of 256 ids among 146,636 vectors of 1024 floats, made of the given embeddings: prints one JSON line.

Folder: $BENCH_SF_DIR, cores: $BENCH_CPUS. The table is stored as `write_vectors` stores vectors: by year, sorted by id, with
Bloom filters. Timed are batches of 256 random ids each, as a list in the scan's filter and as a table in a semi-join.
"""

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from feedloom.operators.candidates import lookup_by_id, lookup_listed
from feedloom.operators.sampling import random_id_batches
from feedloom.session import build_session, scratch_path
from feedloom.sources.writers import write_vectors

ROWS, DIM, BATCHES, IDS = 146_636, 1024, 12, 256


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("lookup", **{"spark.master": f"local[{cores}]", "spark.sql.shuffle.partitions": cores, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    given = spark.read.parquet(f"{folder}/embeddings.parquet")
    copies = -(-ROWS // given.count())
    rows = given.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "embedding").limit(ROWS)
    longer = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(DIM // 64)), lambda k: F.transform("embedding", lambda x: x * (k + F.col("copy")).cast("float"))))
    name = F.concat(F.lit("2401."), F.lpad((F.col("vec_id") * copies + F.col("copy")).cast("string"), 7, "0"))
    path = scratch_path(spark, "lookup")
    stored = rows.repartition(int(cores)).select(
        F.lit("m").alias("model"), F.lit("2024").alias("year"), name.alias("paper_id"), longer.cast("array<float>").alias("embedding"),
        F.lit("t").alias("generated_at"), F.lit(DIM).alias("model_dim"), F.lit("bench").alias("source"),
    )
    write_vectors(stored, path)
    table = spark.read.parquet(path)
    batches: dict[int, list[str]] = {}
    for row in random_id_batches(table, BATCHES, IDS, 1).collect():
        batches.setdefault(row["batch"], []).append(row["paper_id"])
    times: dict[str, list[float]] = {"listed": [], "joined": []}
    for ids in batches.values():
        wanted = spark.createDataFrame([(i,) for i in ids], "paper_id string")
        for kind, find in (("listed", lambda ids=ids: lookup_listed(table, ids)), ("joined", lambda wanted=wanted: lookup_by_id(table, wanted))):
            start = time.perf_counter()
            assert find().select("paper_id", "embedding").toArrow().num_rows == IDS
            times[kind].append(time.perf_counter() - start)
    print(json.dumps({"rows": ROWS, "dim": DIM, "ids": IDS, **{k: round(statistics.median(v), 3) for k, v in times.items()}, "first": {k: round(v[0], 3) for k, v in times.items()}}))
    spark.stop()


if __name__ == "__main__":
    main()
