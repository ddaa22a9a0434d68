import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from feedloom.llm import pipeline


def test_stages(spark, folder):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefghilmnorstu") for _ in range(draw.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(40)
    rows = [(i, text(30) + (" vermin " if i % 3 == 0 else " ") + text(30), "en", "s", 1) for i in range(600)]
    rows += [
        (1001, rows[1][1], "en", "s", 1), (1002, rows[1][1].upper(), "en", "s", 1), (1003, text(20) + " " + passage, "en", "s", 1),
        (1004, "key: password=abcdefgh12 " + text(30), "en", "s", 1), (1005, None, None, None, None), (1006, "", "en", "s", 0),
        (None, text(50), "en", "s", 1), (1007, text(44), "en", "s", 1), (1007, text(44), "en", "s", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, folder)
        assert frame.columns == docs.columns, name
    kept = {r.doc_id: r for r in frame.collect()}
    assert {i for i in kept if i is not None and i < 600} == {i for i in range(600) if i % 3}
    assert {i for i in kept if i is None or i > 600} == {1004, 1005, None, 1007}
    assert kept[1004].text.startswith("key: [SECRET] ") and kept[1004].n_chars == len(kept[1004].text)
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = out.collect()
    assert {r.doc_id for r in rows} == kept.keys()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = []
    for row in frame.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        want.append((row.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_clashing_columns_and_empty_tables(spark, folder):
    draw = random.Random(5)
    text = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage = text(30)
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, i % 2) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    kind = "doc_id long, text string, lang string, source string, n_chars long, _nth string, _ROW_KEY string, _toxicity int, uid long, fp string"
    rows = [(i, text(40) + (" vermin scum" if i % 2 else ""), "en", "s", 1, "nth", "key", 7, 8, "fp") for i in range(60)]
    rows += [(100, text(9) + " " + passage, "en", "s", 1, "nth", "key", 7, 8, "fp"), rows[0], (101, rows[2][1], *rows[2][2:])]
    docs = spark.createDataFrame(rows, kind)
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [field.split()[0] for field in kind.split(", ")], name
        assert {tuple(r)[5:] for r in docs.collect()} == {("nth", "key", 7, 8, "fp")}, name
    assert sorted(r.doc_id for r in docs.collect()) == list(range(0, 60, 2))
    spark.createDataFrame([], kind).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_rows_are_decided_one_by_one(spark, folder):
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefghilmnorstu") for _ in range(draw.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, near = text(40), text(60)
    leaked = text(20) + " " + passage
    docs = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    row = lambda i, t, s="s": (i, t, "en", s, 1)
    clean = [row(None, text(50)), row(None, text(50)), row(3, text(50)), row(4, None), row(None, None)]
    dropped = [row(None, leaked), row(3, leaked), row(5, leaked)]
    got = pipeline.drop_contaminated(spark, spark.createDataFrame(clean + dropped, docs), folder)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(clean, key=str)

    a, b, c, d = (text(50) for _ in range(4))
    kept = [row(2, near), row(7, a), row(7, b), row(9, c), row(None, d), row(None, d), row(None, text(50))]
    dropped = [row(7, near.upper()), row(9, near.upper()), row(7, a, "t"), row(9, c), row(8, b), row(None, near)]
    stage = pipeline.keep_one_of_near_copies
    for rows in (kept + dropped, dropped + kept):
        got = stage(spark, spark.createDataFrame(rows, docs).repartition(3), folder)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(kept, key=str)
    assert stage(spark, spark.createDataFrame([], docs), folder).count() == 0
