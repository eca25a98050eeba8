"""The pipeline against its stages by hand, on a small corpus."""

import corpus_pipeline as cp
from pyspark.sql import functions as F

from playlore.llm import mixing

def line(k: int) -> str:
    return " ".join(f"w{(k * 37 + 11 * j) % 997}x{k}" for j in range(14)) + " sun."


def test_pipeline(spark, tmp_path):
    other = [line(i) for i in range(40)]
    rows = [
        (1, "\n".join(other[:5]), "en", "s", 0), (2, "\n".join(["An own line of more than ten words that is in no other text.", *other[1:3]]), "en", "s", 0),
        (3, "Home | News\n" * 20, "en", "s", 0), (4, None, "en", "s", 0), (5, " ".join(other[10:14]), "en", "s", 0), (6, " ".join(other[10:14]).replace("sun.", "Sun!", 1), "en", "s", 0),
        (7, "\n".join(other[20:22]), "en", None, 0), (8, "\n".join(other[20:22]), "en", "t", 0), (9, f"{other[30]}\nHome | News | More", "en", "t", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    step = docs
    kept = []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = str(tmp_path / f"out{k}")
        stage(spark, step, str(tmp_path)).write.parquet(out)
        step = spark.read.parquet(out)
        kept.append(step)
        if k < len(cp.STAGES) - 1:
            assert step.columns == list(cp.COLUMNS)
    ids = [sorted(r.doc_id for r in d.select("doc_id").distinct().collect()) for d in kept]
    assert ids[0] == [1, 2, 5, 6, 7, 8, 9]
    texts = {r.doc_id: r.text for r in kept[1].collect()}
    assert texts[2] == "An own line of more than ten words that is in no other text." and 8 not in texts
    assert texts[9] == other[30]
    assert ids[2] == [1, 2, 5, 7, 9]
    want = {r.doc_id: r.repeats for r in mixing.draw(kept[2], mixing.source_rates(kept[2])).collect()}
    assert {r.doc_id: r.n for r in kept[3].groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {k: v for k, v in want.items() if v}
    assert kept[4].filter("piece = 0").count() == sum(want.values())
    again = cp.run(spark, str(tmp_path))
    assert sorted(map(repr, again.select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted(map(repr, kept[4].select("doc_id", "piece", "start", "length", "ids_crc32").collect()))


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_each_stage_with_null_ids_repeated_rows_and_clashing_columns(spark, tmp_path):
    """Rows without an id stay apart, repeated rows are one document, and columns beyond those of documents are left behind."""
    line = lambda k: " ".join(f"word{k}x{i}" for i in range(15)) + "."
    rows = [(i, "\n".join(line(5 * i + j) for j in range(5)), "en", "s", 1) for i in range(6)]
    rows += [rows[0], rows[0], (None, "\n".join(line(100 + j) for j in range(5)), None, None, None), (None, None, "en", "s", 0), (7, "", "en", "s", 0), (8, "long " + " ".join(f"w{i}" for i in range(40_000)) + ".", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("clean_text", "kept", "row_key", "component_id", "maybe", "copy", "rate", "piece", "n"):
        docs = docs.withColumn(c, F.lit("clash"))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert tuple(out.columns) == cp.COLUMNS, name
        got = out.collect()
        if name != "mixing sources to target weights":
            assert {r.doc_id for r in got} >= {0, 1, 2, 3, 4, 5, 8}, name
            assert sum(r.doc_id is None and r.text is not None for r in got) == 1, name
        if name == "n-gram Jaccard join":
            assert sum(r.doc_id == 0 for r in got) == 1
    pieces = cp.packing_stage(spark, docs, str(tmp_path)).collect()
    assert sum(r.doc_id == 0 for r in pieces) == 3 and sum(r.length for r in pieces if r.doc_id == 7) == 1


def test_unrelated_texts_of_one_id_all_stay(spark):
    """Rows are spare only if equal to or linked with one that stays, whatever their ids."""
    body = lambda k: " ".join(f"t{k}w{i}" for i in range(60))
    rows = [(5, body(1)), (5, body(2)), (5, body(2)), (9, body(2) + " more"), (3, body(4)), (5, None), (None, body(1)), (7, body(7))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((repr(r.doc_id), r.text or "") for r in cp.near_dup_stage(spark, docs, "").collect())
    assert got == sorted((repr(i), t or "") for i, t in [(5, body(1)), (5, body(2)), (3, body(4)), (5, None), (None, body(1)), (7, body(7))])
