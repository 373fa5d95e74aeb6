"""The stages one by one on planted documents, and the whole run on the smallest table."""

import corpus_pipeline as cp
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_columns_and_clean_documents(spark, docs, sentences):
    a, b, c, d = sentences
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    long = " ".join(sentences)
    table = docs([(1, long), (2, long.replace("quick", "slow")), (3, f"Other text. {bench} End."), (4, d), (5, ""), (None, a), (6, None)])
    near = cp.one_of_each_group(spark, table, SF)
    assert near.columns == table.columns and {r["doc_id"] for r in near.collect()} == {1, 3, 4, 5, 6, None}
    clean = cp.without_benchmark(spark, table, SF)
    assert clean.columns == table.columns and {r["doc_id"] for r in clean.collect()} == {1, 2, 4, 5, 6, None}
    lines = cp.unique_lines(spark, table, SF)
    assert lines.columns == table.columns and {r["doc_id"] for r in lines.collect()} == {1, 3, 4, 5, 6, None}
    scored = cp.good_quality(spark, table, SF)
    assert scored.columns == table.columns


def test_run(spark):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n <> 2048").count()
    assert out.count() > 0 and full <= 1


def test_stages_on_odd_tables(spark, docs, sentences):
    """Repeated rows and ids, nulls, a very long text, clashing columns, and an empty table, in every stage."""
    long = " ".join(sentences)
    rows = [(1, long), (1, long), (1, "another text of the same id, long enough to be read by all of us"), (None, None), (None, long), (2, ""), (3, "word " * 60_000), (4, "x")]
    table = docs(rows).selectExpr("*", "5 as n", "'y' as component_id", "6 as drop", "7 as kept", "8 as row")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, table, SF)
        assert out.columns == table.columns, name
        assert out.count() <= len(rows), name
        assert stage(spark, table.limit(0), SF).count() == 0, name
    near = sorted(map(str, (r["doc_id"] for r in cp.one_of_each_group(spark, table, SF).collect())))
    assert near == ["1", "1", "2", "3", "4", "None"]  # one of the three equal long texts; texts without words all stay
    pieces = cp.packed(spark, table, SF)
    assert pieces.count() >= len(rows) and cp.packed(spark, table.limit(0), SF).count() == 0
