"""Rows without an id in the n-gram join: each is a row of its own."""

from tidemark.llm import ngram_join


def test_one_of_each_with_null_ids(spark):
    base = [" ".join(f"w{g}_{i}" for i in range(60)) for g in range(4)]
    near = [x + " more" for x in base]
    rows = [(None, base[0], 1), (None, near[0], 2), (None, base[0], 3), (7, near[1], 4), (None, base[1], 5), (9, base[1], 6), (None, base[2], 7), (3, base[3], 8), (None, None, 9), (None, "", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").coalesce(1)
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["n"] for r in kept.collect()) == [1, 4, 7, 8, 9, 10]
    found = ngram_join.classes(df).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found if r["doc_id"]) == [(3, 3), (7, 7), (9, 7)]
    assert sorted(str(r["component_id"]) for r in found if not r["doc_id"]) == sorted(["None"] * 6 + ["7"])


def test_null_ids_do_not_meet_each_other(spark):
    """120 different texts without ids, each with a copy: texts shingled for the join are no more than there are classes."""
    texts = [" ".join(f"t{g}_{i}" for i in range(30)) for g in range(120)]
    df = spark.createDataFrame([(None, x) for x in texts * 2], "doc_id long, text string")
    assert ngram_join.one_of_each(df).count() == 120
