"""Short benchmark items, salts that follow the table, the classifier's row bound."""

from pyspark.sql import functions as F

from daygrain.llm import decontaminate, line_dedup, quality_gbt
from tests.llm.helpers import documents


def test_short_items_are_found_as_whole_words_alone(spark):
    docs = spark.createDataFrame([(1, "Another day, however"), (2, "The day"), (3, "a day"), (4, "day, the"), (5, "lathe"), (6, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the"), (2, "a"), (3, "day, however"), (4, "!"), (5, "")], "item_id long, text string")
    got = {r["doc_id"]: [m["item_id"] for m in r["matches"]] for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: [3], 2: [1], 3: [2], 4: [1], 5: [], 6: []}
    long = decontaminate.contamination(docs, items, least_chars=5)
    assert {r["doc_id"]: [m["item_id"] for m in r["matches"]] for r in long.collect()} == {1: [3], 2: [], 3: [], 4: [], 5: [], 6: []}


def test_items_with_a_budget_need_no_word_borders(spark):
    item = "a longer item of some words to find"
    docs = spark.createDataFrame([(1, "xx" + item.replace("some", "sone") + "yy"), (2, item[:20])], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: [(m["item_id"], m["errors"]) for m in r["matches"]] for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: [(1, 1)], 2: []}


def test_line_dedup_salts_follow_the_number_of_documents(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a line that all have\nown line number "), F.col("id")).alias("text"))
    got = line_dedup.dedup_lines(docs).agg(F.sum("n_dropped"), F.min(F.when(F.col("n_dropped") == 0, F.col("doc_id"))), F.count_if(F.col("n_dropped") == 0)).first()
    assert tuple(got) == (2999, 0, 1)


def test_classifier_learns_from_a_bounded_number_of_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_gbt, "fit_forest", lambda x, y: seen.append(len(y)))
    docs = documents(spark, ["words of a text " * 5] * 20)
    docs = docs.unionByName(docs).unionByName(docs)  # every id three times
    labels = spark.range(20).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    for bound, wanted in ((8, 8), (20, 20), (100, 60)):
        quality_gbt.train(docs, labels, fit_rows=bound)
        assert seen.pop() == wanted
