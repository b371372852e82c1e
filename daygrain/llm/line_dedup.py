"""Line dedup: hashes range-partitioned with a secondary sort, answers as keep bitmaps.

Main path: DataFrame functions only. Each line of at least ``min_chars`` code points (after
stripping and lower-casing ASCII letters) becomes one narrow row of hash, document and
position; no text is shuffled to find duplicates.

1. The rows are range-partitioned by (hash, salt) and sorted by (hash, salt, document,
   position). A running first value goes over each (hash, salt) run (the window keeps one run, and spills it if it is long): rows of a later
   document than the run's first are dropped. The salt comes from the document, so a line
   that a third of all documents hold is spread over ``salts`` runs.
2. What is left, at most ``salts`` documents of each hash, goes through the same pass by hash alone.

The salts grow with the square root of the number of documents, so neither pass has a run of more documents than about that.

The dropped positions become one bitmap a document: (word index, 64 bits) for the words with a
dropped line, sorted; an absent word keeps all its lines. ``apply_bitmaps`` joins them with the texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from daygrain.llm.common import NULL_ID, as_table, ascii_lower, fresh

#: Stripped at both ends of a line (fixed values): space and U+0009 to U+000D.
BLANK = " \t\n\x0b\f\r"
MIN_CHARS = 10
LEAST_SALTS = 32


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    return (F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))


def _later_than_first(rows: DataFrame, *run: str) -> DataFrame:
    """Adds ``late``: the run holds the same hash in a document before this row's."""
    rows = rows.repartitionByRange(*run).sortWithinPartitions(*run, "doc", "pos")
    w = Window.partitionBy(*run).orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("late", F.col("doc") > F.first("doc").over(w))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = MIN_CHARS, salts: int | None = None) -> DataFrame:
    """(doc, text_hash, dropped) for each document that loses lines.

    ``dropped`` is an array of (word, bits): bit ``p % 64`` of word ``p // 64`` is set if line
    ``p`` goes. Null ids count as one document after all others; rows that share an id are one
    document for the decision and keep a bitmap for each distinct text. An empty table gives no rows.
    """
    doc, text_hash = _row_key(docs, id_col, text_col)
    salts = salts or max(LEAST_SALTS, math.isqrt(docs.count()))
    keys = docs.select(doc.alias("doc"), text_hash.alias("text_hash"),
                       F.posexplode(F.transform(lines_of(F.col(text_col)), line_key)).alias("pos", "key"))
    rows = as_table(keys.where(F.length("key") >= min_chars).select(
        "doc", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2")))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)))
    first = _later_than_first(rows, "h1", "h2", "salt")
    second = _later_than_first(first.where(~F.col("late")).drop("late"), "h1", "h2")
    out = [x.where("late").select("doc", "text_hash", "pos") for x in (first, second)]
    words = (out[0].unionByName(out[1]).repartition("doc", "text_hash")
             .groupBy("doc", "text_hash", F.shiftright("pos", 6).alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, pos & 63))").alias("bits")))
    return words.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept`` (the kept lines joined by a line feed).

    These names replace columns of ``docs`` that have them.
    """
    doc, text_hash = _row_key(docs, id_col, text_col)
    tag = fresh(docs, "_bitmap")
    left = docs.withColumn(tag, F.struct(doc.alias("doc"), text_hash.alias("text_hash")))
    joined = left.join(bitmaps.withColumnRenamed("dropped", tag + "_words"),
                       (F.col(f"{tag}.doc") == bitmaps["doc"]) & (F.col(f"{tag}.text_hash") == bitmaps["text_hash"]), "left")
    joined = joined.drop(bitmaps["doc"], bitmaps["text_hash"])
    words, lines = F.col(tag + "_words"), lines_of(F.col(text_col))
    n_lines = F.size(lines).cast("long")
    dropped = F.aggregate(words, F.lit(0), lambda n, w: n + F.bit_count(w["bits"])).cast("long")
    #: all words up to the last dropped line, so that a line finds its word by index
    by_word = F.map_from_entries(words)
    dense = F.transform(F.sequence(F.lit(0), F.element_at(words, -1)["word"]),
                        lambda i: F.coalesce(F.try_element_at(by_word, i), F.lit(0).cast("long")))
    def keep(d: Column) -> Column:
        word = lambda i: F.coalesce(F.get(d, F.call_function("shiftright", i, F.lit(6))), F.lit(0).cast("long"))
        bit = lambda i: F.call_function("shiftright", word(i), i.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1))
        return F.array_join(F.filter(lines, lambda _, i: bit(i) == 0), "\n")

    # the outer transform binds the dense words once for all lines
    kept = F.get(F.transform(F.array(dense), keep), F.lit(0))
    joined = joined.withColumns({
        "n_lines": n_lines, "n_dropped": F.coalesce(dropped, F.lit(0).cast("long")),
        "kept": F.when(words.isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(kept)})
    return joined.drop(tag, tag + "_words")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS, salts: int | None = None) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept``.

    Keys of at least ``min_chars`` code points that two or more documents hold lose all their
    lines but those of the smallest id. Repeated lines within that document stay.
    """
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, min_chars, salts), id_col, text_col)
