"""Ranked search, licence scans and the divergence audit against brute force and SQL, and on odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from daygrain.llm import lexical_rank, license_index, queries, source_divergence
from tests.llm.helpers import ODD_TEXTS, SF, documents, same_as_oracle, write

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- 11 --------------------------------------------------------------------------------------------------------------
def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def _ranked(docs, items, k=10):
    """(item, rank, doc, score) by the contract's definition."""
    bags = [(i, Counter(_terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(_terms(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for doc, bag in bags:
            m = 10 + 90 * bag.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
                    for t in terms if t in bag)
            if s > 0:
                scores.append((-s, doc is None, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def _got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"item_tile": 2, "term_tile": 3, "doc_tile": 4}, {"block_chars": 60, "doc_tile": 7}])
def test_lexical_rank_equals_brute_force(spark, sizes):
    rng = random.Random(3)
    vocabulary = ["a", "école", "漢字", "B2B", "x1", "line", "shared", "ß"] + [f"w{i}" for i in range(30)]
    docs = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    docs += [(100 + i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 40)))) for i in range(120)]
    docs += [(300 + i, "the same tied text of w1 and w2") for i in range(40)] + [(None, "w1 alone"), (None, "w1 alone"), (5, "w1 twice"), (5, "w1 twice")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(9)]
    items += [(20, None), (21, ""), (22, "none-of-these wordswords"), (23, "tied TEXT of W1"), (23, "w2 too"), (None, "école"), (24, "word"), (24, "word")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("mine"), "rank": F.lit(1), "id": F.lit(2)}).repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("mine"))
    assert _got(lexical_rank.rank_documents(d, q, **sizes)) == _ranked(docs, items)


def test_lexical_rank_empty_tables(spark):
    docs, items = documents(spark), spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert lexical_rank.rank_documents(docs.limit(0), items).count() == 0
    assert lexical_rank.rank_documents(docs, items.limit(0)).count() == 0
    assert lexical_rank.rank_documents(docs.withColumn("text", F.lit(None).cast("string")), items).count() == 0


def test_lexical_rank_query_equals_sql(spark):
    same_as_oracle(queries.op11_lexical_rank(spark, SF), SF, queries.SQL_LEXICAL_RANK, "documents", "benchmark")


def test_lexical_partial_sums_stay_exact():
    weights = np.full(50_000, lexical_rank.weight(2**61, 0), np.int64)
    items = [(0, np.arange(50_000)), (1, np.arange(3))]
    for term_tile in (4096, 10**9):
        tiles = list(lexical_rank.item_tiles(items, weights, term_tile=term_tile))
        assert all(part.matrix.sum(axis=0).max() * lexical_rank.IMPACT_BOUND < lexical_rank.EXACT for _, parts in tiles for part in parts)
        assert sum(part.matrix.sum() for _, parts in tiles for part in parts) == 50_003 * weights[0]
    heavy = list(lexical_rank.item_tiles(items, weights * 10**5, term_tile=10**9))
    assert len(heavy[0][1]) > 1 and all(p.matrix.sum(axis=0).max() * lexical_rank.IMPACT_BOUND < lexical_rank.EXACT for p in heavy[0][1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 30)), max_size=60), st.integers(1, 5), st.integers(1, 9))
def test_lexical_best_rows_do_not_depend_on_tiles(rows, k, tile):
    best = lexical_rank.Best(1, k)
    for i in range(0, len(rows), tile):
        part = np.array(rows[i:i + tile], np.int64)
        best.add(0, part[:, 1], part[:, :1])
    wanted = sorted((-s, d) for s, d in rows if s > 0)[:k]
    assert [(-s, d) for s, d in zip(best.score.tolist(), best.id.tolist())] == wanted


def test_lexical_words_of_long_texts():
    text = ("Word é9-_" * 400_000).encode()
    got = [w for part in lexical_rank.words(text) for w in part]
    assert got == text.decode().translate(LOWER).replace("-", " ").replace("_", " ").encode().split()
    assert len(list(lexical_rank.words(b"x" * 3_000_000))) == 1 and list(lexical_rank.words(None)) == []


# -- 12 --------------------------------------------------------------------------------------------------------------
LICENSED = ["CC BY, cc-by cc_by! ccby cc\nby", "GNU General  Public\tLicense, General Public License", "All Rights Reserved. all rights reserved all rights",
            "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "version 2 of Apache, a license",
            "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "cc " * 3000 + "by " * 3000,
            "cc by " * 20000, "the MIT license the mit license", "ALL RIGHTS RESERVED É cc by", "ÀLL rights reserved", "tous droits réservés by"]


def test_license_scan_equals_sql(spark):
    folder = write(spark, documents=documents(spark, ODD_TEXTS + LICENSED).withColumn("id", F.lit(5)).withColumn("words", F.lit("mine")))
    same_as_oracle(queries.op12_license_scan(spark, folder), folder, queries.SQL_LICENSE_SCAN, "documents")
    same_as_oracle(queries.op12_license_scan(spark, SF), SF, queries.SQL_LICENSE_SCAN, "documents")


def _phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = {t.label: [i for i in range(len(words)) if words[i:i + len(t.text.split())] == t.text.split()] for t in license_index.BASE}
    return len(words), places


def test_license_base_phrases_are_whole(spark):
    rng = random.Random(4)
    pieces = ["cc", "by", "CC-BY", "general", "public", "license", "all", "rights", "reserved", ",", "\n", "é", "mit", "the", "under", "4.0", "nc"]
    texts = ODD_TEXTS + LICENSED + [" ".join(rng.choices(pieces, k=rng.randint(0, 60))) for _ in range(400)]
    got = {r["id"]: r for r in license_index.scan_licenses(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        n, places = _phrases(text)
        assert got[i]["n_words"] == n
        assert {m["label"]: m["starts"] for m in got[i]["matches"] if m["base"]} == {k: v for k, v in places.items() if v}


def test_license_labels_of_the_method(spark):
    r = {x["doc_id"]: x for x in queries.op12_license_scan(spark, write(spark, documents=documents(spark, LICENSED))).collect()}
    assert [r[i]["labels"] for i in (3, 4, 6, 7)] == ["mit", "apache-2.0", "gpl,gpl-3.0", "cc-by,cc-by-nc-4.0"]
    assert r[5]["labels"] == "" and r[5]["score"] == 0.0 and r[3]["score"] == 1.0
    assert (r[0]["n_base"], r[0]["first_word"], r[0]["last_word"]) == (4, 0, 7)
    assert r[9]["n_base"] == 20000 and r[8]["n_base"] == 1 and r[8]["first_word"] == 2999


def test_license_templates():
    assert len({t.text for t in license_index.LIBRARY}) == len(license_index.LIBRARY)
    assert all(any(key for *_, key in t.words()) for t in license_index.LIBRARY)
    with pytest.raises(ValueError):
        license_index.Template("x", "one two three", ("one three",)).words()


def test_license_scan_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "cc by"), (None, "cc by"), (3, None), (3, "all rights reserved")], "doc_id long, text string")
    got = sorted((r["id"] is None, r["n_words"], [m["label"] for m in r["matches"]]) for r in license_index.scan_licenses(docs).collect())
    assert got == [(False, 0, []), (False, 3, ["reserved"]), (True, 2, ["cc-by"]), (True, 2, ["cc-by"])]
    assert license_index.scan_licenses(docs.limit(0)).count() == 0


def test_license_scan_is_native(spark):
    plan = queries.op12_license_scan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange|Join", plan)
    words = license_index.licence_words(documents(spark), "doc_id", "text", license_index.LIBRARY)
    assert not re.search("Python|Pandas|Arrow", words._jdf.queryExecution().executedPlan().toString().replace("ExistingRDD", ""))


# -- 13 --------------------------------------------------------------------------------------------------------------
@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abAÉ漢 -1", max_size=40) | st.sampled_from(["theaeati theaeation", "x" * 50 + " " + "x" * 49, ""]), max_size=12), st.data())
def test_divergence_slices_equal_counting(texts, data):
    group = np.array(sorted(data.draw(st.lists(st.integers(0, 2), min_size=len(texts), max_size=len(texts)))), np.int64)
    terms, of, docs, n = source_divergence.slice_counts([t.encode() for t in texts], group) if texts else ([], [], [], [])
    got = {(t.decode(), int(g)): (int(d), int(c)) for t, g, d, c in zip(terms, of, docs, n)}
    counts, held = Counter(), Counter()
    for t, g in zip(texts, group.tolist()):
        own = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER)))
        for w, c in own.items():
            counts[w, g] += c
            held[w, g] += 1
    assert got == {k: (held[k], counts[k]) for k in counts}
    assert len(terms) == len(got) and list(terms) == sorted(terms)


def test_divergence_sort_is_that_of_bytes():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 30))).encode() for _ in range(3000)] * 2
    buffer = np.frombuffer(b"\0".join(words), np.uint8)
    start, end = source_divergence.word_pointers(buffer)
    order, heads = source_divergence.sort_pointers(buffer, start, end)
    assert order.tolist() == sorted(range(len(words)), key=lambda i: (words[i], i))
    assert heads.sum() == len(set(words))


def _corpus(spark, partitions=4):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        lang, source = rng.choice(["en", "fr", None]), rng.choice(["hot"] * 6 + ["a", "b", "é", None])
        vocabulary = [f"common{'abcdefgh'[j]}" for j in range(8)] + [f"{source}own", "THEAEATI", "theaeation", "ünï"]
        rows.append((i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30))), lang, source))
    rows += [(900 + i, t, "odd", "s") for i, t in enumerate(ODD_TEXTS)] + [(990, None, "none", "x"), (991, None, "none", "y"), (991, None, "none", "y")]
    rows += [(992, "alone " * 50, "single", "only")] * 31
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs.withColumns({"n": F.lit("mine"), "docs": F.lit(1), "term": F.lit(2)}).repartition(partitions)


@pytest.mark.parametrize("sizes", [{}, {"slice_bytes": 300, "block_terms": 2, "chunk_sources": 2}])
def test_divergence_equals_sql(spark, sizes):
    docs = _corpus(spark)
    folder = write(spark, documents=docs)
    same_as_oracle(source_divergence.audit(docs, **sizes), folder, queries.SQL_SOURCE_DIVERGENCE, "documents")


def test_divergence_query_and_empty_table(spark):
    same_as_oracle(queries.op13_source_divergence(spark, SF), SF, queries.SQL_SOURCE_DIVERGENCE, "documents")
    assert source_divergence.audit(_corpus(spark).limit(0)).count() == 0
    bare = source_divergence.audit(_corpus(spark), min_docs=10**6).collect()
    assert bare and {(r["part"], r["value"]) for r in bare} == {("pair", 0)}


def test_divergence_shares_are_exact(spark):
    rows = [(10**17 + 7, 3 * 10**17 + 1, 10**9), (0, 0, 0), (0, 10, 3), (9 * 10**14, 9 * 10**14, 1)]
    df = spark.createDataFrame(rows, "n long, total long, terms long")
    got = [r[0] for r in df.select(source_divergence.share(F.col("n"), F.col("total"), F.col("terms"))).collect()]
    assert got == [1 + 10**9 * (n + 5) // (t + 5 * v) if v else None for n, t, v in rows]
