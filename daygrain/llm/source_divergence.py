"""Source divergence audit: term counts from sorted pointers, then smoothed shares compared between sources.

Texts are cut into slices of bounded size (or one text), their documents ordered by language and source. In a slice, the
texts form one buffer of bytes; a pointer marks the start of each word. The pointers are sorted by the words they
point to with a multikey quicksort whose symbols are eight bytes: a level sorts by one symbol, and only runs of equal symbols
whose words go on are sorted by the next. The sort keeps equal words in the order of the buffer, so an equal run holds a term's
occurrences by language, source and document: its breaks give the term's document frequency and its counts per source.

Only (language, source, term, documents, count) rows leave a slice. They are summed by all three names, so a term or a source that
everything has is no task of its own. Shares are whole numbers (``share``), computed exactly. Pairs of sources are
compared in blocks of terms: a task holds sources x terms of one block and sends one partial sum a pair of sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from daygrain.llm.common import as_table

MIN_DOCS = 30
TOP_TERMS = 50
SMOOTHING = 5
UNIT = 10**9
SLICE_BYTES = 4_000_000
BLOCK_TERMS = 2048
CHUNK_SOURCES = 256
BLOCK_CELLS = 1 << 21
SYMBOL = 8

#: Of bytes: a-z and all parts of other characters stay, A-Z are lower-cased, the rest are 0.
_LETTERS = np.array([c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0 for c in range(256)], np.uint8)
_COUNTS = "lang string, source string, term string, docs long, n long"


def word_pointers(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each run of bytes that are not 0."""
    edge = np.flatnonzero(np.diff(np.r_[False, buffer != 0, False].astype(np.int8)))
    return edge[::2], edge[1::2]


def sort_pointers(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads): pointers by their words' bytes, equal words in the given order; heads mark the first of each equal run."""
    padded = np.r_[buffer, np.zeros(SYMBOL, np.uint8)]
    symbols = np.ndarray(len(buffer) + 1, ">u8", padded.data, strides=(1,))
    mask = np.array([0] + [2**64 - 2 ** (64 - 8 * i) for i in range(1, SYMBOL + 1)], np.uint64)
    order, heads = np.arange(len(start)), np.zeros(len(start), bool)
    if not len(start):
        return order, heads
    heads[0] = True
    slots, run, depth = order.copy(), np.zeros(len(start), np.int64), 0  # the slots still to be sorted, and their runs
    while len(slots):
        own = order[slots]
        left = end[own] - start[own] - depth
        key = symbols[np.minimum(start[own] + depth, len(buffer))].astype(np.uint64) & mask[np.clip(left, 0, SYMBOL)]
        by = np.lexsort((key, run)) if depth else np.argsort(key, kind="stable")
        own, key, run, left = own[by], key[by], run[by], left[by]
        order[slots] = own
        new = np.r_[True, (key[1:] != key[:-1]) | (run[1:] != run[:-1])]
        heads[slots] |= new
        runs = np.cumsum(new) - 1
        #: a word that ends with this symbol has 0 as its next one, which no other word holds
        on = (np.bincount(runs) > 1)[runs] & (np.bincount(runs, left > SYMBOL) > 0)[runs]
        slots, run, depth = slots[on], runs[on], depth + SYMBOL
    return order, heads


def slice_counts(texts: list[bytes], group: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, documents, count) of a slice whose documents are ordered by group."""
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    buffer = _LETTERS[raw]
    start, end = word_pointers(buffer)
    if not len(start):
        none = np.zeros(0, np.int64)
        return [], none, none, none
    bounds = np.cumsum([len(t) + 1 for t in texts])
    order, heads = sort_pointers(buffer, start, end)
    doc = np.searchsorted(bounds, start[order], side="right")
    part = heads | np.r_[True, group[doc[1:]] != group[doc[:-1]]]
    first = np.flatnonzero(part)
    count = np.diff(np.r_[first, len(order)])
    docs = np.add.reduceat((part | np.r_[True, doc[1:] != doc[:-1]]).astype(np.int64), first)
    data = buffer.tobytes()
    terms, said = [], b""
    for head, s, e in zip(heads[first].tolist(), start[order[first]].tolist(), end[order[first]].tolist()):
        said = data[s:e] if head else said
        terms.append(said)
    return terms, group[doc[first]], docs, count


def _count(slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            lang, source = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for x, y, text in zip(lang, source, batch.column(2).cast(pa.large_binary())):
                text = text.as_py()
                if rows and size + len(text) > slice_bytes:
                    yield from _slice(rows)
                    rows, size = [], 0
                rows.append((x, y, text))
                size += len(text) + 1
        if rows:
            yield from _slice(rows)
    return run


def _slice(rows: list[tuple[str, str, bytes]]) -> Iterator[pa.RecordBatch]:
    rows.sort(key=lambda r: r[:2])
    names, group = [], []
    for x, y, _ in rows:
        if not names or names[-1] != (x, y):
            names.append((x, y))
        group.append(len(names) - 1)
    terms, of, docs, count = slice_counts([t for *_, t in rows], np.array(group, np.int64))
    lang, source = (pa.array([n[i] for n in names], pa.string()) for i in (0, 1))
    of = pa.array(of, pa.int64())
    for i in range(0, len(terms), 1 << 16):
        at = slice(i, i + (1 << 16))
        part = of[at]
        yield pa.RecordBatch.from_arrays([lang.take(part), source.take(part), pa.array(terms[at], pa.binary()).cast(pa.string()),
                                          pa.array(docs[at], pa.int64()), pa.array(count[at], pa.int64())],
                                         ["lang", "source", "term", "docs", "n"])


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
                min_docs: int = MIN_DOCS, slice_bytes: int = SLICE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(counts, groups): (lang, source, term, n) of each language's terms in at least ``min_docs`` of its documents, and
    every (lang, source) that occurs. Null texts, languages and sources count as ''."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(said(lang_col).alias("lang"), said(source_col).alias("source"), said(text_col).alias("text"))
    summed = as_table(rows.mapInArrow(_count(slice_bytes), _COUNTS).groupBy("lang", "source", "term")
                      .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")))
    kept = summed.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term")
    counts = as_table(summed.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"))
    return counts, as_table(rows.select("lang", "source").distinct())


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)) without rounding; null where a language keeps no term."""
    whole = lambda c: c.cast("decimal(20,0)")
    above = F.lit(UNIT).cast("decimal(10,0)") * whole(n + SMOOTHING)
    below = whole(total + F.lit(SMOOTHING) * terms)
    return F.lit(1).cast("long") + F.call_function("div", above, F.when(below > 0, below))


def _pair_sums(key: tuple, cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Sums of |p - q| over a block's terms for the pairs whose first source is of the chunk; ``cells`` has the terms that a source holds."""
    lang, _, chunk = key
    groups = groups.sort_values("source", ignore_index=True)
    names, none = groups["source"].to_numpy(), groups["none"].to_numpy(np.int64)
    firsts = np.flatnonzero(groups["own_chunk"].to_numpy() == chunk)
    of = pd.Index(names).get_indexer(cells["source"])
    term, terms = pd.factorize(cells["term"])
    said = cells["p"].to_numpy(np.int64)
    total = np.zeros((len(firsts), len(names)), np.int64)
    step = max(1, BLOCK_CELLS // max(1, len(names)))
    for x in range(0, len(terms), step):
        p = np.repeat(none[:, None], min(step, len(terms) - x), axis=1)
        own = (term >= x) & (term < x + step)
        p[of[own], term[own] - x] = said[own]
        for row, i in enumerate(firsts):
            total[row, i + 1:] += np.abs(p[i + 1:] - p[i]).sum(axis=1)
    row, j = np.nonzero(np.arange(len(names)) > firsts[:, None])
    return pd.DataFrame({"lang": lang, "a": names[firsts[row]], "b": names[j], "value": total[row, j]})


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS,
          top_terms: int = TOP_TERMS, slice_bytes: int = SLICE_BYTES, block_terms: int = BLOCK_TERMS,
          chunk_sources: int = CHUNK_SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source's use of its language's terms departs from the others'.

    Part ``pair``: the other sources of the language by the summed difference of all kept terms' shares (0 where no term is
    kept). Part ``term``: the kept terms that the source has and uses more than its language, by the difference, the first
    ``top_terms``. Equal values are ranked by the item's bytes. Null names and texts count as ''; repeated rows are
    documents of their own; a language with one source has no pairs; an empty table gives no rows.
    """
    counts, groups = term_counts(docs, lang_col, source_col, text_col, min_docs, slice_bytes)
    whole = as_table(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")))
    langs = whole.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    groups = as_table(groups.join(of, "lang").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", "sources", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), "lang_total"))
    groups = groups.withColumn("none", share(F.lit(0), F.col("total"), F.col("terms")))
    cells = counts.join(groups.drop("none"), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))

    used = cells.join(whole, ["lang", "term"]).withColumn("value", F.col("p") - share(F.col("lang_n"), F.col("lang_total"), F.col("terms")))
    terms = used.where("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    #: a task has about block_terms terms of every source, and the pairs of about chunk_sources sources with all others
    blocks = F.greatest(F.ceil(F.col("terms") / block_terms), F.lit(1)).cast("int")
    chunks = F.ceil(F.col("sources") / chunk_sources).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = (cells.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"), every(chunks).alias("chunk")))
    sides = (groups.where("terms > 0").select("lang", "source", "none", F.pmod(F.xxhash64("source"), chunks).cast("int").alias("own_chunk"),
                                              every(blocks).alias("block"), chunks.alias("chunks"))
             .select("lang", "source", "none", "own_chunk", "block", every(F.col("chunks")).alias("chunk")))
    sums = (dealt.groupBy("lang", "block", "chunk").cogroup(sides.groupBy("lang", "block", "chunk"))
            .applyInPandas(_pair_sums, "lang string, a string, b string, value long"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).select("lang", both.alias("x"), "value").select("lang", "x.*", "value")
    bare = groups.where("terms = 0")
    other = bare.select("lang", F.col("source").alias("item"))
    empty = bare.select("lang", "source").join(other, "lang").where("source != item").withColumn("value", F.lit(0).cast("long"))
    pairs = pairs.unionByName(empty).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    return (terms.withColumn("rank", rank).where(F.col("rank") <= top_terms)
            .unionByName(pairs.withColumn("rank", rank)).select("lang", "source", "part", "item", "value", "rank"))
