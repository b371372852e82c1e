"""Ranked lexical search: dense blocks of documents and items multiplied by BLAS, exact in float64.

Each document becomes its length and the counts of those of its terms that some item has (one pass over the texts,
written as a narrow table). Document frequencies come from that table. Items are cut into tiles; a tile has a compact
vocabulary of its own terms, cut into term tiles. A tile of documents is a dense matrix of impacts (documents x terms),
a tile of items one of weights (terms x items), and their product the partial scores. Impacts and weights are whole numbers,
and a term tile is only so wide that no partial sum reaches 2^53: float64 holds each one exactly, in any order of summation.
Partial scores are added as 64-bit integers. Each task keeps every item's best rows over its document tiles, with equal
scores by ascending id, so a tie is decided the same way whatever the tiling; the tasks' best rows are ranked once more.

Items are read in blocks of at most ``block_chars`` characters (or one item), so what is broadcast, and what the driver
holds, has a fixed bound; each block makes one pass over the documents, which never move.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from daygrain.llm.common import NULL_ID, Shared, as_table, ascii_lower

#: Characters that end a term (all others but A-Z, which are lower-cased, belong to one).
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Fixed values of the score: every impact is below 10^6.
SCALE, TF_SCALE, LENGTH_SCALE, IMPACT_BOUND = 10**9, 1000, 8, 10**6
EXACT = 2**53
BLOCK_CHARS = 16_000_000
ITEM_TILE = 64
TERM_TILE = 4096
DOC_TILE = 512
PIECE = 1 << 20
SALTS = 32

#: Of bytes: digits, a-z and all parts of other characters stay, A-Z are lower-cased, the rest are spaces.
_PLAIN = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def words(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in runs of about ``PIECE`` bytes, cut between terms."""
    plain, start = (text or b"").translate(_PLAIN), 0
    while start < len(plain):
        end = plain.find(b" ", start + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Vocabulary:
    """The distinct terms of a block of items; ``items`` are (id, indexes of its terms)."""

    def __init__(self, block: list[tuple[int | None, bytes]]):
        self.index: dict[bytes, int] = {}
        by_item = defaultdict(list)
        for item, term in block:
            by_item[item].append(self.index.setdefault(term, len(self.index)))
        self.items = [(i, np.array(t, np.int64)) for i, t in by_item.items()]


class TermTile:
    """The weights of a compact run of an item tile's terms: ``local`` maps the block's terms to columns, or -1."""

    def __init__(self, terms: np.ndarray, items: list[tuple], weights: np.ndarray):
        self.local = np.full(len(weights), -1, np.int32)
        self.local[terms] = np.arange(len(terms))
        self.matrix = np.zeros((len(terms), len(items)))
        for j, (_, own) in enumerate(items):
            column = self.local[own]
            self.matrix[column[column >= 0], j] = weights[own[column >= 0]]


def item_tiles(items: list[tuple], weights: np.ndarray, item_tile: int = ITEM_TILE, term_tile: int = TERM_TILE):
    """(first item, its term tiles) of each item tile; no sum over a term tile reaches 2^53."""
    most = max(1, (EXACT - 1) // (IMPACT_BOUND * max(1, int(weights.max(initial=1)))))
    width = min(term_tile, most)
    for at in range(0, len(items), item_tile):
        own = items[at:at + item_tile]
        terms = np.unique(np.concatenate([t for _, t in own]))
        yield at, [TermTile(terms[i:i + width], own, weights) for i in range(0, len(terms), width)]


class Best:
    """The ``k`` best (score, id) of each item so far: higher scores first, equal ones by ascending id."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.item = self.id = self.score = np.zeros(0, np.int64)
        #: a row must come before these to enter
        self.least, self.last = np.zeros(n_items, np.int64), np.full(n_items, -2**63, np.int64)

    def add(self, first: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores``: documents x items from item ``first`` on."""
        n = scores.shape[1]
        least, last = self.least[first:first + n], self.last[first:first + n]
        row, column = np.nonzero((scores > least) | (scores == least) & (ids[:, None] < last))
        if not len(row):
            return
        item = np.concatenate([self.item, column + first])
        doc = np.concatenate([self.id, ids[row]])
        score = np.concatenate([self.score, scores[row, column]])
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        rank = np.arange(len(item)) - np.repeat(starts, np.diff(np.r_[starts, len(item)]))
        full = rank == self.k - 1
        self.least[item[full]], self.last[item[full]] = score[full], doc[full]
        keep = rank < self.k
        self.item, self.id, self.score = item[keep], doc[keep], score[keep]


_built: dict[str, object] = {}  # the last block's vocabulary and tiles


def _kept(key, build):
    if key not in _built:
        _built.clear()
        _built[key] = build()
    return _built[key]


_COUNTS = "id long, n long, terms array<int>, counts array<long>"


def _count(shared: Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _kept((shared.key, "index"), lambda: Vocabulary(shared.value).index)
        for batch in batches:
            lengths, terms, counts = [], [], []
            for text in batch.column(1).cast(pa.large_binary()):
                found, n = Counter(), 0
                for run_of in words(text.as_py()):
                    n += len(run_of)
                    found.update(map(index.get, run_of))
                found.pop(None, None)
                lengths.append(n)
                terms.append(np.fromiter(found.keys(), np.int32, len(found)))
                counts.append(np.fromiter(found.values(), np.int64, len(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                                              pa.array(counts, pa.list_(pa.int64()))], ["id", "n", "terms", "counts"])
    return run


class Block:
    """What a task needs to score one block of items."""

    def __init__(self, items: list[tuple], weights: np.ndarray, n_docs: int, n_terms: int, tiles: dict):
        self.items, self.weights, self.n_docs, self.n_terms, self.sizes = items, weights, n_docs, n_terms, tiles


def _score(shared: Shared, k: int, doc_tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        tiles = _kept((shared.key, "tiles"), lambda: list(item_tiles(block.items, block.weights, **block.sizes)))
        best = Best(len(block.items), k)
        for batch in batches:
            ids = batch.column(0).fill_null(NULL_ID).to_numpy()
            m = np.array([10 + 90 * n * block.n_docs // block.n_terms for n in batch.column(1).to_pylist()], np.int64)
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            terms, tf = lists.values.to_numpy(), batch.column(3).values.to_numpy()
            row = np.repeat(np.arange(len(ids)), np.diff(ends))
            terms, tf = terms[ends[0]:ends[-1]], tf[ends[0]:ends[-1]]
            ends = ends - ends[0]
            impact = (SCALE * tf) // (TF_SCALE * tf + LENGTH_SCALE * m[row])
            for a in range(0, len(ids), doc_tile):
                b = min(a + doc_tile, len(ids))
                at = slice(ends[a], ends[b])
                for first, parts in tiles:
                    scores = sum(_partial(part, row[at] - a, terms[at], impact[at], b - a) for part in parts)
                    best.add(first, ids[a:b], scores)
        names = [i for i, _ in block.items]
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[i] for i in best.item.tolist()], pa.int64()), pa.array(best.id, mask=best.id == NULL_ID),
             pa.array(best.score)], ["item_id", "doc_id", "score"])
    return run


def _partial(part: TermTile, row: np.ndarray, terms: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
    column = part.local[terms]
    own = column >= 0
    dense = np.zeros((n_docs, len(part.matrix)))
    dense[row[own], column[own]] = impact[own]
    return (dense @ part.matrix).astype(np.int64)


def _blocks(terms: DataFrame, block_chars: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """(item, term) rows by item, cut between items by running length."""
    block, own, size, own_size = [], [], 0, 0
    for item, term in terms.orderBy("item", "term").toLocalIterator():
        if own and own[0][0] != item:
            if block and size + own_size > block_chars:
                yield block
                block, size = [], 0
            block, size, own, own_size = block + own, size + own_size, [], 0
        own.append((item, bytes(term)))
        own_size += 8 + len(term)
    if block and size + own_size > block_chars:
        yield block
        block = []
    if block or own:
        yield block + own


def top_rows(rows: DataFrame, k: int, *group: str) -> DataFrame:
    best = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                   item_text: str = "text", k: int = 10, block_chars: int = BLOCK_CHARS, item_tile: int = ITEM_TILE,
                   term_tile: int = TERM_TILE, doc_tile: int = DOC_TILE) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` documents of the highest score above 0.

    Null and empty texts have no terms; such items have no rows, such documents count for nothing. Rows of
    ``items`` that share an id (or have none) are one item with the terms of all. Each row of ``docs`` is a document,
    also where rows repeat; equal scores are ranked by ascending id, null ids last. Empty tables give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    terms = as_table(items.select(F.col(item_id).cast("long").alias("item"), F.explode(_terms(F.col(item_text))).alias("term"))
                     .where("term != ''").distinct().withColumn("term", F.col("term").cast("binary")))
    found, corpus, before = [], None, None
    for block in _blocks(terms, block_chars):
        if before is not None:  # another block follows: write what the one before found, and let its tiles go
            found[-1] = as_table(found[-1])
            before.broadcast.destroy()
        said = Shared(spark, block)
        counted = as_table(docs.mapInArrow(_count(said), _COUNTS))
        said.broadcast.destroy()
        if corpus is None:
            corpus = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        vocabulary = Vocabulary(block)
        df = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # one row a term of the block
        weights = np.array([weight(corpus[0], df.get(t, 0)) for t in range(len(vocabulary.index))], np.int64)
        before = Shared(spark, Block(vocabulary.items, weights, *corpus, {"item_tile": item_tile, "term_tile": term_tile}))
        tops = counted.where(F.size("terms") > 0).mapInArrow(_score(before, k, doc_tile), "item_id long, doc_id long, score long")
        found.append(tops)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    # each task sends k rows an item: salted first, so no group grows with the number of tasks
    out = top_rows(out.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), k, "item_id", "salt")
    return top_rows(out.drop("rank", "salt"), k, "item_id").select("item_id", "rank", "doc_id", "score")


def _terms(text: Column) -> Column:
    return F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), GAPS, -1)
