"""SimHash near-dedup: pigeonhole blocks, join on blocks, Hamming check.

Rows with one fingerprint collapse first. The 64 bits are cut into six blocks; two
fingerprints that differ in at most three bits agree in three of the six, so each distinct
fingerprint gets the 20 keys of three blocks (about 32 bits each) and candidates are joined on
them. Keys that one fingerprint holds are dropped after a partially aggregated count. A key
that more than ``bucket_rows`` fingerprints hold is cut again: its other bits are split into four
parts, of which a linked pair shares one, until each bucket fits in a task. Within a
bucket the links are verified and returned as stars (a spanning forest of the bucket), never as
all pairs: no component is lost and no group grows with the square of its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from daygrain.llm.common import NULL_ID, as_table, fresh
from daygrain.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
BUCKET_ROWS = 4096
BITS = 64
BLOCKS = 6


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint; 0 for null and for texts without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = (end - size)[:len(words) - shingle_words + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(start, end[shingle_words - 1:].tolist())),
                             np.uint64, len(start))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[i:i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> Column:
    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py(), shingle_words, seed) for t in texts], pa.int64())
    return run(text)


def _parts(bits: list[int], n: int) -> list[int]:
    """Masks of ``n`` nearly equal runs of the given bit positions."""
    cuts = [round(i * len(bits) / n) for i in range(n + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def first_masks(max_bits: int) -> list[int]:
    """One mask for each choice of blocks that a pair within ``max_bits`` may share."""
    blocks = _parts(list(range(BITS)), max(BLOCKS, 2 * max_bits))
    return [sum(c) for c in combinations(blocks, len(blocks) - max_bits)]


def finer_masks(mask: int, max_bits: int) -> list[int]:
    """``mask`` with one of ``max_bits`` + 1 parts of the bits outside it."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | p for p in _parts(free, max_bits + 1) if p]


def star_links(fps: np.ndarray, max_bits: int) -> tuple[list[int], list[int]]:
    """Stars (smallest member, member) that connect what is linked among sorted distinct fingerprints."""
    centre, member = [], []
    left = fps.view(np.uint64)
    while len(left) > 1:
        seed, left = left[:1], left[1:]
        frontier = seed
        while len(frontier) and len(left):
            near = np.zeros(len(left), bool)
            for i in range(0, len(frontier), 256):
                near |= (np.bitwise_count(left[None, :] ^ frontier[i:i + 256, None]) <= max_bits).any(axis=0)
            frontier, left = left[near], left[~near]
            centre += [int(seed.view(np.int64)[0])] * len(frontier)
            member += frontier.view(np.int64).tolist()
    return centre, member


def _bucket_links(max_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by (mask, key, fp); a bucket may go on in the next batch, and has a bounded size."""
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            mask, key, fp = (batch[c].to_numpy() for c in ("mask", "key", "fp"))
            starts = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]) if len(fp) else np.zeros(0, int)
            rest = batch.iloc[starts[-1]:] if len(starts) else None
            yield _stars(fp, starts, max_bits)
        if rest is not None:
            yield _stars(rest["fp"].to_numpy(), np.array([0, len(rest)]), max_bits)
    return run


def _stars(fp: np.ndarray, starts: np.ndarray, max_bits: int) -> pd.DataFrame:
    centre, member = [], []
    for x, y in zip(starts.tolist(), starts[1:].tolist()):
        if y - x > 1:
            c, m = star_links(fp[x:y], max_bits)
            centre += c
            member += m
    return pd.DataFrame({"a": np.array(centre, np.int64), "b": np.array(member, np.int64)})


def links(fps: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b), a < b: stars whose components are those of all pairs within ``max_bits``.

    ``fps`` has one column ``fp`` of distinct fingerprints.
    """
    spark = fps.sparkSession
    masks = first_masks(max_bits)
    keys = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    found = []
    while True:
        keys = keys.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        shared = as_table(keys.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"))
        cold = keys.join(shared.where(F.col("n") <= bucket_rows).drop("n"), ["mask", "key"])
        found.append(as_table(cold.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
                              .select("mask", "key", "fp").mapInPandas(_bucket_links(max_bits), "a long, b long").distinct()))
        hot = shared.where(F.col("n") > bucket_rows).drop("n")
        if hot.isEmpty():
            break
        #: the masks follow from the first 20, not from the rows: their number is bounded
        masks = sorted({m for m in masks if finer_masks(m, max_bits)})
        finer = spark.createDataFrame([(_signed(m), [_signed(x) for x in finer_masks(m, max_bits)]) for m in masks],
                                      "mask long, finer array<long>")
        keys = as_table(keys.join(hot, ["mask", "key"]).join(F.broadcast(finer), "mask")
                        .select("fp", F.explode("finer").alias("mask")).distinct())
        masks = sorted({x for m in masks for x in finer_masks(m, max_bits)})
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row for each row of ``docs``: (id, fp, component_id).

    component_id is the smallest id among the rows whose fingerprints are reachable over
    links of at most ``max_bits`` bits. Null texts and texts without words have fingerprint 0,
    which is linked like any other. Null ids are ignored by the minimum (a component of null ids
    alone has null). Repeated rows and rows that share an id each have their own fingerprint.
    """
    return _classes(docs, id_col, text_col, shingle_words, max_bits, bucket_rows).select("id", "fp", "component_id")


def _classes(docs, id_col, text_col, shingle_words=SHINGLE_WORDS, max_bits=MAX_BITS, bucket_rows=BUCKET_ROWS) -> DataFrame:
    rows = as_table(docs.select(F.col(id_col).cast("long").alias("id"), _text_hash(text_col).alias("text_hash"),
                                fingerprint_column(F.col(text_col), shingle_words).alias("fp")))
    distinct = as_table(rows.groupBy("fp").agg(F.min("id").alias("least")))
    linked = components(links(distinct.select("fp"), max_bits, bucket_rows))
    classes = distinct.join(linked, distinct["fp"] == linked["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = classes.join(smallest, "component").select("fp", "component", "component_id")
    return rows.join(ids, "fp")


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that represent their component: one row each, with the smallest id.

    A component of null ids alone keeps one of its rows. Rows with equal id and text count as one.
    """
    rows = as_table(_classes(docs, id_col, text_col, **options)
                    .select(F.coalesce("id", F.lit(NULL_ID)).alias("id"), "text_hash", "component"))
    keep = rows.groupBy("component").agg(F.min(F.struct("id", "text_hash")).alias("k"))
    tag = fresh(docs, "_key")
    keyed = docs.withColumn(tag, F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                                          _text_hash(text_col).alias("text_hash")))
    kept = keyed.join(keep, (keyed[f"{tag}.id"] == keep["k.id"]) & (keyed[f"{tag}.text_hash"] == keep["k.text_hash"]), "left_semi")
    if not rows.groupBy("id", "text_hash").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([tag])
    return kept.drop(tag)
