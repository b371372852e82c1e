"""Benchmark decontamination: pigeonhole pieces, exact hits, Myers verification.

An item of length m may occur with ``budget = m * error_rate`` edits. Cut into budget + 1 pieces,
at least one piece of such an occurrence is unchanged. The pieces of all items form one
automaton; each hit proposes a window of the document, hits of an item on close diagonals share
a window, and Myers' bit-parallel distance decides. Texts are compared lower-cased, with each run
of characters that are neither letters nor digits as one space. An item too short for an edit counts only as whole words, and
items of fewer than ``least_chars`` characters are not looked for.

Items are read in blocks of at most ``block_chars`` characters (or one item), equal texts together and once, so what is
broadcast has a fixed bound; each block makes one pass over the documents, and what it found is written before the
next block is read. Documents never move.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from daygrain.llm.common import Shared, fresh, materialize

ERROR_RATE = 0.05
BLOCK_CHARS = 16_000_000
_GAP = re.compile(r"[\W_]+")
MATCHES = "array<struct<item_id: bigint, errors: int>>"


def normal(text: str | None) -> str:
    return _GAP.sub(" ", (text or "").lower()).strip()


def budget(length: int, error_rate: float = ERROR_RATE) -> int:
    return int(length * error_rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 non-empty pieces with their offsets; fewer only if the item is that short."""
    n = min(errors + 1, len(item))
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(x, item[x:y]) for x, y in zip(cuts, cuts[1:])]


def myers(pattern_bits: dict[str, int], m: int, text: str) -> int:
    """Smallest edit distance of the pattern to any substring of ``text``."""
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = score
    for c in text:
        eq = pattern_bits.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        rise = down | ~(xh | up) & full
        fall = up & xh
        if rise & last:
            score += 1
        elif fall & last:
            score -= 1
        rise = rise << 1 & full  # a match may start anywhere: no cost above the first row
        fall = fall << 1 & full
        up = fall | ~(xv | rise) & full
        down = rise & xv
        if score < best:
            best = score
            if not best:
                break
    return best


class Matcher:
    """The pieces of one block of (item_id, text) as an automaton."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, least_chars: int = 1):
        by_text = defaultdict(list)
        for item_id, text in items:
            text = normal(text)
            if len(text) >= max(1, least_chars):
                by_text[text].append(item_id)
        self.items, at = [], defaultdict(list)
        for text, ids in by_text.items():
            errors = budget(len(text), error_rate)
            masks: dict[str, int] = defaultdict(int)
            for i, c in enumerate(text):
                masks[c] |= 1 << i
            for offset, piece in pieces(text, errors):
                at[piece].append((len(self.items), offset))
            self.items.append((sorted(ids), text, errors, dict(masks)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[dict]:
        text = normal(text)
        if not self.items or not text:
            return []
        diagonals = defaultdict(set)
        for end, (size, places) in self.automaton.iter(text):
            for k, offset in places:
                diagonals[k].add(end + 1 - size - offset)
        found = []
        for k, starts in diagonals.items():
            ids, item, errors, masks = self.items[k]
            best = None
            if not errors:  # too short for an edit: only as whole words
                around = lambda i: not 0 <= i < len(text) or text[i] == " "
                if any(text.startswith(item, s) and around(s - 1) and around(s + len(item)) for s in starts):
                    found += [{"item_id": i, "errors": 0} for i in ids]
                continue
            for lo, hi in self._windows(sorted(starts), len(item), errors):
                window = text[max(0, lo):hi]
                got = 0 if item in window else myers(masks, len(item), window)
                if got <= errors and (best is None or got < best):
                    best = got
            if best is not None:
                found += [{"item_id": i, "errors": best} for i in ids]
        return sorted(found, key=lambda x: (x["item_id"] is None, x["item_id"]))

    @staticmethod
    def _windows(starts: list[int], length: int, errors: int):
        """A window around each start; starts that lie within the budget of the one before join it."""
        lo = hi = None
        for s in starts:
            if hi is not None and s - errors <= hi:
                hi = s + errors
                continue
            if hi is not None:
                yield lo, hi + length
            lo, hi = s - errors, s + errors
        if hi is not None:
            yield lo, hi + length


_matchers: dict[str, Matcher] = {}  # the last block's


def _matches_column(text: Column, shared: Shared, error_rate: float, least_chars: int) -> Column:
    @F.arrow_udf(MATCHES)
    def run(texts: pa.Array) -> pa.Array:
        if shared.key not in _matchers:  # one automaton a worker
            _matchers.clear()
            _matchers[shared.key] = Matcher(shared.value, error_rate, least_chars)
        find = _matchers[shared.key].matches
        return pa.array([find(t.as_py()) for t in texts],
                        pa.list_(pa.struct([("item_id", pa.int64()), ("errors", pa.int32())])))
    # Spark would derive filters from an explode of the result and run the search a second time for them
    return run.asNondeterministic()(text)


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items by text, cut by running length; an id counts as 8 characters, a text once."""
    block: list[tuple[int, str]] = []
    size, last = 0, None
    for item_id, text in items.orderBy("text", "id").toLocalIterator():
        if text == last:
            text, more = last, 8  # the same string: it is broadcast once
        else:
            more = 8 + len(text)
        if block and size + more > block_chars:
            yield block
            block, size, more = [], 0, 8 + len(text)
        block.append((item_id, text))
        size, last = size + more, text
    if block:
        yield block


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS,
                  out: str = "matches", least_chars: int = 1) -> DataFrame:
    """``docs`` with ``out``: the items found in its text, each with its fewest errors, by item id.

    Null and empty texts and items match nothing; equal items are all reported; null item ids
    come last. ``out`` replaces a column of that name.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where("text is not null")
    cols: list[str] = []
    before = None
    for block in _blocks(items, block_chars):
        if before is not None:  # another block follows: write what the one before found, and let its items go
            docs = materialize(docs)
            before.broadcast.destroy()
        before = Shared(spark, block)
        name = fresh(docs, f"_{out}_{len(cols)}")
        docs = docs.withColumn(name, _matches_column(F.col(text_col), before, error_rate, least_chars))
        cols.append(name)
    none = F.array().cast(MATCHES)
    return docs.withColumn(out, F.concat(none, *cols) if cols else none).drop(*cols)
