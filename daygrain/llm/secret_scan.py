"""Secret scans: a trigram index chooses the texts on which each rule runs.

Each rule's regular expression gives a Boolean query over trigrams that every match must hold.
An Arrow batch of texts is indexed by the trigrams of all queries (case folded), a rule's
postings are intersected and united by its query, and only those texts are verified with
the expression itself. A rule without a mandatory trigram scans every text. Batches are bounded
by Spark (``spark.sql.execution.arrow.maxBytesPerBatch``); texts never move.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Rule:
    """A match counts if the named group has at least ``least`` characters; other matches are dropped."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


# The three base kinds, in the order that breaks ties.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # the runs of [0-9a-f]+ that have 16 characters
)
# Published token formats, listed after the base kinds.
EXTRA = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/@]{3,64}@"),
)
RULES = BASE + EXTRA

#: A query: None (nothing is mandatory), a trigram, ("and", ...) or ("or", ...).
_MOST_STRINGS = 64
_MOST_IN_CLASS = 8


def _both(*queries):
    kept = list(dict.fromkeys(q for q in queries if q is not None))
    return None if not kept else kept[0] if len(kept) == 1 else ("and", *kept)


def _either(queries):
    queries = list(dict.fromkeys(queries))
    return None if None in queries or not queries else queries[0] if len(queries) == 1 else ("or", *queries)


def _of_strings(strings: set[bytes]):
    """What holds if one of ``strings`` occurs."""
    return _either([_both(*(s[i:i + 3] for i in range(len(s) - 2))) for s in sorted(strings)])


def _exact(node) -> set[bytes] | None:
    """All case-folded strings that a node matches, if they are few."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower().encode()} if arg < 128 else None
    if op is sre.IN:
        chars = set()
        for kind, value in arg:
            if kind is sre.LITERAL and value < 128:
                chars.add(value)
            elif kind is sre.RANGE and value[1] < 128:
                chars.update(range(value[0], value[1] + 1))
            else:
                return None
        folded = {chr(c).lower().encode() for c in chars}
        return folded if len(folded) <= _MOST_IN_CLASS else None
    if op is sre.SUBPATTERN:
        return _exact_run(arg[-1])
    if op is sre.BRANCH:
        parts = [_exact_run(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is sre.MAX_REPEAT and arg[:2] == (0, 1):
        inner = _exact_run(arg[2])
        return None if inner is None else inner | {b""}
    return None


def _exact_run(nodes) -> set[bytes] | None:
    out = {b""}
    for node in nodes:
        part = _exact(node)
        if part is None or len(out) * len(part) > _MOST_STRINGS:
            return None
        out = {x + y for x in out for y in part}
    return out


def _query(nodes):
    found, run = [], {b""}
    for node in nodes:
        part = _exact(node)
        if part is not None and len(run) * len(part) <= _MOST_STRINGS:
            run = {x + y for x in run for y in part}
            continue
        found.append(_of_strings(run))
        run = part if part is not None else {b""}
        if part is None:
            op, arg = node
            if op is sre.SUBPATTERN:
                found.append(_query(arg[-1]))
            elif op is sre.BRANCH:
                found.append(_either([_query(x) for x in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                found.append(_query(arg[2]))
    return _both(*found, _of_strings(run))


def trigram_query(pattern: str):
    """The query of trigrams (lower-case bytes) that each match of ``pattern`` implies; None: scan fully."""
    return _query(sre_parser.parse(pattern))


def _trigrams(query) -> set[bytes]:
    return set() if query is None else {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1:]))


def _code(t: bytes) -> int:
    return t[0] << 16 | t[1] << 8 | t[2]


class Index:
    """Postings of the wanted trigrams over a batch of texts."""

    def __init__(self, texts: list[bytes], wanted: set[bytes], chunk: int = 1 << 22):
        self.n, self.postings = len(texts), {t: np.zeros(len(texts), bool) for t in wanted}
        if not wanted or not texts:
            return
        # one byte that is in no trigram keeps neighbours apart
        joined = np.frombuffer(b"\0\0".join(texts) + b"\0\0", np.uint8)
        starts = np.cumsum([0] + [len(t) + 2 for t in texts[:-1]])
        is_wanted = np.zeros(1 << 24, bool)
        is_wanted[[_code(t) for t in wanted]] = True
        by_code = {_code(t): t for t in wanted}
        for i in range(0, len(joined) - 2, chunk):
            part = joined[i:i + chunk + 2].astype(np.int32)
            codes = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
            at = np.flatnonzero(is_wanted[codes])
            text_of = np.searchsorted(starts, at + i, side="right") - 1
            for pair in np.unique(codes[at].astype(np.int64) << 32 | text_of).tolist():
                self.postings[by_code[pair >> 32]][pair & 0xFFFFFFFF] = True

    def rows(self, query) -> np.ndarray:
        """The texts that can hold a match."""
        if query is None:
            return np.ones(self.n, bool)
        if isinstance(query, bytes):
            return self.postings[query]
        parts = [self.rows(q) for q in query[1:]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


SPANS = "array<struct<kind: string, start: int, end: int>>"


def scan(texts: list[str], rules: tuple[Rule, ...]) -> list[list[dict]]:
    """Spans of each text by start, then by the rules' order; code points, end exclusive."""
    queries = [trigram_query(r.pattern) for r in rules]
    index = Index([t.encode("utf-8", "surrogatepass").lower() for t in texts], set().union(*map(_trigrams, queries)))
    out: list[list[tuple]] = [[] for _ in texts]
    for order, (rule, query) in enumerate(zip(rules, queries)):
        find = rule.compiled().finditer
        for i in np.flatnonzero(index.rows(query)).tolist():
            for m in find(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out[i].append((m.start(), order, rule.kind, m.end()))
    return [[{"kind": k, "start": s, "end": e} for s, _, k, e in sorted(found)] for found in out]


def spans_column(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(scan([t or "" for t in texts.to_pylist()], rules),
                        pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
    return run(text)


def find_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "spans") -> DataFrame:
    """``docs`` with ``out``: the spans of every rule in the whole text, by start, then in the rules' order.

    Null and empty texts have none. Per rule matches are leftmost and do not overlap; spans of different
    rules may. ``out`` replaces a column of that name.
    """
    return docs.withColumn(out, spans_column(F.col(text_col), rules))
