"""URL filters: a trie over reversed host labels, then path segments, longest rule first.

A rule (verdict, host, path) fits its host and all subdomains if the url's path starts with the
rule's path. A host's labels are walked from the right; at each host node with rules the
path is walked segment by segment, and the last piece of a rule's path may end inside a segment.
The longest fitting rule (characters of host and path) wins, then the longer host. Rules are
broadcast in tries of at most ``block_rules`` rules; more rules make more tries, whose best
rules are compared.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from daygrain.llm.common import ascii_lower, fresh

Rule = tuple[str, str, str]
BLOCK_RULES = 500_000
BEST = "struct<length: int, host: int, rule: string, verdict: string>"


def host_column(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_column(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def build_trie(rules: Sequence[Rule]) -> dict:
    """Nested dicts. ("host", label) leads to a host node, whose "path" is the root of its path trie;
    there ("segment", text) leads on, and "ends" maps the last piece of a rule's path to the rule."""
    root: dict = {}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(("host", label), {})
        node = node.setdefault("path", {})
        *segments, last = path.split("/")
        for s in segments:
            node = node.setdefault(("segment", s), {})
        at = node.setdefault("ends", {})
        # of rules that differ in their verdict alone, block stays
        if last not in at or verdict == "block":
            at[last] = (len(host) + len(path), len(host), host + path, verdict)
    return root


def longest_match(trie: dict, host: str, path: str) -> tuple | None:
    best = None
    segments = path.split("/")
    node = trie
    for label in reversed(host.split(".")):
        node = node.get(("host", label))
        if node is None:
            break
        at = node.get("path")
        for s in segments:
            if at is None:
                break
            for last, rule in at.get("ends", {}).items() if len(at.get("ends", ())) <= 8 else _prefixes(at["ends"], s):
                if s.startswith(last) and (best is None or rule[:2] > best[:2]):
                    best = rule
            at = at.get(("segment", s))
    return best


def _prefixes(ends: dict, segment: str) -> list:
    return [(segment[:n], ends[segment[:n]]) for n in range(len(segment) + 1) if segment[:n] in ends]


def _best_column(host: Column, path: Column, trie: dict, spark) -> Column:
    shared = spark.sparkContext.broadcast(trie)

    @F.arrow_udf(BEST)
    def run(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        names = ("length", "host", "rule", "verdict")
        found = (longest_match(shared.value, h.as_py(), p.as_py()) for h, p in zip(hosts, paths))
        return pa.array([None if x is None else dict(zip(names, x)) for x in found],
                        pa.struct([("length", pa.int32()), ("host", pa.int32()), ("rule", pa.string()), ("verdict", pa.string())]))
    return run(host, path)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", default: str = "allow",
               block_rules: int = BLOCK_RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` (else ``default``).

    A null url or one without :// has empty host and path. These names replace columns of ``pages``.
    """
    url = fresh(pages, "_url")
    out = pages.withColumn(url, F.col(url_col))
    out = out.withColumns({"host": host_column(F.col(url)), "path": path_column(F.col(url))})
    blocks = [rules[i:i + block_rules] for i in range(0, len(rules), block_rules)]
    best = [F.lit(None).cast(BEST)] * 2 + [_best_column(F.col("host"), F.col("path"), build_trie(b), pages.sparkSession) for b in blocks]
    name = fresh(out, "_best")
    out = out.withColumn(name, F.greatest(*best))
    return out.withColumns({"rule": F.col(f"{name}.rule"), "verdict": F.coalesce(F.col(f"{name}.verdict"), F.lit(default))}).drop(name, url)
