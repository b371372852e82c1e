"""Quality classifier: histogram gradient-boosted trees over statistics of the whole text.

Training takes the statistics of at most ``fit_rows`` labelled rows (chosen by a hash of the id),
cuts each into at most ``MAX_BINS`` quantile bins and grows trees level by level from gradient
histograms. The forest is flattened into arrays, which score a batch with one gather a level.
Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

FIT_ROWS = 20_000
MAX_BINS = 64
TREES = 120
DEPTH = 4
RATE = 0.15
L2 = 1.0
LEAST_IN_LEAF = 12

FEATURES = ("log_chars", "log_words", "log_lines", "word_length", "line_words", "longest_word", "letters", "upper", "digits",
            "blanks", "other_ascii", "beyond_ascii", "exclaim", "bar", "percent", "hash", "star", "dollar", "ampersand",
            "comma", "full_stop", "upper_words", "symbol_words", "distinct_words", "top_word", "distinct_lines",
            "short_lines", "byte_entropy", "marked_lines", "loud_lines")
_UPPER_WORD = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b")
_SYMBOL_WORD = re.compile(r"[^\w\s]{2,}(?=\s|$)")
_BYTES = {c: ord(x) for c, x in zip(FEATURES[12:21], "!|%#*$&,.")}


def statistics(text: str | None) -> list[float]:
    """The features of a text; null and empty texts have zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    count = np.bincount(raw, minlength=256).astype(float)
    n = float(len(raw))
    words, lines = text.split(), text.split("\n")
    nw, nl = max(len(words), 1), len(lines)
    tally: dict[str, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    share = count[count > 0] / n
    upper = count[65:91].sum()
    letters = upper + count[97:123].sum()
    digits = count[48:58].sum()
    blanks = count[32] + count[9:14].sum()
    beyond = count[128:].sum()
    symbols = [len(_SYMBOL_WORD.findall(x)) for x in lines]
    uppers = [len(_UPPER_WORD.findall(x)) for x in lines]
    return [np.log1p(n), np.log1p(len(words)), np.log1p(nl), len(text) / nw, len(words) / nl, float(max(map(len, words), default=0)),
            letters / n, upper / max(letters, 1.0), digits / n, blanks / n, (n - letters - digits - blanks - beyond) / n, beyond / n,
            *(count[b] / nw for b in _BYTES.values()), sum(uppers) / nw, sum(symbols) / nw, len(tally) / nw,
            max(tally.values(), default=0) / nw, len(set(lines)) / nl, sum(len(x) < 20 for x in lines) / nl,
            float(-(share * np.log2(share)).sum()),
            sum(4 * (s + x.count("|")) > len(x.split()) for s, x in zip(symbols, lines)) / nl,
            sum(2 * u > len(x.split()) for u, x in zip(uppers, lines)) / nl]


@dataclass(frozen=True)
class Forest:
    """All trees as flat arrays: node i asks ``x[feature[i]] <= cut[i]`` and goes to left[i] or right[i]; a leaf goes to itself."""
    start: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        out = np.empty(len(x))
        for i in range(0, len(x), rows):
            part = x[i:i + rows]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                small = np.take_along_axis(part, self.feature[at], axis=1) <= self.cut[at]
                at = np.where(small, self.left[at], self.right[at])
            out[i:i + rows] = 1 / (1 + np.exp(-(self.start + self.value[at].sum(axis=1))))
        return out


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Boosted trees for log loss. Without both labels the score is the share of label 1 (0.5 without rows)."""
    n, width = x.shape
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if n else 0.5
    start = np.log(share / (1 - share))
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        feature.append(0), cut.append(np.inf), value.append(0.0)
        left.append(len(feature) - 1), right.append(len(feature) - 1)
        return len(feature) - 1

    if n and 0 < y.mean() < 1:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, MAX_BINS + 1)[1:-1])) for j in range(width)]
        bins = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)], axis=1)
        column = np.arange(width) * MAX_BINS
        margin = np.full(n, start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            root = node()
            roots.append(root)
            live, where = [root], np.zeros(n, np.int64)  # where: index in live, -1 in a finished leaf
            final = np.full(n, root)
            for _ in range(depth):
                rows = np.flatnonzero(where >= 0)
                slot = (where[rows, None] * width * MAX_BINS + column + bins[rows]).ravel()
                size = len(live) * width * MAX_BINS
                hist = [np.bincount(slot, np.repeat(v[rows], width), size).reshape(len(live), width, MAX_BINS)
                        for v in (grad, hess, np.ones(n))]
                g, h, c = (np.cumsum(a, axis=2) for a in hist)
                gt, ht, ct = (a[:, :, -1:] for a in (g, h, c))
                gain = g * g / (h + L2) + (gt - g) ** 2 / (ht - h + L2) - gt * gt / (ht + L2)
                gain[(c < LEAST_IN_LEAF) | (ct - c < LEAST_IN_LEAF)] = 0
                flat = gain.reshape(len(live), -1)
                best = flat.argmax(axis=1)
                new, go = [], np.full((len(live), 2), -1)
                for k, parent in enumerate(live):
                    if flat[k, best[k]] <= 1e-9:
                        continue
                    j, b = divmod(int(best[k]), MAX_BINS)
                    feature[parent], cut[parent] = j, float(edges[j][b])
                    left[parent], right[parent] = node(), node()
                    go[k] = len(new), len(new) + 1
                    new += [left[parent], right[parent]]
                split = go[where[rows], 0] >= 0
                done, rows = rows[~split], rows[split]
                final[done], parents = np.array(live)[where[done]], np.array(live)[where[rows]]
                to_right = bins[rows, np.array(feature)[parents]] > np.array(
                    [np.searchsorted(edges[feature[q]], cut[q]) if np.isfinite(cut[q]) else 0 for q in range(len(feature))])[parents]
                where[rows] = go[where[rows], to_right.astype(int)]
                where[done] = -1
                live = new
                if not live:
                    break
            rows = np.flatnonzero(where >= 0)
            final[rows] = np.array(live)[where[rows]] if len(rows) else final[rows]
            g, h = (np.bincount(final, v, len(feature)) for v in (grad, hess))
            for leaf in np.unique(final).tolist():
                value[leaf] = -rate * g[leaf] / (h[leaf] + L2)
            margin += np.array(value)[final]
    if not roots:
        roots.append(node())
    return Forest(start, np.array(roots), np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value), depth)


def statistics_column(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t.as_py()) for t in texts], pa.list_(pa.float64()))
    return run(text)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          fit_rows: int = FIT_ROWS) -> Forest:
    """Fits on at most ``fit_rows`` labelled rows, those of smallest hashed id; where ids repeat, so many rows of them.

    Rows with a null id, label or another label than 0 and 1 teach nothing. The ids, labels and statistics
    of these rows are all that is collected (bounded by ``fit_rows``).
    """
    chosen = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
              .where("id is not null and label in (0, 1)").distinct()
              .orderBy(F.xxhash64("id"), "id", "label").limit(fit_rows))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = (texts.join(F.broadcast(chosen), "id").select("id", "label", statistics_column(F.col("text")).alias("x"))
            .orderBy(F.xxhash64("id"), "id", "label", F.hash("x")).limit(fit_rows).collect())
    rows = sorted(rows, key=lambda r: (r["id"], r["label"], r["x"]))
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit_forest(x, np.array([r["label"] for r in rows], float))


def score_column(text: Column, forest: Forest, spark) -> Column:
    shared = spark.sparkContext.broadcast(forest)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        x = np.array([statistics(t.as_py()) for t in texts], float).reshape(len(texts), len(FEATURES))
        return pa.array(shared.value.score(x), pa.float64())
    return run(text)


def held_out(doc_id: Column) -> Column:
    """The rows that no model here learns from; null ids are not held out (nor learnt from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (score >= 0.5).

    Empty and null texts are scored like any other. Without labels every score is 0.5. These names
    replace columns of ``docs``.
    """
    forest = train(docs, labels.where(~held_out(F.col(id_col))), id_col, text_col, label_col, fit_rows)
    out = docs.withColumns({"held_out": held_out(F.col(id_col)), "score": score_column(F.col(text_col), forest, docs.sparkSession)})
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
