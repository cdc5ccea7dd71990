"""Text quality by a sparse rule ensemble (RuleFit; Friedman and Popescu, 2008).

``text_statistics`` measures whole texts.  ``fit_rules`` grows small boosted trees
on a labelled sample, takes the path to every tree node as a conjunctive rule,
and fits lasso logistic weights to the rules, most of which become zero.
``RuleModel.score`` compiles what remains into one Spark column expression, so
that scoring is code-generated and needs no Python.

The sample holds at most ``TRAIN_ROWS`` labelled rows, those of least hash; the
fit's cost does not grow with the corpus.

Defined results: a null or empty text has statistics of zero and is scored by
the rules like any other; a text of any length is measured whole; repeated rows
each get their row, also with a null doc_id; without usable
labels (none, or one class) every text gets the smoothed share of label 1;
an empty table gives no rows; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, bounded_batches, held_out, utf8

TRAIN_ROWS = 20_000
TREES = 16
DEPTH = 3
SHRINKAGE = 0.3
BINS = 48
LEAST_ROWS = 20
LASSO = 5e-4
LASSO_STEPS = 400
LARGEST_WEIGHT_SUM = 30.0

_SYMBOLS = b"#*$%&|<>~^_=+{}[]\\"
_ENDS = (b".", b"!", b"?", b":", b";", b'"')

STATISTICS = (
    "n_words", "word_bytes", "upper_share", "digit_share", "symbols_per_word", "pipes_per_word", "bangs_per_word", "marks_per_word",
    "distinct_share", "top_share", "adjacent_share", "copied_lines", "line_words", "ended_lines", "short_share",
)
STATISTICS_SCHEMA = "doc_id long, " + ", ".join(f"{c} double" for c in STATISTICS)

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))


def measure(text: bytes) -> tuple[float, ...]:
    """The values of ``STATISTICS`` for one text."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    size = len(text)
    without = lambda signs: size - len(text.translate(None, signs))
    letters = sum(map(len, words))
    codes: dict = defaultdict()
    codes.default_factory = codes.__len__
    seen = np.fromiter(map(codes.__getitem__, words), np.int64, n)
    counts = np.bincount(seen)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        float(n), letters / n, without(_UPPER) / letters, without(_DIGITS) / letters, without(_SYMBOLS) / n, text.count(b"|") / n, text.count(b"!") / n, without(b".,;:?!") / n,
        len(counts) / n, float(counts.max()) / n, float((seen[1:] == seen[:-1]).sum()) / n, 1 - len(set(lines)) / len(lines), n / len(lines), sum(line.rstrip().endswith(_ENDS) for line in lines) / len(lines), float((lengths <= 3).sum()) / n,
    )


def _measure_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        rows = np.array([measure(x) for x in utf8(block.column("text"))], np.float64).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], names=["doc_id", *STATISTICS])


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row of ``docs`` (doc_id, text); one narrow pass."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_measure_batches, STATISTICS_SCHEMA)


# ------------------------------------------------------------------ trees and rules

#: Bounds of statistics: (name, lower bound or None, upper bound or None), lower < value <= upper.
Rule = tuple[tuple[str, float | None, float | None], ...]


@dataclass
class RuleModel:
    """A logistic model over conjunctive rules."""

    intercept: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self) -> Column:
        """The probability of label 1 as an expression over the statistics' columns."""
        margin = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            margin = margin + F.when(rule_column(rule), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))

    def score_rows(self, rows: np.ndarray) -> np.ndarray:
        margin = self.intercept + rule_matrix(self.rules, rows) @ np.array(self.weights)
        return 1 / (1 + np.exp(-margin))


def rule_column(rule: Rule) -> Column:
    tests = [F.col(name) > low for name, low, _ in rule if low is not None] + [F.col(name) <= high for name, _, high in rule if high is not None]
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def rule_matrix(rules: list[Rule], rows: np.ndarray) -> np.ndarray:
    out = np.ones((len(rows), len(rules)))
    for k, rule in enumerate(rules):
        for name, low, high in rule:
            values = rows[:, STATISTICS.index(name)]
            if low is not None:
                out[:, k] *= values > low
            if high is not None:
                out[:, k] *= values <= high
    return out


def _bin_edges(rows: np.ndarray) -> list[np.ndarray]:
    """Candidate thresholds of each statistic: midpoints between neighbouring quantiles."""
    edges = []
    for values in rows.T:
        marks = np.unique(np.quantile(values, np.linspace(0, 1, BINS + 1), method="nearest"))
        edges.append((marks[1:] + marks[:-1]) / 2)
    return edges


class _Tree:
    """A regression tree on binned statistics; ``paths`` has the bounds of every node but the root."""

    def __init__(self, bins: np.ndarray, edges: list[np.ndarray], residual: np.ndarray, hessian: np.ndarray, rng: np.random.Generator) -> None:
        self.bins, self.edges, self.residual, self.hessian, self.rng = bins, edges, residual, hessian, rng
        self.paths: list[dict[int, tuple[float | None, float | None]]] = []
        self.update = np.zeros(len(bins))
        self._grow(np.arange(len(bins)), {}, DEPTH)

    def _grow(self, rows: np.ndarray, bounds: dict, depth: int) -> None:
        best = self._split(rows) if depth and len(rows) >= 2 * LEAST_ROWS else None
        if best is None:
            self.update[rows] = self.residual[rows].sum() / (self.hessian[rows].sum() + 1e-6)
            return
        column, cut = best
        edge = float(self.edges[column][cut])
        left = self.bins[rows, column] <= cut
        low, high = bounds.get(column, (None, None))
        for part, new in ((left, (low, edge)), (~left, (edge, high))):
            inside = bounds | {column: new}
            self.paths.append(inside)
            self._grow(rows[part], inside, depth - 1)

    def _split(self, rows: np.ndarray) -> tuple[int, int] | None:
        """The best cut among half of the statistics, drawn at random; ties go to the first."""
        best, gain_of = None, 1e-9
        residual, hessian = self.residual[rows], self.hessian[rows]
        total_r, total_h = residual.sum(), hessian.sum()
        for column in np.sort(self.rng.permutation(len(self.edges))[: max(1, (len(self.edges) + 1) // 2)]):
            size = len(self.edges[column])
            if not size:
                continue
            at = self.bins[rows, column]
            n, r, h = (np.cumsum(np.bincount(at, w, size + 1))[:-1] for w in (None, residual, hessian))
            gain = r**2 / (h + 1e-6) + (total_r - r) ** 2 / (total_h - h + 1e-6) - total_r**2 / (total_h + 1e-6)
            gain[(n < LEAST_ROWS) | (len(rows) - n < LEAST_ROWS)] = 0
            if gain.max() > gain_of:
                best, gain_of = (int(column), int(gain.argmax())), gain.max()
        return best


def tree_rules(rows: np.ndarray, labels: np.ndarray, seed: int = 11) -> list[Rule]:
    """Paths of boosted trees, without repeats, in order of first appearance."""
    rng = np.random.default_rng(seed)
    edges = _bin_edges(rows)
    bins = np.column_stack([np.searchsorted(e, values, side="left") for e, values in zip(edges, rows.T, strict=True)])
    margin = np.full(len(rows), math.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = _Tree(bins, edges, labels - p, p * (1 - p), rng)
        margin = margin + SHRINKAGE * np.clip(tree.update, -4, 4)
        for path in tree.paths:
            rules[tuple((STATISTICS[c], low, high) for c, (low, high) in sorted(path.items()))] = None
    return list(rules)


def lasso_logistic(x: np.ndarray, labels: np.ndarray, penalty: float = LASSO, steps: int = LASSO_STEPS) -> tuple[float, np.ndarray]:
    """Intercept and weights of least mean log loss plus ``penalty`` times the weights' sizes (FISTA)."""
    n, m = x.shape
    step = 4.0 / (np.linalg.norm(x, 2) ** 2 / n + 1.0) if m else 4.0
    weights = ahead = np.zeros(m)
    intercept = ahead_0 = math.log((labels.sum() + 1) / (n - labels.sum() + 1))
    t = 1.0
    for _ in range(steps):
        slope = 1 / (1 + np.exp(-(ahead_0 + x @ ahead))) - labels
        moved = ahead - step * (x.T @ slope) / n
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        new_0 = ahead_0 - step * slope.mean()
        next_t = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_0 = new + (t - 1) / next_t * (new - weights), new_0 + (t - 1) / next_t * (new_0 - intercept)
        weights, intercept, t = new, new_0, next_t
    return intercept, weights


def fit_rules(rows: np.ndarray, labels: np.ndarray) -> RuleModel:
    """A sparse rule ensemble for rows of ``STATISTICS`` and labels 0 or 1."""
    labels = labels.astype(np.float64)
    ones = labels.sum()
    if not 0 < ones < len(labels):
        return RuleModel(math.log((ones + 1) / (len(labels) - ones + 1)))
    rules = tree_rules(rows, labels)
    intercept, weights = lasso_logistic(rule_matrix(rules, rows), labels)
    used = np.flatnonzero(np.abs(weights) > 1e-6)
    return RuleModel(float(intercept), [rules[k] for k in used], [float(weights[k]) for k in used])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> RuleModel:
    """Fits on the ``rows`` labelled documents of least hash that are not held out.

    The sample's ids are broadcast: their number is bounded by ``rows``.  Of rows
    that share an id, the least text counts, so the bound is one of rows, too.
    """
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = usable.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    table = text_statistics(labelled).join(F.broadcast(sample), "doc_id").toPandas().sort_values(["doc_id", *STATISTICS])
    return fit_rules(table[list(STATISTICS)].to_numpy(np.float64), table["label"].to_numpy())


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and predicted of every row of ``docs``, by rules fitted to ``labels`` (doc_id, quality)."""
    model = fit(docs, labels)
    return text_statistics(docs).select("doc_id", model.score().alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _measure_kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        rows = np.array([measure(x) for x in utf8(block.column("text"))], np.float64).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([block.column("kept"), block.column("text"), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], names=["kept", "text", *STATISTICS])


def accepted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model predicts to be of quality 1; no shuffle of texts."""
    model = fit(docs, labels)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("kept"), "text")
    schema = T.StructType([rows.schema["kept"], T.StructField("text", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in STATISTICS)])
    accepted = rows.mapInArrow(_measure_kept, schema).filter(model.score() >= 0.5)
    return accepted.select(*((F.col("text") if c == "text" else F.col("kept").getField(c)).alias(c) for c in docs.columns))
