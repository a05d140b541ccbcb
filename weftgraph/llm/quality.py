"""Quality classifier: a sparse rule ensemble over text statistics, compiled to Spark columns.

Statistics are computed once per whole text. A small set of trees is grown on residuals over
bootstrap samples; every path of a tree is a conjunctive rule. Lasso logistic regression weighs the
rules and the winsorised statistics, most weights become 0, and what is left is one Spark
expression over the statistic columns, inside whole-stage code generation.

The fit uses at most ``max_train`` labelled rows (those with the smallest hash of the id): a
documented bound of driver memory; the statistics and scores cover all rows.

A null text counts as empty; empty texts have statistics 0 and are scored; a text of any length is
read whole. Null labels and labels of a null id are not learned from; a repeated label of an id is
averaged and rounded. With labels of one kind only (or none) the score is their smoothed share. An
empty table gives no rows. Repeated rows score alike. ``score`` reads the id and the text only, so
columns of any name are ignored; ``with_statistics`` keeps other columns and replaces those named
as the statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import chunks, lean, materialize

STATS = (
    "n_chars", "n_words", "mean_word", "distinct_words", "repeated_next", "top_word", "upper", "digits", "symbols", "exclaims", "pipes", "marked_words", "distinct_lines", "line_words", "punct_ends",
)


def _kinds() -> np.ndarray:
    """Character kinds by code point: 0 other letters, 1 upper, 2 digit, 3 white space, 4 plain punctuation, 5 symbol, 6 '!', 7 '|', 8 newline."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x3000):
        c = chr(point)
        table[point] = 8 if c == "\n" else 3 if c.isspace() else 2 if c.isdigit() else 1 if c.isupper() else 0 if c.isalpha() else 4 if c in ".,;:'\"-()?" else 6 if c == "!" else 7 if c == "|" else 5
    return table


_TABLE: list[np.ndarray] = []


def statistics(texts: list[str]) -> np.ndarray:
    """One row of STATS a text."""
    if not _TABLE:
        _TABLE.append(_kinds())
    n = len(texts)
    lens = np.fromiter(map(len, texts), np.int64, n)
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _TABLE[0][raw]
    doc = np.repeat(np.arange(n), lens)
    count = np.bincount(doc * 9 + kinds, minlength=9 * n).reshape(n, 9)
    out = np.zeros((n, len(STATS)))
    chars = np.maximum(lens, 1)
    out[:, 0] = np.log1p(lens)
    for col, kind in ((6, 1), (7, 2), (8, 5), (9, 6), (10, 7)):
        out[:, col] = count[:, kind] / chars
    for i, text in enumerate(texts):
        words = text.split()
        m = len(words)
        if not m:
            continue
        seen: dict[str, int] = {}
        get = seen.get
        for w in words:
            seen[w] = get(w, 0) + 1
        lines = [x for x in text.split("\n") if x]
        out[i, 1] = math.log1p(m)
        out[i, 2] = sum(map(len, words)) / m
        out[i, 3] = len(seen) / m
        out[i, 4] = sum(map(str.__eq__, words, words[1:])) / m
        out[i, 5] = max(seen.values()) / m
        out[i, 11] = sum(c for w, c in seen.items() if not w[-1].isalpha() and w[-1] not in ".,") / m
        out[i, 12] = len(set(lines)) / max(1, len(lines))
        out[i, 13] = math.log1p(m / max(1, len(lines)))
        out[i, 14] = sum(c for w, c in seen.items() if w[-1] == ".") / m
    return out


def with_statistics(docs: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs (without drop) with the STATS columns."""
    kept = docs.drop(*STATS)
    at = kept.columns.index(text)
    names = [c for c in kept.columns if c not in drop]
    schema = T.StructType([*(kept.schema[c] for c in names), *(T.StructField(c, T.DoubleType()) for c in STATS)])

    def run(batches):
        for batch in batches:
            parts = [statistics(part) for _, part in chunks(batch.column(at).to_pylist())]
            own = np.concatenate(parts) if parts else np.zeros((0, len(STATS)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(own[:, k]) for k in range(len(STATS)))], names=schema.fieldNames())

    return kept.mapInArrow(lean(run), schema)


@dataclass
class RuleModel:
    names: tuple[str, ...]
    bias: float = 0.0
    rules: list[tuple[float, list[tuple[int, bool, float]]]] = field(default_factory=list)  # weight, [(statistic, is above, cut)]
    linear: list[tuple[float, int, float, float]] = field(default_factory=list)  # weight a unit, statistic, low, high

    def column(self) -> Column:
        """The score as a Spark expression."""
        z = F.lit(self.bias)
        for weight, tests in self.rules:
            hit = None
            for k, above, cut in tests:
                own = F.col(self.names[k]) > cut if above else F.col(self.names[k]) <= cut
                hit = own if hit is None else hit & own
            z = z + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
        for weight, k, low, high in self.linear:
            z = z + F.lit(weight) * F.greatest(F.least(F.col(self.names[k]), F.lit(high)), F.lit(low))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """As column(), for tests."""
        z = np.full(len(x), self.bias)
        for weight, tests in self.rules:
            z += weight * np.all([x[:, k] > cut if above else x[:, k] <= cut for k, above, cut in tests], axis=0)
        for weight, k, low, high in self.linear:
            z += weight * np.clip(x[:, k], low, high)
        return 1 / (1 + np.exp(-z))


def _tree(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], y: np.ndarray, rng, depth: int) -> list[list[tuple[int, bool, float]]]:
    """Paths of a regression tree (all nodes but the root), grown on binned statistics."""
    paths = []

    def grow(rows, path, depth):
        if depth == 0 or len(rows) < 40:
            return
        best, total, own = None, y[rows].sum(), y[rows]
        for k in rng.permutation(bins.shape[1])[: max(4, bins.shape[1] * 2 // 3)]:
            if not len(cuts[k]):
                continue
            b = bins[rows, k]
            n = np.cumsum(np.bincount(b, minlength=len(cuts[k]) + 1))[:-1]
            s = np.cumsum(np.bincount(b, weights=own, minlength=len(cuts[k]) + 1))[:-1]
            m = len(rows) - n
            ok = (n >= 10) & (m >= 10)
            if ok.any():
                gain = np.where(ok, s * s / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(m, 1), -np.inf)
                j = int(gain.argmax())
                if best is None or gain[j] > best[0]:
                    best = (gain[j], int(k), j)
        if best is None or best[0] <= total * total / len(rows) + 1e-9:
            return
        _, k, j = best
        low = bins[rows, k] <= j
        for above, part in ((False, rows[low]), (True, rows[~low])):
            own_path = [*path, (k, above, float(cuts[k][j]))]
            paths.append(own_path)
            grow(part, own_path, depth - 1)

    grow(np.arange(len(x)), [], depth)
    return paths


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = STATS, trees: int = 40, depth: int = 3, seed: int = 7, penalty: float = 1e-3, steps: int = 400) -> RuleModel:
    """Rules from trees, weights by proximal gradient (accelerated) for the lasso logistic loss."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = RuleModel(names, float(np.log(share / (1 - share))))
    if len(y) < 20 or y.min() == y.max():
        return model
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, 48))) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    rules, seen, f = [], set(), np.full(len(y), model.bias)
    for _ in range(trees):
        rows = np.sort(rng.choice(len(y), min(len(y), 4000), replace=False))
        residual = y - 1 / (1 + np.exp(-f))
        for path in _tree(x[rows], bins[rows], cuts, residual[rows], rng, depth):
            key = tuple(sorted(path))
            if key not in seen:
                seen.add(key)
                rules.append(path)
                hit = np.all([x[:, k] > cut if above else x[:, k] <= cut for k, above, cut in path], axis=0)
                if len(path) == depth and hit.any():  # a step of boosting, so that later trees look elsewhere
                    f[hit] += 0.3 * np.clip(residual[hit].mean() / max(share * (1 - share), 0.05), -3, 3)
    cols = [np.all([x[:, k] > cut if above else x[:, k] <= cut for k, above, cut in p], axis=0).astype(np.float32) for p in rules]
    ends = [(float(np.quantile(x[:, k], 0.02)), float(np.quantile(x[:, k], 0.98))) for k in range(x.shape[1])]
    for k, (low, high) in enumerate(ends):
        cols.append(np.clip(x[:, k], low, high).astype(np.float32))
    a = np.stack(cols, axis=1)
    mean, sd = a.mean(axis=0), a.std(axis=0)
    sd[sd < 1e-6] = np.inf
    a = (a - mean) / sd
    w, b = np.zeros(a.shape[1]), model.bias
    v, c, t = w.copy(), b, 1.0
    probe = np.ones(a.shape[1]) / math.sqrt(a.shape[1])
    for _ in range(20):  # the largest eigenvalue bounds the step
        probe = a.T @ (a @ probe)
        size = np.linalg.norm(probe)
        probe = probe / max(size, 1e-12)
    step = 1 / max(0.25 * size / len(y) + 0.25, 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a @ v + c)))
        g = (p - y) / len(y)
        new = v - step * (a.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = c - step * g.sum()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    own = np.where(np.isfinite(sd), w / sd, 0.0)
    model.bias = float(b - (own * mean).sum())
    model.rules = [(float(own[i]), p) for i, p in enumerate(rules) if own[i] != 0]
    model.linear = [(float(own[len(rules) + k]), k, *ends[k]) for k in range(x.shape[1]) if own[len(rules) + k] != 0]
    return model


def train(
    stats: DataFrame,
    labels: DataFrame,
    allowed: Column,
    max_train: int = 20_000,
    doc_id: str = "doc_id",
    label: str = "quality",
) -> RuleModel:
    """Fits on the labelled rows of stats for which allowed holds: those with the smallest hashes of the id.

    Labels are keyed by the id of stats. A first pass counts the rows; a bound on the hash then keeps
    max_train of them and a margin, so that no task sends more than its share to the driver.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    own = known.groupBy(F.col(doc_id).alias("__id")).agg(F.round(F.avg(label)).alias("__y"))
    rows = stats.where(allowed).join(own, F.col(doc_id) == F.col("__id"))
    rows = rows.select("__y", *STATS, F.xxhash64("__id").alias("__h"), "__id")
    n = own.count()
    if n > 2 * max_train:  # rows of labels, not of documents: where these repeat, the margin only grows
        shares = rows.select("__h").agg(*[F.count_if(F.col("__h") <= _bound(k)).alias(f"k{k}") for k in range(65)]).first()
        least = next(k for k in range(65) if shares[k] >= max_train or k == 64)
        rows = rows.where(F.col("__h") <= _bound(least))
    got = rows.orderBy("__h", "__id").limit(max_train).toArrow()
    x = np.stack([got[c].to_numpy() for c in STATS], axis=1) if got.num_rows else np.zeros((0, len(STATS)))
    return fit(x.astype(np.float64), got["__y"].to_numpy().astype(np.float64))


def _bound(k: int) -> int:
    """Upper end of the lowest k + 1 steps of a geometric ladder over all 64-bit hashes (each 1.25 times the one before)."""
    return min((1 << 63) - 1, int((1 << 64) * 1.25 ** (k - 64)) - (1 << 63))


def score(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column,
    threshold: float = 0.3,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; labels of held-out rows are never read into the fit.

    held_out is a condition on the id (as ``doc_id``); labels has the columns doc_id and quality.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    stats = materialize(with_statistics(rows, "text", drop=("text",)), "quality").withColumn("held_out", held_out)
    own = labels.withColumnRenamed(doc_id, "doc_id") if doc_id != "doc_id" else labels
    model = train(stats, own, ~F.col("held_out"))
    scored = stats.select("doc_id", "held_out", model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
