"""Quality rules: base rules, then gradient-boosted trees over document statistics.

The trees are flattened into numpy node arrays and score batches of rows in a few vectorised steps; chosen features are
under monotonic constraints, so that more symbols, repeats or capitals never raise a score. They are fitted on a bounded
sample of labelled rows; the statistics cover every word of every text.

Defined results: a null or empty text has no words and fails the base rules; repeated rows get equal results; extra
columns pass through; without labels of both classes the base rules decide alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, refuse, renamed, small_batches, works

SYMBOLS = "#*$%&|<>"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Model features, with the sign of the allowed effect on the score (0: free).
FEATURES = {"words_log": 0, "mean_chars": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "distinct_share": 0, "lines_per_word": 0}
#: Labelled rows that the fit may use at most.
FIT_ROWS = 20_000
#: Lowest model probability of a good document that is kept: clean documents stay when in doubt.
KEEP_FROM = 0.3

STATS = T.StructType([*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("score", T.DoubleType()), T.StructField("features", T.ArrayType(T.DoubleType()))])


def repeated_words(ids: np.ndarray) -> int:
    """Words inside windows of WINDOW words that occur at least twice."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    # Names of windows of 2, 4, 8 words: equal names, equal words. No hash, so no chance of error.
    name = ids
    for half in (1, 2, 4):
        pair = name[:-half] * (int(name.max()) + 1) + name[half:]
        name = np.unique(pair, return_inverse=True)[1]
    twice = np.bincount(name)[name] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.nonzero(twice)[0]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def document_stats(text: str | None) -> tuple[list[int], list[float]]:
    """(COUNTS, FEATURES) of a whole text. A word is a run without ASCII white space."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, ASCII_SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    index: dict[bytes, int] = {}
    for w in words:
        index.setdefault(w, len(index))
    # A repeated window needs a repeated word, so documents without one need no windows.
    repeats = repeated_words(np.fromiter(map(index.__getitem__, words), np.int64, n)) if len(index) < n - WINDOW + 2 else 0
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(ASCII_SPACE):
            lines += 1
            dup += line in seen
            seen.add(line)
    # Letters that lower-casing changes in place; few characters change the length, and then only share is lost.
    code, low = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (text, text.lower()))
    upper = int((code != low).sum()) if len(code) == len(low) else sum(map(str.isupper, text))
    m = max(n, 1)
    features = [np.log1p(n), chars / m, symbols / m, dup / max(lines, 1), repeats / m, upper / max(chars, 1), len(index) / m, lines / m]
    return [n, chars, symbols, dup, repeats], features


@dataclass
class Forest:
    """Trees as flat node arrays: feature (-1 at a leaf), threshold (left if x <= threshold), children, value."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        row = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while (inner := self.feature[node] >= 0).any():
                to = np.where(x[row, np.maximum(self.feature[node], 0)] <= self.threshold[node], self.left[node], self.right[node])
                node = np.where(inner, to, node)
            total += self.value[node]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_forest(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, smooth: float = 1.0, least: int = 10) -> Forest:
    """Log-loss boosting on binned features. A split on a signed feature must order its children so, and the subtrees stay on their side of the middle."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    margin = np.full(len(y), start := float(np.log(share / (1 - share))))
    nodes: list[list[float]] = []
    roots = []

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, rate * float(np.clip(-g / (h + smooth), low, high))])
        if level == depth or len(rows) < 2 * least:
            return at
        best = (1e-6, -1, -1, 0.0)
        for f, sign in enumerate(signs):
            if not len(edges[f]):
                continue
            b = binned[rows, f]
            sums = [np.cumsum(np.bincount(b, weights=w, minlength=len(edges[f]) + 1))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows)))]
            gl, hl, nl = sums
            wl, wr = np.clip(-gl / (hl + smooth), low, high), np.clip(-(g - gl) / (h - hl + smooth), low, high)
            gain = -(gl * wl + 0.5 * (hl + smooth) * wl**2) - ((g - gl) * wr + 0.5 * (h - hl + smooth) * wr**2)
            w = np.clip(-g / (h + smooth), low, high)
            gain += g * w + 0.5 * (h + smooth) * w**2
            gain[(nl < least) | (len(rows) - nl < least) | (sign * (wr - wl) < 0)] = -1
            if (k := int(gain.argmax())) >= 0 and gain[k] > best[0]:
                best = (float(gain[k]), f, k, float((wl[k] + wr[k]) / 2))
        _, f, k, middle = best
        if f < 0:
            return at
        goes = binned[rows, f] <= k
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[signs[f]]
        l, r = grow(rows[goes], level + 1, *bounds[0]), grow(rows[~goes], level + 1, *bounds[1])
        nodes[at][:4] = [f, float(edges[f][k]), l, r]
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
        a = np.array(nodes, float)
        one = Forest(np.array(roots[-1:]), a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], 0.0)
        margin += one.margin(x)
    a = np.array(nodes, float).reshape(-1, 5)
    return Forest(np.array(roots, int), a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], start)


def quality_stats(text: Column, forest: Forest | None = None) -> Column:
    """struct of COUNTS, the model's probability (null without a model) and the features of a text column."""

    @F.pandas_udf(STATS)
    def run(texts: pd.Series) -> pd.DataFrame:
        works("quality")
        rows = [document_stats(t) for t in texts]
        out = pd.DataFrame([r[0] for r in rows], columns=list(COUNTS))
        x = np.array([r[1] for r in rows]).reshape(-1, len(FEATURES))
        out["score"] = forest.probability(x) if forest is not None else None
        out["features"] = list(x)
        return out

    return run(text)


def fit_quality(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Forest | None:
    """The model of at most `rows` labelled documents, chosen by a hash of their key."""
    chosen = renamed(labels, k=key, y=label).filter("k IS NOT NULL AND y IS NOT NULL").orderBy(F.xxhash64("k"), "k", "y").limit(rows)
    # at most `rows` rows of two numbers are broadcast
    found = renamed(documents, k=key, t=text).join(F.broadcast(chosen), "k").withColumn("h", F.xxhash64("k", "t"))
    sample = found.withColumn("s", quality_stats(F.col("t"))).select("h", "y", "s.features").orderBy("h", "y").limit(rows).toPandas()
    y = (sample.y > 0).to_numpy(float)
    if not len(y) or y.min() == y.max():
        return None
    return fit_forest(np.array(sample.features.tolist()), y, list(FEATURES.values()))


def judge(df: DataFrame, forest: Forest | None, text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """df with COUNTS, base_failed and kept. Columns of these names are refused, not overwritten."""
    refuse(df, *COUNTS, "base_failed", "kept")
    small_batches(df.sparkSession)
    s = "__qt_stats"
    out = df.withColumn(s, quality_stats(F.col(f"`{text}`"), forest))
    out = out.withColumns({c: F.col(f"{s}.{c}") for c in COUNTS})
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col(f"{s}.score") >= keep_from, F.lit(True))).drop(s)
