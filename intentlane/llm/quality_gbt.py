"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each document is reduced to a few statistics (lengths, character classes,
repetition, lines). Trees are grown on binned statistics from gradient
histograms, then flattened into arrays that numpy walks for all documents and
all trees at once, one tree level a step.

The trees are fitted on a bounded sample of labelled documents. Nulls: a null or
empty text has all-zero statistics and is scored like any other; without
training rows of both labels the score is the share of label 1 among them (0.5
without any). Repeated rows get the same score; other columns are ignored."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from intentlane.llm.common import is_rest, labelled_sample, table, text_slices

MAX_TRAINING_ROWS = 20_000   # labelled documents sampled for the trees
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15

_BYTES = np.arange(256)
_CLASSES = np.stack([
    (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122), (_BYTES >= 48) & (_BYTES <= 57),
    np.isin(_BYTES, [32, 9, 11, 12, 13]), _BYTES == 10, _BYTES >= 128,
    (_BYTES > 32) & (_BYTES < 127) & ~np.isin(_BYTES, [*range(48, 58), *range(65, 91), *range(97, 123)]),
], axis=1).astype(np.float64)
FEATURES = ("log_bytes", "upper", "lower", "digit", "blank", "newline", "non_ascii", "punct", "top_punct",
            "punct_kinds", "byte_entropy", "log_words", "word_length", "word_spread", "distinct_words",
            "top_word", "repeat_next", "log_lines", "distinct_lines", "words_a_line", "end_punct", "capital_words")


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of FEATURES."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    share = (seen @ _CLASSES) / n
    punct = seen[(_CLASSES[:, 6] > 0)]
    p = seen[seen > 0] / n
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    w = len(words)
    return [
        math.log1p(n), *share, punct.max() / n, float((punct > 0).sum()), float(-(p * np.log2(p)).sum()),
        math.log1p(w), float(lengths.mean()), float(lengths.std()), len(counts) / w, max(counts.values()) / w,
        sum(map(bytes.__eq__, words, words[1:])) / w, math.log1p(len(lines)), len(set(lines)) / len(lines),
        w / len(lines), sum(x[-1] < 48 for x in words) / w, sum(65 <= x[0] <= 90 for x in words) / w,
    ]


def statistics_of(texts: Iterator[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


def statistics_by_slice(texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros((0, len(FEATURES))), *(statistics_of(t.as_py() for t in part) for part in text_slices(texts))])


@dataclass
class Trees:
    """All trees in flat arrays; a leaf points to itself."""
    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if len(self.roots) and len(x):
            at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
            row = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out = out + self.value[at].sum(1)
        return 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE,
        bins: int = BINS, least_hessian: float = 2.0, ridge: float = 1.0) -> Trees:
    """Boost logistic loss; every tree is grown level by level from histograms."""
    n, m = x.shape
    share = float(y.mean()) if n else 0.5
    base = math.log(min(max(share, 1e-6), 1 - 1e-6) / (1 - min(max(share, 1e-6), 1 - 1e-6)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    if 0 < share < 1:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        flat = binned + np.arange(m) * bins
        out = np.full(n, base)

        def node(v: float) -> int:
            for column, item in ((feature, 0), (threshold, np.inf), (left, len(value)), (right, len(value)), (value, v)):
                column.append(item)
            return len(value) - 1

        for _ in range(trees):
            p = 1 / (1 + np.exp(-out))
            g, h = y - p, p * (1 - p)
            root = node(rate * g.sum() / (h.sum() + ridge))
            roots.append(root)
            level = {root: np.arange(n)}
            for _ in range(depth):
                below = {}
                for at, rows in level.items():
                    split = _best_split(flat[rows], g[rows], h[rows], m, bins, least_hessian, ridge)
                    if split is None:
                        continue
                    j, b = split
                    if b >= len(edges[j]):
                        continue
                    goes = binned[rows, j] <= b
                    feature[at], threshold[at] = j, edges[j][b]
                    for side, part in ((left, rows[goes]), (right, rows[~goes])):
                        side[at] = node(rate * g[part].sum() / (h[part].sum() + ridge))
                        below[side[at]] = part
                level = below
            made = Trees(0.0, np.array([root]), *map(np.array, (feature, threshold, left, right, value)), depth)
            leaf = np.full(n, root)
            for _ in range(depth):
                leaf = np.where(x[np.arange(n), made.feature[leaf]] <= made.threshold[leaf], made.left[leaf], made.right[leaf])
            out = out + made.value[leaf]
    return Trees(base, np.array(roots, np.int64), np.array(feature, np.int64), np.array(threshold, np.float64),
                 np.array(left, np.int64), np.array(right, np.int64), np.array(value, np.float64), depth)


def _best_split(flat: np.ndarray, g: np.ndarray, h: np.ndarray, m: int, bins: int,
                least_hessian: float, ridge: float) -> tuple[int, int] | None:
    """Feature and bin of the largest gain, from gradient and hessian histograms."""
    at = flat.reshape(-1)
    gs = np.bincount(at, np.repeat(g, m), minlength=m * bins).reshape(m, bins).cumsum(1)
    hs = np.bincount(at, np.repeat(h, m), minlength=m * bins).reshape(m, bins).cumsum(1)
    gt, ht = gs[:, -1:], hs[:, -1:]
    gain = gs ** 2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt ** 2 / (ht + ridge)
    gain[(hs < least_hessian) | (ht - hs < least_hessian)] = -1.0
    best = int(gain.argmax())
    return (best // bins, best % bins) if gain.reshape(-1)[best] > 1e-6 else None


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label: str = "quality", modulus: int = 3, held_out: int = 1,
                  max_rows: int = MAX_TRAINING_ROWS) -> Trees:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics_by_slice(batch["_text"])
            yield pa.RecordBatch.from_arrays(
                [batch["_id"].cast(pa.string()), pa.array(list(x), pa.list_(pa.float64())), batch["label"].cast(pa.int32())],
                names=["id", "x", "label"])

    sample = labelled_sample(docs, labels, label, modulus, held_out, max_rows, id_col, text_col)
    rows = sorted(sample.select("_id", "_text", "label").mapInArrow(measure, "id string, x array<double>, label int").collect(),
                  key=lambda r: (r["id"], r["x"]))  # at most the sample: some numbers per labelled document
    return fit(np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)),
               np.array([float(r["label"] == 1) for r in rows]))


def quality_score(text: Column, trees: Trees) -> Column:
    """Score between 0 and 1 of a text column."""
    @F.arrow_udf("double")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(trees.score(statistics_by_slice(texts)), pa.float64())
    return udf(text)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = train_quality(docs, table(spark, sf_dir, "labels"))
    return (docs.select("doc_id", is_rest(F.col("doc_id"), 3, 1).alias("held_out"),
                        quality_score(F.col("text"), trees).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
