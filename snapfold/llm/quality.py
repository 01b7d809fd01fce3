"""Document quality by histogram gradient-boosted trees over document statistics.

Statistics are computed on the executors, for a batch of whole texts at once. The trees are fitted on a bounded sample of
labelled rows (MOST_ROWS, chosen by a hash of the id) and flattened into arrays, through which whole batches go at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: The most labelled rows that a model is fitted on.
MOST_ROWS = 20_000
BINS, TREES, DEPTH, RATE, LEAST_ROWS, RIDGE = 64, 80, 4, 0.15, 20, 1.0

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" ", "line": b"\n", "other_space": b"\t\r\x0b\x0c",
    "stop": b".", "comma": b",", "bang": b"!", "query": b"?", "bar": b"|", "colon": b":;", "quote": b"'\"`", "bracket": b"()[]{}<>", "sign": b"#$%&*@^~\\/_+=-", "high": bytes(range(128, 256)),
}
FEATURES = [*_CLASSES, "log_bytes", "word_bytes", "line_words", "distinct_words", "distinct_lines", "sentence_words", "top_word", "long_words"]


def _class_matrix() -> np.ndarray:
    out = np.zeros((256, len(_CLASSES)))
    for k, members in enumerate(_CLASSES.values()):
        out[list(members), k] = 1
    return out


_MATRIX = _class_matrix()


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES for each text: shares of character classes, lengths and repetition. An empty text has zeros."""
    parts = [(t or "").encode() for t in texts]
    out = np.zeros((len(parts), len(FEATURES)))
    n = len(_CLASSES)
    for i, raw in enumerate(parts):
        if not raw:
            continue
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _MATRIX
        words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
        out[i, :n] = counts / len(raw)
        many, seen = max(1, len(words)), Counter(words)
        stops = counts[6] + counts[8] + counts[9]
        out[i, n:] = [
            np.log1p(len(raw)), len(raw) / many, many / max(1, len(lines)), len(seen) / many, len(set(lines)) / max(1, len(lines)),
            many / (1 + stops), max(seen.values(), default=0) / many, sum(len(w) > 20 for w in words) / many,
        ]
    return out


class Forest:
    """Trees of one depth as arrays: node k of a tree has children 2k + 1 and 2k + 2; leaves follow the inner nodes."""

    def __init__(self, base: float, feature: np.ndarray, limit: np.ndarray, value: np.ndarray) -> None:
        self.base, self.feature, self.limit, self.value = base, feature, limit, value

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        raw = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1] if self.feature.size else 0
        depth = (inner + 1).bit_length() - 1
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            raw += value[node - inner]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Logistic loss; splits by gain over BINS-bin histograms of gradients. Without both labels: the prior alone."""
    inner = (1 << depth) - 1
    empty = np.zeros((0, inner))
    prior = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(prior / (1 - prior)))
    if len(np.unique(y)) < 2:
        return Forest(base, empty.astype(int), empty, np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)], axis=1)
    count, raw = x.shape[1], np.full(len(y), base)
    slots = np.arange(count) * BINS
    forest = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, weight = y - p, p * (1 - p)
        feature, limit, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            if len(own) >= 2 * LEAST_ROWS:
                at = (binned[own] + slots).ravel()
                sums = [np.bincount(at, np.repeat(v, count), count * BINS).reshape(count, BINS).cumsum(axis=1) for v in (gradient[own], weight[own], np.ones(len(own)))]
                (g, h, n), (total, heavy, rows) = sums, [s[0, -1] for s in sums]
                gain = g**2 / (h + RIDGE) + (total - g) ** 2 / (heavy - h + RIDGE) - total**2 / (heavy + RIDGE)
                gain[(n < LEAST_ROWS) | (rows - n < LEAST_ROWS)] = 0
                best = int(gain.argmax())
                if gain.flat[best] > 1e-6:
                    feature[k], cut = divmod(best, BINS)
                    limit[k] = edges[feature[k]][cut]
            node[own] = 2 * k + 1 + (x[own, feature[k]] > limit[k])
        leaf = node - inner
        value = RATE * np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, weight, inner + 1) + RIDGE)
        raw += value[leaf]
        forest.append((feature, limit, value))
    return Forest(base, *map(np.array, zip(*forest, strict=True)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        x = statistics(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column("quality")], names=["x", "quality"])


def _scores(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        score = pa.array(forest.score(statistics(batch.column("text").to_pylist())))
        yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, "score"])


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Forest:
    """A forest from the labelled rows of docs. docs: doc_id, text; labels: doc_id, quality (0 or 1).

    At most `most` labelled ids, those of least hash, are used: the one bounded sample. Labels that are null or of null
    id are passed over; an id with several labels counts once, with the largest, and of an id with several texts that of the
    least hash counts.
    """
    chosen = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    each = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `most` ids
    each = each.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = each.select("text", "quality").mapInArrow(_features, "x array<double>, quality int").collect()
    if not rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.array([r.x for r in rows]), np.array([r.quality for r in rows], float)
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves 0. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def score_documents(docs: DataFrame, forest: Forest, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of each row and `score`, 0 to 1, of its whole text. Null counts as empty; empty texts are scored too."""
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    own = docs.select(*keep, *([] if "text" in keep else ["text"]))
    schema = ", ".join(f"`{c}` {fields[c]}" for c in own.columns) + ", score double"
    return own.mapInArrow(partial(_scores, forest=forest), schema).select(*keep, "score")
