"""Importance resampling towards a target distribution, over hashed word n-grams.

A batch's texts are joined with sentinels between them and one regex pass finds all words of the batch with their places.
Document offsets are searched for these places, which gives each word its document; an n-gram whose first and last word
lie in different documents is masked. What remains is hashed to buckets and counted by bincount.

Bucket counts of corpus and target give each bucket a gain, the log ratio of its shares. A document's weight is the mean
gain of its features; Gumbel noise from a hash of its id is added, and the highest sums are drawn: a sample without
replacement in which a document's chance follows its weight.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, strings, written

#: Words of the joined bytes, A-Z in lower case: digits, letters and all that is not ASCII. The group keeps them in split().
WORD = re.compile(rb"([0-9a-z\x80-\xff]+)")
SENTINEL = b"\n"
BUCKETS = 10_000


def batch_words(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts in lower case (A-Z only) and the number of the text that each lies in."""
    raw = [(t or "").encode() for t in texts]
    found = WORD.split(SENTINEL.join(raw).lower())  # what lies between words, a word, what lies between, ...
    places = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))[0:-1:2]
    offsets = np.cumsum([0, *[len(r) + len(SENTINEL) for r in raw]])
    return found[1::2], np.searchsorted(offsets, places, side="right") - 1


def batch_features(texts: list[str | None], n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket and the text of every run of 1 to n words that lies in one text, and the words of each text."""
    words, of = batch_words(texts)
    hashed, owners = [], []
    for size in range(1, n + 1):
        runs = words if size == 1 else map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False))
        crc = np.fromiter(map(zlib.crc32, runs), np.int64, max(0, len(words) - size + 1)) % buckets
        inside = of[: len(crc)] == of[size - 1 : size - 1 + len(crc)]
        hashed.append(crc[inside])
        owners.append(of[: len(crc)][inside])
    return np.concatenate(hashed), np.concatenate(owners), np.bincount(of, minlength=len(texts))


def _count(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(buckets, np.int64)
    for batch in pieces(batches, "text"):
        counts += np.bincount(batch_features(strings(batch.column("text")), n, buckets)[0], minlength=buckets)
    at = np.flatnonzero(counts)
    yield pa.record_batch({"bucket": pa.array(at, pa.int32()), "n": pa.array(counts[at])})


def bucket_counts(texts: DataFrame, n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How often features fall into each bucket, over all texts. Each task sends its sums; `buckets` numbers come to the driver."""
    parts = texts.select("text").mapInArrow(partial(_count, n=n, buckets=buckets), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of a bucket's share of the target over its share of the corpus), one feature a bucket added to both."""
    s, t, size = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + size) / ((float(a) + 1) * (t + size)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(batches: Iterator[pa.RecordBatch], n: int, gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        hashed, of, words = batch_features(strings(batch.column("text")), n, len(gain))
        many = np.bincount(of, minlength=len(batch))
        sums = np.zeros(len(batch), np.int64)
        np.add.at(sums, of, gain[hashed])
        weight = sums // np.maximum(many, 1)
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_features": pa.array(many.astype(np.int64)), "n_words": pa.array(words.astype(np.int64)), "weight": pa.array(weight)})


def gumbel(key: Column, seed: int) -> Column:
    """floor(1000 * a Gumbel variate) from the first 8 hexadecimal digits of sha256('seed:key')."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, draw: int, score: str = "score", tie: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """rows with `rank`: 1, 2, ... for the `draw` highest scores, ties to the smaller tie columns, null for the others.

    Scores are counted first, which gives the score that the last drawn row has; only rows from there on are put in order,
    by ranges, and a row's rank is its place in its range after all rows of the ranges before. No task sees them all.
    `rows` is read more than once.
    """
    counts = rows.groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    above = F.sum("_n").over(Window.orderBy(F.desc_nulls_last(score)))  # as many rows as there are whole-numbered scores
    last = counts.withColumn("_above", above).filter(F.col("_above") >= draw).agg(F.max(score)).first()[0] if draw else None
    none = rows.withColumn("rank", F.lit(None).cast("long"))
    if not draw:
        return none
    candidates = F.lit(True) if last is None else F.coalesce(F.col(score) >= last, F.lit(False))
    order = [F.desc_nulls_last(score), *[F.asc_nulls_first(c) for c in tie]]
    placed = written(rows.filter(candidates).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size")).withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))  # a row for each range
    numbered = placed.withColumn("_part", part).join(F.broadcast(sizes), "_part").withColumn("rank", F.col("_before") + place + 1)
    numbered = numbered.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return numbered.select(*rows.columns, "rank").unionByName(none.filter(~candidates))


def resample(
    docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text"
) -> DataFrame:
    """doc_id, n_features, weight, score, rank (all long) for each row of docs; rank is null for rows that are not drawn.

    Of the rows with `least_words` words or more, floor(percent / 100) of them are drawn. Null and empty texts have no
    features: weight 0, never drawn. A null id is hashed as no text and comes first in ties; repeated rows are rows of
    their own (equal scores, ranks of their own). Other columns are not read. Without documents there are no rows;
    without target texts every bucket has the share of one feature there.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    gain = gains(bucket_counts(texts, n, buckets), bucket_counts(target.select(F.coalesce(F.col(target_text), F.lit("")).alias("text")), n, buckets))
    weighed = texts.mapInArrow(partial(_weigh, n=n, gain=gain), "doc_id long, n_features long, n_words long, weight long")
    rows = written(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "weights")
    fit = F.col("n_words") >= least_words
    draw = rows.filter(fit).count() * percent // 100
    out = ranked(rows.filter(fit), draw).unionByName(rows.filter(~fit).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
