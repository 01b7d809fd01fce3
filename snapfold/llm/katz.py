"""Katz backoff language model as partitioned tables, and its scores of whole texts.

The table of order n has a row for each n-gram of the training texts: context (hash of its first n - 1 words), word, its
count, and its discounted probability; beside it stands the table of contexts with their backoff weights. Counts up to
CUT are discounted by Good-Turing, and the weights are normalised exactly: the mass that the seen words of a context leave
goes to all other words in proportion to the next lower order. A context without a discounted count would leave none; it is
counted as if one more token had followed, which it leaves. Unigrams leave their discounts to unknown words, as one class.

A token is evaluated recursively: its n-gram's row if there is one, else the context's weight and the order below.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, scratch, whole

CUT = 5
END, START = 1, 2
BREAKS = r"[\x20\x09-\x0D]+"


def _hashes(text: Column) -> Column:
    words = F.filter(F.split(ascii_lower(text), BREAKS), lambda w: w != "")
    return F.concat(F.transform(words, lambda w: F.xxhash64(w)), F.array(F.lit(END).cast("long")))


def tokens(texts: DataFrame, order: int, *keys: str) -> DataFrame:
    """keys, word, context_2 .. context_order for each token of each text; texts open with START words and close with END."""
    hashed = texts.select(*keys, _hashes(F.col("text")).alias("h"))
    before = lambda i, k: F.coalesce(F.get("h", i - k), F.lit(START).cast("long"))
    place = F.sequence(F.lit(0), F.size("h") - 1)
    contexts = [_context(before, place, n).alias(f"context_{n}") for n in range(2, order + 1)]
    names = ["word", *[f"context_{n}" for n in range(2, order + 1)]]
    zipped = hashed.select(*keys, F.col("h").alias("word"), *contexts).select(*keys, F.explode(F.arrays_zip(*names)).alias("t"))
    return zipped.select(*keys, *[F.col(f"t.{name}") for name in names])


def _context(before, place: Column, n: int) -> Column:  # noqa: ANN001
    return F.transform(place, lambda i: F.xxhash64(*[before(i, k) for k in range(n - 1, 0, -1)]))


def discounts(counts: DataFrame) -> dict[int, float]:
    """factors() of a table's counts of counts (CUT + 1 numbers)."""
    rows = counts.filter(F.col("count") <= CUT + 1).groupBy("count").agg(F.count(F.lit(1)).alias("n")).collect()
    return factors({r["count"]: r["n"] for r in rows})


def factors(n: dict[int, int]) -> dict[int, float]:
    """The factor for each count up to CUT, from how many n-grams have each count. Counts above keep their value.

    Good-Turing by the counts of counts as they are, wherever that gives a factor in (0, 1). Where repeated copies lift one
    count of counts beside its neighbour and it gives none, the factor is Good-Turing's by the log-linear fit of the counts
    of counts up to CUT + 1, which lies in (0, 1) whenever the fit falls faster than 1 / r. Absolute discounting takes
    the place of all where there is no such fit: one of these counts does not occur at all, or the fit is flatter.
    """
    slope = _slope(n) if all(n.get(r) for r in range(1, CUT + 2)) else 0.0
    if slope < -1:
        common = (CUT + 1) * n[CUT + 1] / n[1]
        own = {r: ((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common) if common < 1 else 0.0 for r in range(1, CUT + 1)}
        level = (CUT + 1.0) ** (slope + 1)
        fitted = {r: (((r + 1) / r) ** (slope + 1) - level) / (1 - level) for r in range(1, CUT + 1)}
        return {r: own[r] if 0 < own[r] < 1 else fitted[r] for r in range(1, CUT + 1)}
    least = n.get(1, 0) / (n.get(1, 0) + 2 * n.get(2, 0)) if n.get(1) else 0.5
    least = min(max(least, 0.1), 0.9)
    return {r: (r - least) / r for r in range(1, CUT + 1)}


def _slope(n: dict[int, int]) -> float:
    """The slope of log n_r over log r by least squares, r up to CUT + 1."""
    x, y = [math.log(r) for r in range(1, CUT + 2)], [math.log(n[r]) for r in range(1, CUT + 2)]
    mx, my = sum(x) / len(x), sum(y) / len(y)
    return sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / sum((a - mx) ** 2 for a in x)


def _factor(d: dict[int, float]) -> Column:
    return reduce(lambda c, r: c.when(F.col("count") == r, F.lit(d[r])), range(2, CUT + 1), F.when(F.col("count") == 1, F.lit(d[1]))).otherwise(F.lit(1.0))


class Tables:
    """An order-2 model as tables: words (word, count), pairs (context, word, count), contexts (context, stats and below of a part of its words).

    stats: total, how many of the context's words have each count up to CUT, and the sum of greater counts; below: the
    lower-order mass of its words. A context that was dealt out has several rows, which add up (but for the total, which is whole).
    """

    def __init__(self, words: DataFrame, mass: float, unknown: float, d1: dict[int, float], pairs: DataFrame, stats: DataFrame, d2: dict[int, float]) -> None:
        self.counts, self.mass, self.unknown, self.d1, self.pairs, self.stats, self.d2 = words, mass, unknown, d1, pairs, stats, d2

    def words(self) -> DataFrame:
        """word, count, p of the words in training texts."""
        return self.counts.filter("count > 0").select("word", "count", (F.col("count") * _factor(self.d1) / self.mass).alias("p"))

    def contexts(self) -> DataFrame:
        """context, total, divisor (what counts are taken over) and weight, the exactly normalised backoff weight."""
        sums = [F.max(F.col("stats")[0]).alias("total"), *[F.sum(F.col("stats")[r]).alias(f"n{r}") for r in range(1, CUT + 1)], F.sum(F.col("stats")[CUT + 1]).alias("above"), F.sum("below").alias("below")]
        each = self.stats.groupBy("context").agg(*sums)
        low = reduce(lambda a, b: a + b, [F.col(f"n{r}") for r in range(1, CUT + 1)])
        divisor = F.col("total") + 1 - F.when(low > 0, 1.0).otherwise(0.0)
        seen = reduce(lambda a, b: a + b, [F.col(f"n{r}") * (r * self.d2[r]) for r in range(1, CUT + 1)]) + F.col("above")
        return each.select("context", "total", divisor.alias("divisor"), ((1 - seen / divisor) / (1 - F.col("below"))).alias("weight"))

    def grams(self) -> DataFrame:
        """context, word, count, p of the word pairs."""
        return self.pairs.join(self.contexts(), "context").select("context", "word", "count", (F.col("count") * _factor(self.d2) / F.col("divisor")).alias("p"))

    def evaluate(self, each: DataFrame, *keys: str) -> DataFrame:
        """keys, word, p (log10) of tokens (keys, context, word), recursively: the pair, else its context's weight and the word, else the unknown class."""
        pair = self.grams().select("context", "word", F.col("p").alias("own"))
        met = each.join(pair, ["context", "word"], "left").join(self.contexts().select("context", "weight"), "context", "left")
        met = met.join(self.words().select("word", F.col("p").alias("lower")), "word", "left")
        below = F.log10(F.coalesce("weight", F.lit(1.0))) + F.log10(F.coalesce("lower", F.lit(self.unknown)))
        return met.select(*keys, "word", F.when(F.col("own").isNotNull(), F.log10("own")).otherwise(below).alias("p"))


def train(texts: DataFrame, order: int = 2) -> dict:
    """The model of the texts (a column text, not null): tables by order, their folder, and the totals N and V.

    Every table is written to the shared folder, hashed by its key. No texts at all: N is 0 and all mass is unknown.
    """
    spark = texts.sparkSession
    home = scratch(spark, "katz")

    def table(df: DataFrame, name: str, *key: str) -> DataFrame:
        df.repartition(*key).write.parquet(f"{home}/{name}")
        return spark.read.schema(df.schema).parquet(f"{home}/{name}")

    grams = tokens(texts, order)
    counts = {1: table(grams.groupBy("word").agg(F.count(F.lit(1)).alias("count")), "counts_1", "word")}
    for n in range(2, order + 1):
        lower = [] if n == 2 else [F.first(f"context_{n - 1}").alias("lower")]
        own = grams.groupBy(F.col(f"context_{n}").alias("context"), "word").agg(F.count(F.lit(1)).alias("count"), *lower)
        counts[n] = table(own, f"counts_{n}", "context")
    total, kinds = counts[1].agg(F.sum("count"), F.count(F.lit(1))).first()
    model = {"order": order, "home": home, "N": total or 0, "V": kinds, "grams": {}, "contexts": {}}
    model["counts"] = counts[1]

    d = discounts(counts[1])
    kept = counts[1].agg(F.sum(F.col("count") * _factor(d))).first()[0] if total else 0.0
    parts = total if total and total - kept > 1e-9 * total else (total or 0) + 1
    model["unknown"] = (parts - kept) / parts
    model["grams"][1] = counts[1].withColumn("p", F.col("count") * _factor(d) / F.lit(float(parts)))
    for n in range(2, order + 1):
        d = discounts(counts[n])
        sums = counts[n].groupBy("context").agg(F.sum("count").alias("total"), F.max((F.col("count") <= CUT).cast("int")).alias("leaves"))
        grams_n = counts[n].join(sums, "context").withColumn("p", F.col("count") * _factor(d) / (F.col("total") + 1 - F.col("leaves")))
        below = model["grams"][n - 1]
        if n == 2:
            both = grams_n.join(below.select("word", F.col("p").alias("q")), "word")
        else:
            both = grams_n.join(below.select(F.col("context").alias("lower"), "word", F.col("p").alias("q")), ["lower", "word"])
        weights = both.groupBy("context").agg(((1 - F.sum("p")) / (1 - F.sum("q"))).alias("weight"))
        model["grams"][n] = table(grams_n.select("context", "word", "p", *(["lower"] if n > 2 else [])), f"grams_{n}", "context", "word")
        model["contexts"][n] = table(weights, f"contexts_{n}", "context")
    return model


def evaluate(model: dict, each: DataFrame, *keys: str) -> DataFrame:
    """keys, word, p for each token of `each` (as tokens() gives them): p is its log10 probability."""
    todo, found = each.withColumn("p", F.lit(0.0)).withColumn("found", F.lit(False)), F.col("found")
    for n in range(model["order"], 1, -1):
        grams = model["grams"][n].select(F.col("context").alias(f"context_{n}"), "word", F.col("p").alias("own"))
        weights = model["contexts"][n].select(F.col("context").alias(f"context_{n}"), "weight")
        todo = todo.join(grams, [f"context_{n}", "word"], "left").join(weights, f"context_{n}", "left")
        add = F.when(found, 0.0).when(F.col("own").isNotNull(), F.log10("own")).otherwise(F.log10(F.coalesce("weight", F.lit(1.0))))
        todo = todo.withColumn("p", F.col("p") + add).withColumn("found", found | F.col("own").isNotNull()).drop("own", "weight")
    last = model["grams"][1].select("word", F.col("p").alias("own"), F.col("count").alias("count"))
    out = todo.join(last, "word", "left")
    p = F.when(found, F.col("p")).otherwise(F.col("p") + F.log10(F.coalesce("own", F.lit(model["unknown"]))))
    return out.select(*keys, "word", F.coalesce("count", F.lit(0)).alias("count"), p.alias("p"))


def score_documents(docs: DataFrame, held: Column, order: int = 2, id_col: str = "doc_id", text_col: str = "text", stable: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row; rows where `held` is false train the model.

    Words lie between ASCII white space, A-Z in lower case; each text ends with one more token. Null counts as empty: the
    end token alone. Repeated rows train as often as they stand and get equal scores. Null ids are kept. Other columns are
    not read. An empty table gives no rows. Order 2 goes by packed pairs (katz_pairs), other orders by the tables of train().
    stable says that docs comes straight from files; other texts are written first, so that a lost task meets the same rows.
    """
    if order == 2:
        from .katz_pairs import score_pairs

        return score_pairs(docs, held, id_col, text_col, stable)[0]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).withColumn("row", F.xxhash64("text")).withColumn("held_out", held)
    model = train(rows.filter(~F.col("held_out")).select("text"), order)
    texts = rows.select("row", "text").dropDuplicates(["row"])
    each = evaluate(model, tokens(texts, order, "row"), "row")
    n, v = model["N"], model["V"]
    base = F.log10((F.col("count") + 0.1) / F.lit(n + 0.1 * (v + 1)))
    sums = each.groupBy("row").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum((F.col("count") > 0).cast("long")).alias("n_known"), F.sum(base).alias("base_score"), F.sum("p").alias("score"))
    return rows.select("doc_id", "held_out", "row").join(sums, "row").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
