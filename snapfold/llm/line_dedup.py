"""Lines that many documents share, dropped from all but one of them, in DataFrame functions.

Occurrences (hash of the line's key, document, position) are range-partitioned by hash and sorted by hash, document and
position within; the stream meets the first occurrence of each key, whose document keeps it, and then its followers,
which go. What comes out are keep bitmaps per document, not texts.

A line that a large share of the documents holds would make one range hot. Such keys are looked for in a sample of the
documents, which decides on placement alone: they are counted exactly over all documents by pre-aggregated sums, of which
at most HOT_KEYS rows are broadcast. All other keys take the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, let, whole, written

SAMPLED_DOCS = 50_000
#: A key in this share of the sampled documents, and in HOT_LEAST of them, is hot.
HOT_SHARE, HOT_LEAST, HOT_KEYS = 0.001, 20, 2000
#: Lines to a word of the bitmap.
WORD = 32


def _occurrences(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, row, pos, h1, h2 for each line whose key has `least` code points. The key's hash has 128 bits."""
    keys = F.transform(F.split(ascii_lower(F.col("text")), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)))
    hashes = F.transform(keys, lambda k: F.when(F.char_length(k) >= least, F.struct(F.xxhash64(F.lit(1), k).alias("h1"), F.xxhash64(F.lit(2), k).alias("h2"))))
    at = docs.select("doc_id", "row", F.posexplode(hashes).alias("pos", "hash")).filter("hash is not null")
    return at.select("doc_id", "row", "pos", F.col("hash.h1").alias("h1"), F.col("hash.h2").alias("h2"))


def _hot_keys(occurrences: DataFrame, docs: int) -> DataFrame:
    """h1, h2 of keys that a sample of the documents shows in very many of them: HOT_KEYS rows at most."""
    share = min(1.0, SAMPLED_DOCS / max(1, docs))
    sampled = F.pmod(F.xxhash64(F.lit(17), "doc_id", "row"), F.lit(1 << 30)) < int(share * (1 << 30))
    seen = occurrences.filter(sampled).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    hot = seen.filter(F.col("n") >= max(HOT_LEAST, HOT_SHARE * share * docs)).orderBy(F.desc("n"), "h1", "h2").limit(HOT_KEYS)
    return occurrences.sparkSession.createDataFrame(hot.select("h1", "h2").collect(), "h1 long, h2 long")


def dropped_lines(docs: DataFrame, least: int = 20, copies: int = 3) -> DataFrame:
    """doc_id, row, pos of each line to drop. docs: doc_id, row, text (not null). Lines are cut and hashed once and written."""
    occurrences = written(_occurrences(docs, least), "occurrences")
    hot = _hot_keys(occurrences, docs.count())

    stats = (
        occurrences.join(F.broadcast(hot), ["h1", "h2"], "left_semi").groupBy("h1", "h2", "doc_id").agg(F.count(F.lit(1)))
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last"))
    )
    of_hot = occurrences.join(F.broadcast(stats), ["h1", "h2"]).filter((F.col("docs") >= copies) & ~F.col("doc_id").eqNullSafe(F.col("last")))

    run = Window.partitionBy("h1", "h2")
    stream = run.orderBy(F.col("doc_id").desc_nulls_last())
    ranged = occurrences.join(F.broadcast(hot), ["h1", "h2"], "left_anti").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.col("doc_id").desc_nulls_last(), "pos")
    # place 1 is the first document of the key's run; the last place is the number of its documents.
    followers = ranged.withColumn("place", F.dense_rank().over(stream)).withColumn("docs", F.max("place").over(run)).filter((F.col("docs") >= copies) & (F.col("place") > 1))
    return of_hot.select("doc_id", "row", "pos").unionByName(followers.select("doc_id", "row", "pos"))


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, text: `row` tells rows of one id apart by their text. Null text is empty."""
    text = whole(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def keep_bitmaps(docs: DataFrame, least: int = 20, copies: int = 3) -> DataFrame:
    """doc_id, row, n_dropped, kept for each document that loses lines. docs: as identified() gives them.

    `kept` is the compressed bitmap: number of the word -> its WORD bits, bit i set where line WORD * number + i stays.
    Words without a dropped line are left out.
    """
    lines = dropped_lines(docs, least, copies).distinct()
    word, bit = F.expr(f"pos div {WORD}").cast("int"), F.expr(f"shiftleft(1L, pos % {WORD})")
    words = lines.groupBy("doc_id", "row", word.alias("word")).agg(F.bit_or(bit).alias("gone"), F.count(F.lit(1)).alias("n"))
    entry = F.struct(F.col("word"), F.bitwise_not("gone").alias("bits"))
    return words.groupBy("doc_id", "row").agg(F.sum("n").alias("n_dropped"), F.map_from_entries(F.collect_list(entry)).alias("kept"))


def dense(kept: Column) -> Column:
    """The bitmap as an array of words up to the last one that it has; words that it leaves out have all bits set."""
    def filled(words: Column) -> Column:
        before = lambda i: F.coalesce(F.get(words, i - 1)["key"], F.lit(-1))
        return F.flatten(F.transform(words, lambda w, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), w["key"] - before(i) - 1), F.array(w["value"]))))

    return let(F.array_sort(F.map_entries(kept)), filled)


def kept_text(text: Column, words: Column) -> Column:
    """The lines that a dense() bitmap keeps, joined again; the text itself where there is none."""

    def stays(line: Column, i: Column) -> Column:
        word = F.coalesce(F.get(words, F.floor(i / WORD).cast("int")), F.lit(-1).cast("long"))
        return F.getbit(word, i % WORD) == 1

    return F.when(words.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n", -1), stays), "\n"))


def dedup_lines(docs: DataFrame, least: int = 20, copies: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row of docs with its text after line dedup: doc_id, text, n_lines (before), n_dropped, and the columns `carry`.

    A line's key is the line without ASCII white space at its ends and with A-Z in lower case. Keys of at least `least`
    code points in at least `copies` documents (distinct ids) lose all their lines but those in the largest id. Null text
    counts as empty: one empty line. Rows that repeat an id are one document, each with its own text; a null id is one
    document below all others. A text that loses every line becomes ''. No rows are lost; an empty table gives none.
    """
    base = identified(docs, id_col, text_col)
    maps = keep_bitmaps(base, least, copies).withColumn("kept", dense(F.col("kept")))
    own = docs.select(*[F.col(c).alias(f"_carry_{c}") for c in carry], F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).withColumn("row", F.xxhash64("text"))
    maps = maps.withColumnsRenamed({"doc_id": "_doc", "row": "_row"})
    joined = own.join(maps, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row")), "left")
    return joined.select(
        "doc_id", kept_text(F.col("text"), F.col("kept")).alias("text"),
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        *[F.col(f"_carry_{c}").alias(c) for c in carry],
    )
