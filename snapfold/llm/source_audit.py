"""How far the term frequencies of each source of a language lie from those of its other sources, exactly.

Terms are counted by a token-start pointer sort over Arrow buffers. The texts of a slice of a shard stay where they lie, in
one buffer of bytes; a pointer is made for the start of each word. Pointers are sorted as suffixes that end with their
word, by multikey quicksort: eight bytes are one character of the key, quicksort parts the slice by it, and only the parts
of equal characters whose words go on are sorted by the next eight bytes. Equal runs of pointers are then one term each;
documents were put in order of their language and source, and the sort is stable, so a run lists its documents in that
order: steps in it give document frequency and the counts by source. Nothing is hashed and no word becomes a Python object.

What a slice sends is one row for each of its terms in a language, which lists sources and counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, pieces, written

SLICE_BYTES = 8 << 20
SCALE = 1_000_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of terms in lower case: ASCII letters and all bytes of characters that are not ASCII.
_TERM = np.zeros(256, bool)
_TERM[97:123] = _TERM[128:] = True


def term_pointers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the terms in the bytes; offsets are the borders of texts, which no term crosses."""
    inside = _TERM[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[:-1][np.diff(offsets) > 0]  # first bytes of texts that are not empty
    begins[full] = inside[full]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) - starts + 1


def _characters(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes of each word from depth on as one number that sorts like them; nothing after the word's end."""
    left = np.clip(lengths - depth, 0, 8)
    kept = np.where(left > 0, ~np.uint64(0) << ((8 - np.maximum(left, 1)) * 8).astype(np.uint64), np.uint64(0))
    return words[np.where(left > 0, starts + depth, 0)].astype(np.uint64) & kept


def pointer_sort(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the pointers by their words (stable), and for each place in it whether a new word begins there."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))
    key = _characters(words, starts, lengths, 0)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    depth, open_places = 8, np.arange(len(order))
    while len(open_places):
        # Places in runs of two or more whose words go on; words that end here sort first among their equals.
        run = np.cumsum(new[open_places]) if depth == 8 else run_of[open_places]
        goes = lengths[order[open_places]] > depth
        size = np.bincount(run)
        longer = np.bincount(run, weights=goes)
        kept = (size[run] > 1) & (longer[run] > 0)
        open_places, run = open_places[kept], run[kept]
        if not len(open_places):
            break
        moved = order[open_places]
        key = _characters(words, starts[moved], lengths[moved], depth)
        by = np.lexsort((key, run))
        order[open_places] = moved[by]
        key, run = key[by], run[by]
        first = np.ones(len(run), bool)
        first[1:] = (key[1:] != key[:-1]) | (run[1:] != run[:-1])
        new[open_places] |= first
        run_of = np.zeros(len(order), np.int64)
        run_of[open_places] = np.cumsum(first)
        depth += 8
    return order, new


def slice_terms(texts: pa.Array, groups: np.ndarray, langs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of texts whose group and language numbers ascend: term, lang and document frequency of each row, the borders
    of its sources, and their groups and counts."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data = _LOWER[raw]
    starts, lengths = term_pointers(data, offsets)
    order, new = pointer_sort(data, starts, lengths)
    doc = (np.searchsorted(offsets, starts, side="right") - 1)[order]
    group, lang = groups[doc], langs[doc]
    step = lambda a: np.concatenate([np.ones(min(1, len(a)), bool), a[1:] != a[:-1]])
    row = new | step(lang)
    source = row | step(group)
    document = source | step(doc)
    at, from_source = np.flatnonzero(row), np.flatnonzero(source)
    counts = np.diff(np.append(from_source, len(order)))
    borders = np.searchsorted(from_source, np.append(at, len(order)))
    of_row = np.cumsum(row) - 1
    frequency = np.bincount(of_row[document], minlength=len(at))
    first = order[at]
    ends = np.concatenate([[0], np.cumsum(lengths[first])])
    if len(at):
        within = np.arange(ends[-1]) - np.repeat(ends[:-1], lengths[first])
        spelled = data[np.repeat(starts[first], lengths[first]) + within]
    else:
        spelled = data[:0]
    terms = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(spelled.tobytes()))
    return terms, lang[at], frequency, borders, group[from_source], counts


def _terms(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", limit):
        table = pa.table({c: pc.fill_null(batch.column(c), "") for c in ("text", "lang", "source")})
        table = table.take(pc.sort_indices(table, [("lang", "ascending"), ("source", "ascending")])).combine_chunks()
        text, lang, source = (table.column(c).chunk(0) for c in ("text", "lang", "source"))
        change = lambda a: np.concatenate([[0], np.cumsum(pc.not_equal(a[1:], a[:-1]).to_numpy(zero_copy_only=False))]).astype(np.int64)
        langs = change(lang)
        steps = np.concatenate([[True], (np.diff(langs) != 0) | (np.diff(change(source)) != 0)])
        groups = np.cumsum(steps) - 1
        firsts = np.flatnonzero(steps)
        names, of_lang = source.take(pa.array(firsts)), lang.take(pa.array(np.flatnonzero(np.concatenate([[True], np.diff(langs) != 0]))))
        terms, lang_of, frequency, borders, group, counts = slice_terms(text, groups, langs)
        listed = pa.StructArray.from_arrays([names.take(pa.array(group)), pa.array(counts.astype(np.int64))], ["source", "n"])
        yield pa.record_batch({
            "lang": of_lang.take(pa.array(lang_of)).cast(pa.string()), "term": terms.cast(pa.string()), "df": pa.array(frequency.astype(np.int64)),
            "sources": pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), listed),
        })


def term_counts(docs: DataFrame, least: int = 10, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """lang, source, term, n: how often each term kept occurs in each group that has it, a written table.

    A lang keeps the terms that `least` of its documents hold. Slices have summed up what they send, and each aggregation
    sums again before its exchange, so that a term of all documents moves as one row from each task. Most terms are rare:
    their rows end at the semi join, and only kept ones are laid out by source.
    """
    schema = "lang string, term string, df long, sources array<struct<source: string, n: long>>"
    parts = written(docs.select("text", "lang", "source").mapInArrow(partial(_terms, limit=slice_bytes), schema), "slice-terms")
    kept = parts.groupBy("lang", "term").agg(F.sum("df").alias("df")).filter(F.col("df") >= least)
    each = parts.join(kept, ["lang", "term"], "left_semi").select("lang", "term", F.explode("sources").alias("s"))
    out = written(each.groupBy("lang", F.col("s.source").alias("source"), "term").agg(F.sum("s.n").alias("n")), "term-counts")
    discard(parts)
    return out


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), in whole numbers of 38 digits."""
    wide = lambda c: c.cast("decimal(20,0)")
    parts = F.call_function("div", wide(count + 2) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + 2 * terms))
    return F.lit(1) + parts


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are SCALE + 1 at most, so squares fit 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of apart() over terms for the pairs of a language's sources. Rows: lang, at and p (sources with the term), zero (the share without it, by source)."""
    sums: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for name, total in sums.items():
            i, j = np.triu_indices(len(total), 1)
            if len(i):
                yield pa.record_batch({"lang": pa.array([name] * len(i), pa.string()), "i": pa.array(i.astype(np.int64)), "j": pa.array(j.astype(np.int64)), "value": pa.array(total[i, j])})
        sums.clear()

    for batch in batches:
        names = batch.column("lang").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1], [True]])).tolist() if len(names) else []
        for a, b in zip(edges, edges[1:], strict=False):
            part = batch.slice(a, b - a)
            if names[a] not in sums:
                yield from flush()
            at, p = part.column("at"), part.column("p")
            row = np.repeat(np.arange(b - a), np.diff(at.offsets.to_numpy()))
            zero = np.array(part.column("zero")[0].as_py(), np.int64)
            total = sums.setdefault(names[a], np.zeros((len(zero), len(zero)), np.int64))
            shares = np.tile(zero[:, None], b - a)
            shares[at.flatten().to_numpy(), row] = p.flatten().to_numpy()
            for i in range(len(zero) - 1):
                other = shares[i + 1 :]
                total[i, i + 1 :] += ((other - shares[i]) ** 2 // (other + shares[i])).sum(axis=1)
    yield from flush()


def divergence(docs: DataFrame, least: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language the others by divergence (part 'pair', item:
    the other source) and the terms that it has more of than the language, `top` of them at most (part 'term').

    Null texts, langs and sources count as ''. A source without kept terms, in a language that has some, has the share of
    no occurrences for each; where a language keeps none, pairs have the value 0 and there are no terms. A lone source has
    no pairs. Repeated rows are documents of their own. Other columns are not read. An empty table gives no rows. Terms
    of more than 2^31 bytes can't come, as texts are shorter. The result and one array for each task grow with the square
    of a language's sources, as all their pairs are asked for.
    """
    columns = {"text": text_col, "lang": lang_col, "source": source_col}
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for n, c in columns.items()])
    terms = term_counts(docs, least, slice_bytes)
    of_lang = terms.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"))
    langs = of_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("in_lang").alias("total"))
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("v", F.lit(0)).alias("v"), "total")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # the sources of one language
    zero = F.when(F.col("v") > 0, share(F.lit(0), F.col("own"), F.greatest("v", F.lit(1))))
    groups = written(groups.withColumn("at", place).withColumn("zero", zero), "groups")

    p = terms.join(groups, ["lang", "source"]).select("lang", "source", "term", "at", share(F.col("n"), F.col("own"), F.col("v")).alias("p"))
    found = p.join(of_lang, ["lang", "term"]).join(langs, "lang").withColumn("q", share(F.col("in_lang"), F.col("total"), F.col("v"))).filter("p > q")
    found = found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)

    listed = p.groupBy("lang", "term").agg(F.collect_list(F.struct("at", "p")).alias("l"))  # one entry for each source of a language
    zeros = groups.filter("v > 0").groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "zero"))), lambda x: x["zero"]).alias("zero"))
    rows = listed.join(zeros, "lang").select("lang", F.col("l.at").alias("at"), F.col("l.p").alias("p"), "zero").sortWithinPartitions("lang")
    sums = rows.mapInArrow(_pairs, "lang string, i long, j long, value long").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    ends = groups.select("lang", "source", "at")
    pairs = ends.alias("a").join(ends.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.at") != F.col("b.at"))).select(F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("b.source").alias("item"), F.least("a.at", "b.at").alias("i"), F.greatest("a.at", "b.at").alias("j"))
    pairs = pairs.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by))
    return pairs.unionByName(best).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
