"""Katz backoff of order 2: a model of typed tables, trained and read with no row for each token in any shuffle.

The model is three tables in the shared folder, keyed by 64-bit hashes of words and hashed by context into partitions:

* words: word, count (in training texts), tokens (in all texts);
* pairs: context, word, count;
* contexts: context, total, the numbers of its words with each discounted count, and what a backoff weight is made of.

katz.Tables gives them probabilities and exactly normalised weights, and evaluate() there reads any text's tokens from them
by joins. For the whole corpus that would move a row for each token, so here a text's tokens travel packed. Texts are taken
a few MB at a time; each such batch sends one message to each partition that owns one of its contexts: its distinct pairs,
and for each the texts that have it and how often. A message holds a token at least, so messages never outnumber tokens.

1. Words are counted (a plain sum by word). Contexts of more than half a partition's tokens are known from it, at most two
   for each partition, and dealt out by the whole pair.
2. Batches ask the words' owners for counts; owners reply to the partitions that will need them.
3. Messages and replies meet. A partition counts its pairs, writes them and their contexts, and evaluates each message as far
   as it goes without the pair discounts: a seen pair by its count over its context's; an unseen one backs off, its context's
   weight being named, to the word below, and from an unknown word to the class of unknown words.
4. Pair discounts and all weights follow from the written tables; what was left open is added, and a batch's sums meet.

Counts and weights are those of the whole corpus and exact. Batches are numbered by scan partition and place, so texts that
do not come straight from files are written first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete, freed_shuffles, pieces, scratch, strings, whole, written
from .katz import CUT, END, START, Tables, factors
from .packed import deltas, pack, unpack
from .words import mix, word_hashes

#: Tokens for each partition, and bytes of text for each batch.
PART_TOKENS, BATCH_BYTES = 4_000_000, 6 << 20
ASK, WORDS, REPLY, STATE, DOCS, SUMS, CONTEXTS, PAIRS = range(8)
_DDL = "part int, kind int, batch long, blob binary, context long, word long, count long, stats array<double>, below double"
_ARROW = pa.schema([
    ("part", pa.int32()), ("kind", pa.int32()), ("batch", pa.int64()), ("blob", pa.binary()), ("context", pa.int64()), ("word", pa.int64()), ("count", pa.int64()), ("stats", pa.list_(pa.float64())), ("below", pa.float64()),
])
_SALT = np.uint64(0x9E3779B97F4A7C15)

Rows = list[tuple]


def _record(rows: Rows) -> pa.RecordBatch:
    """Rows of (part, kind, batch, blob)."""
    none = [pa.nulls(len(rows), f.type) for f in list(_ARROW)[4:]]
    return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], f.type) for i, f in zip(range(4), _ARROW, strict=False)), *none], schema=_ARROW)


def _typed(part: int, kind: int, **columns: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows of the model's tables, some at a time."""
    n = len(next(iter(columns.values())))
    arrays = [pa.array(np.full(n, {"part": part, "kind": kind}[f.name], np.int32)) if f.name in ("part", "kind") else columns.get(f.name, pa.nulls(n, f.type)) for f in _ARROW]
    whole_batch = pa.RecordBatch.from_arrays(arrays, schema=_ARROW)
    yield from (whole_batch.slice(i, 50_000) for i in range(0, n, 50_000))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What np.unique gives with the inverse, in less than half of its memory: places are 32 bits, and nothing is kept twice."""
    order = np.argsort(values)
    ordered = values[order]
    first = np.ones(len(values), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    kinds = ordered[first]
    del ordered
    places = np.cumsum(first, dtype=np.int32)
    places -= 1
    of = np.empty(len(values), np.int32)
    of[order] = places
    return kinds, of


class Batch:
    """The distinct texts of some rows: tokens with their contexts, and the number of training rows of each text."""

    def __init__(self, rows: pa.RecordBatch) -> None:
        places: dict[str, int] = {}
        self.text_of = np.array([places.setdefault(t, len(places)) for t in strings(rows.column("text"))], np.int64)
        ids, held = rows.column("doc_id"), rows.column("held_out")
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        self.held = held.fill_null(False).to_numpy(zero_copy_only=False)
        self.train = np.bincount(self.text_of[~self.held], minlength=len(places))
        words, at = word_hashes(list(places))
        each, n = np.arange(len(places)), len(words) + len(places)
        self.word, self.context = np.full(n, END, np.uint64), np.full(n, START, np.uint64)
        last, first = np.ones(n, bool), np.ones(n, bool)
        last[at[1:] + each] = first[at[:-1] + each] = False
        self.word[last] = words
        self.context[first] = words
        self.text = np.repeat(each, np.diff(at) + 1)


def _batches(records: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Batch]]:
    first = TaskContext.get().partitionId() << 32
    for record in records:
        for rows in pieces(iter([record]), "text", BATCH_BYTES):
            yield first, Batch(rows)
            first += 1


def _part(context: np.ndarray, word: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each pair."""
    with np.errstate(over="ignore"):
        out = mix(context) % np.uint64(parts)
        spread = np.flatnonzero(np.isin(context, hot))
        out[spread] = mix(context[spread] * _SALT + word[spread]) % np.uint64(parts)
    return out.astype(np.int64)


def _owner(word: np.ndarray, parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(word ^ _SALT) % np.uint64(parts)).astype(np.int64)


def _pieces_of(values: np.ndarray, parts: int) -> np.ndarray:
    """Where each partition's run begins in ascending partition numbers, and the end."""
    return np.searchsorted(values, np.arange(parts + 1))


def _word_counts(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, count in training texts, tokens in all of them (contexts follow: a word is the context of the token behind it)."""
    for _, b in _batches(records):
        words, of = _distinct(b.word)
        counts = np.bincount(of, weights=b.train[b.text], minlength=len(words)).astype(np.int64)
        rows = np.bincount(b.text_of, minlength=len(b.train))
        every = np.bincount(of, weights=rows[b.text], minlength=len(words)).astype(np.int64)
        yield pa.record_batch({"word": _signed(words), "count": pa.array(counts), "tokens": pa.array(every)})


def _word_blobs(records: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The words table, packed for the words' owners."""
    for record in records:
        words, counts = record.column("word").to_numpy().view(np.uint64), record.column("count").to_numpy()
        order = np.lexsort((words, _owner(words, parts)))
        words, counts = words[order], counts[order]
        at = _pieces_of(_owner(words, parts), parts)
        yield _record([(q, WORDS, None, pack(deltas(words[i:j]), counts[i:j])) for q, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i])


def _asks(records: Iterator[pa.RecordBatch], hot: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """To each owner: words and the partitions that will ask for each."""
    for _, b in _batches(records):
        words, of = _distinct(b.word)
        owner = _owner(words, parts)
        order = np.argsort(owner, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        words, owner = words[order], owner[order]
        asking = np.unique(rank[of] * parts + _part(b.context, b.word, hot, parts))
        who, asked = asking % parts, np.bincount(asking // parts, minlength=len(words))
        at, ask_at = _pieces_of(owner, parts), np.concatenate([[0], np.cumsum(asked)])
        yield _record([(q, ASK, None, pack(deltas(words[i:j]), asked[i:j], who[ask_at[i] : ask_at[j]])) for q, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i])


def _rows(records: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for record in records:
        yield from zip(*(record.column(name).to_pylist() for name in ("part", "kind", "batch", "blob")), strict=True)


def _replies(records: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """An owner's counts, to each partition that asked."""
    words, asked, who, known, counts = [], [], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, kind, _, blob in _rows(records):
        first, *rest = unpack(blob)
        if kind == WORDS:
            known.append(np.cumsum(first, dtype=np.uint64)), counts.append(rest[0].astype(np.int64))
        else:
            words.append(np.cumsum(first, dtype=np.uint64)), asked.append(rest[0]), who.append(rest[1])
    if not words:
        return
    known, counts = np.concatenate(known), np.concatenate(counts)
    order = np.argsort(known)
    known, counts = known[order], counts[order]
    of = np.searchsorted(known, np.concatenate(words))
    pairs = np.unique(np.concatenate(who).astype(np.int64) * len(known) + np.repeat(of, np.concatenate(asked)))
    at = _pieces_of(pairs // len(known), parts)
    for p, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
        if j > i:
            place = pairs[i:j] % len(known)
            yield _record([(p, REPLY, None, pack(deltas(known[place]), counts[place]))])


def _messages(records: Iterator[pa.RecordBatch], hot: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Each batch's pairs by partition, and its rows to one of them."""
    for number, b in _batches(records):
        out = [(number % parts, DOCS, number, pack(b.ids, b.null, b.held, b.text_of))]
        known, of = _distinct(b.word)
        begin = int(np.searchsorted(known, np.uint64(START)))  # a token's context is the token before it, or the start
        if begin == len(known) or known[begin] != START:
            known = np.insert(known, begin, START)
            of += of >= begin
        behind = np.empty_like(of)
        behind[1:] = of[:-1]
        behind[b.context == START] = begin
        texts, kinds = len(b.train), len(known)
        key = behind.astype(np.int64) * kinds
        key += of
        del behind, of
        if kinds * kinds * texts < 1 << 63:
            key *= texts
            key += b.text
            key, times = np.unique(key, return_counts=True)
            pair, text = key // texts, key % texts
        else:  # only where one batch is a very long text
            both, times = np.unique(np.stack([key, b.text]), axis=1, return_counts=True)
            pair, text = both
        del key
        part = _part(known[pair // kinds], known[pair % kinds], hot, parts)
        order = np.argsort(part.astype(np.uint32), kind="stable")
        pair, text, times = pair[order], text[order], times[order]
        at = _pieces_of(part[order], parts)
        for p, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if j == i:
                continue
            begin = np.flatnonzero(np.diff(pair[i:j], prepend=-1))
            contexts, follow = np.unique(pair[i:j][begin] // kinds, return_counts=True)
            words, word_of = np.unique(pair[i:j][begin] % kinds, return_inverse=True)
            here, own = np.unique(text[i:j], return_inverse=True)
            out.append((p, SUMS, number, pack(deltas(here), b.train[here], deltas(known[contexts]), follow, deltas(known[words]), word_of, np.diff(begin, append=j - i), own, times[i:j] - 1)))
        yield _record(out)


def _partition(records: Iterator[pa.RecordBatch], hot: np.ndarray, hot_totals: np.ndarray, ends: int, total: int, kinds: int, d: dict[int, float], whole_mass: float, unknown: float) -> Iterator[pa.RecordBatch]:
    """Counts the pairs of a partition; evaluates each message; stores pairs."""
    words, counts, mail, part = [], [], [], None
    for part, kind, batch, blob in _rows(records):
        if kind == DOCS:
            yield _record([(part, DOCS, batch, blob)])
        elif kind == REPLY:
            w, c = unpack(blob)
            words.append(np.cumsum(w, dtype=np.uint64)), counts.append(c.astype(np.int64))
        else:
            mail.append((batch, blob))
    if not mail:
        return
    words, counts = np.concatenate(words), np.concatenate(counts)
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    factor = np.array([1.0, *[d[r] for r in range(1, CUT + 1)], 1.0])
    p1 = np.where(counts > 0, counts * factor[np.minimum(counts, CUT + 1)] / whole_mass, unknown)

    contexts = np.unique(np.concatenate([np.cumsum(unpack(blob)[2], dtype=np.uint64) for _, blob in mail]))
    keys, trained = [], []
    for _, blob in mail:
        _, train, context, follow, word, word_of, texts, text, times = unpack(blob)
        c = np.searchsorted(contexts, np.cumsum(context, dtype=np.uint64))
        w = np.searchsorted(words, np.cumsum(word, dtype=np.uint64))
        keys.append(np.repeat(c, follow) * len(words) + w[word_of])
        trained.append(np.add.reduceat((times.astype(np.int64) + 1) * train[text], np.concatenate([[0], np.cumsum(texts[:-1], dtype=np.int64)])))
    lengths = [len(k) for k in keys]
    every = np.concatenate(keys)
    keys.clear()
    pairs, of = _distinct(every)
    del every
    have = np.bincount(of, weights=np.concatenate(trained), minlength=len(pairs)).astype(np.int64)
    trained.clear()
    c_of, w_of = pairs // len(words), pairs % len(words)
    seen, low = have > 0, np.minimum(have, CUT + 1)
    size = len(contexts)
    in_hot = np.isin(contexts, hot)
    totals = np.bincount(c_of, weights=have, minlength=size)
    if len(hot):
        totals[in_hot] = hot_totals[np.searchsorted(hot, contexts[in_hot])]
    table = np.bincount(c_of * (CUT + 2) + low, minlength=size * (CUT + 2)).reshape(size, CUT + 2)[:, 1 : CUT + 1]
    above = np.bincount(c_of, weights=np.where(have > CUT, have, 0), minlength=size)
    below = np.bincount(c_of, weights=np.where(seen, p1[w_of], 0.0), minlength=size)
    divisor = totals + 1 - (table.sum(1) > 0)
    stats = np.column_stack([totals, table, above])[totals > 0]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, stats.shape[1]), pa.int32()), pa.array(stats.ravel()))
    yield from _typed(part, CONTEXTS, context=_signed(contexts[totals > 0]), stats=lists, below=pa.array(below[totals > 0]))
    yield from _typed(part, PAIRS, context=_signed(contexts[c_of[seen]]), word=_signed(words[w_of[seen]]), count=pa.array(have[seen]))
    yield _record([(part, STATE, None, pack(np.bincount(np.minimum(have, CUT + 2), minlength=CUT + 3)))])

    with np.errstate(divide="ignore"):
        value = np.where(seen, np.log10(have) - np.where(in_hot, 0.0, np.log10(divisor))[c_of], np.log10(p1[w_of]))
        own = np.where(contexts == START, ends, totals)
        base = np.log10((own + 0.1) / (total + 0.1 * (kinds + 1)))
    at = 0
    for (batch, blob), n in zip(mail, lengths, strict=True):
        own_texts, train, _, _, _, _, texts, text, times = unpack(blob)
        names = np.cumsum(own_texts, dtype=np.int64)  # of the message's texts in their batch
        of_each, times = np.repeat(of[at : at + n], texts), times.astype(np.int64) + 1
        at += n
        c, some = c_of[of_each], len(train)
        add = lambda weights, text=text, some=some: np.bincount(text, weights=weights, minlength=some)
        tokens = add(times)
        here = np.flatnonzero(tokens)
        lows = np.bincount(text.astype(np.int64) * (CUT + 2) + low[of_each], weights=times, minlength=some * (CUT + 2)).reshape(some, CUT + 2)[here, 1 : CUT + 1]
        opened = ~seen[of_each] & (totals[c] > 0)
        cold, warm, done = np.flatnonzero(opened & ~in_hot[c]), np.flatnonzero(opened & in_hot[c]), np.flatnonzero(seen[of_each] & in_hot[c])
        open_c, open_of = np.unique(c[cold], return_inverse=True)
        hot_of = lambda k, c=c: np.searchsorted(hot, contexts[c[k]])
        yield _record([(part, SUMS, batch, pack(
            names[here], add(value[of_each] * times)[here], add(base[c] * times)[here], add((own[c] > 0) * times)[here].astype(np.int64), tokens[here].astype(np.int64), lows.astype(np.int64).ravel(),
            names[text[cold]], open_of, times[cold], table[open_c].ravel(), above[open_c].astype(np.int64), divisor[open_c].astype(np.int64), below[open_c],
            names[text[warm]], hot_of(warm), times[warm], names[text[done]], hot_of(done), times[done],
        ))])


def _weight(table: np.ndarray, above: np.ndarray, divisor: np.ndarray, below: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Backoff weights of contexts: what their seen words leave, over what these leave in the order below."""
    return (1 - (table @ (np.arange(1, CUT + 1) * d) + above) / divisor) / (1 - below)


def _finish(records: Iterator[pa.RecordBatch], d: np.ndarray, hot_weights: np.ndarray, hot_divisors: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Closes each message's sums with the discounts and weights."""
    for part, kind, batch, blob in _rows(records):
        if kind == DOCS:
            yield _record([(part, DOCS, batch, blob)])
            continue
        here, score, base, known, tokens, lows, text, of, times, table, above, divisor, below, w_text, w_hot, w_times, d_text, d_hot, d_times = unpack(blob)
        more = lows.reshape(len(here), CUT) @ np.log10(d)
        weights = _weight(table.reshape(len(above), CUT).astype(np.float64), above, divisor, below, d)
        for texts, values, count in ((text, np.log10(weights)[of], times), (w_text, np.log10(hot_weights)[w_hot], w_times), (d_text, -np.log10(hot_divisors)[d_hot], d_times)):
            more += np.bincount(np.searchsorted(here, texts), weights=values * count, minlength=len(here))
        yield _record([(part, SUMS, batch, pack(here, score + more, base, known, tokens))])


def _collect(records: Iterator[pa.RecordBatch], total: int) -> Iterator[pa.RecordBatch]:
    """The rows of each batch with the sums of its messages. A task has as many batches as about PART_TOKENS tokens make."""
    rows: dict[int, bytes] = {}
    sums: dict[int, np.ndarray] = {}
    for _, kind, batch, blob in _rows(records):
        if kind == DOCS:
            rows[batch] = blob
            continue
        here, *values = unpack(blob)
        top = int(here[-1]) + 1
        old = sums.get(batch)
        if old is None or old.shape[1] < top:
            sums[batch] = np.zeros((4, top))
            if old is not None:
                sums[batch][:, : old.shape[1]] = old
        sums[batch][:, here] += np.stack([v.astype(np.float64) for v in values])
    for batch, blob in rows.items():
        ids, null, held, of = unpack(blob)
        score, base, known, tokens = sums.pop(batch)[:, of]
        yield pa.record_batch({
            "doc_id": pa.array(ids.astype(np.uint64).view(np.int64), mask=null.astype(bool)), "held_out": pa.array(held.astype(bool)), "n_tokens": pa.array(tokens.astype(np.int64)), "n_known": pa.array(known.astype(np.int64)),
            "train_tokens": pa.array(np.full(len(ids), total, np.int64)), "base_score": pa.array(base), "score": pa.array(score),
        })


def score_pairs(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", stable: bool = False) -> tuple[DataFrame, Tables]:
    """What katz.score_documents gives for order 2, and the model. stable: docs comes straight from files, so its rows keep their order."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).withColumn("held_out", held)
    texts = texts if stable else written(texts, "katz-texts")
    home = scratch(spark, "katz-pairs")

    def table(df: DataFrame, name: str) -> DataFrame:
        with freed_shuffles(spark):
            # A dictionary of a row group's words is larger than the default limit, beyond which hashes would be written out.
            df.write.option("compression", "zstd").option("parquet.dictionary.page.size", 8 << 20).parquet(f"{home}/{name}")
        return spark.read.schema(df.schema).parquet(f"{home}/{name}")

    words = table(texts.mapInArrow(_word_counts, "word long, count long, tokens long").groupBy("word").agg(F.sum("count").alias("count"), F.sum("tokens").alias("tokens")), "words")
    low = F.least(F.col("count"), F.lit(CUT + 2)).cast("int")
    by_count = words.groupBy(low.alias("r")).agg(F.count(F.lit(1)).alias("kinds"), F.sum("count").alias("count"), F.sum("tokens").alias("tokens")).collect()
    total, kinds, n = sum(r["count"] for r in by_count), sum(r["kinds"] for r in by_count if r["r"]), sum(r["tokens"] for r in by_count)
    parts = max(12, n // PART_TOKENS, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)
    # The end of a text is no context, but as many tokens follow its start. Two contexts for each partition at most.
    large = words.filter((F.col("tokens") * 2 > PART_TOKENS) | (F.col("word") == END)).collect()
    sizes = {int(np.int64(START if r["word"] == END else r["word"]).view(np.uint64)): r for r in large}
    ends = sizes[START]["count"] if START in sizes else 0
    hot = np.sort(np.array([h for h, r in sizes.items() if r["tokens"] * 2 > PART_TOKENS], np.uint64))
    hot_totals = np.array([sizes[int(h)]["count"] for h in hot], np.float64)
    of_counts = {r["r"]: r["kinds"] for r in by_count}
    d = factors({r: of_counts.get(r, 0) for r in range(1, CUT + 2)})
    kept = total - sum(r * of_counts.get(r, 0) * (1 - d[r]) for r in range(1, CUT + 1))
    mass = float(total if total and total - kept > 1e-9 * total else total + 1)
    unknown = (mass - kept) / mass

    asks = texts.mapInArrow(lambda rows: _asks(rows, hot, parts), _DDL).unionByName(words.mapInArrow(lambda rows: _word_blobs(rows, parts), _DDL))
    replies = table(asks.repartitionById(parts, F.col("part")).mapInArrow(lambda rows: _replies(rows, parts), _DDL), "replies")
    messages = texts.mapInArrow(lambda rows: _messages(rows, hot, parts), _DDL)
    met = messages.unionByName(replies).repartitionById(parts, F.col("part"))
    out = table(met.mapInArrow(lambda rows: _partition(rows, hot, hot_totals, ends, total, kinds, d, mass, unknown), _DDL), "pairs")
    delete(spark, f"{home}/replies")
    of_counts = sum((unpack(r["blob"])[0].astype(np.int64) for r in out.filter(F.col("kind") == STATE).select("blob").collect()), np.zeros(CUT + 3, np.int64))
    d2 = factors({r: int(of_counts[r]) for r in range(1, CUT + 2)})
    model = Tables(words, mass, unknown, d, out.filter(F.col("kind") == PAIRS).select("context", "word", "count"), out.filter(F.col("kind") == CONTEXTS).select("context", "stats", "below"), d2)
    d2 = np.array([d2[r] for r in range(1, CUT + 1)])

    own = model.contexts().filter(F.col("context").isin([int(h) for h in hot.view(np.int64)])).collect() if len(hot) else []
    by_hot = {int(np.int64(r["context"]).view(np.uint64)): r for r in own}
    divisors = np.array([by_hot[int(h)]["divisor"] if int(h) in by_hot else 1.0 for h in hot])
    weights = np.array([by_hot[int(h)]["weight"] if int(h) in by_hot else 1.0 for h in hot])

    closed = out.filter(F.col("kind").isin(DOCS, SUMS)).select(*[f.name for f in _ARROW]).mapInArrow(lambda rows: _finish(rows, d2, weights, divisors), _DDL)
    columns = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return closed.select("part", "kind", "batch", "blob").repartition(parts, "batch").mapInArrow(lambda rows: _collect(rows, total), columns), model
