"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming search, exact weighted check.

Item and window get 64-bit SimHash fingerprints over their k-word shingles, each weighted by how often it occurs. A
fingerprint is cut into BLOCKS blocks. Two fingerprints within RADIUS bits are within RADIUS // BLOCKS bits in one block at
least, so items are indexed under every value that near to each of their blocks, and a window looks up its own five
values: all items of its length within the radius are found.

A window of similarity s or more shares at least s * parts shingles with its item (parts: the shingles of an item of that
length), so windows are laid, word by word, only where so many shingles stand that any item of that length has; which
item it is, the fingerprints tell. Items of more than STEPS shingles get windows at every (parts // STEPS)-th word, where
as many shingles less one step stand: the best window lies within half a step of one of these.

A document and an item that meet so go on to the exact check, which looks at all windows of the document, on a grid or
not. A shared shingle at place p counts in the windows that start in one interval: not behind p, not so early that the
window ends before p or that it holds more of this shingle than the item does. Sums over the ends of these intervals give
the shared weight of every window at once, and so the weighted Jaccard similarity of the best one.

RADIUS is statistical: of shingle bags of similarity 0.8, the expected distance is 9.7 bits with a deviation of 2.9, as
long as many shingles make up the weight. Where few do (the sum of squared shares is over 1 / EFFECTIVE: heavily repeated
text, and items of a few words), fingerprints tell little; such items are met on their own shingles, document by
document, and go to the exact check without them. tests/llm measures the recall. All in DataFrame functions.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

#: Fingerprints within RADIUS bits are found for certain: BLOCKS blocks, values within RADIUS // BLOCKS bits of each.
RADIUS, BLOCKS = 19, 5
STEPS = 2000
#: Items whose weight rests on fewer shingles than this, by the sum of squared shares, are met without fingerprints.
EFFECTIVE = 8
BREAKS = r"[^\p{L}\p{N}]+"
BROADCAST_ROWS = 200_000
#: Two 32-bit counters in a long; 32 longs count the 64 bits of shingle hashes.
_LANES = 0x0000000100000001


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), BREAKS), lambda w: w != "")


def grams(words: Column, k: int) -> Column:
    """The hash of each run of k words; none for fewer words."""
    full = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(F.size(words) >= k, full).otherwise(F.array().cast("array<bigint>"))


def shingles_of(words: Column, k: int) -> Column:
    """The k-word shingles as text; the whole sequence for fewer words; none without words."""
    n = F.size(words)
    full = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)]))
    return F.when(n >= k, full).when(n > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def simhash(df: DataFrame, keys: list[str], hashes: str) -> DataFrame:
    """keys, fingerprint: bit b is 1 where more than half of the hashes (with repeats, so by weight) have it."""
    each = df.select(*keys, F.explode(hashes).alias("_h"))
    sums = [F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(F.lit(_LANES))).alias(f"_{k}") for k in range(32)]
    counts = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *sums)
    bit = lambda b: F.when(F.shiftrightunsigned(f"_{b % 32}", b // 32 * 32).bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("_n"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0))
    out = bit(0).cast("long")
    for b in range(1, 64):
        out = out.bitwiseOR(bit(b).cast("long"))
    return counts.select(*keys, out.alias("fingerprint"))


def _edges() -> list[tuple[int, int]]:
    cuts = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _block(fingerprint: Column, a: int, b: int) -> Column:
    return F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).cast("int")


def blocks(fingerprint: Column) -> Column:
    """(block, value) of each block of the fingerprint."""
    return F.array(*[F.struct(F.lit(i).alias("block"), _block(fingerprint, a, b).alias("value")) for i, (a, b) in enumerate(_edges())])


def near_blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """(block, value) of every value within radius // BLOCKS bits of each block."""

    def around(i: int, a: int, b: int) -> Column:
        masks = [sum(1 << x for x in on) for n in range(radius // BLOCKS + 1) for on in combinations(range(b - a), n)]
        value = _block(fingerprint, a, b)
        return F.transform(F.lit(masks), lambda m: F.struct(F.lit(i).alias("block"), value.bitwiseXOR(m).alias("value")))

    return F.flatten(F.array(*[around(i, a, b) for i, (a, b) in enumerate(_edges())]))


def weighted_jaccard(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, similarity of two arrays as bags: the sum of the lesser counts over the sum of the greater ones."""
    both = F.concat(F.transform(x, lambda v: F.struct(v.alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y"))), F.transform(y, lambda v: F.struct(v.alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y"))))
    counts = pairs.select(*keys, F.explode(both).alias("e")).groupBy(*keys, "e.v").agg(F.sum("e.x").alias("x"), F.sum("e.y").alias("y"))
    sums = counts.groupBy(*keys).agg(F.sum(F.least("x", "y")).alias("least"), F.sum(F.greatest("x", "y")).alias("most"))
    return sums.select(*keys, (F.col("least") / F.col("most")).alias("similarity"))


def _placed(worded: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, row, size, pos, shingle for the runs of each size."""
    each = [worded.select("doc_id", "row", F.lit(n).alias("size"), F.posexplode(grams(F.col("words"), n)).alias("pos", "shingle")) for n in sizes]
    return reduce(DataFrame.unionByName, each)


def _starts(hits: Column, parts: Column, need: Column, last: Column, step: Column) -> Column:
    """The starts of all windows of `parts` places that hold `need` of the ascending hits, each once: they follow from runs of hits.

    Runs of need hits from hit i on lie in the windows that start between hit i + need - 1, less the window, and hit i; those
    from hit i - 1 on have given all starts up to that hit.
    """
    def of(i: Column) -> Column:
        own, end = F.get(hits, i), F.get(hits, i + need - 1)
        low = F.greatest(end - parts + 1, F.coalesce(F.when(i > 0, F.get(hits, i - 1) + 1), F.lit(0)), F.lit(0))
        high = F.least(own, last)
        first = F.when(low >= last, last).otherwise(F.least(F.ceil(low / step).cast("int") * step, last))
        return F.when((low <= own) & (first <= high), F.sequence(first, high, step)).when((low <= own) & (low <= last) & (high == last), F.array(last)).otherwise(F.array().cast("array<int>"))

    runs = F.when(F.size(hits) >= need, F.sequence(F.lit(0), F.size(hits) - need)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(runs, of)))


def _bags(items: DataFrame) -> DataFrame:
    """item_key, size, shingle, copies of each item, and firm: whether its weight rests on EFFECTIVE shingles at least."""
    each = items.select("item_key", "size", F.explode("hashes").alias("shingle")).groupBy("item_key", "size", "shingle").agg(F.count(F.lit(1)).alias("copies"))
    firm = each.groupBy("item_key").agg((F.sum(F.col("copies") * F.col("copies")) * EFFECTIVE <= F.sum("copies") * F.sum("copies")).alias("firm"))
    return each.join(firm, "item_key")


def _best_windows(candidates: DataFrame, worded: DataFrame, bags: DataFrame, items: DataFrame, sizes: list[int], least: float, small) -> DataFrame:  # noqa: ANN001
    """doc_id, row, item_key, start, length of each candidate's first window of most shared weight, if it has `least` of similarity."""
    some = candidates.join(small(items.select("item_key", "size", "length")), "item_key").withColumnsRenamed({"doc_id": "_doc", "row": "_row"})
    docs = candidates.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row"))
    held = worded.join(docs, same, "left_semi").dropDuplicates(["doc_id", "row"])
    n = F.size("words")
    each = [held.select("doc_id", "row", F.lit(k).alias("size"), n.alias("n_words"), F.posexplode(grams(F.col("words"), k)).alias("pos", "shingle")) for k in sizes]
    occurring = reduce(DataFrame.unionByName, each).groupBy("doc_id", "row", "size", "n_words", "shingle").agg(F.array_sort(F.collect_list("pos")).alias("at"))  # places in one document
    met = occurring.join(some, same & (occurring["size"] == some["size"])).drop(some["size"]).join(small(bags.select("item_key", "shingle", "copies")), ["item_key", "shingle"])
    parts, last = F.col("length") - F.col("size") + 1, F.greatest(F.col("n_words") - F.col("length"), F.lit(0))

    def interval(p: Column, i: Column) -> Column:
        too_many = F.coalesce(F.get(F.col("at"), (i - F.col("copies")).cast("int")) + 1, F.lit(0))
        return F.struct(F.greatest(too_many, p - parts + 1, F.lit(0)).alias("lo"), F.least(p, last).alias("hi"))

    spans = met.select("doc_id", "row", "item_key", "length", "size", "n_words", F.explode(F.transform("at", interval)).alias("s")).filter("s.lo <= s.hi")
    ends = F.explode(F.array(F.struct(F.col("s.lo").alias("start"), F.lit(1).alias("d")), F.struct((F.col("s.hi") + 1).alias("start"), F.lit(-1).alias("d")))).alias("e")
    key = ["doc_id", "row", "item_key", "length", "size", "n_words"]
    steps = spans.select(*key, ends).groupBy(*key, "e.start").agg(F.sum("e.d").alias("d"))
    shared = F.sum("d").over(Window.partitionBy("doc_id", "row", "item_key").orderBy("start"))  # the starts of one document
    best = steps.withColumn("shared", shared).groupBy(*key).agg(F.min(F.struct((-F.col("shared")).alias("less"), "start")).alias("best"))
    own = F.least(parts, F.col("n_words") - F.col("size") + 1)
    like = -F.col("best.less") / (own + parts + F.col("best.less"))
    return best.filter(like >= least - 1e-9).select("doc_id", "row", "item_key", F.col("best.start").alias("start"), "length")


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (the hash of the row's text), item_id, start_word, similarity: as contaminated(), each text of an id on its own."""
    items = benchmark.filter("item_id is not null").select("item_id", words_of(F.coalesce("text", F.lit(""))).alias("item_words")).dropDuplicates().filter(F.size("item_words") > 0)
    items = items.withColumn("item_key", F.xxhash64("item_id", "item_words")).withColumn("length", F.size("item_words"))
    items = items.withColumn("size", F.least("length", F.lit(k)))
    # Items of fewer than k words are met on runs of their own length; there are k - 1 such lengths at most.
    sizes = [k, *sorted(r["length"] for r in items.filter(F.col("length") < k).select("length").distinct().collect())]
    own = F.coalesce(*[F.when(F.col("size") == n, grams(F.col("item_words"), n)) for n in sizes])
    items = written(items.select("item_id", "item_key", "length", "size", own.alias("hashes"), shingles_of(F.col("item_words"), k).alias("item_shingles")), "items")
    bags = written(_bags(items), "item-bags")
    small = (lambda df: F.broadcast(df)) if bags.count() <= BROADCAST_ROWS else (lambda df: df)
    # Firm items are met by length, all of them at once; each other one by itself.
    lengths = bags.join(small(items.select("item_key", "length")), "item_key")
    index = written(lengths.select("size", "length", F.when(~F.col("firm"), F.col("item_key")).alias("alone"), "shingle").distinct(), "item-index")

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    worded = rows.select("doc_id", "row", words_of(F.col("text")).alias("words"))
    hits = _placed(worded, sizes).join(small(index), ["size", "shingle"]).groupBy("doc_id", "row", "size", "length", "alone").agg(F.array_sort(F.collect_set("pos")).alias("hits"))  # places in one document
    parts = F.col("length") - F.col("size") + 1
    step = F.greatest(F.floor(parts / STEPS), F.lit(1)).cast("int")
    grid = F.when((step > 1) & F.col("alone").isNull(), step).otherwise(0)
    need = F.greatest(F.ceil(parts * similarity - 1e-9) - grid, F.lit(1)).cast("int")
    hits = written(hits.withColumns({"parts": parts, "need": need, "step": step}).filter(F.size("hits") >= F.col("need")), "hits")

    of_length = hits.filter("alone is null").drop("alone")
    near = F.broadcast(of_length) if of_length.count() <= BROADCAST_ROWS else of_length
    near = near.withColumnsRenamed({"doc_id": "_doc", "row": "_row"})
    found = worded.join(near, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row")))
    last = F.greatest(F.size("words") - F.col("length"), F.lit(0))
    places = found.select("doc_id", "row", "size", "length", "words", F.explode(_starts(F.col("hits"), F.col("parts"), F.col("need"), last, F.col("step"))).alias("start"))
    # Words are cut first, so that whole texts stay out of the shuffle; rows that repeat an id and a text give their windows once.
    windows = places.select("doc_id", "row", "size", "length", "start", F.slice("words", F.col("start") + 1, F.col("length")).alias("window"))
    key = ["doc_id", "row", "length", "start"]
    of_size = F.coalesce(*[F.when(F.col("size") == n, grams(F.col("window"), n)) for n in sizes])
    hashed = windows.dropDuplicates(key).select(*key, of_size.alias("hashes"))
    marks = simhash(hashed, key, "hashes").withColumn("b", F.explode(blocks(F.col("fingerprint"))))
    firm = items.join(small(bags.filter("firm").select("item_key").distinct()), "item_key", "left_semi")
    known = simhash(firm, ["item_key", "length"], "hashes").withColumnRenamed("fingerprint", "item_fingerprint").withColumn("b", F.explode(near_blocks(F.col("item_fingerprint"), radius)))
    alike = marks.join(known, ["length", "b"]).filter(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))) <= radius)
    alone = hits.filter("alone is not null").select("doc_id", "row", F.col("alone").alias("item_key"))
    candidates = written(alike.select("doc_id", "row", "item_key").unionByName(alone).distinct(), "candidates")

    best = _best_windows(candidates, worded, bags, items, sizes, similarity, small)
    # What the hashes of shingles say is checked on the shingles themselves.
    best = written(best.withColumnsRenamed({"doc_id": "_doc", "row": "_row"}), "best-windows")
    few = F.broadcast(best) if best.count() <= BROADCAST_ROWS else best
    cut = worded.dropDuplicates(["doc_id", "row"]) if best.count() > BROADCAST_ROWS else worded
    checked = cut.join(few, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row"))).select("doc_id", "row", "item_key", "start", F.slice("words", F.col("start") + 1, F.col("length")).alias("window"))
    checked = checked.dropDuplicates(["doc_id", "row", "item_key"]).select("doc_id", "row", "item_key", "start", shingles_of(F.col("window"), k).alias("shingles"))
    checked = checked.join(items.select("item_key", "item_id", "item_shingles"), "item_key")
    scored = weighted_jaccard(checked, ["doc_id", "row", "item_id", "item_key", "start"], "shingles", "item_shingles").filter(F.col("similarity") >= similarity)
    first = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("start").alias("start")))
    out = scored.groupBy("doc_id", "row", "item_id").agg(first.alias("best"))
    out = written(out.select("doc_id", "row", "item_id", F.col("best.start").cast("long").alias("start_word"), (-F.col("best.s")).alias("similarity")), "contaminated")
    discard(hits, candidates, best, index, bags, items)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start_word, similarity: for each document and item the best window of `similarity` or more.

    docs and benchmark (item_id, text) are read by these names only. Null, empty or wordless texts and items match
    nothing, and items of null id are passed over. An item of fewer than k words is one shingle. A document shorter than
    the item is one window. Rows of one doc_id are told apart by text, and the best of them is returned; a null id is
    returned as null. Of equal windows the first is named: all windows of a document that meets an item are compared.
    Items are broadcast only while they have BROADCAST_ROWS shingles at most. Texts and items may have any length; empty
    tables give no rows.
    """
    scored = contaminated_rows(docs, benchmark, k, similarity, radius, id_col, text_col)
    best = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("start_word").alias("start")))
    return scored.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", F.col("best.start").alias("start_word"), (-F.col("best.s")).alias("similarity"))
