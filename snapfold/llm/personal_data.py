"""Personal data: base spans by pattern, then terms that disclose a protected entity, in DataFrame functions.

An entity is one found value: an address, a number, or a credential, the value that stands behind a word such as token or
password and an equals sign or colon. Over the whole corpus, its information content is
IC(c) = -log2 P(c) with P(c) = n(c) / D, and a term t of the same text shares PMI(c; t) = log2(P(c | t) / P(c)) of it; counts
are of distinct texts, whole ones. P(c | t) = (n(c, t) + P(c)) / (n(t) + 1): one more text, in which the entity is as likely
as anywhere, stands for what small counts cannot tell. PMI(c; t) = IC(c) + log2 P(c | t): a term that hardly occurs apart
from the entity gives all of it away. Terms whose PMI is above 0 and at least IC + log2 `disclosure`, so P(c | t) >=
`disclosure`, are sanitised wherever they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, whole, written

#: Fixed patterns. Possessive repeats match the same strings as greedy ones here, as nothing follows them that they could give back;
#: shorter digit runs than a card's are left out by the pattern, as they would be dropped.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: A credential: the value alone is the match, what must stand before it is looked behind at (bounded, as it has to be).
SECRET = r"(?i)(?<=\b(?:token|secret|password|passwd|api[_-]?key)[\x20\x09]{0,3}[=:][\x20\x09]{0,3}[\"']{0,1})[A-Za-z0-9+/_.-]{12,}+"
SECRET_WORDS = r"(?i)token|secret|passw|api[_-]?key"
KINDS = [*PATTERNS, "term", "secret"]
SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"
TERM = r"[^\p{L}]+"


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        digit = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = lambda i: F.when(i % 2 == 0, digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)).otherwise(digit(i))
        luhn = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + twice(i)) % 10 == 0
        return F.when(n.between(12, 19), luhn).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _found(text: Column, pattern: Column, rank: Column) -> Column:
    """All matches with their places in code points: the pieces between matches and the matches, laid end to end.

    Running sums go block by block, as many blocks as a block has matches, so that many matches in one text stay cheap.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    both = F.filter(F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("value"), gaps.alias("gap")), lambda m: m["value"].isNotNull())
    length = lambda m: m["gap"] + F.length(m["value"])
    none = F.expr(f"cast(array() as {SPAN})")

    def step(a: Column, m: Column) -> Column:
        begin = a["at"] + m["gap"]
        end = a["at"] + length(m)
        span = F.struct(begin.alias("start"), rank.alias("rank"), end.alias("end"), m["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(a["spans"], F.array(span)).alias("spans"))

    def laid(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, m: a + length(m)))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        run = lambda at, b: F.aggregate(b, F.struct(at.alias("at"), none.alias("spans")), step, lambda a: a["spans"])
        return let(starts, lambda at: F.flatten(F.transform(blocks, lambda b, i: run(F.get(at, i), b))))

    def spans(matches: Column) -> Column:
        cut = lambda width: F.transform(F.sequence(F.lit(1), F.size(matches), width), lambda at: F.slice(matches, at, width))
        return let(F.ceil(F.sqrt(F.size(matches))).cast("int"), lambda width: let(cut(width), laid))

    return let(both, lambda matches: F.when(F.size(matches) > 0, spans(matches)).otherwise(none))


def base_spans(text: Column) -> Column:
    """The valid matches of every base kind, by start and then kind. text is not null."""
    def of(rank: int, kind: str) -> Column:
        spans = F.filter(_found(text, F.lit(PATTERNS[kind]), F.lit(rank)), lambda s: _valid(kind, s["value"]))
        here = F.contains(text, F.lit(NEEDS[kind])) & F.regexp_like(text, F.lit(PATTERNS[kind]))
        return F.when(here, spans).otherwise(F.expr(f"cast(array() as {SPAN})"))

    kinds = [of(rank, kind) for rank, kind in enumerate(PATTERNS)]
    return F.array_sort(F.concat(*kinds))


def secret_spans(text: Column) -> Column:
    """The credentials of the text. text is not null."""
    return F.when(F.regexp_like(text, F.lit(SECRET_WORDS)), _found(text, F.lit(SECRET), F.lit(KINDS.index("secret")))).otherwise(F.expr(f"cast(array() as {SPAN})"))


def _terms(text: Column, least: int) -> Column:
    return F.filter(F.array_distinct(F.split(ascii_lower(text), TERM)), lambda t: F.length(t) >= least)


def _outside(text: Column, spans: Column) -> Column:
    """The text with each span replaced by a space, so that an entity is no term of itself. spans: by start."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        between = F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], between, F.lit(" ")).alias("out"))

    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text) - a["at"])))


#: A filter of hashes: CELLS rows of CELL longs, 16 MB whatever it holds.
CELLS, CELL = 4096, 512
BROADCAST_ROWS = 200_000


def _place(term: Column) -> tuple[Column, Column, Column]:
    """The row, the long and the bit of a term in the filter."""
    h = F.xxhash64(term)
    return F.pmod(h, F.lit(CELLS)), F.pmod(F.shiftright(h, 12), F.lit(CELL)).cast("int"), F.pmod(F.shiftright(h, 21), F.lit(64)).cast("int")


def _filter(terms: DataFrame) -> DataFrame:
    """cell, bits: the terms as a bitmap of fixed size. It lets through all of them and, of N, one other word in 2^27 / N."""
    cell, at, bit = _place(F.col("term"))
    held = terms.groupBy(cell.alias("cell"), at.alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    grid = terms.sparkSession.range(CELLS * CELL).select(F.pmod("id", F.lit(CELLS)).alias("cell"), F.floor(F.col("id") / CELLS).cast("int").alias("at"))
    full = grid.join(held, ["cell", "at"], "left").select("cell", "at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return full.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "bits"))), lambda x: x["bits"]).alias("bits"))


def _among(words: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of words (row, term) whose term is one of terms, a written table of distinct ones.

    Up to BROADCAST_ROWS terms are broadcast. More meet the words by a shuffle, but only words that a broadcast filter of
    fixed size lets through are shuffled, so that the corpus's words stay where they are.
    """
    if terms.count() <= BROADCAST_ROWS:
        return words.join(F.broadcast(terms), "term", "left_semi")
    cell, at, bit = _place(F.col("term"))
    met = words.withColumns({"cell": cell, "_at": at, "_bit": bit}).join(F.broadcast(_filter(terms)), "cell")
    # An inner join: a semi join would be moved in front of the filter. Terms are distinct, so it adds no rows.
    return met.filter(F.getbit(F.get("bits", F.col("_at")), F.col("_bit")) == 1).select("row", "term").join(terms.select("term"), "term")


def disclosing_terms(found: DataFrame, docs: DataFrame, disclosure: float = 0.5, least: int = 4, broadcast_rows: int = 200_000) -> DataFrame:
    """term, kind and value of an entity, n_c, n_ct, n_t, pmi, ic for each term that gives entities away.

    found: row (a hash of the text), text, spans; docs: row, text. Terms are runs of letters of at least `least` characters,
    anywhere in a text that holds the entity and outside the entities. Entities of the very same texts have the same counts
    with every term: they are counted as one, of which the least is named.
    """
    total = docs.select("row").distinct().count()
    few = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    values = F.array_distinct(F.transform("spans", lambda s: F.struct(s["rank"].alias("rank"), s["value"].alias("value"))))
    holders = found.select("row", values.alias("entities"), _terms(_outside(F.col("text"), F.col("spans")), least).alias("terms"))
    holders = written(holders.dropDuplicates(["row"]), "entity-texts")
    each = holders.select("row", F.explode("entities").alias("entity"))
    texts = each.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"), F.bit_xor("row").alias("a"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("b"))
    groups = written(texts.groupBy("n_c", "a", "b").agg(F.min("entity").alias("entity")), "entity-groups")
    held = each.join(few(groups), "entity").groupBy("row").agg(F.collect_list(F.struct("entity", "n_c")).alias("groups"))
    both = holders.select("row", "terms").join(held, "row").select(F.explode("groups").alias("g"), "terms")
    pairs = both.select("g.entity", "g.n_c", F.explode("terms").alias("term")).groupBy("entity", "n_c", "term").agg(F.count(F.lit(1)).alias("n_ct"))
    share = F.col("n_c") / F.lit(float(max(1, total)))
    given = lambda n: (F.col("n_ct") + share) / (F.col(n) + 1)
    # n_t is at least what is seen in the texts that hold any entity; what fails on this bound fails on n_t.
    bound = holders.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("bound"))
    pairs = written(pairs.join(bound, "term").filter(given("bound") >= disclosure).drop("bound"), "disclosing-pairs")
    words = docs.select("row", F.explode(_terms(F.col("text"), least)).alias("term"))
    wanted = written(pairs.select("term").distinct(), "disclosing-candidates")
    totals = _among(words, wanted).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    out = pairs.join(totals, "term").withColumn("given", given("n_t")).withColumn("ic", -F.log2(share)).withColumn("pmi", F.log2(F.col("given") / share))
    return out.filter((F.col("given") >= disclosure) & (F.col("pmi") > 0)).select("term", "entity.rank", "entity.value", "n_c", "n_ct", "n_t", "pmi", "ic")


def _held_terms(rows: DataFrame, terms: DataFrame, least: int) -> DataFrame:
    """row, terms for every distinct text that holds one of the terms. terms: a column term, distinct."""
    hits = _among(rows.select("row", F.explode(_terms(F.col("text"), least)).alias("term")), terms)
    return hits.groupBy("row").agg(F.collect_set("term").alias("terms"))  # as many as the text's words at most


def find_personal_data(docs: DataFrame, disclosure: float = 0.5, least: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, base, spans for each row: base spans, and all spans with credentials and disclosing terms. Spans are by start, then kind.

    Null text counts as empty. Rows of one id stay apart; equal rows get equal spans. Null ids are kept. Other columns are
    not read. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).withColumn("row", F.xxhash64("text"))
    found = rows.withColumn("spans", base_spans(F.col("text"))).withColumn("secrets", secret_spans(F.col("text")))
    entities = found.select("row", "text", F.array_sort(F.concat("spans", "secrets")).alias("spans")).filter(F.size("spans") > 0)
    entities = written(entities.dropDuplicates(["row"]), "entity-rows")  # the texts with an entity, found in one pass
    terms = written(disclosing_terms(entities, rows, disclosure, least).select("term").distinct(), "disclosing-terms")
    protected = F.concat("spans", "secrets")
    if terms.isEmpty():
        return found.select("doc_id", "text", F.col("spans").alias("base"), F.array_sort(protected).alias("spans"))
    held = written(_held_terms(rows, terms, least), "held-terms").withColumnRenamed("row", "_row")
    held = F.broadcast(held) if held.count() <= BROADCAST_ROWS else held
    out = found.join(held, F.col("row") == F.col("_row"), "left")
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    extra = F.when(F.col("terms").isNotNull(), _found(ascii_lower(F.col("text")), pattern, F.lit(KINDS.index("term")))).otherwise(F.expr(f"cast(array() as {SPAN})"))
    return out.select("doc_id", "text", F.col("spans").alias("base"), F.array_sort(F.concat(protected, extra)).alias("spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span generalised to its kind in brackets, disclosing terms removed; of overlapping spans the first counts."""
    names = F.array(*[F.lit("" if k == "term" else f"[{k}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,start:int,end:int,rank:int>>").alias("kept"))

    def step(a: Column, s: Column) -> Column:
        own = F.array(F.struct(a["at"].alias("begin"), s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank")))
        go = s["start"] >= a["at"]
        return F.struct(F.when(go, s["end"]).otherwise(a["at"]).alias("at"), F.when(go, F.concat(a["kept"], own)).otherwise(a["kept"]).alias("kept"))

    kept = F.aggregate(spans, start, step)
    part = lambda k: F.concat(F.substring(text, k["begin"] + 1, k["start"] - k["begin"]), F.element_at(names, k["rank"] + 1))
    whole_text = F.concat(F.array_join(F.transform(kept["kept"], part), ""), F.substring(text, kept["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(whole_text)
