"""Token ids as directly addressable codes.

An id is cut into chunks of 8 bits, the lowest first. Level k holds the k-th chunk of every id that has one, as bytes;
beside it stands a bitmap with one bit for each of its entries, set where the id goes on in level k + 1, and a rank
directory with the number of set bits before each block of 512. Token i is read from level 0 at i; if its bit is set,
its next chunk is at rank(i) in level 1, and so on: no block is decoded.

A token file is a Parquet table of segments (SEGMENT below). A segment holds whole documents in ascending id order;
`part` and `seg` order the segments, so the table as a whole is one sequence of tokens.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, strings

#: Texts with white space that is neither a line end nor a space before a visible character are not cut.
_ODD = r" \s| $|^[\s]|[^\S\n]\n|\x00|[\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Punctuation that makes a pre-token of its own behind a word, and letters that are not so in every version of Unicode.
_TAIL, _RARE = ".,;:!?#$%&*", r"[^\x{00}-\x{24F}]"
BLOCK = 512
SEGMENT_TOKENS = 1 << 20
BROADCAST_PARTS = 2_000_000
SEGMENT = (
    "part int, seg int, before long, n_docs long, n_tokens long, doc_ids array<long>, doc_ends array<long>,"
    " levels array<binary>, more array<binary>, ranks array<binary>"
)


def dac_encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """The levels, continuation bitmaps and rank directories of ids (unsigned 32 bit)."""
    levels, more, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        levels.append((rest & 255).astype(np.uint8).tobytes())
        high = rest >> 8
        on = high > 0
        bits = np.packbits(on, bitorder="little")
        blocks = np.add.reduceat(on.astype(np.uint32), np.arange(0, len(on), BLOCK)) if len(on) else np.zeros(0, np.uint32)
        more.append(bits.tobytes())
        ranks.append(np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype("<u4").tobytes() if len(on) else b"")
        rest = high[on]
        if not len(rest):
            return levels, more, ranks


def dac_decode(levels: list[bytes], more: list[bytes]) -> np.ndarray:
    """All ids, from the last level to the first."""
    above = np.zeros(0, np.uint32)
    for level, bits in zip(reversed(levels), reversed(more), strict=True):
        own = np.frombuffer(level, np.uint8).astype(np.uint32)
        if len(above):
            on = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own), bitorder="little").view(bool)
            own[on] |= above << 8
        above = own
    return above


def dac_at(levels: list[bytes], more: list[bytes], ranks: list[bytes], i: int) -> int:
    """Token i, by one byte and one rank in each of its levels."""
    value = shift = 0
    for level, bits, rank in zip(levels, more, ranks, strict=True):
        value |= level[i] << shift
        if not bits[i >> 3] >> (i & 7) & 1:
            return value
        block = i // BLOCK
        before = int.from_bytes(bits[block * BLOCK // 8 : (i >> 3) + 1], "little") & ((1 << (i - block * BLOCK)) - 1)
        i = int.from_bytes(rank[4 * block : 4 * block + 4], "little") + before.bit_count()
        shift += 8
    raise ValueError("the last level has a continuation bit")


def _byte_letters() -> dict[int, str]:
    """The letter for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b if b in own else 256 + sum(x not in own for x in range(b))) for b in range(256)}


class WordIds:
    """Ids of the parts that texts fall into, from the tokenizers library; a word met before costs one look-up.

    At most `most` plain words are kept, as bytes.
    """

    def __init__(self, path: str, most: int = 500_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        before = str(self.tokenizer.pre_tokenizer)
        # With this splitting rule a pre-token starts at every space with a visible character behind it and at every run of line ends.
        self.cuts = before.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in before and self.tokenizer.normalizer is None
        self.cuts &= len(self.tokenizer.encode("\n", add_special_tokens=False).ids) == 1
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([_ODD, *special])
        self.model, self.letters, self.plain = self.tokenizer.model.tokenize, _byte_letters(), {}

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _stems(self, stems: list[str]) -> list[bytes]:
        """Words of letters behind a space: one pre-token each."""
        if len(self.plain) >= self.most:
            self.plain.clear()
        plain, model = self.plain, self.model
        for word in stems:
            if word not in plain:
                spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                plain[word] = self._packed([t.id for t in model("Ġ" + spelled)])
        return [plain[word] for word in stems]

    def _pool(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(units), self.kind), np.fromiter(map(len, units), np.int64, len(units)) // self.kind.itemsize

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, each behind a space unless it begins with a line end; and how many each has."""
        stems = pc.utf8_rtrim(words, _TAIL)
        plain = pc.fill_null(pc.and_(pc.utf8_is_alpha(stems), pc.invert(pc.match_substring_regex(stems, _RARE))), False)
        is_plain = plain.to_numpy(zero_copy_only=False)
        cut = words.filter(plain)
        own = stems.filter(plain).dictionary_encode()
        ends = pa.array([w[n:] for w, n in zip(strings(cut), strings(pc.utf8_length(stems.filter(plain))), strict=True)], pa.string()).dictionary_encode()
        others = [self._whole(w if w[:1] == "\n" else " " + w) if w else b"" for w in strings(words.filter(pc.invert(plain)))]
        units = [*self._stems(strings(own.dictionary)), *(self._whole(t) if t else b"" for t in strings(ends.dictionary)), *others, b""]
        pool, size = self._pool(units)
        first, second = np.empty(len(words), np.int64), np.full(len(words), len(units) - 1)
        first[is_plain] = own.indices.to_numpy(zero_copy_only=False)
        second[is_plain] = len(own.dictionary) + ends.indices.to_numpy(zero_copy_only=False)
        first[~is_plain] = len(own.dictionary) + len(ends.dictionary) + np.arange(len(others))
        both = np.stack([first, second], axis=1)
        return gathered(pool, size, both.ravel()), size[both].sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after another, and how many each has: as Tokenizer.encode(text, add_special_tokens=False).

        Each distinct part of the batch is looked up once; texts that may not be cut so go to the library as a whole.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.or_(pc.match_substring_regex(texts, self.odd), pc.equal(texts, "")) if self.cuts else pa.array([True] * len(texts))
        even = texts.filter(pc.invert(odd))
        # A line end in front of each text: what follows no space then always follows a line end, whose one id is taken off again.
        spaced = pc.replace_substring_regex(even, "(\n+)", r" \1") if pc.any(pc.match_substring(even, "\n\n")).as_py() else pc.replace_substring(even, "\n", " \n")
        lined = pc.binary_join_element_wise(pa.scalar("\n", even.type), spaced, pa.scalar("", even.type))
        parts = pc.split_pattern(lined, " ")
        coded = parts.flatten().dictionary_encode()
        pool, size = self._words(coded.dictionary.cast(pa.string()))
        codes = coded.indices.to_numpy(zero_copy_only=False)
        flat = gathered(pool, size, codes)
        words = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]).astype(np.int64)
        stops = np.concatenate([[0], np.cumsum(size[codes])])[words]
        counts = np.zeros(len(texts), np.int64)
        is_odd = odd.to_numpy(zero_copy_only=False)
        counts[~is_odd] = np.diff(stops) - 1
        keep = np.ones(len(flat), bool)
        keep[stops[:-1]] = False
        flat = flat[keep]
        if not is_odd.any():
            return flat, counts
        own, counts[is_odd] = self._pool([self._whole(t) for t in strings(texts.filter(odd))])
        out, inside = np.empty(int(counts.sum()), self.kind), np.repeat(is_odd, counts)
        out[~inside], out[inside] = flat, own
        return out, counts


def gathered(pool: np.ndarray, size: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs of `pool` (whose lengths are `size`) that codes name, one after another."""
    if not len(codes):
        return pool[:0]
    each, begin = size[codes], (np.cumsum(size) - size)[codes]
    ends = np.cumsum(each)
    return pool[np.arange(int(ends[-1])) + np.repeat(begin - ends + each, each)]


_CACHE: dict[str, WordIds] = {}


def _encoder(path: str) -> WordIds:
    if path not in _CACHE:
        _CACHE.clear()
        _CACHE[path] = WordIds(path)
    return _CACHE[path]


def _segments(batches: Iterator[pa.RecordBatch], path: str, end: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    encoder, part, seg, before = _encoder(path), TaskContext.get().partitionId(), 0, 0
    ids: list[np.ndarray] = []
    docs: list[pa.Array] = []
    sizes: list[np.ndarray] = []

    def segment() -> pa.RecordBatch:
        tokens, each = np.concatenate(ids), np.concatenate(sizes)
        own = pa.concat_arrays(docs)
        row = [part, seg, before, len(own), len(tokens), own, np.cumsum(each), *dac_encode(tokens)]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

    held = 0
    for batch in pieces(batches, "text"):
        own, counts = encoder.encode(batch.column("text"))
        closed = np.full(len(own) + len(counts), end, encoder.kind)
        at = np.ones(len(closed), bool)
        at[np.cumsum(counts + 1) - 1] = False
        closed[at] = own
        ids.append(closed)
        docs.append(batch.column("doc_id"))
        sizes.append(counts + 1)
        held += len(closed)
        if held >= SEGMENT_TOKENS:
            yield segment()
            ids, docs, sizes, seg, before, held = [], [], [], seg + 1, before + held, 0
    if docs:
        yield segment()


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text and writes the token file, documents in ascending id order, each closed by `end`.

    Null text counts as empty and gives the end id alone. Null ids come first; rows of equal id are ordered by text and
    all are written; ranges are cut by id and the first characters of the text, so that rows of one id spread too. Other
    columns are not read. An empty table gives a file without segments.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    schema = to_arrow_schema(spark.createDataFrame([], SEGMENT).schema)
    (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange("doc_id", F.substring("text", 1, 32))
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(partial(_segments, path=tokenizer, end=end, schema=schema), SEGMENT)
        .write.option("compression", "none")
        .parquet(path)
    )


def open_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The segments of a token file with `start`, the number of tokens before each.

    A segment knows its place in its part. The parts' places come from their counts, a row for each task that wrote, and
    are broadcast up to BROADCAST_PARTS of them: segments are not shuffled.
    """
    file = spark.read.schema(SEGMENT).parquet(path)
    parts = file.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that wrote
    starts = parts.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_start"))
    small = F.broadcast(starts) if starts.count() <= BROADCAST_PARTS else starts
    return file.join(small, "part").withColumn("start", F.col("part_start") + F.col("before")).drop("part_start")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            own = batch.slice(i, 1)
            levels, more = (own.column(c).to_pylist()[0] for c in ("levels", "more"))
            ids = dac_decode(levels, more).astype("<u4")
            docs, ends = own.column("doc_ids").flatten(), own.column("doc_ends").flatten().to_numpy()
            begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            start = own.column("start").to_pylist()[0]
            yield pa.RecordBatch.from_arrays([docs, pa.array(begins + start), pa.array(ends - begins), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a token file, from its decoded ids: doc_id, start, n_tokens, ids_crc32."""
    return open_tokens(spark, path).select("start", "doc_ids", "doc_ends", "levels", "more").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, out = [], []
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            for p in row["positions"]:
                at.append(p)
                out.append(dac_at(row["levels"], row["more"], row["ranks"], p - row["start"]))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out, pa.int64())], names=["position", "token"])


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """position, token for each row of `positions` (a column position) inside the file; null and outside ones have no row.

    Positions meet segments by stretches of SEGMENT_TOKENS tokens, an equality join; tokens are read by rank.
    """
    segments = open_tokens(spark, path)
    reach = segments.select("part", "seg", "start", "n_tokens").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("start") / SEGMENT_TOKENS), F.floor((F.col("start") + F.col("n_tokens") - 1) / SEGMENT_TOKENS)))
    )
    wanted = positions.select(F.col("position").cast("long").alias("position")).withColumn("cell", F.floor(F.col("position") / SEGMENT_TOKENS))
    found = wanted.join(reach, "cell").filter("position >= start and position < start + n_tokens")
    salted = found.groupBy("part", "seg", F.pmod(F.xxhash64("position"), F.lit(64))).agg(F.collect_list("position").alias("positions"))
    return salted.join(segments, ["part", "seg"]).select("start", "levels", "more", "ranks", "positions").mapInArrow(_lookup, "position long, token long")
