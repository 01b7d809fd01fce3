"""Encoding with merge-type SentencePiece vocabularies by a score-ordered agenda, and decoding.

The agenda holds the adjacent symbol pairs whose joint spelling is a piece; the pair of best score, leftmost on ties, is
merged until none is left. No piece of such a vocabulary has a space mark behind another character, so no merge crosses
the start of a run of space marks: a text falls into words there, and each distinct word of an Arrow batch is encoded once.
Words of equal length are worked on together, one merge each a round; very long words go through a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, strings

MARK = "▁"
NONE = np.iinfo(np.int32).max
#: Words of more symbols go through the heap.
LONG = 40
_WORDS = re.compile(r" *[^ ]+| +")


class Agenda:
    """The vocabulary as arrays: the id of each character, and the piece and rank that each pair of ids makes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        spelled = {sp.id_to_piece(i): i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in spelled):
            raise ValueError("a piece has a space mark behind another character")
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        order = sorted(plain, key=lambda i: -sp.get_score(i))
        rank = np.full(n, NONE, np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.chars = np.arange(0x110000, dtype=np.int32) + n  # a character without a piece: its code point above the ids
        pairs: dict[int, int] = {}
        for p, i in spelled.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
            for k in range(1, len(p)):
                left, right = spelled.get(p[:k]), spelled.get(p[k:])
                if left is not None and right is not None:
                    pairs[left * n + right] = i
        self.chars[ord(" ")] = self.chars[ord(MARK)]
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.ranks = rank[self.made]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of what each pair makes; rank NONE if nothing."""
        key = np.where((left < self.size) & (right < self.size), left.astype(np.int64) * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def _rounds(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of one length, a row each: yields rows and their final symbols, as they run out of merges."""
        rows = np.arange(len(symbols))
        ranks, made = self.look_up(symbols[:, :-1], symbols[:, 1:])
        while symbols.shape[1] > 1:
            best = ranks.argmin(axis=1)
            live = ranks[np.arange(len(rows)), best] < NONE
            if not live.all():
                yield rows[~live], symbols[~live]
                rows, symbols, ranks, made, best = rows[live], symbols[live], ranks[live], made[live], best[live]
            if not len(rows):
                return
            n, width = symbols.shape
            every, at = np.arange(n), best[:, None]
            merged = made[every, best]
            keep = np.arange(width - 1)[None, :]
            symbols = np.take_along_axis(symbols, keep + (keep > at), axis=1)
            symbols[every, best] = merged
            if width == 2:
                break
            keep = np.arange(width - 2)[None, :]
            ranks, made = (np.take_along_axis(x, keep + (keep >= at), axis=1) for x in (ranks, made))
            for shift in (-1, 0):
                own = every[(best + shift >= 0) & (best + shift < width - 2)]
                col = best[own] + shift
                ranks[own, col], made[own, col] = self.look_up(symbols[own, col], symbols[own, col + 1])
        yield rows, symbols

    def _heap(self, symbols: list[int]) -> list[int]:
        """One long word: the agenda as a heap over a linked list of symbols."""
        n = len(symbols)
        after, before, agenda = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def push(i: int, left: int, right: int) -> None:
            rank, made = self.look_up(np.array([left]), np.array([right]))
            if rank[0] < NONE:
                heapq.heappush(agenda, (int(rank[0]), i, left, right, int(made[0])))

        first_ranks, first_made = self.look_up(np.array(symbols[:-1]), np.array(symbols[1:]))
        agenda = [(int(r), i, symbols[i], symbols[i + 1], int(m)) for i, (r, m) in enumerate(zip(first_ranks, first_made, strict=True)) if r < NONE]
        heapq.heapify(agenda)
        while agenda:
            _, i, left, right, made = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, made, symbols[after[i]])
            if before[i] >= 0:
                push(before[i], symbols[before[i]], made)
        return [s for s in symbols if s >= 0]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each word has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = self.chars[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(words) else np.zeros(0, np.int64)
        ids, of, place = [], [], []

        def take(which: np.ndarray, symbols: np.ndarray) -> None:
            ids.append(symbols.ravel())
            of.append(np.repeat(which, symbols.shape[1]))
            place.append(np.tile(np.arange(symbols.shape[1]), len(which)))

        for length in np.unique(lengths).tolist():
            which = np.flatnonzero(lengths == length)
            if 0 < length <= LONG:
                for rows, symbols in self._rounds(flat[starts[which][:, None] + np.arange(length)]):
                    take(which[rows], symbols)
            elif length:
                for w in which.tolist():
                    take(np.array([w]), np.array([self._heap(flat[starts[w] : starts[w] + length].tolist())], np.int32))
        if not ids:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        out, word, at = np.concatenate(ids), np.concatenate(of), np.concatenate(place)
        order = np.argsort(word * (int(lengths.max()) + 1) + at, kind="stable")
        out, word = out[order], word[order]
        if (odd := np.flatnonzero(out >= self.size)).size:
            fallback = [[self.bytes[b] for b in chr(c - self.size).encode()] for c in out[odd].tolist()]
            many = np.ones(len(out), np.int64)
            many[odd] = [len(f) for f in fallback]
            ends = np.cumsum(many)
            out, word = np.repeat(out, many), np.repeat(word, many)
            for i, f in zip(odd.tolist(), fallback, strict=True):
                out[ends[i] - len(f) : ends[i]] = f
        return out, np.bincount(word, minlength=len(words))

    def encode(self, texts: pa.Array) -> list[list[int]]:
        """The ids of each text. Null counts as empty, and an empty text has no ids."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if pc.any(pc.match_substring(texts, MARK)).as_py():
            texts = pc.replace_substring(texts, MARK, " ")
        if pc.any(pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))).as_py():
            # Runs of spaces stay with the word behind them; each word without its first space, as below.
            lists = pa.array([[w[1:] for w in _WORDS.findall(" " + t)] if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            lists = pc.split_pattern(texts, " ")
            lists = pc.if_else(pc.equal(texts, ""), pa.scalar([], lists.type), lists)
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        pool, sizes = self.encode_words([" " + w for w in strings(coded.dictionary)])
        begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        each = sizes[codes] if len(codes) else np.zeros(0, np.int64)
        ends = np.cumsum(each)
        flat = pool[np.arange(int(each.sum())) + np.repeat(begins[codes] - ends + each, each)] if len(codes) else pool
        stops = np.concatenate([[0], ends])[np.cumsum(counts)].tolist()
        out, a = [], 0
        for b in stops:
            out.append(flat[a:b].tolist())
            a = b
        return out


_AGENDAS: dict[str, Agenda] = {}


def agenda(path: str) -> Agenda:
    if path not in _AGENDAS:
        _AGENDAS.clear()
        _AGENDAS[path] = Agenda(path)
    return _AGENDAS[path]


def _coded(batches: Iterator[pa.RecordBatch], path: str, check: bool, full: bool) -> Iterator[pa.RecordBatch]:
    own = agenda(path)
    decimal = [str(i) for i in range(own.size)]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for batch in pieces(batches, "text"):
        texts = batch.column("text")
        ids = own.encode(texts)
        if check and (bad := [i for i, (x, y) in enumerate(zip(ids, own.library.encode([t or "" for t in texts.to_pylist()], num_threads=1), strict=True)) if x != y]):
            raise ValueError(f"the library encodes a text of a batch otherwise: row {bad[0]}")
        decoded = own.library.decode(ids, num_threads=1) if ids else []
        columns = [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64())]
        if full:
            columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
        else:
            columns += [pa.array([digest(",".join(map(decimal.__getitem__, x))) for x in ids], pa.string()), pa.array(list(map(digest, decoded)), pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"])


def encode_pieces(docs: DataFrame, model: str, check: bool = True, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, decoded of each row's whole text; with `digests` ids_sha256, decoded_sha256 in their place.

    `check` has the library encode every batch too and fails the job on any difference. Null counts as empty: no ids, and
    decoded to ''. Rows stay apart, repeated ones too; other columns are not read. There is no shuffle.
    """
    schema = f"doc_id long, n_tokens long, ids {'string' if digests else 'array<int>'}, decoded string"
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(partial(_coded, path=model, check=check, full=not digests), schema)
    return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"}) if digests else out


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = agenda(path)
    for batch in batches:
        texts = own.library.decode([x or [] for x in batch.column("ids").to_pylist()], num_threads=1) if batch.num_rows else []
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def decode_pieces(ids: DataFrame, model: str) -> DataFrame:
    """doc_id, text of rows doc_id, ids. Null ids decode to ''."""
    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(partial(_decoded, path=model), "doc_id long, text string")
