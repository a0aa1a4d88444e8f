"""Byte-pair encoding and decoding with a contiguous rank array.

A pre-token's parts and the merge ranks of its adjacent pairs lie in two short contiguous arrays. The smallest rank is
found by a scan, its boundary is deleted by moving the rest one place to the left, and the ranks of the two pairs beside
the merged part are looked up again, until no pair has a rank. Many pre-tokens are merged side by side: one row of a
matrix each, one merge a row and step. Pre-tokens of more than ``SHORT`` bytes, where repeated scans would cost the
square of the length, keep their boundaries in a linked list with a heap of ranks; the order of merges is the same.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantrail.llm.common import list_slices, text_slices, workers_import
from vantrail.llm.tokens import TableEncoder, Vocabulary, byte_alphabet, vocabulary

#: Bytes of the longest pre-token that is merged by scanning.
SHORT = 64
#: No merge: greater than every rank.
NONE = np.int32(2**31 - 1)
_ROWS = 16384


class RankArrayBPE:
    def __init__(self, vocab: Vocabulary):
        if not vocab.byte_level:
            raise ValueError("a byte-level vocabulary is asked for")
        ids = vocab.vocab
        self.byte_id = np.array([ids[c] for c in byte_alphabet()], dtype=np.int32)
        left, right = (np.array([ids[m[side]] for m in vocab.merges], dtype=np.int64) for side in (0, 1))
        self.made = np.array([ids[a + b] for a, b in vocab.merges], dtype=np.int32)
        self.size = max(max(ids.values()), 1) + 1
        keys = left * self.size + right
        first = np.unique(keys, return_index=True)[1]  # of a pair listed twice the last rank counts, as in the library
        last = len(keys) - 1 - np.unique(keys[::-1], return_index=True)[1]
        self.keys, self.ranks = keys[first], last.astype(np.int32)
        self.pair = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        # open addressing by multiplication; a pair is found within a few probes
        bits = max(4, int(len(self.keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slot_key, self.slot_rank = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, NONE, dtype=np.int32)
        at, rest = self._home(self.keys), np.arange(len(self.keys))
        while len(rest):
            free = self.slot_key[at] < 0
            self.slot_key[at[free]] = self.keys[rest[free]]
            won = self.slot_key[at] == self.keys[rest]
            self.slot_rank[at[won]] = self.ranks[rest[won]]
            rest, at = rest[~won], (at[~won] + 1) & ((1 << bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        at = self._home(keys)
        out, mask = np.full(keys.shape, NONE, dtype=np.int32), len(self.slot_key) - 1
        held = self.slot_key[at]
        hit = held == keys
        out[hit] = self.slot_rank[at[hit]]
        open_ = np.nonzero(~hit & (held >= 0))
        while len(open_[0]):
            at_open = (at[open_] + 1) & mask
            at[open_] = at_open
            held = self.slot_key[at_open]
            hit = held == keys[open_]
            done = tuple(x[hit] for x in open_)
            out[done] = self.slot_rank[at_open[hit]]
            open_ = tuple(x[~hit & (held >= 0)] for x in open_)
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each pre-token as little-endian unsigned 32-bit bytes."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        short = [i for i in order if 0 < len(words[i]) <= SHORT]
        for lo in range(0, len(short), _ROWS):
            rows = short[lo : lo + _ROWS]
            for i, ids in zip(rows, self._merge_rows([words[i] for i in rows]), strict=True):
                out[i] = ids
        for i in order[::-1]:
            if len(words[i]) <= SHORT:
                break
            out[i] = self._merge_long(words[i])
        return out

    def _merge_rows(self, words: list[bytes]) -> list[bytes]:
        width = max(map(len, words))
        size = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width)
        part = np.zeros((len(words), width + 1), dtype=np.int32)  # one spare column, so a move to the left stays inside
        part[:, :width] = self.byte_id[raw]
        rank = np.full((len(words), width + 1), NONE, dtype=np.int32)
        if width > 1:
            inside = np.arange(1, width)[None, :] < size[:, None]
            rank[:, : width - 1] = np.where(inside, self.rank(part[:, : width - 1], part[:, 1:width]), NONE)
        done: list[bytes] = [b""] * len(words)
        which = np.arange(len(words))
        column = np.arange(width + 1)[None, :]
        while len(which):
            at = rank.argmin(axis=1)
            every = np.arange(len(which))
            best = rank[every, at]
            live = best != NONE
            if not live.all():
                for i in np.nonzero(~live)[0]:
                    done[which[i]] = part[i, : size[i]].astype("<u4").tobytes()
                which, size, at, best = which[live], size[live], at[live], best[live]
                if not len(which):
                    break
                most = int(size.max())
                part, rank, column = part[live, : most + 1], rank[live, : most + 1], column[:, : most + 1]
                every = np.arange(len(which))
            part[every, at] = self.made[best]
            behind = column[:, :-1] > at[:, None]  # the boundary after part ``at`` goes: all behind it moves one place
            part[:, :-1] = np.where(behind, part[:, 1:], part[:, :-1])
            behind = column[:, :-1] >= at[:, None]
            rank[:, :-1] = np.where(behind, rank[:, 1:], rank[:, :-1])
            size = size - 1
            has = at > 0
            rank[every[has], at[has] - 1] = self.rank(part[every[has], at[has] - 1], part[every[has], at[has]])
            has = at + 1 < size
            rank[every[has], at[has]] = self.rank(part[every[has], at[has]], part[every[has], at[has] + 1])
            rank[every[~has], at[~has]] = NONE
        return done

    def _merge_long(self, word: bytes) -> bytes:
        part: list[int] = self.byte_id[np.frombuffer(word, dtype=np.uint8)].tolist()
        n, pair, made, size = len(part), self.pair, self.made, self.size
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := pair.get(part[i] * size + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if i < n else n
            if part[i] != a or j >= n or part[j] != b:
                continue  # a merge has changed this pair since
            part[i], part[j] = int(made[r]), -1
            k = after[i] = after[j]
            after[j] = n
            if k < n:
                before[k] = i
                if (q := pair.get(part[i] * size + part[k])) is not None:
                    heapq.heappush(heap, (q, i, part[i], part[k]))
            if (h := before[i]) >= 0 and (q := pair.get(part[h] * size + part[i])) is not None:
                heapq.heappush(heap, (q, h, part[h], part[i]))
        return np.array([p for p in part if p >= 0], dtype="<u4").tobytes()


@lru_cache(maxsize=4)
def rank_array_encoder(path: str) -> TableEncoder:
    vocab = vocabulary(path)
    bpe = RankArrayBPE(vocab)
    return TableEncoder(vocab, lambda words: bpe.merge([w.encode() for w in words]))


@lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes each id stands for."""
    vocab = vocabulary(path)
    value = {c: b for b, c in enumerate(byte_alphabet())}
    return {i: bytes(value[c] for c in token) for token, i in vocab.vocab.items()} | {i: s.encode() for s, i in vocab.special.items()}


#: Ids whose bytes are gathered at once.
DECODED = 1 << 17


class Decoder:
    """Bytes of many ids at once: a table of all tokens' bytes, gathered by position."""

    def __init__(self, path: str):
        table = token_bytes(path)
        tokens = [table.get(i, b"") for i in range(max(table) + 1)]
        self.size = np.array([len(t) for t in tokens] + [0], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts whose ids follow one another in ``ids``."""
        ids = np.where((ids >= 0) & (ids < len(self.size) - 1), ids, len(self.size) - 1)
        size = self.size[ids]
        ends = np.cumsum(size)
        parts = []
        for lo in range(0, len(ids), DECODED):  # a place, eight bytes, for each byte of a part only
            own = size[lo : lo + DECODED]
            place = np.repeat(self.start[ids[lo : lo + DECODED]] - (np.cumsum(own) - own), own)
            place += np.arange(len(place))
            parts.append(self.flat[place].tobytes())
        whole = b"".join(parts)
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [whole[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=4)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def as_lists(encoded: Iterable[bytes]) -> pa.ListArray:
    encoded = list(encoded)
    sizes = np.fromiter((len(b) // 4 for b in encoded), dtype=np.int64, count=len(encoded))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), dtype="<u4").astype(np.int32)))


def encode(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out``: the ids of the whole text, array<int>. Special strings in a text become their own ids, as
    the library has it; a null text is empty and has no ids. A column already named ``out`` is replaced. All other
    columns, nulls and repeated rows are kept; no rows give no rows."""
    workers_import(docs.sparkSession)
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False))])
    names, at = [*docs.columns, out], docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_array_encoder(tokenizer)
        for batch, _, _ in text_slices(batches, at):
            lists = as_lists(encoder.encode(t or "" for t in batch.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=names)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with ``out``: the text of the ids, special tokens included. Bytes that are no UTF-8 become U+FFFD, as in
    the library; an id that the vocabulary lacks and a null in a list stand for nothing; a null list gives null. ``out`` is replaced."""
    workers_import(rows.sparkSession)
    rows = rows.drop(out)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])
    names, at = [*rows.columns, out], rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoder(tokenizer)
        for batch in list_slices(batches, at):
            lists = batch.column(at)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            texts = table.texts(lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), counts)
            texts = pa.array(texts, pa.string())
            if lists.null_count:
                texts = pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=names)

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded) of every document, encoded and then decoded from its ids."""
    encoded = encode(docs.select(key, F.col(text).alias("__text")), tokenizer, "__text", "ids").drop("__text")
    return decode(encoded, tokenizer, "ids", "decoded")
