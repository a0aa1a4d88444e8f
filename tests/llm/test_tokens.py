"""Encoders, counts, packing and tables against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import DATA, crc
from vantrail.llm import bpe, packing, queries, sstable, transducer
from vantrail.llm.common import read_table
from vantrail.llm.tokens import library_encoder, vocabulary

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    pool = [chr(i) for i in [*range(0x20, 0x250), 9, 10, 11, 12, 13, 0x1C, 0x1F, 0x85, 0xA0, 0x2003, 0x3000, 0x200B, 0x130, 0x3A3, 0x3C2, 0x4E2D, 0x1F600, 0x301, 0x1E9E, 0x212A, 0x11DE0]] + [" "] * 60 + ["'s", "'ll", "<|endoftext|>", "<|startoftext|>"] * 5
    made = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    return [*made, "", *["a" * n for n in range(0, 200, 7)], *["".join(rng.choice("etaoin") for _ in range(n)) for n in range(0, 300, 9)], "x" * 40000, "ab cd " * 9000]


def library(path, texts):
    tok = Tokenizer.from_file(path)
    return [e.ids for k in range(0, len(texts), 100) for e in tok.encode_batch(texts[k : k + 100], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_table_encoder_equals_library(texts, path):
    assert [np.frombuffer(b, "<u4").tolist() for b in library_encoder(path).encode(texts)] == library(path, texts)


def test_rank_array_and_transducer_equal_library(texts):
    want = library(BYTE, texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in bpe.rank_array_encoder(BYTE).encode(texts)] == want
    counter = transducer.token_counter(BYTE)
    assert [counter.count(t) for t in texts] == [len(x) for x in want]


def test_tables_start_anew(texts, monkeypatch):
    monkeypatch.setattr(transducer, "TRANSITIONS", 500)
    monkeypatch.setattr(transducer, "WORDS", 100)
    counter = transducer.TokenCounter(vocabulary(BYTE))
    assert [counter.count(t) for t in texts[:400]] == [len(x) for x in library(BYTE, texts[:400])]


def test_state_maps_compose_anywhere(texts):
    """Texts cut at any characters, inside words, runs of white space and contractions: the scan of the chunks' maps, however grouped, counts as the
    library does; walks from a state go on where they stopped."""
    counter, rng = transducer.token_counter(BYTE), random.Random(7)
    odd = ["it's we're they'll I'd 'tis ''ve 'r 'v'l 'lla", "a  b   c\n\n d\t\te \n", "'" * 9 + "s", " '", "x'", "x'r", "x'll", "  ", "\n ", "中文'll 中 文１２ ½", "don't\u3000stop  'em", "a" * 50 + "'re" * 3]
    pool = [t for t in odd + texts if "<|endoftext|>" not in t and len(t) < 3000]
    want = library(BYTE, pool)
    for text, ids in zip(pool, want, strict=True):
        for _ in range(3):
            cuts = sorted(rng.sample(range(len(text) + 1), min(len(text), rng.randrange(0, 9))))
            maps = [counter.map(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
            assert counter.close(transducer.prefix_scan(maps, counter.compose)[-1]) == len(ids)
            while len(maps) > 1:
                i = rng.randrange(len(maps) - 1)
                maps[i : i + 2] = [counter.compose(maps[i], maps[i + 1])]
            assert counter.close(maps[0]) == len(ids)
        state, total = counter.initial, 0
        for c in text:
            state, n = counter.walk(state, c)
            total += n
        assert total + counter.finish(state) == len(ids)


def test_small_chunks_of_whole_texts(texts, monkeypatch):
    monkeypatch.setattr(transducer, "CHUNK", 11)
    monkeypatch.setattr(transducer, "SHORT", 0)
    counter = transducer.token_counter(BYTE)
    assert [counter.count(t) for t in texts[:700]] == [len(x) for x in library(BYTE, texts[:700])]


def test_prefix_scan_is_all_prefixes():
    for n in range(20):
        assert transducer.prefix_scan([str(i) for i in range(n)], lambda a, b: a + b) == ["".join(map(str, range(i + 1))) for i in range(n)]


def test_decoding_bad_bytes_and_unknown_ids(spark):
    euro = library(BYTE, ["€"])[0]
    df = spark.createDataFrame([(euro,), (euro[:1],), (None,), ([],), ([99999, *euro],)], "ids array<int>")
    tok = Tokenizer.from_file(BYTE)
    got = [r.decoded for r in bpe.decode(df, BYTE).collect()]
    assert got == ["€", tok.decode(euro[:1], skip_special_tokens=False), None, "", "€"]


def expected(rows, path):
    return {i: x for (i, _), x in zip(rows, library(path, [t or "" for _, t in rows]), strict=True)}


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in read_table(spark, DATA, "documents").collect()]


def test_op4_op7_op9(spark, docs):
    want = expected(docs, BYTE)
    texts = dict(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op4_bpe(spark, DATA).collect()} == {i: (len(x), sha(",".join(map(str, x))), sha(texts[i] or "")) for i, x in want.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op7_count(spark, DATA).collect()} == {i: (len((texts[i] or "").encode()), len(x), len(x) > 1024) for i, x in want.items()}
    start, rows = 0, {}
    for i in sorted(want):
        rows[i] = (start, len(want[i]) + 1, crc([*want[i], 0]))
        start += len(want[i]) + 1
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op9_tables(spark, DATA).collect()} == rows


def test_op1(spark, docs):
    want = {i: [*x, 1] for i, x in expected(docs, WORD).items()}
    rows = queries.op1_pack(spark, DATA).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == {(i, k): (4096 * k, len(x[4096 * k : 4096 * (k + 1)]), crc(x[4096 * k : 4096 * (k + 1)])) for i, x in want.items() for k in range(-(-len(x) // 4096))}
    check_places(rows)
    assert len({r.sequence_id for r in rows}) <= -(-sum(map(len, want.values())) // 4096) + 1


def check_places(rows, capacity=4096):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_sum_of_squares_fills_what_can_be_filled():
    where, offset, made = packing.sum_of_squares(np.array([3, 7, 5, 5, 2, 8, 10, 0]), 10)
    assert made == 4
    for s in range(made):
        assert sum(n for n, w in zip([3, 7, 5, 5, 2, 8, 10, 0], where, strict=True) if w == s) == 10
    assert packing.sum_of_squares(np.array([], dtype=int), 10)[2] == 0
    with pytest.raises(ValueError):
        packing.sum_of_squares(np.array([11]), 10)


def plain_sum_of_squares(lengths, capacity, thrifty):
    """The rule as written: of all places for a piece the one with the least sum of N(g)^2 over the open gaps g, then an open sequence
    before a new one, then the tightest gap; the last opened sequence of a gap is filled first."""
    gaps, where = [], {}
    square = lambda g: sum(g.count(x) ** 2 for x in set(g) if 0 < x < capacity)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        s, ways = lengths[i], []
        for g in sorted({x for x in gaps if x >= s}):
            after = list(gaps)
            after[max(j for j, x in enumerate(gaps) if x == g)] = g - s
            ways.append((square(after), 0, g))
        if not ways or not thrifty:
            ways.append((square([*gaps, capacity - s]), 1, capacity))
        _, fresh, g = min(ways)
        if fresh:
            gaps.append(capacity)
        b = len(gaps) - 1 if fresh else max(j for j, x in enumerate(gaps) if x == g)
        where[i], gaps[b] = g, gaps[b] - s
    return where, sorted(gaps)


def test_placement_is_the_rule_as_written():
    rng = random.Random(9)
    for _ in range(60):
        capacity = rng.choice([10, 16, 25])
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 40))]
        for thrifty in (False, True):
            want, left = plain_sum_of_squares(lengths, capacity, thrifty)
            where, offset, made = packing._place(np.array(lengths), capacity, thrifty)
            assert {i: capacity - int(o) for i, o in enumerate(offset)} == want
            assert sorted(capacity - sum(n for n, w in zip(lengths, where, strict=True) if w == b) for b in range(made)) == left


def test_packed_groups_and_real_sequences(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    placed = packing.pack_documents(df, WORD, 512, group_size=50).cache()
    check_places(placed.collect(), 512)
    seq = {r.sequence_id: (r.n_tokens, len(r.ids)) for r in packing.sequences(placed).collect()}
    assert all(n <= 512 and b == 4 * n for n, b in seq.values()) and sum(n for n, _ in seq.values()) == placed.agg(F.sum("length")).first()[0]


def test_odd_and_empty(spark, odd_docs, no_docs):
    n = odd_docs.count()
    placed = packing.pack_documents(odd_docs, WORD, keep_ids=False).collect()
    assert len({(r.doc_id, r.piece) for r in placed}) >= n - 1 and min(r.length for r in placed) == 1
    check_places(placed)
    assert bpe.round_trip(odd_docs, BYTE).count() == n
    assert {(r.doc_id, r.n_tokens) for r in transducer.count_tokens(odd_docs.select("doc_id", "text", "lang"), BYTE).collect()} >= {(3, 0), (4, 0)}
    manifest = sstable.write_tables(odd_docs, BYTE, sstable.scratch_folder(spark), docs_per_shard=3)
    back = sstable.read_tables(manifest).orderBy("start").collect()
    assert len(back) == n and back[0].doc_id is None and [r.doc_id for r in back[1:]] == sorted(r.doc_id for r in back[1:])
    for out in (packing.pack_documents(no_docs, WORD, keep_ids=False), bpe.round_trip(no_docs, BYTE), transducer.count_tokens(no_docs, BYTE), sstable.read_tables(sstable.write_tables(no_docs, BYTE, sstable.scratch_folder(spark)))):
        assert out.count() == 0


def test_table_lookup(spark, docs):
    w = sstable.Writer(4, block_bytes=64)
    rows = [(k, np.arange((k or 0) % 5 + 1, dtype="<u4").tobytes()) for k in [None, -7, 0, 0, 1, *range(100, 300, 3)]]
    for k, ids in rows:
        w.add(sstable.encode_key(k), ids)
    data = w.finish()
    t = sstable.Table(lambda at, n: data[at : at + n], len(data))
    assert [(k, i) for k, _, i in t.scan()] == rows and len(t.blocks) > 3
    assert len(t.get(0)) == 2 and t.get(None) == [rows[0][1]] and t.get(101) == [] and t.get(103) == [np.arange(4, dtype="<u4").tobytes()]
    assert sum(t.may_have(sstable.encode_key(k)) for k in range(10_000, 12_000)) < 60
    with pytest.raises(ValueError):
        sstable.Table(lambda at, n: (data[:-60] + b"\x01" + data[-59:])[at : at + n], len(data))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    manifest = sstable.write_tables(df, BYTE, sstable.scratch_folder(spark), docs_per_shard=40)
    found = {r.doc_id: r.ids for r in sstable.lookup(spark, manifest, spark.createDataFrame([(3,), (77,), (10**9,)], "doc_id long")).collect()}
    want = expected(docs, BYTE)
    assert {k: np.frombuffer(v, "<u4").tolist() for k, v in found.items()} == {k: [*want[k], 0] for k in (3, 77)}


def test_ids_beyond_two_bytes(spark):
    with pytest.raises(ValueError):
        sstable.Writer(2).add(sstable.encode_key(1), np.array([70_000], dtype="<u4").tobytes())
    df = spark.createDataFrame([(1, "some words"), (2, "")], "doc_id long, text string")
    back = sstable.read_tables(sstable.write_tables(df, BYTE, sstable.scratch_folder(spark), end_id=70_000)).collect()
    assert [np.frombuffer(r.ids, "<u4")[-1] for r in back] == [70_000, 70_000]


def test_lookup_of_text_keys(spark, tmp_path):
    rows = spark.createDataFrame([("é", "one"), ("b", "two"), (None, "three"), ("b", "four")], "doc_id string, text string")
    manifest = sstable.write_tables(rows, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "t"), docs_per_shard=1)
    asked = spark.createDataFrame([("b",), ("é",), ("none",), (None,)], "doc_id string")
    found = sstable.lookup(spark, manifest, asked)
    assert sorted(str(r.doc_id) for r in found.collect()) == ["None", "b", "b", "é"]
    assert sstable.lookup(spark, manifest, asked.limit(0)).count() == 0 and found.schema["doc_id"].dataType.simpleString() == "string"
