"""Vector codes and secret scans against brute force and by their laws."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DATA
from vantrail.llm import codes, queries, secrets
from vantrail.llm.common import read_table


def brute_codes(rows, scale=1024, parts=4, entries=256, rounds=4):
    """rows: (key, vector) in order. Codebooks and (codes, error) by plain loops over whole numbers."""
    whole = [[math.floor(scale * x) for x in v] for _, v in rows]
    width = len(whole[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut:
                groups.setdefault(best(v[p], books[p])[1], []).append(v[p])
            for e, own in groups.items():
                books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [[best(v[p], books[p]) for p in range(parts)] for v in cut]
    return books, [("".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for f in found]


@pytest.mark.parametrize(("n", "k", "d", "most"), [(400, 256, 16, 200), (300, 7, 3, 4), (10, 1, 4, 3), (200, 64, 5, 1 << 27), (60, 20, 2, 2), (0, 5, 4, 9), (20, 6, 3, 0)])
def test_nearest_is_exact(n, k, d, most):
    rng = np.random.default_rng(n)
    points, entries = rng.integers(-most, most + 1, (n, d)), rng.integers(-most, most + 1, (k, d))
    index, distance = codes.nearest(points, entries)
    far = ((points[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2) if n else []
    want = [min((int(x), j) for j, x in enumerate(row)) for row in far]
    assert list(zip(distance.tolist(), index.tolist(), strict=True)) == want


def test_annulus_leaves_entries_out(monkeypatch):
    monkeypatch.setattr(codes, "RING", 2)
    monkeypatch.setattr(codes, "GROUP", 3)
    rng = np.random.default_rng(5)
    entries = (rng.normal(size=(64, 4)) * rng.integers(1, 10_000, (64, 1))).astype(np.int64)
    points = entries[rng.integers(0, 64, 200)] + rng.integers(-2, 3, (200, 4))
    index, _ = codes.nearest(points, entries)
    assert index.tolist() == ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()


def test_codes_brute(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(8)], i % 3 if i % 7 else None) for i in range(60)]
    rows += [(100 + i, rows[5][1], 1) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    coded, books = codes.compress(df, entries=12, rounds=3)
    want, each = brute_codes([(i, v) for i, v, _ in rows], entries=12, rounds=3)
    assert books.tolist() == want
    got = {r.vec_id: (r.codes.hex(), r.error) for r in coded.select("row.*", "codes", "error").collect()}
    assert got == {i: e for (i, _, _), e in zip(rows, each, strict=True)}
    total = {}
    for (_, _, label), (_, error) in zip(rows, each, strict=True):
        total[label] = total.get(label, 0) + error
    assert {r.label: r.label_error for r in codes.error_by(coded, "label").select("row.label", "label_error").collect()} == total
    back = codes.decode(coded, books).select("v", "approximate", "error").collect()
    assert all(sum((a - b) ** 2 for a, b in zip(r.v, r.approximate, strict=True)) == r.error for r in back)


def test_codes_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in read_table(spark, DATA, "embeddings").orderBy("vec_id").limit(300).collect()]
    df = read_table(spark, DATA, "embeddings").where(F.col("vec_id") <= rows[-1][0])
    coded, books = codes.compress(df, rounds=1)
    want, each = brute_codes(rows, rounds=1)
    assert books.tolist() == want
    assert {r.vec_id: (r.codes.hex(), r.error) for r in coded.select("row.vec_id", "codes", "error").collect()} == {i: e for (i, _), e in zip(rows, each, strict=True)}
    assert codes.codebooks_sha256(books) == hashlib.sha256(",".join(str(x) for p in want for e in p for x in e).encode()).hexdigest()


def test_codes_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.5, 0.25, 1.0], None), (2, None, 1), (3, [nan, 0.0, 0.0, 0.0], 1), (4, [inf, 0.0, 0.0, 0.0], 1), (5, [None, 0.0, 0.0, 0.0], 1), (None, [0.1, 0.2, 0.3, 0.4], None), (6, [1.0, 2.0], 2), (7, [0.5, -0.5, 0.25, 1.0], 2), (7, [0.5, -0.5, 0.25, 1.0], 2), (8, [], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for name in ("row", "v", "codes", "error", "dim", "place"):
        df = df.withColumn(name, F.lit("clash"))
    coded, books = codes.compress(df)
    got = sorted((r.vec_id or 0, r.codes.hex() if r.codes is not None else None, r.error, r.label_error) for r in codes.error_by(coded, "label").select("row.vec_id", "codes", "error", "label_error").collect())
    assert books.shape == (4, 4, 1)
    assert [(g[0], g[1] is None) for g in got] == [(0, False), (1, False), (6, True), (7, False), (7, False), (8, True)]
    assert got[1][1] == got[3][1] and all(g[3] == 0 for g in got[:2]) and got[5][3] is None and got[0][2] == 0
    assert coded.select("row.*").columns == df.columns
    none, empty = codes.compress(df.where("vec_id = 2"))
    assert none.count() == 0 and empty.shape[1] == 0 and codes.error_by(none, "label").count() == 0
    with pytest.raises(ValueError, match="64 bits"):
        codes.compress(spark.createDataFrame([(1, [1e30] * 4, 1)], "vec_id long, embedding array<double>, label int"))


ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_base(text):
    """The contract's patterns as written: matches first, lengths after."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found)]


def odd_texts(rng, n):
    parts = ["password", "PassWd", "secret", "ToKen", "api_key", "apikey", "API-KEY", "toKen", "=", ":", " ", '"', "'", " = ", ': "', "AKIA", "AKIAAKIA", "abc", "short", "0123456789abcdef", "ABCDEFGH0123", "é", "中", "\n", "-", "==", "/x.y"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_base_spans_brute():
    for text in [*odd_texts(random.Random(8), 4000), "password=token: abcdefghijk", "AKIA" * 9, "f" * 31 + "g" + "0" * 32]:
        assert [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e, _ in secrets.base_spans(text)] == brute_base(text)


def likelihood_of_all(automaton, length):
    return sum(math.exp(automaton.log_likelihood("".join(x))) for n in range(length + 1) for x in itertools.product(secrets.ALPHABET, repeat=n))


def test_automaton_is_a_distribution():
    automaton = secrets.Automaton(["ab", "ab", "abab", "b"])
    assert 0.3 < likelihood_of_all(automaton, 2) < 1
    # from every state, the end and all characters have a probability of one together
    for end, steps in zip(automaton.ends, automaton.steps, strict=True):
        assert set(steps) == set(secrets.ALPHABET) and math.isclose(math.exp(end) + sum(math.exp(p) for p, _ in steps.values()), 1.0)


def test_merging_finds_the_language():
    rng = random.Random(4)
    letter = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    keys = ["ZX_" + letter(20) for _ in range(400)]
    automaton = secrets.Automaton(keys)
    assert len(automaton.steps) < 30  # of about 8,000 states of the prefix tree
    assert automaton.log_likelihood("ZX_" + letter(20)) > automaton.log_likelihood(letter(23)) + 10
    assert secrets.Automaton([]).log_likelihood("ab") == pytest.approx(-3 * math.log(len(secrets.ALPHABET) + 1))


@pytest.fixture(scope="module")
def credentials(spark):
    """Labelled tokens and key ids, plain words, numbers and hosts, and bare values of the tokens' format in documents 9000 and on."""
    rng = random.Random(6)
    pick = lambda of, n: "".join(rng.choice(of) for _ in range(n))
    words = lambda n: " ".join(pick("etaoinshrdlu", rng.randrange(2, 24)) for _ in range(n))
    rows = []
    for i in range(240):
        own = [words(12), f"mail{i % 9}.example.com/list/{i}", pick("0123456789", 16)]
        if i % 3 == 0:
            own.append(f'token = "zq_{pick("0123456789abcdef", 24)}"')
        if i % 4 == 0:
            own.append("AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16))
        rng.shuffle(own)
        rows.append((i, " ".join(own)))
    rows += [(9000 + i, f"{words(4)} zq_{pick('0123456789abcdef', 24)} {words(3)}") for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_formats_are_found(credentials):
    texts = {r.doc_id: r.text for r in credentials.collect()}
    got = {r.doc_id: r.spans for r in secrets.scan_secrets(credentials).collect()}
    for i, text in texts.items():
        assert [f"{s.kind}:{s.start}:{s.end}" for s in got[i] if s.kind != "format"] == brute_base(text)
        added = [text[s.start : s.end] for s in got[i] if s.kind == "format"]
        assert added == re.findall(r"zq_[0-9a-f]{24}", text) if i >= 9000 else not added
        assert all((s.score is None) == (s.kind != "format") for s in got[i])


def test_redaction(spark):
    rows = [(1, "x password=abcdefgh12 é"), (2, "password=" + "0" * 32 + "ab"), (3, None), (4, "AKIA" + "A" * 12 + " " + "f" * 32)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.t for r in df.join(secrets.scan_secrets(df), "doc_id").select("doc_id", secrets.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert out == {1: "x [secret] é", 2: "[secret]", 3: None, 4: "[secret] [secret]"}


def test_secrets_odd(spark, odd_docs, no_docs):
    got = secrets.scan_secrets(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(r.spans == [] for r in got)
    assert secrets.scan_secrets(no_docs).count() == 0
    long_ = "a word " * 200_000 + "token: " + "ab" * 40_000
    df = spark.createDataFrame([(1, long_), (1, long_), (None, "secret: 123456789")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, [(s.kind, s.start, s.end) for s in r.spans]) for r in secrets.scan_secrets(df).collect()) == [(0, [("assign", 0, 17)]), *[(1, [("assign", 1_400_000, 1_480_007), ("hex", 1_400_007, 1_480_007)])] * 2]


def test_secrets_query(spark):
    texts = {r.doc_id: r.text or "" for r in read_table(spark, DATA, "documents").collect()}
    rows = queries.op12_secrets(spark, DATA).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        base = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(b.startswith(k + ":") for b in base) for k in secrets.KINDS]
        assert set(base) <= set(r.spans.split(",") if r.spans else [])
