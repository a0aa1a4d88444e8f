"""Deduplication, sharding, search, quality and the pipeline against brute force and by their laws."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import DATA
from vantrail.llm import common, exactdup, linedup, neardup, quality, queries, sharding, topk
from vantrail.llm.common import read_table

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([b" ".join(w)] if 0 < len(w) < 5 else [b" ".join(w[i : i + 5]) for i in range(len(w) - 4)])


def near_brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies():
    """A group of edited copies and of copies of copies, texts that share one long passage, exact copies, short texts."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(base)] + [edited(rng, base, rng.randrange(0, 9)) for _ in range(60)]
    for _ in range(30):
        texts.append(edited(rng, rng.choice(texts).split(), rng.randrange(1, 5)))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"u{i}_{j}" for j in range(rng.randrange(5, 80))) for i in range(40)]
    texts += ["same text for all of these"] * 20 + ["x", "x", "", " ", "one two three", "ONE two\tthree", "a b c d e", "a b c d e f"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_duplicates_brute(spark, copies, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 4)
    monkeypatch.setattr(neardup, "FREQUENT", 4)
    got = neardup.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == near_brute(copies)


def test_near_duplicates_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in read_table(spark, DATA, "documents").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op5_near_dedup(spark, DATA).collect()} == near_brute(rows)


def test_near_duplicates_in_blocks(spark, copies, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    got = neardup.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c, _) in near_brute(copies).items()}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 51), (52, 51), (60, 60)]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 51: 50, 52: 50}


def test_near_odd(spark, odd_docs, no_docs):
    got = neardup.near_duplicates(odd_docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == odd_docs.count()
    assert by[3].n_shingles == 0 and by[3].component_id == 3 and by[8].kept and by[7].component_id == 1 and by[2].component_id == 1 and by[11].component_id == 10
    assert by[None].component_id is None and by[None].kept
    stays = Counter(r.doc_id for r in neardup.kept_rows(odd_docs).collect())
    assert stays == Counter([1, 3, 4, 5, None, 8, 9, 10])
    assert neardup.kept_rows(odd_docs).columns == odd_docs.columns
    assert neardup.near_duplicates(no_docs).count() == 0 and neardup.kept_rows(no_docs).count() == 0


def test_exact_dedup_brute(spark, odd_docs, no_docs):
    rows = exactdup.exact_dedup(exactdup.digested(odd_docs)).collect()
    groups = defaultdict(list)
    for r in odd_docs.collect():
        groups[SPACE.sub(" ", r.text or "")].append(r.doc_id)
    want = Counter((i, min((x for x in ids if x is not None), default=None), len(ids)) for ids in groups.values() for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in rows) == want
    kept = exactdup.exact_dedup_rows(odd_docs)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(min((x for x in ids if x is not None), default=None) for ids in groups.values())
    assert kept.columns == odd_docs.columns
    assert exactdup.exact_dedup(exactdup.digested(no_docs)).count() == 0 and exactdup.exact_dedup_rows(no_docs).count() == 0


def test_exact_dedup_hot_group(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 2}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert exactdup.frequent(exactdup.digested(df)).count() >= 1
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exactdup.exact_dedup(exactdup.digested(df)).collect()}
    size = Counter(t for _, t in rows)
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert got == {i: (first[t], size[t]) for i, t in rows}


def test_sharding_laws(spark, odd_docs, no_docs):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("é").alias("text"))
    rows = sharding.shard_documents(df, [1.0] * 16, buckets=8).collect()
    assert all(r.grown_shard in (r.shard, 16) for r in rows) and all(r.size == 3 for r in rows)
    for s in range(16):
        own = sorted((r.doc_id, r.slot) for r in rows if r.shard == s)
        assert [x for _, x in own] == list(range(len(own))) and 150 < len(own) < 350
    heavy = Counter(r.s for r in df.select(sharding.rendezvous(F.col("doc_id"), [1, 3, 0]).alias("s")).collect())
    assert set(heavy) == {0, 1} and 2.5 < heavy[1] / heavy[0] < 3.6
    odd = sharding.shard_documents(odd_docs, [1.0] * 4).collect()
    assert len(odd) == odd_docs.count() and {r.size for r in odd if r.doc_id == 3} == {1} and {r.text_crc32 for r in odd if r.doc_id == 4} == {0}
    for s in range(4):
        assert sorted(r.slot for r in odd if r.shard == s) == list(range(sum(r.shard == s for r in odd)))
    assert sharding.shard_documents(no_docs, [1.0] * 4).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), [0.0])


def test_hot_key_slots(spark):
    df = spark.createDataFrame([(5 if i % 3 == 0 else i, "t") for i in range(900)], "doc_id long, text string")
    rows = sharding.shard_documents(df, [1.0] * 4, buckets=8).collect()
    for s in range(4):
        own = sorted((r.slot, r.doc_id) for r in rows if r.shard == s)
        assert [x for x, _ in own] == list(range(len(own))) and [k for _, k in own] == sorted(k for _, k in own)


def test_top_k_brute(spark, monkeypatch):
    monkeypatch.setattr(topk, "PART", 16)
    monkeypatch.setattr(topk, "SMALLEST", 64)
    monkeypatch.setattr(topk, "TOGETHER", 4)
    rng = np.random.default_rng(9)
    vectors = np.floor(64 * rng.normal(0, 0.2, (300, 8)))
    vectors[100:160] = vectors[0]
    rows = [(int(i), v.tolist()) for i, v in enumerate(vectors)] + [(301, None), (None, [1.0] * 8), (303, [1.0, 2.0]), (320, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = defaultdict(list)
    for r in topk.exact_top_k(df, F.col("vec_id") % 20 == 0, k=7, block=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = {i: np.array(v) for i, v in rows if i is not None and v is not None}
    for q in (i for i in whole if i % 20 == 0):
        want = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])))[:7]
        assert got[q] == [(i, -s) for s, i in want]
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_repeated_rows(spark):
    rows = [(0, [1.0, 2.0])] * 5 + [(i, [1.0, 2.0]) for i in range(1, 9)] + [(20, [3.0, 3.0]), (20, [2.0, 9.0]), (3, [1.0, 2.0])]
    got = defaultdict(list)
    for r in topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, v array<double>"), F.col("vec_id") % 20 == 0, k=3, block=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == {0: [(20, 20), (20, 9), (1, 5)], 20: [(0, 20), (0, 20), (0, 20)]}


def test_finite_vectors(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, [1.0]), (2, None), (3, [nan]), (4, [inf]), (5, [1.0, None])], "vec_id long, e array<float>")
    assert [r.vec_id for r in df.where(topk.finite("e")).collect()] == [1]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last = [i]
        for j, y in enumerate(b, 1):
            last.append(min(row[j] + 1, last[-1] + 1, row[j - 1] + (x != y)))
        row = last
    return row[-1]


def test_banded_distance(spark):
    rng = random.Random(11)
    pairs = []
    for _ in range(600):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 14)))
        b = list(a)
        for _ in range(rng.randrange(0, 5)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = rng.choice(["", "a", "b", "é"])
        b = "".join(b)
        pairs.append((max(a, b, key=len), min(a, b, key=len)) if len(a) != len(b) else (a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    cut = linedup._let(linedup.without_common_ends(F.col("a"), F.col("b")), lambda s: linedup.banded_distance(s["x"], s["y"], 2))
    for r in df.select("a", "b", linedup.banded_distance(F.col("a"), F.col("b"), 2).alias("d"), cut.alias("c")).collect():
        want = distance(r.a, r.b)
        assert (r.d == want and r.c == want) if want <= 2 else (r.d > 2 and r.c > 2)


@pytest.fixture(scope="module")
def variants():
    """Lines and what up to three edits make of them, short ones and ones of more than one byte a letter."""
    rng = random.Random(13)
    lines = set()
    for _ in range(12):
        base = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(16, 40))).strip()
        for _ in range(10):
            s = list(base)
            for _ in range(rng.randrange(0, 4)):
                i = rng.randrange(len(s) + 1)
                s[i : i + rng.randrange(2)] = rng.choice(["", "x", "y"])
            lines.add(" ".join("".join(s).split()))
    lines |= {"ab cd ef", "ab cd eg", "ab cd xy", "short", "shorn", "naïve café ça", "naive café ça", "naïve café çaé", "naïve çafé çaé"}
    return sorted(lines)


def reach(a, b):
    return min(2, min(len(a), len(b)) // 8)


def line_brute(rows):
    """(key, line_no): every output column of the operator."""
    lines = {(k, i): " ".join(x for x in SPACE.split(line) if x) for k, t in rows for i, line in enumerate((t or "").split("\n"))}
    texts = sorted({s for s in lines.values() if s})
    up = {s: s for s in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if abs(len(a) - len(b)) <= 2 and distance(a, b) <= reach(a, b):
                up[find(a)] = find(b)
    groups, copies = defaultdict(list), Counter(lines.values())
    for place, s in lines.items():
        if s:
            groups[find(s)].append(place)
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    ids = {root: min(md5(lines[p]) for p in places) for root, places in groups.items()}
    out = {}
    for place, s in lines.items():
        if not s:
            out[place] = (None, 1, 1, *place, True)
            continue
        places = groups[find(s)]
        first = min(places)
        out[place] = (ids[find(s)], copies[s], len(places), *first, place == first)
    return out


def test_line_dedup_brute(spark, variants, monkeypatch):
    rng = random.Random(17)
    rows = [(i, "\n".join(rng.choice([*variants, "", " "]) for _ in range(rng.randrange(1, 9)))) for i in range(60)] + [(100, None), (101, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for small, block in ((16, 128), (2, 4)):
        monkeypatch.setattr(linedup, "SMALL", small)
        monkeypatch.setattr(linedup, "BLOCK", block)
        got = {(r.doc_id, r.line_no): (r.class_id, r.n_copies, r.class_size, r.keep_id, r.keep_line, r.kept) for r in linedup.line_dedup(df).collect()}
        assert got == line_brute(rows)


def test_line_dedup_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in read_table(spark, DATA, "documents").collect()]
    lengths = defaultdict(list)
    got = {(r.doc_id, r.line_no): r for r in queries.op10_line_dedup(spark, DATA).collect()}
    lines = {(k, i): " ".join(x for x in SPACE.split(line) if x) for k, t in rows for i, line in enumerate((t or "").split("\n"))}
    assert set(got) == set(lines)
    copies = Counter(lines.values())
    assert all(got[p].n_copies == copies[s] for p, s in lines.items() if s)
    for s in copies:
        lengths[len(s)].append(s)
    place = {s: p for p, s in lines.items()}
    for n in lengths:  # every pair within reach whose ends or middles are equal, as edits of two leave a third unchanged
        for a in lengths[n]:
            for b in (x for d in range(3) for x in lengths.get(n + d, [])):
                third = max(1, n // 3)
                if a < b and n >= 8 and (a[:third] == b[:third] or a[-third:] == b[-third:]) and distance(a, b) <= reach(a, b):
                    assert got[place[a]].class_id == got[place[b]].class_id


def test_line_dedup(spark, odd_docs, no_docs):
    rows = [(1, "the first line of this text\n\nanother line that repeats\nshort"), (2, "the first line of thiz text\nanother  line that repeats \nshort"), (None, "short"), (3, None)]
    marks = linedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, r.line_no): (r.keep_id, r.keep_line, r.kept, r.class_size, r.n_copies) for r in marks.collect()}
    assert got[(1, 0)] == (1, 0, True, 2, 1) and got[(2, 0)] == (1, 0, False, 2, 1) and got[(2, 1)] == (1, 2, False, 2, 2)
    assert got[(1, 1)][2] and got[(3, 0)][2] and got[(None, 0)] == (1, 3, False, 3, 3)
    left = {r.doc_id: r.text for r in linedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), marks).collect()}
    assert left[1] == rows[0][1] and left[2] == ""
    twice = spark.createDataFrame([(1, "a b", "x"), (1, "c d", "y")], "doc_id long, text string, gone string")
    two = linedup.deduplicated(twice, spark.createDataFrame([(1, 0, False)], "doc_id long, line_no int, kept boolean"))
    assert two.columns == twice.columns and [r.gone for r in two.orderBy("gone").collect()] == ["x", "y"]
    assert linedup.deduplicated(no_docs, linedup.line_dedup(no_docs)).count() == 0
    assert linedup.line_dedup(odd_docs).count() == sum((r.text or "").count("\n") + 1 for r in odd_docs.select("text").collect())
    assert linedup.line_dedup(no_docs).count() == 0


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    seen, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = quality.classify(docs, seen, F.col("source"), F.col("lang")).join(held.select("doc_id", F.col("quality").alias("truth")), "doc_id").collect()
    assert np.mean([r.kept == (r.truth == 1) for r in got]) > 0.97
    good = [r.kept for r in got if r.truth == 1]
    assert np.mean(good) > 0.99


def test_shrinkage(spark):
    rows = [("big", "p", 1.0)] * 90 + [("big", "p", 0.0)] * 10 + [("tiny", "q", 0.0)] + [("bad", "r", 0.0)] * 80 + [("bad", "r", 1.0)] * 20
    paths, hosts, share = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, good double"))
    h = {r.host: r.host_share for r in hosts.collect()}
    counts = {"big": (90.0, 100), "tiny": (0.0, 1), "bad": (20.0, 100)}
    mean = 110.5 / 202
    assert abs(share - mean) < 1e-12
    off = {k: g / n - mean for k, (g, n) in counts.items()}
    spread = (sum(n * off[k] ** 2 for k, (_, n) in counts.items()) - 3 * mean * (1 - mean)) / sum(n - 1 for _, n in counts.values())
    weight = min(max(mean * (1 - mean) / spread - 1, quality.LEAST_WEIGHT), quality.MOST_WEIGHT)
    assert all(abs(h[k] - (g + weight * mean) / (n + weight)) < 1e-12 for k, (g, n) in counts.items())
    p = {r.host: r.path_share for r in paths.collect()}
    weights = {(p[k] * n - g) / (h[k] - p[k]) for k, (g, n) in counts.items() if abs(h[k] - p[k]) > 1e-9}
    assert max(weights) - min(weights) < 1e-6 * max(weights)
    assert h["bad"] < h["tiny"] < h["big"] and abs(h["big"] - 0.9) < abs(h["tiny"] - 0.0) and h["tiny"] < share


def shrunk(groups, parents):
    """Shares of groups {name: (good, n)} shrunk to {name: parent share}, by the moments of the groups."""
    off = {k: g / n - parents[k] for k, (g, n) in groups.items()}
    noise = {k: parents[k] * (1 - parents[k]) for k in groups}
    spread = (sum(n * off[k] ** 2 for k, (_, n) in groups.items()) - sum(noise.values())) / max(1.0, sum(n - 1 for _, n in groups.values()))
    weight = np.mean(list(noise.values())) / spread - 1 if spread > 0 else quality.MOST_WEIGHT
    weight = min(max(weight, quality.LEAST_WEIGHT), quality.MOST_WEIGHT)
    return {k: (g + weight * parents[k]) / (n + weight) for k, (g, n) in groups.items()}


def test_quality_posterior_brute(spark):
    """Every row's posterior from its evidence and from counts of all labels by source and language, in plain numbers."""
    docs = {r.doc_id: r for r in read_table(spark, DATA, "documents").collect()}
    labels = {r.doc_id: r.quality for r in read_table(spark, DATA, "labels").collect() if r.quality is not None}
    paths, hosts = defaultdict(lambda: (0.0, 0)), defaultdict(lambda: (0.0, 0))
    for i, good in labels.items():
        for counts, key in ((paths, (docs[i].source, docs[i].lang)), (hosts, docs[i].source)):
            counts[key] = (counts[key][0] + good, counts[key][1] + 1)
    share = (sum(labels.values()) + 0.5) / (len(labels) + 1)
    of_host = shrunk(hosts, dict.fromkeys(hosts, share))
    of_path = shrunk(paths, {k: of_host[k[0]] for k in paths})
    for r in queries.op2_quality(spark, DATA).collect():
        d = docs[r.doc_id]
        site = of_path.get((d.source, d.lang), of_host.get(d.source, share))
        assert r.path_share == pytest.approx(site, abs=1e-9) and r.host_share == pytest.approx(of_host.get(d.source, share), abs=1e-9)
        odds = np.exp(r.evidence) * site / (1 - site)
        assert r.quality == pytest.approx(odds / (1 + odds), abs=1e-9) and r.kept == (r.quality >= 0.5)


def test_quality_odd(spark, odd_docs, no_docs, monkeypatch):
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, None), (None, 1), (1, 1)], "doc_id long, quality int")
    host = F.col("source")
    names = ["row", "host", "path", "evidence", "host_share", "path_share", *quality.FEATURES]
    clashing = odd_docs.withColumns({c: F.lit("clash") for c in names})
    for few in (1 << 18, 0):
        monkeypatch.setattr(common, "MARKS", few)
        marked = quality.classify(clashing, labels, host, F.col("lang"))
        assert marked.count() == odd_docs.count()
        kept = quality.kept_rows(clashing, labels, host, F.col("lang"))
        assert kept.columns == clashing.columns and {kept.first()[c] for c in names} == {"clash"}
        assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in marked.where("kept").collect())
    assert quality.kept_rows(no_docs, labels, host, F.col("lang")).count() == 0
    none = quality.classify(odd_docs, labels.limit(0), host, F.col("lang")).collect()
    assert all(r.kept and abs(r.quality - 0.5) < 1e-9 for r in none)
    assert quality.classify(no_docs, labels, host, F.col("lang")).count() == 0


def test_pipeline_stages(spark, odd_docs, no_docs, tmp_path):
    docs = read_table(spark, DATA, "documents")
    at = docs
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        out = stage(spark, at, DATA)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{number}")
        rows = [(r.doc_id, r.text) for r in at.collect()]
        at = spark.read.parquet(f"{tmp_path}/{number}")
        left = {r.doc_id for r in at.collect()}
        if number == 0:
            truth = {r.doc_id: r.quality for r in read_table(spark, DATA, "labels").collect()}
            assert all(i in left for i, q in truth.items() if q == 1) and sum(i in left for i, q in truth.items() if q == 0) <= 1
        elif number == 1:
            first = {}
            for i, t in sorted(rows):
                first.setdefault(SPACE.sub(" ", t or ""), i)
            assert left == set(first.values())
        else:
            assert left == {i for i, (_, _, kept) in near_brute(rows).items() if kept}
    for stage in (s for _, s in corpus_pipeline.STAGES[:3]):
        assert stage(spark, odd_docs, DATA).columns == odd_docs.columns and stage(spark, no_docs, DATA).count() == 0
    packed = corpus_pipeline.STAGES[3][1](spark, at, DATA)
    assert {r.doc_id for r in packed.collect()} == left
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()} == left


def test_near_dedup_at_other_similarities(spark):
    assert (neardup.least_shared(75, 64), neardup.least_shared(50, 64), neardup.least_shared(75, 16)) == (28, 11, 2)
    with pytest.raises(ValueError):
        neardup.least_shared(10, 64)
    word = lambda *of: "w" + "x".join(map(str, of))
    rows = [(2 * p + side, " ".join([word(p, i) for i in range(200)] + [word(p, side, i) for i in range(100)])) for p in range(60) for side in (0, 1)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=1, percent=50).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i, _ in rows}


def test_one_set_a_node_where_texts_of_a_key_differ(spark):
    docs = spark.createDataFrame([(1, "One two three four five six"), (1, "one  TWO three four five six"), (1, "another text of the same key")] * 3, "key long, text string")
    nodes = neardup.nodes_of(neardup.sketches(docs, "key", "text"))
    assert sorted(len(r.hashes) for r in neardup.node_sets(nodes.select("node"), nodes, docs, 5).collect()) == [2, 2]


def test_word_hashes_in_windows(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Ab", "ab", "é", "\t", "x" * 90, "\n\x0b", "中文"]) for _ in range(rng.randrange(0, 60))) for _ in range(80)]
    texts += ["", "y" * 700, " "]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    flat = np.frombuffer(b"".join(data), dtype=np.uint8)
    whole, at = neardup.word_hashes(flat, offsets)
    words = [w for d in data for w in d.lower().split()]
    assert len(whole) == len(words) == at[-1] and len(set(words)) == len(set(whole.tolist())) == len(set(zip(words, whole.tolist(), strict=True)))
    assert np.diff(at).tolist() == [len(d.split()) for d in data]
    monkeypatch.setattr(neardup, "WINDOW", 128)
    assert (neardup.word_hashes(flat, offsets)[0] == whole).all()
    assert [len(s) for s in neardup.shingle_sets(flat, offsets)] == [len(shingles(t)) for t in texts]


def test_common_counts_and_estimate():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 120))) for _ in range(40)]
    row = np.repeat(np.arange(40), [len(s) for s in sets])
    got = neardup.common_counts(np.concatenate(sets), row, 40)
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (np.triu(got, 1) == np.triu(want, 1)).all() and (got == got.T).all()
    sketch = np.full((40, 16), np.iinfo(np.int64).max)
    for i, s in enumerate(sets):
        sketch[i, : min(16, len(s))] = s[:16]
    a, b = np.triu_indices(40, 1)
    sure = neardup.estimated(sketch, a, b, 16, 3)
    for i, j, yes in zip(a, b, sure, strict=True):
        union = np.union1d(sets[i][:16], sets[j][:16])[:16]
        shared = np.intersect1d(np.intersect1d(sets[i][:16], sets[j][:16]), union)
        assert yes == (16 * len(shared) >= 3 * len(union))


def test_kept_rows_beyond_the_broadcast(spark, odd_docs, monkeypatch):
    rows = spark.createDataFrame([(3, None), (3, None), (1, "a b c d e"), (2, "a b c d e"), (2, "A b c d e"), (1, "a b c d e")], "doc_id long, text string")
    for marks in (1 << 18, 0):
        monkeypatch.setattr(common, "MARKS", marks)
        assert Counter((r.doc_id, r.text) for r in neardup.kept_rows(rows).collect()) == Counter([(3, None), (3, None), (1, "a b c d e")])
        assert Counter((r.doc_id, r.text) for r in exactdup.exact_dedup_rows(rows).collect()) == Counter([(3, None), (1, "a b c d e"), (2, "A b c d e")])
        assert Counter(r.doc_id for r in neardup.kept_rows(odd_docs).collect()) == Counter([1, 3, 4, 5, None, 8, 9, 10])
