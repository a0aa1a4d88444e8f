"""Near-duplicate documents by bottom-k sketches of word shingles from one hash function.

1. Sets. Each document's distinct shingles are hashed once to 63 bits; the sketch is the k smallest values. Documents
   with equal sets become one node, so exact copies cost nothing further on.
2. Inverted lists. Two sets of Jaccard similarity t share about t k sketch values. Under any fixed order of values, two
   sketches of size s that share c values share one among the first s - c + 1 of each. The order puts values that few
   documents hold first (the most frequent ones are counted, all others come by hash), so passages that many documents
   share seldom make a list. c is a share of the sketch that a pair of the asked similarity falls below with a
   probability of at most ``LOSS``: 28 of 64 at similarity 3/4.
3. Candidates. A list of up to ``SMALL`` nodes gives its pairs. A longer one links each node with the list's hub, the
   node whose values are the most shared: in a group of edited copies that is the text they were made from. Estimates
   from the union sketch drop unlikely pairs, and exact Jaccard on the full sets confirms the rest.
4. The rest of the long lists. Lists with one hub hold much the same nodes and make one family. Its nodes fall into those
   that link with the hub, which need no comparison with each other, and the rest. Both are dealt by hash into blocks of
   at most about ``BLOCK`` nodes and ``BLOCK_HASHES`` shingles, and every pair of blocks that holds a node of the rest
   is one unit of work: overlaps of the sketches, the estimate, exact Jaccard, and of the links it finds a spanning
   forest leaves the unit. So no list is capped, no link between components is lost, and no pair becomes a row.
5. Components by contraction, once, over all links; every node hooks to its smallest neighbour, and edges are relabelled
   until none is left.

Scale: what is shuffled is a few dozen sketch values a document and the full sets of documents that have a candidate; a
node of a family's rest goes to as many units as the family has blocks. A family whose copies mostly do not link with
their hub is compared in full, the square of its number, in units of bounded size. The only thing that reaches the
driver is the table of the ``COMMON`` most frequent values.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantrail.llm.common import bounded, checkpointed, drop_marked, text_slices, whole_row, workers_import

#: Sketch size, words of a shingle, similarity in hundredths.
K, WORDS, PERCENT = 64, 5, 75
#: Most that the estimate may lose of the pairs whose similarity is exactly the asked one.
LOSS = 3e-8
#: Longest list whose pairs are all candidates; documents from which a value counts as frequent; frequent values kept.
SMALL, FREQUENT, COMMON = 16, 16, 100_000
#: Nodes and shingles of a block, about.
BLOCK, BLOCK_HASHES = 512, 1 << 17
#: Bytes hashed at once, columns of a product, pairs estimated at once.
WINDOW, COLUMNS, ESTIMATED = 1 << 18, 2048, 8192
_U = np.uint64
#: The base of a word's hash, which has an inverse.
_BASE = 0xD1342543DE82EF95


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return (h ^ (h >> _U(31))) >> _U(1)


#: Odd multipliers of the words of a shingle, without a simple relation between them.
_MULTIPLIERS = list(_mix(np.arange(1, 65, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1))


def _byte_values() -> np.ndarray:
    """A value for each byte: zero for ASCII white space, that of the small letter for A-Z."""
    values = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
    values[65:91] = values[97:123]
    values[[0x20, *range(0x09, 0x0E)]] = 0
    return values


_VALUES = _byte_values()
_SPACE = _VALUES == 0


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS, _INVERSES = _powers(WINDOW, _BASE), _powers(WINDOW, pow(_BASE, -1, 1 << 64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the texts, whose UTF-8 bytes lie between the offsets, and where each text's words begin. Words are
    maximal runs without ASCII white space, A-Z in lower case; a word's hash is a polynomial in its bytes' values."""
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = word[begins]
    starts = np.flatnonzero(first)
    out, at = np.empty(len(starts), dtype=np.uint64), 0
    while at < len(starts):
        lo = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, lo + WINDOW, "right")) - 1) if len(data) - lo > WINDOW else len(starts)
        chunk = _VALUES[data[lo : starts[to] if to < len(starts) else len(data)]]
        own = starts[at:to] - lo
        powers, inverses = (_POWERS, _INVERSES) if len(chunk) <= WINDOW else (_powers(len(chunk), _BASE), _powers(len(chunk), pow(_BASE, -1, 1 << 64)))
        out[at:to] = np.add.reduceat(chunk * powers[: len(chunk)], own) * inverses[own]
        at = to
    return _mix(out), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, ascending; of fewer words the whole sequence is one, of none nothing."""
    hashed, at = word_hashes(data, offsets)
    rolled = np.zeros(max(0, len(hashed) - words + 1), dtype=np.uint64)
    for i in range(words):
        rolled += hashed[i : i + len(rolled)] * _MULTIPLIERS[i]
    rolled = _mix(rolled).astype(np.int64)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= words:
            own = np.sort(rolled[lo : hi - words + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            short = (hashed[lo:hi] * np.array(_MULTIPLIERS[: hi - lo], dtype=np.uint64)).sum(dtype=np.uint64, keepdims=True)
            out.append(_mix(short ^ _U(hi - lo)).astype(np.int64) if hi > lo else np.empty(0, np.int64))
    return out


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)), pa.array(np.concatenate([*sets, np.empty(0, np.int64)])))


def sketches(docs: DataFrame, key: str, text: str, k: int = K, words: int = WORDS) -> DataFrame:
    """(key, h, n, set_key, sketch): a hash of the text, size and digest of the set (digest null if empty), and its k smallest hashes."""
    workers_import(docs.sparkSession)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("h", T.LongType()), T.StructField("n", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_slices(batches, 1):
            sets = shingle_sets(data, offsets, words)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), _lists([s[:k] for s in sets])], names=[key, "h", "n", "set_key", "sketch"])

    return docs.select(key, text, F.xxhash64(text).alias("h")).mapInArrow(run, schema)


def full_sets(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, hashes) of rows (node, set_key, text): the whole set, kept only where its digest is the node's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_slices(batches, 2):
            sets = shingle_sets(data, offsets, words)
            same = [i for i, (s, d) in enumerate(zip(sets, batch.column(1).to_pylist(), strict=True)) if xxhash.xxh3_128_digest(s.tobytes()) == d]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(same, pa.int32())), _lists([sets[i] for i in same])], names=["node", "hashes"])

    return rows.select("node", "set_key", "text").mapInArrow(run, "node long, hashes array<long>")


def least_shared(percent: int, k: int) -> int:
    """The most values c such that a pair at the asked similarity shares fewer than c of the k smallest of its union with a probability
    of at most LOSS. An error where that is none, since sketches then find no pairs without loss."""
    p, below, c = percent / 100, 0.0, 0
    while c < k * p and below + comb(k, c) * p**c * (1 - p) ** (k - c) <= LOSS:
        below += comb(k, c) * p**c * (1 - p) ** (k - c)
        c += 1
    if c < 1:
        raise ValueError(f"sketches of {k} values do not find pairs of {percent} hundredths; take more values")
    return c


def prefixes(nodes: DataFrame, common: tuple[np.ndarray, np.ndarray], k: int, c: int) -> DataFrame:
    """(value, node, shared): the first values of each sketch in the fixed order; shared sums how many hold its values."""
    values, held = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            freq = np.zeros(len(flat), dtype=np.int64)
            if len(values):
                at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
                freq = np.where(values[at] == flat, held[at], 0)
            order = np.lexsort((flat, freq, row))
            rank = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = order[rank < (sizes - (c * sizes + k - 1) // k + 1)[row]]
            shared = np.bincount(row, weights=freq, minlength=len(sizes)).astype(np.int64)
            node = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(flat[first]), pa.array(node[row[first]]), pa.array(shared[row[first]])], names=["value", "node", "shared"])

    return nodes.select("node", "sketch").mapInArrow(run, "value long, node long, shared long")


def likely(a: Column, b: Column, k: int, c: int) -> Column:
    """Whether the similarity estimated from the union sketch is at least c of k."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return k * F.size(F.array_intersect(union, F.array_intersect(a, b))) >= c * F.size(union)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes of the links (a, b): root is the smallest node of the component."""
    edges = checkpointed(links.select("a", "b").where("a <> b").distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        over = hooks.select(F.col("a").alias("p"), F.col("p").alias("to"))
        hooks = checkpointed(hooks.join(over, "p").select(F.col("a").alias("from"), "to"))  # every p hooks too
        steps.append(hooks)
        moved = edges.join(hooks, edges["a"] == hooks["from"]).select(F.col("to").alias("a"), "b")
        moved = moved.join(hooks, moved["b"] == hooks["from"]).select("a", F.col("to").alias("b"))
        edges = checkpointed(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = steps[0].select(F.col("from").alias("node"), F.col("to").alias("root"))
    for hooks in steps[1:]:
        labels = labels.join(hooks, labels["root"] == hooks["from"], "left").select("node", F.coalesce("to", "root").alias("root"))
    return checkpointed(labels)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row.

    Documents link where 100 |A and B| >= percent |A or B|; component_id is the smallest key that links reach, and kept
    says whether it is the row's own. A text without words, or null, has no shingles and is its own component. A null
    key is reached like others but is never smaller than one; in a component without any other key component_id is
    null and its rows are kept. Repeated rows share their component and each says kept. No rows give no rows. Other
    columns are not read.
    """
    out = _grouped(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), k, words, percent)
    component = F.when(F.col("group").isNull(), F.col("key")).otherwise(F.col("least"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))


def _grouped(docs: DataFrame, k: int, words: int, percent: int) -> DataFrame:
    """(key, h, n, group, least) for every row (key, text): the component, null for an empty set, and its smallest key."""
    rows = checkpointed(sketches(docs, "key", "text", k, words))
    nodes = nodes_of(rows)
    links = _links(nodes, docs, k, words, percent)
    labels = components(links)
    named = nodes.select("set_key", "node", "least").join(labels, "node", "left")
    smallest = named.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("least").alias("of_all"))
    named = named.join(smallest, "root", "left").select("set_key", F.coalesce("root", "node").alias("group"), F.coalesce("of_all", "least").alias("least"))
    return rows.select("key", "h", "n", "set_key").join(named, "set_key", "left").select("key", "h", "n", "group", "least")


def nodes_of(rows: DataFrame) -> DataFrame:
    """(node, set_key, least, doc, h, n, sketch) of each distinct set: the smallest key, and key and text hash of one row that has it."""
    one = F.min(F.struct(F.col("key").alias("doc"), "h"))
    nodes = rows.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("key").alias("least"), one.alias("one"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    return checkpointed(nodes.select(F.monotonically_increasing_id().alias("node"), "set_key", "least", "one.doc", "one.h", "n", "sketch"))


def _links(nodes: DataFrame, docs: DataFrame, k: int, words: int, percent: int) -> DataFrame:
    """(a, b): links that connect all of each component."""
    counted = nodes.select(F.explode("sketch").alias("value")).groupBy("value").agg(F.count("*").alias("m"))
    top = counted.where(F.col("m") >= FREQUENT).orderBy(F.desc("m"), "value").limit(COMMON).toPandas().sort_values("value")  # COMMON rows at most
    c = least_shared(percent, k)
    entries = prefixes(nodes, (top["value"].to_numpy(np.int64), top["m"].to_numpy(np.int64)), k, c)
    lists = entries.groupBy("value").agg(F.count("*").alias("m"), F.max("shared").alias("most")).where("m > 1")
    listed = checkpointed(entries.join(lists, "value"))

    pairs = _pairs(listed.where(F.col("m") <= SMALL).select("value", "node"))
    long_ = listed.where(F.col("m") > SMALL)
    hubs = checkpointed(long_.where("shared = most").groupBy("value").agg(F.min("node").alias("hub")))
    family = checkpointed(long_.join(bounded(hubs), "value").select("hub", "node").distinct())
    star = family.where("hub <> node").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    seen = checkpointed(_likely_pairs(pairs.unionByName(star).distinct(), nodes, k, c, percent))
    wanted = seen.select(F.col("a").alias("node")).unionByName(seen.select(F.col("b").alias("node"))).distinct()
    links = _confirmed(seen, node_sets(wanted, nodes, docs, words), percent)

    known = links.select(F.col("a").alias("hub"), F.col("b").alias("node")).unionByName(links.select(F.col("b").alias("hub"), F.col("a").alias("node")))
    dealt = _dealt(family, known, nodes)
    if dealt.isEmpty():
        return links
    sets = node_sets(dealt.select("node").distinct(), nodes, docs, words)
    forest = dealt.join(sets, "node").groupBy("hub", "low", "high").applyInArrow(_unit(k, c, percent), "a long, b long")
    return links.unionByName(checkpointed(forest))


def _pairs(entries: DataFrame) -> DataFrame:
    """Pairs within a list."""
    left, right = (entries.select("value", F.col("node").alias(s)) for s in "ab")
    return left.join(right, (left["value"] == right["value"]) & (F.col("a") < F.col("b"))).select("a", "b")


def node_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, hashes) of the wanted nodes, one row each, from the row that stands for each. Up to MARKS of them are broadcast and no
    text moves; beyond that texts and nodes meet in a shuffle."""
    who = checkpointed(wanted.join(nodes.select("node", "doc", "h", "set_key"), "node"))
    small = bounded(who)
    docs = docs.select("key", "text", F.xxhash64("text").alias("th"))
    found = docs.join(small, docs["key"].eqNullSafe(small["doc"]) & (docs["th"] == small["h"]))
    return checkpointed(full_sets(found, words).dropDuplicates(["node"]))  # a table, so that joins with hot nodes can be split


def _likely_pairs(pairs: DataFrame, nodes: DataFrame, k: int, c: int, percent: int) -> DataFrame:
    """The pairs whose sizes allow the similarity and whose estimate comes near it."""
    of = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias("n" + s), F.col("sketch").alias("s" + s))
    seen = pairs.join(of("a"), "a").join(of("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return seen.where(likely(F.col("sa"), F.col("sb"), k, c)).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets (node, hashes) are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    return checkpointed(both.where((100 + percent) * shared >= percent * (F.size("ha") + F.size("hb"))).select("a", "b"))


def _dealt(family: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(hub, low, high, block, node): each node of a family in every unit of its block. Blocks 0 to r - 1 hold the rest of a family, which
    is not linked with the hub, and the blocks after these the others; a unit is two blocks, or one, with a block of the rest."""
    own = family.join(links.select("hub", "node", F.lit(True).alias("linked")).distinct(), ["hub", "node"], "left")
    own = own.select("hub", "node", (F.col("linked").isNull() & (F.col("hub") != F.col("node"))).alias("rest"))
    sized = checkpointed(own.join(nodes.select("node", "n"), "node"))
    need = lambda of: F.greatest(F.ceil(F.count(F.when(of, 1)) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0)) / BLOCK_HASHES))
    blocks = sized.groupBy("hub").agg(need(F.col("rest")).alias("r"), need(~F.col("rest")).alias("o")).where("r > 0")
    at = F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("r")).otherwise(F.col("o")))
    placed = sized.join(blocks, "hub").withColumn("block", at + F.when(F.col("rest"), F.lit(0)).otherwise(F.col("r")))
    last = F.when(F.col("rest"), F.col("r") + F.col("o")).otherwise(F.col("r")) - 1
    spread = placed.select("hub", "node", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("other"))
    return checkpointed(spread.select("hub", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node"))


def common_counts(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """How many values each two of n rows share; a row holds a value once."""
    _, column, held = np.unique(values, return_inverse=True, return_counts=True)
    out = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, many = row[order], held[column[order]]
    for h in range(2, 9):  # few holders: their pairs
        of = row[many == h].reshape(-1, h)
        for i in range(h):
            for j in range(i):
                out += np.bincount(of[:, i] * n + of[:, j], minlength=n * n).reshape(n, n) if len(of) else 0
    out += out.T
    heavy = many > 8
    place = np.cumsum(np.concatenate([[0], np.diff(column[order][heavy]) != 0])) if heavy.any() else np.empty(0, int)
    row = row[heavy]
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        here = (place >= lo) & (place < lo + COLUMNS)
        part = np.zeros((n, COLUMNS), dtype=np.float32)
        part[row[here], place[here] - lo] = 1
        out += part @ part.T
    return out


def estimated(sketch: np.ndarray, a: np.ndarray, b: np.ndarray, k: int, c: int) -> np.ndarray:
    """Whether the similarity that the union sketch of each pair gives is at least c of k; short sketches are filled with the largest int."""
    out, none = np.empty(len(a), dtype=bool), np.iinfo(np.int64).max
    for lo in range(0, len(a), ESTIMATED):
        both = np.sort(np.concatenate([sketch[a[lo : lo + ESTIMATED]], sketch[b[lo : lo + ESTIMATED]]], axis=1), axis=1)
        again = np.zeros(both.shape, dtype=bool)
        again[:, 1:] = both[:, 1:] == both[:, :-1]
        real = both != none
        rank = np.cumsum(real & ~again, axis=1)
        shared = (again & real & (rank <= k)).sum(axis=1)
        out[lo : lo + ESTIMATED] = k * shared >= c * np.minimum(rank[:, -1], k)
    return out


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """Of links between n rows as many as connect what they connect."""
    linked = np.zeros((n, n), dtype=bool)
    linked[a, b] = linked[b, a] = True
    fresh, x, y = np.ones(n, dtype=bool), [], []
    for root in range(n):
        todo = [root] if fresh[root] else []
        fresh[root] = False
        while todo:
            at = todo.pop()
            found = np.flatnonzero(linked[at] & fresh)
            fresh[found] = False
            todo += found.tolist()
            x += [at] * len(found)
            y += found.tolist()
    return x, y


def _unit(k: int, c: int, percent: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        node, block, lists = rows["node"].to_numpy(), rows["block"].to_numpy(), rows["hashes"].combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0)
        n, size = len(node), lists.value_lengths().to_numpy().astype(np.int64)
        flat, row = lists.flatten().to_numpy(), np.repeat(np.arange(n), size)
        rank = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        first = rank < k
        sketch = np.full((n, k), np.iinfo(np.int64).max)
        sketch[row[first], rank[first]] = flat[first]
        short = np.minimum(size, k)
        overlap = common_counts(flat[first], row[first], n)
        may = k * overlap >= c * np.minimum(k, short[:, None] + short[None, :] - overlap)
        may &= 100 * np.minimum(size[:, None], size[None, :]) >= percent * np.maximum(size[:, None], size[None, :])
        low, high = int(rows["low"][0].as_py()), int(rows["high"][0].as_py())
        may &= np.triu(np.ones((n, n), dtype=bool), 1) if low == high else ((block == low)[:, None] & (block == high)[None, :])
        a, b = np.nonzero(may)
        sure = estimated(sketch, a, b, k, c)
        a, b = a[sure], b[sure]
        x: list[int] = []
        y: list[int] = []
        if len(a):
            used = np.zeros(n, dtype=bool)
            used[a] = used[b] = True
            take = used[row]
            shared = common_counts(flat[take], row[take], n)[a, b]
            yes = (100 + percent) * shared.astype(np.int64) >= percent * (size[a] + size[b])
            x, y = _forest(a[yes], b[yes], n)
        return pa.table({"a": pa.array(node[x], pa.int64()), "b": pa.array(node[y], pa.int64())})

    return run


def kept_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, all columns as they were: the row of the smallest key, null
    last, and of several such rows the one whose text has the smallest hash. Rows without words all stay.

    Only keys and hashes of texts decide; then texts are read once more. Other columns, whatever their names, are carried. No rows
    give no rows.
    """
    rows = checkpointed(_grouped(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), k, words, percent).where(F.col("group").isNotNull()).select("key", "h", "group"))
    order = F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("h"))
    same = rows.groupBy("group", "key", "h").agg(F.count("*").alias("m"))
    first = same.groupBy("group").agg(F.min(order).alias("o"))
    judged = checkpointed(same.join(first, "group").select("key", "h", "m", ((F.col("h") == F.col("o.h")) & F.col("key").eqNullSafe(F.col("o.key"))).alias("stays")))
    named = docs.select(whole_row(docs), F.col(key).alias("key"), F.xxhash64(text).alias("h"))
    return drop_marked(named, judged.where("not stays"), judged.where("stays and m > 1"), ["key", "h"]).select("row.*")
