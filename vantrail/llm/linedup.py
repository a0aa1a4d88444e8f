"""Line deduplication with a segment-partition edit join.

Lines link when their edit distance is at most what the shorter one allows: one edit for every ``PER_EDIT`` characters,
``threshold`` at most. A line of length l that allows t edits is cut into t + 1 segments of fixed places; of two lines
within t edits the longer holds some segment of the shorter unchanged, at a place that both their lengths and the
segment's number narrow down to a few. So each distinct line probes its substrings for every shorter or equal length in
reach, only at starts that a left-to-right and a right-to-left count of edits both allow, under (length, number,
content); its own segments are the probes of its own length at their own place, and these it writes. Lines lie as
UTF-32 for this, where a substring costs nothing to find.

A list is all lines with one key. Lists that hold one line, or that no line writes, go first. A list of up to ``SMALL``
lines gives its pairs. A longer one links each line with its hub, the written line of the smallest hash; lines that do
not link with it are compared with all others of the list in blocks of about ``BLOCK`` lines. Two blocks are one row, whose
links are found inside and leave as edges that connect the same lines, about as many as there are lines. Counts of
frequent letters, which t edits change by twice as much at most, come before every distance. Pairs lose their common
ends and are verified by bit-parallel edit distance within a band of 2 threshold + 1 diagonals: one word of vertical
differences slides along the diagonal, a few word operations a character.

Scale: copies of a line meet in partial sums where they lie, and up to ``MARKS`` shared keys are broadcast to them, so they are
one entry before anything is shuffled; beyond that many keys copies are shuffled to them once. The joins move 64-bit segment and line hashes, no text; texts are
read again only of documents that hold the first copy of a line in question. Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantrail.llm.common import bounded, checkpointed, text_or_empty, utf8
from vantrail.llm.neardup import components

THRESHOLD, PER_EDIT = 2, 8
#: Longest list whose pairs are all candidates; lines of a block, about.
SMALL, BLOCK = 16, 128
#: Letters frequent in many languages, six bits each.
LETTERS, LETTER_BITS = "eantiorsld", 6
#: White space that is not one space already; plain lines have none, and nothing is replaced in them.
_ODD_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def allowed(length: Column, threshold: int) -> Column:
    """The edits that a line of this length forgives."""
    return F.least(F.floor(length / PER_EDIT).cast("int"), F.lit(threshold))


def segment(length: Column, number: int, edits: int) -> tuple[Column, Column]:
    """Start, from 1, and length of a segment, numbered from 1: the first are the shorter ones."""
    parts = edits + 1
    over = length % parts
    base = ((length - over) / parts).cast("int")
    short = parts - over
    return (number - 1) * base + F.greatest(F.lit(number - 1) - short, F.lit(0)) + 1, base + F.when(F.lit(number) > short, 1).otherwise(0)


def segment_keys(wide: Column, length: Column, threshold: int) -> tuple[list[Column], int]:
    """The hashes a line of UTF-32 probes, null where they do not fit, and how many of them, the first, it also writes."""
    writes, probes = [], []
    for edits in range(1, threshold + 1):
        for delta in range(edits + 1):
            of = length - delta
            fits = (of >= edits * PER_EDIT) if edits == threshold else (of >= edits * PER_EDIT) & (of < (edits + 1) * PER_EDIT)
            for number in range(1, edits + 2):
                start, size = segment(of, number, edits)
                left, right = number - 1, edits + 1 - number
                for move in range(max(-left, delta - right), min(left, delta + right) + 1):
                    at = start + move
                    part = wide.substr((at * 4 - 3).cast("int"), (size * 4).cast("int"))
                    key = F.when(fits & (at >= 1) & (at + size - 1 <= length), F.xxhash64(of, F.lit(number), part))
                    (writes if delta == 0 and move == 0 else probes).append(key)
    return [*writes, *probes], len(writes)


def letter_counts(line: Column, length: Column) -> Column:
    """Counts of the letters, each up to 63, in one bigint."""
    packed = F.lit(0).cast("bigint")
    most = (1 << LETTER_BITS) - 1
    for i, c in enumerate(LETTERS):
        packed = packed.bitwiseOR(F.shiftleft(F.least(length - F.length(F.replace(line, F.lit(c), F.lit(""))), F.lit(most)).cast("bigint"), i * LETTER_BITS))
    return packed


def letters_apart(a: Column, b: Column) -> Column:
    most = (1 << LETTER_BITS) - 1
    part = lambda x, i: F.shiftright(x, i * LETTER_BITS).bitwiseAND(F.lit(most).cast("bigint"))
    total = F.abs(part(a, 0) - part(b, 0))
    for i in range(1, len(LETTERS)):
        total = total + F.abs(part(a, i) - part(b, i))
    return total


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of two strings, exact up to ``threshold`` and greater than it beyond; b is no longer than a.

    Bit i of a word is the row ``column - threshold + i`` of the matrix. Rows above the first hold the distances of
    characters that match nothing; cells outside the band count as one more than their neighbour inside.
    """
    parts = F.struct(F.split(a, "").alias("rows"), F.split(b, "").alias("columns"), F.length(a).alias("m"), F.length(b).alias("n"))
    return _let(parts, lambda s: _banded(s["rows"], s["columns"], s["m"], s["n"], threshold))


def _banded(rows: Column, columns: Column, m: Column, n: Column, t: int) -> Column:
    width = 2 * t + 1
    mask = (1 << width) - 1
    word = lambda x: F.lit(x).cast("bigint")
    start = F.struct(word(mask ^ ((1 << (t + 1)) - 1)).alias("p"), word((1 << (t + 1)) - 1).alias("q"), word(0).alias("d"))

    def matches(j: Column) -> Column:
        found = word(0)
        for i in range(width):
            found = found.bitwiseOR(F.when(F.get(rows, j - t + i - 1) == F.get(columns, j - 1), word(1 << i)).otherwise(word(0)))
        return found

    def step(s: Column, j: Column) -> Column:
        moved = F.struct(F.shiftright(s["p"], 1).bitwiseOR(word(1 << (width - 1))).alias("p"), F.shiftright(s["q"], 1).alias("q"), matches(j).alias("e"), s["d"].alias("d"))
        # a diagonal above 2 t leaves no cell of the band within t
        return F.when(s["d"] > 2 * t, s).otherwise(_let(_let(_let(moved, diagonal), horizontal), vertical))

    def diagonal(x: Column) -> Column:
        p, q, e = x["p"], x["q"], x["e"]
        zero = ((e.bitwiseAND(p) + p).bitwiseXOR(p)).bitwiseOR(e).bitwiseOR(q).bitwiseAND(word(mask))
        return F.struct(p.alias("p"), q.alias("q"), zero.alias("z"), x["d"].alias("d"))

    def horizontal(x: Column) -> Column:
        p, q, z = x["p"], x["q"], x["z"]
        up = F.shiftleft(q.bitwiseOR(z.bitwiseOR(p).bitwiseXOR(word(mask))), 1).bitwiseOR(word(1)).bitwiseAND(word(mask))
        down = F.shiftleft(z.bitwiseAND(p), 1).bitwiseAND(word(mask))
        return F.struct(up.alias("u"), down.alias("w"), z.alias("z"), x["d"].alias("d"))

    def vertical(x: Column) -> Column:
        u, w, z = x["u"], x["w"], x["z"]
        return F.struct(w.bitwiseOR(z.bitwiseOR(u).bitwiseXOR(word(mask))).alias("p"), z.bitwiseAND(u).alias("q"), (x["d"] + 1 - F.shiftright(z, t).bitwiseAND(word(1))).alias("d"))

    def last(s: Column) -> Column:
        below = F.when(m == n, word(0))
        for k in range(1, t + 1):
            bits = word(((1 << k) - 1) << (t + 1))
            below = below.when(m - n == k, (F.bit_count(s["p"].bitwiseAND(bits)) - F.bit_count(s["q"].bitwiseAND(bits))).cast("bigint"))
        return s["d"] + below

    return F.when(m - n > t, word(t + 1)).when(n == 0, m.cast("bigint")).otherwise(_let(F.aggregate(F.sequence(F.lit(1), n), start, step), last))


def without_common_ends(a: Column, b: Column, rounds: int = 6) -> Column:
    """A struct (x, y) of the strings without equal beginnings and ends, found by halves; the edit distance is the same."""

    def step(s: Column, k: Column) -> Column:
        front = k <= rounds
        share = F.get(F.array(*[F.lit(1 << min(i, 5)) for i in range(1, rounds + 1)] * 2), k - 1)
        cut = F.floor(F.least(F.length(s["x"]), F.length(s["y"])) / share).cast("int")

        def drop(c: Column) -> Column:
            x, y, cut = c["x"], c["y"], c["cut"]
            one = F.lit(1)
            same_front = front & (x.substr(one, cut) == y.substr(one, cut))
            same_back = ~front & (F.right(x, cut) == F.right(y, cut))
            kept = lambda v: F.when(same_front, v.substr(cut + 1, F.length(v))).when(same_back, v.substr(one, F.length(v) - cut)).otherwise(v)
            return F.struct(kept(x).alias("x"), kept(y).alias("y"))

        return _let(F.struct(s["x"].alias("x"), s["y"].alias("y"), cut.alias("cut")), drop)

    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * rounds)), F.struct(a.alias("x"), b.alias("y")), step)


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line, digest, h): lines between newlines, numbered from 0, white space runs as one space, ends
    trimmed; digest is the MD5 of a line and h 64 bits of it. A null text is one empty line."""
    parts = docs.select(F.col(key).alias("key"), F.posexplode(F.split(text_or_empty(text), "\n")).alias("line_no", "raw"))
    odd = F.col("raw").contains("  ")
    for c in "\t\x0b\x0c\r":
        odd = odd | F.col("raw").contains(c)
    line = F.trim(F.when(odd, F.regexp_replace("raw", _ODD_SPACE, " ")).otherwise(F.col("raw")))
    return parts.select("key", "line_no", line.alias("line")).withColumn("digest", F.unhex(F.md5(utf8(F.col("line"))))).withColumn("h", F.xxhash64("digest"))


def keyed(lines: DataFrame, threshold: int) -> tuple[DataFrame, int, int]:
    """``lines`` with the keys that each probes as columns k0, k1, ..., how many these are and how many, the first, it writes."""
    wide = lines.withColumn("wide", F.encode("line", "UTF-32")).withColumn("size", (F.octet_length("wide") / 4).cast("int"))
    keys, written = segment_keys(F.col("wide"), F.col("size"), threshold)
    return wide.select(*lines.columns, *[k.alias(f"k{i}") for i, k in enumerate(keys)]), len(keys), written


def edit_links(rows: DataFrame, keys: int, written: int, read: Callable[[DataFrame], DataFrame], threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): digests of lines, so that components of these edges are the components of all pairs of lines within reach of each
    other. ``rows`` has (h, k0, k1, ...), a row for each copy of a line; ``read`` gives (h, digest, line) of the rows of a table (h)."""
    spread = rows.select("h", F.posexplode(F.array(*[f"k{i}" for i in range(keys)])).alias("i", "k")).where(F.col("k").isNotNull())
    entries = spread.select("k", "h", (F.col("i") < written).alias("w"))
    lists = entries.groupBy("k").agg(F.min("h").alias("least"), F.max("h").alias("most"), F.min(F.when(F.col("w"), F.col("h"))).alias("hub"))
    lists = checkpointed(lists.where("least <> most and hub is not null").select("k", "hub"))  # few of all keys
    shared = checkpointed(entries.join(bounded(lists), "k").distinct())
    sizes = checkpointed(shared.groupBy("k").agg(F.count("*").alias("m")))
    listed = checkpointed(shared.join(bounded(sizes), "k"))
    short, long_ = listed.where(F.col("m") <= SMALL), listed.where(F.col("m") > SMALL)
    writer, prober = short.where("w").select("k", F.col("h").alias("a")), short.select("k", F.col("h").alias("b"))
    pairs = writer.join(prober, "k").select("a", "b").unionByName(long_.select(F.col("hub").alias("a"), F.col("h").alias("b")))
    pairs = checkpointed(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    family = checkpointed(long_.select("k", "hub", "h").distinct())
    wanted = pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h")))
    texts = checkpointed(read(checkpointed(wanted.distinct())).select("h", "digest", "line", F.length("line").alias("size")).withColumn("letters", letter_counts(F.col("line"), F.col("size"))))
    of = lambda s: texts.select(F.col("h").alias(s), F.struct("digest", "line", "size", "letters").alias("of_" + s))
    found = checkpointed(pairs.join(of("a"), "a").join(of("b"), "b").where(within(F.col("of_a"), F.col("of_b"), threshold)).select("a", "b", F.col("of_a.digest").alias("da"), F.col("of_b.digest").alias("db")))
    links = found.select(F.col("da").alias("a"), F.col("db").alias("b"))
    known = found.select(F.col("a").alias("hub"), F.col("b").alias("h")).unionByName(found.select(F.col("b").alias("hub"), F.col("a").alias("h")))
    dealt = _dealt(family, known)
    if dealt.isEmpty():
        return links
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # units are few bytes and much work
    side = F.when(F.col("block") == F.col("low"), F.lit(0)).otherwise(1)
    units = dealt.join(texts, "h").repartition(parts, "k", "low", "high").groupBy("k", "low", "high").agg(*[F.collect_list(F.when(side == i, F.struct("digest", "line", "size", "letters"))).alias(f"s{i}") for i in (0, 1)])
    units = units.select("s0", F.when(F.col("low") == F.col("high"), F.col("s0")).otherwise(F.col("s1")).alias("s1"))
    edges = units.select(F.explode(unit_edges(F.col("s0"), F.col("s1"), threshold)).alias("e")).select("e.a", "e.b")
    return links.unionByName(checkpointed(edges.distinct()))


def _dealt(family: DataFrame, links: DataFrame) -> DataFrame:
    """(k, low, high, block, h): each line of a long list in every unit of its block. Blocks 0 to r - 1 hold the lines that are not
    linked with the hub, and the blocks after these the others; a unit is two blocks, or one, with a block of the former."""
    own = family.join(links.select("hub", "h", F.lit(True).alias("linked")).distinct(), ["hub", "h"], "left")
    own = checkpointed(own.select("k", "h", (F.col("linked").isNull() & (F.col("hub") != F.col("h"))).alias("rest")))
    need = lambda of: F.ceil(F.count(F.when(of, 1)) / BLOCK)
    blocks = checkpointed(own.groupBy("k").agg(need(F.col("rest")).alias("r"), need(~F.col("rest")).alias("o")).where("r > 0"))
    placed = own.join(bounded(blocks), "k")
    at = F.pmod(F.xxhash64("h"), F.when(F.col("rest"), F.col("r")).otherwise(F.col("o")))
    placed = placed.withColumn("block", at + F.when(F.col("rest"), F.lit(0)).otherwise(F.col("r")))
    last = F.when(F.col("rest"), F.col("r") + F.col("o")).otherwise(F.col("r")) - 1
    spread = placed.select("k", "h", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("other"))
    return checkpointed(spread.select("k", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "h"))


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether two lines (digest, line, size, letters) are different and within the reach of the shorter one."""
    reach = allowed(F.least(a["size"], b["size"]), threshold)
    longer = a["size"] >= b["size"]
    cut = lambda: without_common_ends(F.when(longer, a["line"]).otherwise(b["line"]), F.when(longer, b["line"]).otherwise(a["line"]))
    near = (F.abs(a["size"] - b["size"]) <= reach) & (letters_apart(a["letters"], b["letters"]) <= 2 * reach) & (a["digest"] != b["digest"])
    return near & (_let(cut(), lambda s: banded_distance(s["x"], s["y"], threshold)) <= reach)


def unit_edges(left: Column, right: Column, threshold: int) -> Column:
    """Edges (a, b) of digests that connect what the links between two arrays of lines connect: each line of the left with its first
    neighbour, and each neighbour with the next, which for lines that share their neighbours are the same few edges."""
    base = 1 << 20  # places of a block are far below it

    def of(x: Column) -> Column:
        near = F.filter(F.sequence(F.lit(0), F.size(right) - 1), lambda j: within(x, F.get(right, j), threshold))
        return _let(near, lambda n: F.struct(x["digest"].alias("a"), F.get(n, F.lit(0)).alias("first"), F.when(F.size(n) > 1, F.zip_with(F.slice(n, 1, F.size(n) - 1), F.slice(n, 2, F.size(n) - 1), lambda p, q: p.cast("bigint") * base + q)).otherwise(F.array().cast("array<bigint>")).alias("more")))

    def both(found: Column) -> Column:
        linked = F.filter(found, lambda f: f["first"].isNotNull())
        first = F.transform(linked, lambda f: F.struct(f["a"].alias("a"), F.get(right, f["first"])["digest"].alias("b")))
        more = F.transform(F.array_distinct(F.flatten(F.transform(linked, lambda f: f["more"]))), lambda c: F.struct(F.get(right, F.floor(c / base).cast("int"))["digest"].alias("a"), F.get(right, (c % base).cast("int"))["digest"].alias("b")))
        return F.concat(first, more)

    found = F.when((F.size(left) > 0) & (F.size(right) > 0), F.transform(left, of))
    return _let(found, both)


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(key, line_no, class_id, n_copies, class_size, keep_id, keep_line, kept) for every line of every document.

    A class holds the copies of a line and all lines that links reach; class_id is its smallest digest, n_copies counts
    the lines equal to this one, class_size the lines of the class. The line of the smallest key, and in it the first,
    stays: keep_id and keep_line. Empty lines separate paragraphs: each is its own and stays, with a null class and a
    class_size of 1. A null key comes after all others. Of rows repeated with one key all lines at the place that stays are
    kept. No rows give no rows. Other columns are not read.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = lines_of(docs, "key", "text")
    place = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("line_no").alias("line_no"))
    lines, keys, written = keyed(found.withColumns({c: F.when(F.col("line") != "", F.col(c)) for c in ("digest", "h")}), threshold)
    lines = checkpointed(lines.drop("line"))
    filled = lines.where(F.col("digest").isNotNull())
    known = checkpointed(filled.groupBy("digest", "h").agg(F.min(place).alias("first"), F.count("*").alias("n_copies")))

    def read(wanted: DataFrame) -> DataFrame:
        hashes = checkpointed(known.select("h", F.col("first.key").alias("of")).join(wanted, "h"))
        holders = bounded(checkpointed(hashes.select("of").distinct()))
        held = docs.join(holders, docs["key"].eqNullSafe(holders["of"]), "left_semi")
        return lines_of(held, "key", "text").join(bounded(hashes.select("h")), "h").select("h", "digest", "line").distinct()

    labels = components(edit_links(filled, keys, written, read, threshold)).select(F.col("node").alias("digest"), "root")
    known = known.join(labels, "digest", "left").select("digest", "first", "n_copies", F.col("root").isNotNull().alias("linked"), F.coalesce("root", "digest").alias("class_id"))
    known = checkpointed(known)
    classes = known.where("linked").groupBy("class_id").agg(F.min("first").alias("least"), F.sum("n_copies").alias("n"))
    known = known.join(classes, "class_id", "left").select("digest", "class_id", "n_copies", F.coalesce("n", "n_copies").alias("class_size"), F.coalesce("least", "first").alias("stays"))
    out = lines.select("key", "line_no", "digest").join(known, "digest", "left")
    own = F.col("class_id").isNull()
    keep_id, keep_line = F.when(own, F.col("key")).otherwise(F.col("stays.key")), F.when(own, F.col("line_no")).otherwise(F.col("stays.line_no"))
    one = lambda c: F.coalesce(c, F.lit(1)).alias(c)
    return out.select(F.col("key").alias(key), "line_no", F.lower(F.hex("class_id")).alias("class_id"), one("n_copies"), one("class_size"), keep_id.alias("keep_id"), keep_line.alias("keep_line"), (F.col("key").eqNullSafe(keep_id) & (F.col("line_no") == keep_line)).alias("kept"))


def deduplicated(docs: DataFrame, marks: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the dropped lines gone from their texts; ``marks`` is what ``line_dedup`` gave. Rows that share a key, or have none, lose
    every line whose place any of them lost. No rows give no rows; columns of any name are carried."""
    gone = marks.where("not kept").groupBy(F.col(key).alias("key")).agg(F.collect_set("line_no").alias("gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"), F.col(key).alias("of"), F.col(text).alias("text"))
    joined = rows.join(gone, rows["of"].eqNullSafe(gone["key"]), "left")
    kept = F.filter(F.split(text_or_empty("text"), "\n"), lambda x, i: ~F.array_contains("gone", i))
    joined = joined.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    return joined.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
