"""Secret scans with inferred credential formats.

Three fixed patterns give the base spans: assigned values, access key ids and runs of hexadecimal digits. What they match
are labelled credentials: the value of an assignment, the key id, the run. For each label a probabilistic automaton is
inferred from a bounded sample of its distinct values (``SAMPLE`` values of at most ``LONGEST`` characters, chosen by a hash)
by state merging: the prefix tree of the sample counts how many values pass and end at each state, and states are merged,
with all that follows from them, while the frequencies of their ends and of every next character differ by less than a
Hoeffding bound allows (``ALPHA``), prefix by prefix. One more automaton is inferred the same way from plain candidates.

Candidates are all runs of ``LEAST`` or more credential characters that no base span touches. One is a span of kind ``format``
where some label's automaton gives it at least ``ODDS`` times the likelihood of the plain one, in nats, and a likelihood a
character that is at most ``SLACK`` below what all but ``FLOOR`` of that label's held-out credentials reach.

Scale: one pass over whole texts writes spans and candidates as a table; sampling counts and cuts distinct values by their
hash before anything is ordered; scoring reads the table. The automata are what the driver holds, and their size follows
from the sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantrail.llm.common import checkpointed, text_slices, workers_import

#: Distinct values a label's automaton is inferred from at most, and their characters; fewer than FEWEST values give none.
SAMPLE, LONGEST, FEWEST = 900, 128, 12
#: The share of a sample that is held out; the share of held-out credentials that may score below the least likelihood.
HELD_OUT, FLOOR = 1 / 3, 0.02
#: Nats a character by which the least likelihood is below theirs, so that values of other lengths have the format too.
SLACK = 0.25
ALPHA, LEAST, ODDS = 0.05, 16, 12.0
PLAIN, FORMAT = "plain", "format"

#: The kinds of base spans in the order of their listing, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a shorter run has no longer one inside
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGNED = 8

#: The characters of candidates; "=" ends one only.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Classes of characters; every other character is its own.
CLASSES = {"upper": ALPHABET[:26], "hex": "abcdef", "lower": ALPHABET[32:52], "digit": "0123456789"} | {c: c for c in "+/_.=-"}
CLASS = {c: k for k, of in CLASSES.items() for c in of}
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.-]{{{LEAST},}}={{0,2}}")

SPAN = "struct<kind:string,start:int,end:int,score:double>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, place of its kind in KINDS, end, labelled value) of the fixed patterns' matches, in this order."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGNED]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, value) of the runs of credential characters that no span in ``taken`` touches."""
    found = [(m.start(), m.end(), m[0]) for m in CANDIDATE.finditer(text)]
    return [c for c in found if all(c[1] <= start or end <= c[0] for start, _, end, _ in taken)] if taken else found


class Automaton:
    """A probabilistic automaton of strings over ALPHABET, inferred by merging compatible states of their prefix tree.

    A character's class (CLASSES) leads to the next state, and each state has its own frequencies of characters, so a fixed beginning
    is learned as well as a run of random characters. Of the states that a new one may be merged with, it goes to the one
    under which what leaves it is likeliest; where there is none, it stays.
    """

    def __init__(self, values: list[str], alpha: float = ALPHA) -> None:
        self.after: list[dict[str, int]] = [{}]  # a state: where classes lead, how many values take each character, how many end
        self.flow: list[Counter[str]] = [Counter()]
        self.ended = [0]
        for value in sorted(values):
            at = 0
            for c in value:
                self.flow[at][c] += 1
                if CLASS[c] not in self.after[at]:
                    self.after[at][CLASS[c]] = len(self.after)
                    self.after.append({})
                    self.flow.append(Counter())
                    self.ended.append(0)
                at = self.after[at][CLASS[c]]
            self.ended[at] += 1
        self._scale = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()
        self._number()

    def _differ(self, f: int, n: int, g: int, m: int) -> bool:
        return abs(f / n - g / m) >= self._scale * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(self, a: int, b: int) -> bool:
        """Whether two states, and all pairs of states that the same classes lead to from them, have frequencies alike."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.ended[a] + self.flow[a].total(), self.ended[b] + self.flow[b].total()
            if self._differ(self.ended[a], n, self.ended[b], m):
                return False
            for one, other in ((self.flow[a], self.flow[b]), (in_classes(self.flow[a]), in_classes(self.flow[b]))):
                if any(self._differ(one[c], n, other[c], m) for c in one | other):
                    return False
            todo += [(x, y) for c, x in self.after[a].items() if (y := self.after[b].get(c)) is not None and x != y]
        return True

    def _likelihood(self, of: int, under: int) -> float:
        """Of what leaves one state, under the probabilities of another."""
        end, by_class, within = probabilities(self.ended[under], self.flow[under])
        return self.ended[of] * end + sum(n * (by_class[CLASS[c]] + within(c)) for c, n in self.flow[of].items())

    def _merge_all(self) -> None:
        red, blue = {0: None}, [(0, c) for c in sorted(self.after[0])]  # red states stay, in order; blue ones follow them
        while blue:
            parent, c = blue[0]
            state = self.after[parent][c]
            fits = [r for r in red if self.compatible(r, state)]
            if fits:
                into = max(fits, key=lambda r: self._likelihood(state, r))
                self.after[parent][c] = into
                self._fold(into, state)
            else:
                red[state] = None
            blue = [(r, x) for r in red for x in sorted(self.after[r]) if self.after[r][x] not in red]

    def _fold(self, into: int, state: int) -> None:
        """Add the tree below ``state`` to ``into``."""
        todo = [(into, state)]
        while todo:
            a, b = todo.pop()
            self.ended[a] += self.ended[b]
            self.flow[a] += self.flow[b]
            for c, y in self.after[b].items():
                if c in self.after[a]:
                    todo.append((self.after[a][c], y))
                else:
                    self.after[a][c] = y

    def _number(self) -> None:
        """Keep the states that are left, with log probabilities; a class that a state has never seen leads to the start."""
        place, order = {0: 0}, [0]
        for at in order:
            for _, x in sorted(self.after[at].items()):
                if x not in place:
                    place[x] = len(order)
                    order.append(x)
        self.ends, self.steps = [], []
        for at in order:
            end, by_class, within = probabilities(self.ended[at], self.flow[at])
            self.ends.append(end)
            self.steps.append({c: (by_class[CLASS[c]] + within(c), place.get(self.after[at].get(CLASS[c], 0), 0)) for c in ALPHABET})
        del self.after, self.flow, self.ended

    def log_likelihood(self, value: str) -> float:
        at, total = 0, 0.0
        for c in value:
            p, at = self.steps[at][c]
            total += p
        return total + self.ends[at]


def in_classes(flow: Counter[str]) -> Counter[str]:
    out: Counter[str] = Counter()
    for c, n in flow.items():
        out[CLASS[c]] += n
    return out


def probabilities(ended: int, flow: Counter[str]) -> tuple[float, dict[str, float], Callable[[str], float]]:
    """Logarithms of the end, of each class, and of a character in its class. One more value is spread over the end and all characters, and one
    more of each character over a class that was seen."""
    share, seen = 1 / (len(ALPHABET) + 1), in_classes(flow)
    total = ended + flow.total() + 1
    by_class = {k: math.log((seen[k] + len(of) * share) / total) for k, of in CLASSES.items()}
    return math.log((ended + share) / total), by_class, lambda c: math.log((flow[c] + 1) / (seen[CLASS[c]] + len(CLASSES[CLASS[c]])))


class Formats:
    """The automata of all labels, and what a candidate must reach."""

    def __init__(self, samples: dict[str, list[str]], odds: float = ODDS) -> None:
        self.odds = odds
        self.labels: dict[str, tuple[Automaton, float]] = {}
        for label in KINDS:
            values = samples.get(label, [])
            if len(values) < FEWEST:
                continue
            held = max(1, int(len(values) * HELD_OUT))  # samples come in the order of a hash
            automaton = Automaton(values[held:])
            each = sorted(automaton.log_likelihood(v) / len(v) for v in values[:held])
            self.labels[label] = automaton, each[int(len(each) * FLOOR)] - SLACK
        self.plain = Automaton(samples.get(PLAIN, [])) if self.labels else None

    def score(self, value: str) -> float | None:
        """The most nats by which a label's likelihood is above the plain one, of labels whose format the value has; None where it has none."""
        best, plain = None, None
        for automaton, floor in self.labels.values():
            own = automaton.log_likelihood(value)
            if own / len(value) < floor:
                continue
            plain = self.plain.log_likelihood(value) if plain is None else plain
            if own - plain >= self.odds and (best is None or own - plain > best):
                best = own - plain
        return best


def found_in(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, spans, candidates) of whole texts; a null text is empty."""
    workers_import(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
    runs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in text_slices(batches, 1):
            base, other = [], []
            for t in part.column(1).to_pylist():
                own = base_spans(t or "")
                base.append([{"kind": KINDS[k], "start": s, "end": e, "value": v} for s, k, e, v in own])
                other.append([{"start": s, "end": e, "value": v} for s, e, v in candidates(t or "", own)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, spans), pa.array(other, runs)], names=["key", "spans", "candidates"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(scan, f"key {kind}, spans array<struct<kind:string,start:int,end:int,value:string>>, candidates array<struct<start:int,end:int,value:string>>")


def sampled(found: DataFrame, size: int = SAMPLE) -> dict[str, list[str]]:
    """At most ``size`` distinct values of each label, of at most LONGEST characters, in the order of a hash."""
    labelled = found.select(F.explode("spans").alias("s")).select(F.col("s.kind").alias("label"), "s.value")
    plain = found.select(F.explode("candidates").alias("s")).select(F.lit(PLAIN).alias("label"), "s.value")
    values = labelled.unionByName(plain).where(F.length("value") <= LONGEST).distinct()
    values = checkpointed(values.select("label", "value", F.xxhash64("value").alias("h")))
    counts = values.groupBy("label").agg(F.count("*").alias("n"))  # a row a label
    space = 1 << 40
    few = values.join(F.broadcast(counts), "label").where(F.pmod("h", F.lit(space)) < F.lit(4.0 * size * space) / F.col("n"))
    order = Window.partitionBy("label").orderBy("h", "value")
    rows = few.withColumn("at", F.row_number().over(order)).where(F.col("at") <= size).select("label", "at", "value").collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.label, r.at)):
        out.setdefault(r.label, []).append(r.value)
    return out


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", odds: float = ODDS) -> DataFrame:
    """(key, spans) a row of ``docs``: spans are (kind, start, end, score) in code points, the end exclusive, ordered by start and then by
    kind as in KINDS, ``format`` last. Base spans have no score, added ones that of their format.

    A null or empty text has no spans. Repeated rows give repeated rows, and a null key is carried. Fewer than FEWEST distinct
    labelled values of a kind give it no automaton; without any, only base spans are found. No rows give no rows. Other columns
    are not read.
    """
    found = checkpointed(found_in(docs, key, text))
    formats = Formats(sampled(found), odds)
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, other in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = [(s["start"], KINDS.index(s["kind"]), s["end"], None) for s in base]
                scores = ((c, formats.score(c["value"])) for c in other)
                own += [(c["start"], len(KINDS), c["end"], x) for c, x in scores if x is not None]
                own.sort(key=lambda s: s[:2])
                out.append([{"kind": (*KINDS, FORMAT)[k], "start": s, "end": e, "score": x} for s, k, e, x in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, spans)], names=[key, "spans"])

    scored = found.select(F.col("key").alias(key), "spans", "candidates")
    return scored.mapInArrow(score, f"`{key}` {found.schema['key'].dataType.simpleString()}, spans array<{SPAN}>")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """``text`` with what its spans cover replaced; spans that meet or overlap leave one mask."""
    one = F.lit(1)

    def step(a: Column, s: Column) -> Column:
        fresh = (s["start"] > a["at"]) | (a["at"] == 0)
        out = F.when(fresh, F.concat(a["out"], text.substr(a["at"] + one, s["start"] - a["at"]), F.lit(mask))).otherwise(a["out"])
        return F.struct(out.alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], text.substr(a["at"] + one, F.length(text))))
