"""Token counts by a compiled finite-state tokenizer.

Transducer. For every prefix of a pre-token, byte-pair encoding ends in one token t(i), and that token is the only one
that ends there, continues the encoding of what lies before it, and whose pair with the last token before it encodes to
just these two tokens. So what the next bytes can do depends on a window alone: the longest suffix that some token
starts with, the last tokens at the places inside it from which a token may still come, and how far their counts lie
behind. These windows are the states, finite in number since tokens are of bounded length. A transition by a byte leads
to the next window and is annotated with the change in the number of emitted tokens. States and transitions are compiled
when first met and kept in a table of bounded size, dropped and built anew beyond it.

Splitter. Which bytes form a pre-token is decided by a second automaton over characters, whose state is the class of the run it
is in, white space of which the last character still waits for what follows, or an apostrophe that may begin a contraction.
Together with the window of the unfinished pre-token this is the state of the tokenizer between any two characters.

State maps. A text is cut into chunks anywhere. A chunk's map takes the state before it to the state after it and the tokens
it emits. Wherever white space follows other text, every state goes to the initial one, so a map is its behaviour up to the
first such place, which is the walk of the characters there from any state, then a count, and the state at its end, which no
longer depends on what came before. Maps compose: the state at the end of one walks the beginning of the next. So the maps
of a text's chunks are combined by a parallel prefix scan that begins with the initial state, in which a beginning is walked once a
level at most; the count of a text is its last prefix, closed. Between the places where the state is known equal pre-tokens are counted once and looked up.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantrail.llm.bpe import RankArrayBPE, token_bytes
from vantrail.llm.common import text_slices, workers_import
from vantrail.llm.tokens import Vocabulary, vocabulary

#: Transitions and counted pre-tokens after which a worker's tables start anew.
TRANSITIONS, WORDS = 1_500_000, 600_000
#: Characters of a chunk, and of a text that is one run of pre-tokens and needs no map.
CHUNK, SHORT = 1 << 14, 512
_WS = r"\t-\r\x20\x85\xa0  -     　"
_SYNC = re.compile(rf"(?<=[^{_WS}])[{_WS}]")
_BIAS = 128


class CountTransducer:
    #: The window in which every pre-token begins.
    START = (b"", ((0, -1, 0),))

    def __init__(self, vocab: Vocabulary):
        self.bpe = RankArrayBPE(vocab)
        raw = {i: b for i, b in token_bytes(vocab.path).items() if i not in vocab.special.values()}
        order = list(raw)
        again = self.bpe.merge([raw[i] for i in order])
        #: Tokens that encoding can end in: those that encode to themselves.
        self.token = {raw[i]: i for i, e in zip(order, again, strict=True) if len(e) == 4 and int.from_bytes(e, "little") == i}
        self.bytes = raw
        self.prefix = {b[:n] for b in self.token for n in range(1, len(b))}
        self.pairs: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states, self.number, self.step = [self.START], {self.START: 0}, {}

    def fits(self, a: int, b: int) -> bool:
        """Whether the two tokens' bytes encode to just these two."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > TRANSITIONS:
                self.pairs.clear()
            known = self.pairs[key] = self._pair(a, b)
        return known

    def _pair(self, a: int, b: int) -> bool:
        pair, made, size = self.bpe.pair, self.bpe.made, self.bpe.size
        left, right = self.bytes[a], self.bytes[b]
        cut = len(left)
        part = self.bpe.byte_id[np.frombuffer(left + right, dtype=np.uint8)].tolist()
        end = list(range(1, len(part) + 1))
        while True:
            best, at = None, -1
            for i in range(len(part) - 1):
                r = pair.get(part[i] * size + part[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return len(part) == 2 and part[0] == a and part[1] == b
            if end[at] == cut:
                return False  # the boundary between them goes
            part[at] = int(made[best])
            end[at] = end[at + 1]
            del part[at + 1], end[at + 1]

    def _compile(self, state: int, byte: int) -> int:
        window, live = self.states[state]
        window += bytes((byte,))
        n = len(window)
        for length, last, behind in live:  # longest first
            token = self.token.get(window[n - 1 - length :])
            if token is not None and (last < 0 or self.fits(last, token)):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        delta = behind + 1
        prefix = self.prefix
        after = [(length + 1, t, c - delta) for length, t, c in live if window[n - 1 - length :] in prefix]
        keep = after[0][0] if after else 0
        key = (window[n - keep :], (*after, (0, token, 0)))
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        self.step[state << 8 | byte] = value = number << 8 | delta + _BIAS
        return value

    def count(self, word: bytes) -> int:
        """Tokens of one pre-token: the sum of the annotations on its path."""
        return self._run(0, word)[1]

    def feed(self, window: tuple, text: str) -> tuple[tuple, int]:
        """The window after some characters of a pre-token, and the sum of the annotations on the way."""
        number = self.number.get(window)
        if number is None:
            number = self.number[window] = len(self.states)
            self.states.append(window)
        state, total = self._run(number, text.encode())
        return self.states[state], total

    def _run(self, state: int, word: bytes) -> tuple[int, int]:
        if len(self.step) > TRANSITIONS:
            window = self.states[state]
            self._reset()
            state = self.number.setdefault(window, len(self.states))
            if state:
                self.states.append(window)
        step, total = self.step.get, 0
        for byte in word:
            value = step(state << 8 | byte)
            if value is None:
                value = self._compile(state, byte)
            state = value >> 8
            total += (value & 255) - _BIAS
        return state, total


class State(NamedTuple):
    """Of the tokenizer between two characters: the splitter's mode, the window of the unfinished pre-token, and what waits."""

    mode: str
    window: tuple
    waits: str


#: Modes: nothing begun; a run of letters, numbers or other characters; white space; an apostrophe, alone or with the letter after it.
NONE, LETTER, NUMBER, OTHER, SPACE, MARK = "", "L", "N", "O", "S", "'"
#: The letters that end a contraction at once, and those that need a second one.
_ONE, _TWO = "stmd", {"r": "e", "v": "e", "l": "l"}


class StateMap(NamedTuple):
    """What a chunk does to a state: walk ``head``; then, unless the whole chunk is head, ``count`` tokens lead to the state ``end``."""

    head: str
    count: int
    end: State | None


class TokenCounter:
    def __init__(self, vocab: Vocabulary):
        self.vocab, self.transducer = vocab, CountTransducer(vocab)
        self.words: dict[str, int] = {}
        self.classes: dict[str, str] = {}
        self.initial = State(NONE, CountTransducer.START, "")

    def tokens(self, text: str) -> int:
        """Of a text that begins and ends where the state is the initial one."""
        if not text:
            return 0
        if len(self.words) > WORDS:
            self.words.clear()
        words, total = self.words, 0
        for part in self.vocab.segments(text):
            if part in self.vocab.special:
                total += 1
                continue
            found = self.vocab.split(part)
            try:
                total += sum(map(words.__getitem__, found))
            except KeyError:
                count = self.transducer.count
                for w in found:
                    if w not in words:
                        words[w] = count(w.encode())
                total += sum(map(words.__getitem__, found))
        return total

    def kind(self, c: str) -> str:
        """The class of a character, as the split puts it together with others."""
        found = self.classes.get(c)
        if found is None:
            alone = lambda before: len(self.vocab.split(before + c)) == 1
            found = self.classes[c] = LETTER if alone("a") else NUMBER if alone("1") else OTHER if alone("!") else SPACE
        return found

    def walk(self, state: State, text: str) -> tuple[State, int]:
        """The state after a text without special strings, and the tokens emitted on the way."""
        mode, window, waits = state
        start, feed, total = CountTransducer.START, self.transducer.feed, 0

        def token(word: str) -> int:
            return self.transducer.count(word.encode())

        for c in text:
            if mode == MARK:
                if not waits:
                    if c in _ONE:
                        mode, total = NONE, total + token(MARK + c)
                        continue
                    if c in _TWO:
                        waits = c
                        continue
                    mode, (window, n) = OTHER, feed(start, MARK)
                elif c == _TWO[waits]:
                    mode, waits, total = NONE, "", total + token(MARK + waits + c)
                    continue
                else:
                    total += token(MARK)
                    mode, (window, n), waits = LETTER, feed(start, waits), ""
                total += n
            kind = self.kind(c)
            if mode == SPACE:
                if kind == SPACE:
                    window, n = feed(window, waits)
                    waits, total = c, total + n
                    continue
                if waits == " ":
                    window, n = feed(start, " ")
                    mode, waits, total = kind, "", total + n
                else:
                    mode, total, waits = NONE, total + token(waits), ""
            if mode != kind:
                window = start
                if c == MARK:
                    mode = MARK
                    continue
                mode = kind
                if kind == SPACE:
                    waits = c
                    continue
            window, n = feed(window, c)
            total += n
        return State(mode, window, waits), total

    def finish(self, state: State) -> int:
        """Tokens that a state still emits where the text, or all that a pre-token can hold, ends."""
        if state.mode == MARK:
            return self.transducer.count(MARK.encode()) + (self.transducer.count(state.waits.encode()) if state.waits else 0)
        return self.transducer.feed(state.window, state.waits)[1] if state.mode == SPACE else 0

    def map(self, chunk: str) -> StateMap:
        first = _SYNC.search(chunk)
        if first is None:
            return StateMap(chunk, 0, None)
        a = first.start()
        b = self._last(chunk, a)
        end, more = self.walk(self.initial, chunk[b:])
        return StateMap(chunk[:a], self.tokens(chunk[a:b]) + more, end)

    @staticmethod
    def _last(chunk: str, first: int) -> int:
        for back in (512, len(chunk)):  # mostly near the end
            at = -1
            for m in _SYNC.finditer(chunk, max(first, len(chunk) - back)):
                at = m.start()
            if at >= 0:
                break
        return at

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """First a, then b."""
        if a.end is None:
            return StateMap(a.head + b.head, b.count, b.end)
        state, walked = self.walk(a.end, b.head)
        if b.end is None:
            return StateMap(a.head, a.count + walked, state)
        return StateMap(a.head, a.count + walked + self.finish(state) + b.count, b.end)

    def close(self, m: StateMap) -> int:
        """Tokens of a text whose map this is."""
        whole = self.compose(StateMap("", 0, self.initial), m)
        return whole.count + self.finish(whole.end)

    def count(self, text: str) -> int:
        if len(text) <= SHORT:
            return self.tokens(text)
        total = 0
        for part in self.vocab.segments(text):
            if part in self.vocab.special:
                total += 1
            else:
                maps = [self.map(part[i : i + CHUNK]) for i in range(0, len(part), CHUNK)]
                last = prefix_scan([StateMap("", 0, self.initial), *maps], self.compose)[-1]  # from the initial state, so no prefix is open
                total += last.count + self.finish(last.end)
        return total


def prefix_scan(items: list, compose: Callable) -> list:
    """All prefixes under an associative operation, by pairs: the odd places from the scan of composed pairs, the even
    ones by one more composition. Depth grows with the logarithm of the number of items."""
    if len(items) <= 1:
        return list(items)
    pairs = prefix_scan([compose(a, b) for a, b in zip(items[::2], items[1::2], strict=False)], compose)
    out = []
    for i, x in enumerate(items):
        out.append(x if i == 0 else pairs[i // 2] if i % 2 else compose(pairs[i // 2 - 1], x))
    return out


@lru_cache(maxsize=2)
def token_counter(path: str) -> TokenCounter:
    return TokenCounter(vocabulary(path))


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` without its text and with ``n_bytes`` (UTF-8) and ``out``, as the library counts without added tokens;
    special strings in a text count one each, a null text counts 0 of both. Columns of these names are replaced. Other
    columns, nulls and repeated rows are kept; no rows give no rows."""
    workers_import(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text, out, "n_bytes")]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("n_bytes", T.LongType()), T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(tokenizer)
        for batch, _, at in text_slices(batches, len(keep)):
            texts = batch.column(len(keep)).to_pylist()
            n_bytes = pa.array(np.diff(at), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n_bytes, pa.array([counter.count(t) for t in texts], pa.int64())], names=[*keep, "n_bytes", out])

    return docs.mapInArrow(run, schema)
