"""Token counts by a tokenizer compiled into deterministic transducers.

Two machines read the text. The first splits it into words: five states over the character classes. A
chunk of text is a map from start state to end state; the maps of all chunks compose by a parallel
prefix scan, and only then does each chunk run from its one true start state. The second reads the
bytes of the words and carries byte-pair encoding: a state is what the encoding of a word's beginning
leaves open (the suffixes that a token could still grow from, and the last token before each of them),
and each transition bears the change in the number of tokens. Its states are compiled when first
met, it is back in its start state after every word, and lanes of whole words run side by side, so the
map of a lane is its sum and the counts of documents are differences of a prefix sum.

That the state suffices rests on a property of byte-pair merges: the encoding of a beginning ends in the
one token that stands next to the last token before it without merging, so the last tokens determine
all that follows.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows count alike; an empty table
gives an empty table; columns besides the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import row_bytes
from millrace.llm.lexing import CONT, LETTER, NUMBER, OTHER, SPACE, class_table, classes, contraction

LIMIT = 2048
PIECE = 4 << 20  # bytes of text counted at a time
LANE = 512
FIRST_STATES = 1 << 12
MOST_CELLS = 32 << 20  # transitions kept; beyond them all but the states in use are forgotten and compiled anew when met
_MARKS = 0xCC  # the first byte of U+0300: no text of lower characters composes, and its lower case is settled
_END = 256  # added to the last byte of a word

# The word machine. Classes as in lexing, and apostrophes that open a contraction of two or three letters.
_OPEN2, _OPEN3, _KINDS = 5, 6, 7
_FRESH, _LETTERS, _OTHERS, _ONE_MORE, _TWO_MORE = range(5)


def _word_machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a word begins, by state and class."""
    after = np.zeros((5, _KINDS), np.uint8)
    begins = np.zeros((5, _KINDS), bool)
    for state in range(5):
        for kind, (to, starts) in {
            SPACE: (_FRESH, False),
            LETTER: (_LETTERS, state != _LETTERS),
            NUMBER: (_FRESH, True),
            OTHER: (_OTHERS, state != _OTHERS),
            CONT: (state, False),
            _OPEN2: (_OTHERS, False) if state == _OTHERS else (_ONE_MORE, True),
            _OPEN3: (_OTHERS, False) if state == _OTHERS else (_TWO_MORE, True),
        }.items():
            after[state, kind], begins[state, kind] = to, starts
    for state, to in ((_ONE_MORE, _FRESH), (_TWO_MORE, _ONE_MORE)):  # inside a contraction
        after[state], begins[state] = to, False
    return after, begins


_AFTER, _BEGINS = _word_machine()


def _scan(maps: np.ndarray) -> np.ndarray:
    """Composition of the maps of all chunks up to each, in log steps; maps[k] takes a start state to an end state."""
    step = 1
    while step < len(maps):
        later = maps.copy()
        later[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        maps, step = later, 2 * step
    return maps


def word_begins(kinds: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Where words begin, from the classes of one long text."""
    n = len(kinds)
    lanes = -(-n // chunk)
    padded = np.full(lanes * chunk, CONT, np.uint8)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(lanes, chunk).T)
    after = (_AFTER * _KINDS).reshape(-1)  # states are kept as row offsets
    maps = np.repeat((np.arange(5, dtype=np.uint8) * _KINDS)[:, None], lanes, axis=1)
    for kind in columns:
        maps = after.take(maps + kind)
    maps = _scan((maps // _KINDS).T)
    state = np.concatenate([[_FRESH], maps[:-1, _FRESH]]).astype(np.uint8) * np.uint8(_KINDS)
    begins, flat = np.empty((chunk, lanes), bool), _BEGINS.reshape(-1)
    for k, kind in enumerate(columns):
        cell = state + kind
        begins[k] = flat.take(cell)
        state = after.take(cell)
    return begins.T.reshape(-1)[:n]


class TokenMachine:
    """Byte-pair encoding of words as a machine that counts tokens."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str
        self.kinds = class_table(lambda text: [span for _, span in library.pre_tokenizer.pre_tokenize_str(text)])
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.special = [x["content"] for x in spec["added_tokens"]]
        suffix = model["end_of_word_suffix"]
        number: dict[str, int] = {}
        self.symbols: list[tuple[int, ...]] = []
        for byte, char in enumerate(_byte_letters()):
            for text, symbol in ((char, byte), (char + suffix, byte + _END)):
                number[text] = len(self.symbols)
                self.symbols.append((symbol,))
        self.single = {s[0]: k for k, s in enumerate(self.symbols)}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            whole = number.setdefault(left + right, len(self.symbols))
            if whole == len(self.symbols):
                self.symbols.append(self.symbols[number[left]] + self.symbols[number[right]])
            self.merges.setdefault((number[left], number[right]), (rank, whole))
        self._index_tokens()
        self.columns = np.full(512, -1, np.int32)
        self.forget()

    def _index_tokens(self) -> None:
        """A suffix automaton of the tokens that encode to themselves: per node children, fallback, depth, token."""
        self.children, self.depth, self.token = [{}], [0], [-1]
        for token, symbols in enumerate(self.symbols):
            if self.merge(symbols) != [token]:
                continue
            node = 0
            for symbol in symbols:
                below = self.children[node].get(symbol)
                if below is None:
                    below = self.children[node][symbol] = len(self.children)
                    self.children.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.token.append(-1)
                node = below
            self.token[node] = token
        self.fallback, self.shorter = [0] * len(self.children), [0] * len(self.children)
        queue = list(self.children[0].values())
        for node in queue:  # grows while it is read
            for symbol, below in self.children[node].items():
                self.fallback[below] = self._go(self.fallback[node], symbol)
                queue.append(below)
            back = self.fallback[node]
            self.shorter[node] = back if self.token[back] >= 0 else self.shorter[back]
        # What a later token may still begin with: of each node the suffixes, itself included, that go on.
        self.open = [(0,)] * len(self.children)
        for node in queue:
            rest = self.open[self.fallback[node]]
            self.open[node] = (node, *rest) if self.children[node] else rest
        self.open_depths = [tuple(self.depth[n] for n in chain) for chain in self.open]

    def _go(self, node: int, symbol: int) -> int:
        while symbol not in self.children[node]:
            if not node:
                return 0
            node = self.fallback[node]
        return self.children[node][symbol]

    def merge(self, symbols: tuple[int, ...]) -> list[int]:
        """Plain byte-pair encoding, for the short strings that the machine is built from."""
        parts = [self.single[s] for s in symbols]
        while True:
            best, at = None, 0
            for k, pair in enumerate(zip(parts, parts[1:])):
                found = self.merges.get(pair)
                if found and (best is None or found < best):
                    best, at = found, k
            if best is None:
                return parts
            parts[at : at + 2] = [best[1]]

    def forget(self) -> None:
        self.columns[:] = -1
        self.symbol_of: list[int] = []
        self._only([(0, ((-1, 0),))])

    def _only(self, states: list[tuple]) -> None:
        """A machine that knows these states alone, and none of their transitions."""
        self.pairs: dict[tuple[int, int], bool] = {}
        self.states = states
        self.number = {state: k for k, state in enumerate(states)}
        self.places: dict[int, dict[int, int]] = {}
        high, wide = max(FIRST_STATES, len(states)), -(-max(32, len(self.symbol_of)) // 16) * 16
        self.next = np.full((high, wide), -1, np.int32)
        self.change = np.zeros((high, wide), np.int8)

    def _forget_all_but(self, state: np.ndarray) -> np.ndarray:
        """Keep the start and the states that lanes are in; their new numbers."""
        kept, at = np.unique(np.append(state, 0), return_inverse=True)
        self._only([self.states[k] for k in kept.tolist()])
        return at[:-1].astype(np.int32)

    def _grow(self) -> None:
        """Room for all states and symbols met so far."""
        old_next, old_change = self.next, self.change
        high, wide = old_next.shape
        if len(self.states) > high:
            high = max(len(self.states), high * 3 // 2)
        if len(self.symbol_of) > wide:
            wide = -(-len(self.symbol_of) // 16) * 16
        if (high, wide) == old_next.shape:
            return
        self.next, self.change = np.full((high, wide), -1, np.int32), np.zeros((high, wide), np.int8)
        self.next[: old_next.shape[0], : old_next.shape[1]] = old_next
        self.change[: old_next.shape[0], : old_next.shape[1]] = old_change

    def _compile(self, state: int, symbol: int) -> tuple[int, int]:
        """Where a state goes on a symbol, and the change in tokens."""
        node, window = self.states[state]
        place = self.places.get(node)
        if place is None:
            place = self.places[node] = {d: k for k, d in enumerate(self.open_depths[node])}
        to, token, depth, pairs = self._go(node, symbol), self.token, self.depth, self.pairs
        at = to if token[to] >= 0 else self.shorter[to]
        while True:  # the longest token that ends here and stands beside the last token before it
            before, count = window[place[depth[at] - 1]]
            last = token[at]
            if before < 0:
                break
            apart = pairs.get((before, last))
            if apart is None:
                apart = pairs[before, last] = self.merge(self.symbols[before] + self.symbols[last]) == [before, last]
            if apart:
                break
            at = self.shorter[at]
        change = count + 1
        if symbol >= _END:
            return 0, change
        to = self.open[to][0]
        rest = [window[place[d - 1]] for d in self.open_depths[to] if d]
        key = (to, (*[(t, c - change) for t, c in rest], (last, 0)))
        follows = self.number.get(key)
        if follows is None:
            follows = self.number[key] = len(self.states)
            self.states.append(key)
        return follows, change

    def run(self, symbols: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        """The change in tokens at each symbol; lanes are where runs of whole words begin."""
        for symbol in np.flatnonzero(np.bincount(symbols, minlength=512)).tolist():
            if self.columns[symbol] < 0:
                self.columns[symbol] = len(self.symbol_of)
                self.symbol_of.append(symbol)
        self._grow()
        if self.next.size > MOST_CELLS:
            self._forget_all_but(np.zeros(1, np.int32))
        column = self.columns[symbols]
        length = np.diff(lanes, append=len(symbols))
        order = np.argsort(-length, kind="stable")
        begins, length = lanes[order], length[order]
        active = len(begins) - np.searchsorted(length[::-1], np.arange(1, int(length[0]) + 1))
        change = np.empty(len(symbols), np.int8)
        state = np.zeros(len(begins), np.int32)
        for step, lanes_left in enumerate(active.tolist()):
            at = begins[:lanes_left] + step
            wide = self.next.shape[1]
            cell = state[:lanes_left] * wide + column[at]
            follows = self.next.reshape(-1).take(cell)
            if follows.min() < 0:
                missing = np.unique(cell[follows < 0])
                from_, on = np.divmod(missing, wide)
                if (len(self.states) + len(missing)) * wide > MOST_CELLS and len(self.states) > 2 * lanes_left + 1:
                    state = self._forget_all_but(state[:lanes_left])
                    cell = state * wide + column[at]
                    missing = np.unique(cell)
                    from_, on = np.divmod(missing, wide)
                made = np.array([self._compile(a, self.symbol_of[b]) for a, b in zip(from_.tolist(), on.tolist(), strict=True)])
                self._grow()
                self.next[from_, on], self.change[from_, on] = made[:, 0], made[:, 1]
                cell = state[:lanes_left] * self.next.shape[1] + column[at]
                follows = self.next.reshape(-1).take(cell)
            change[at] = self.change.reshape(-1).take(cell)
            state = follows
        return change

    def prepare(self, text: bytes) -> bytes:
        """The text as the tokenizer normalises it, but for white space, which no word contains."""
        if text.isascii():
            return text.lower()
        if np.frombuffer(text, np.uint8).max() < _MARKS:
            return text.decode().lower().encode()
        return self.normalise(text.decode()).encode()

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text."""
        extra = np.zeros(len(texts), np.int64)
        special = [s.encode() for s in self.special]
        pattern = re.compile(b"|".join(map(re.escape, special)))
        prepared = []
        for k, text in enumerate(texts):
            if any(s in text for s in special):
                parts = pattern.split(text)
                extra[k] = len(parts) - 1  # each is one token and ends what stands before it
                prepared.append(b"\n".join(map(self.prepare, parts)))
            else:
                prepared.append(self.prepare(text))
        data = np.frombuffer(b"\n".join(prepared) + b"\n", np.uint8)
        kinds = classes(data, self.kinds)
        quotes = np.flatnonzero(data == ord("'"))
        if len(quotes):
            kinds = kinds.copy()
            kinds[quotes] = np.array([OTHER, 0, _OPEN2, _OPEN3], np.uint8)[contraction(data, quotes)]
        begins = word_begins(kinds)
        inside = _spread(kinds)
        symbols = data[inside].astype(np.int32)
        if not len(symbols):
            return extra
        first = np.flatnonzero(begins[inside])
        # A word ends before the next begins or before white space; the second falls away with the white space itself.
        symbols[np.append(first[1:] - 1, len(symbols) - 1)] += _END
        lanes = first[np.unique(np.searchsorted(first, np.arange(0, len(symbols), LANE), side="right") - 1)]
        change = self.run(symbols, lanes)
        total = np.concatenate([[0], np.cumsum(change, dtype=np.int64)])
        ends = np.cumsum([len(p) + 1 for p in prepared])
        upto = np.concatenate([[0], np.cumsum(inside)])[np.concatenate([[0], ends])]
        return extra + np.diff(total[upto])


def _spread(kinds: np.ndarray) -> np.ndarray:
    """Which bytes belong to words."""
    return kinds != SPACE


def _byte_letters() -> list[str]:
    """How byte-level vocabularies spell the 256 bytes."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@functools.cache
def machine(path: str) -> TokenMachine:
    return TokenMachine(path)


_OUT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def _grouped(texts: Iterator[bytes], limit: int) -> Iterator[list[bytes]]:
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > limit:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = machine(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, tokens = [], []
            for texts in _grouped(row_bytes(batch.column("text")), PIECE):
                sizes += map(len, texts)
                tokens.append(counter.count(texts))
            n = np.concatenate(tokens)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, _OUT)
