"""Character classes and word boundaries of UTF-8 bytes, by array operations over many texts at once."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np

SPACE, LETTER, NUMBER, OTHER, CONT = range(5)


def class_table(pieces: Callable[[str], list[tuple[int, int]]]) -> np.ndarray:
    """The class of every code point, asked of a pre-tokenizer: ``pieces`` gives the spans that it cuts a text into.

    Code points in a row are cut where their class changes, so few questions settle all of them.
    """
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    step = 1 << 11
    for at in range(0, sys.maxunicode + 1, step):
        if 0xD800 <= at < 0xE000:  # surrogates, which no text holds
            continue
        text = "".join(map(chr, range(at, at + step)))
        cuts = np.unique([0, step, *(x for span in pieces(text) for x in span)])
        for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            table[at + begin : at + end] = _asked(pieces, text[begin])
    for char in map(chr, range(128)):  # in a row, a space or an apostrophe can join what follows
        table[ord(char)] = _asked(pieces, char)
    return table


def _asked(pieces: Callable[[str], list[tuple[int, int]]], char: str) -> int:
    """A letter joins a letter and a mark joins a mark; a number joins a number or is a piece of its own."""
    for before, kind in (("a", LETTER), ("!", OTHER)):
        if pieces(before + char) == [(0, 2)]:
            return kind
    if pieces("1" + char) == [(0, 2)] or (pieces(char) == [(0, 1)] and pieces(char + " " + char) == [(0, 1), (2, 3)]):
        return NUMBER
    return SPACE


def classes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of each byte: that of its character at the lead byte, then CONT; SPACE throughout for wide spaces."""
    out = table[:256].take(data)  # right for ASCII
    out[(data & 0xC0) == 0x80] = CONT
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.uint32)
        at = lambda k: data[np.minimum(lead + k, len(data) - 1)].astype(np.uint32) & 0x3F
        two, three = (first & 0x1F) << 6 | at(1), (first & 0x0F) << 12 | at(1) << 6 | at(2)
        four = (first & 0x07) << 18 | at(1) << 12 | at(2) << 6 | at(3)
        kind = table[np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))]
        out[lead] = kind
        wide = lead[kind == SPACE]
        for k in (1, 2):
            tail = wide[wide + k < len(data)] + k
            tail = tail[out[tail] == CONT] if k == 1 else tail[(out[tail] == CONT) & (data[tail - 2] >= 0xE0)]
            out[tail] = SPACE
    return out


def contraction(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For apostrophes at these places: 2 or 3 if 's 't 'm 'd or 're 've 'll begins there, else 0."""
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    one, two = padded[at + 1], padded[at + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    return np.where(short, 2, np.where(long, 3, 0))


def word_starts(data: np.ndarray, text_starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where the pieces begin that byte-level BPE splits a text into.

    ``text_starts`` are the places where texts begin; pieces never cross them. A single space belongs to the
    word that follows it, of a longer white-space run the last character stands apart, contractions are
    pieces of their own, and letters, numbers and the rest form runs.
    """
    kinds = classes(data, table)
    wide = (data & 0xC0) != 0x80  # places of characters
    at = np.flatnonzero(wide)
    kind = kinds[at]
    first = np.zeros(len(data) + 1, bool)
    first[text_starts] = True
    first = first[:-1][at]
    before = np.empty_like(kind)
    before[1:], before[:1] = kind[:-1], OTHER
    space, space_before = kind == SPACE, before == SPACE
    plain_before = np.zeros(len(at), bool)
    plain_before[1:] = data[at[:-1]] == 32
    # The last of a white-space run, when a word of the same text follows.
    last = np.zeros(len(at), bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    start = np.where(space, ~space_before | last, np.where(space_before, ~plain_before, kind != before)) | first
    quote = np.flatnonzero(start & (data[at] == ord("'")))
    # A contraction must lie within its text: its letters begin no text.
    length = contraction(data, at[quote])
    for n in (2, 3):
        q = quote[length == n]
        q = q[q + n - 1 < len(at)]
        inside = np.ones(len(q), bool)
        for k in range(1, n):
            inside &= ~first[q + k]
        q = q[inside]
        for k in range(1, n):
            start[q + k] = False
        q = q[q + n < len(at)] + n
        start[q[~space[q]]] = True
    return at[start]
