"""Words of texts and counts over short stretches of them, taken with whole-array operations.

The texts of a block are laid end to end as one array of code points. Every character gets a set of traits from a table, words
are runs of letters and digits (each ideograph and syllable sign is a word of its own), and a word is known by a 64-bit hash of
its lower-case characters, taken from prefix sums. Each text is divided into stretches of about 300 characters, and what is
counted is counted for a stretch. Nothing here depends on any language or any word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Characters of a stretch, about.
STRETCH = 300
#: Characters laid end to end at once; a longer text is taken in parts.
BLOCK = 1_000_000

LETTER, DIGIT, UPPER, SPACE, MARK, STOP, SIGN, HAN, PARTS, JOINT, CLOSING, FULL = (1 << i for i in range(12))

_KNOWN = 0x20000
# Marks of ordinary sentences, which say nothing about lists and links.
_ORDINARY = set(".,;:!?'\"()-—–…«»“”‘’„¿¡。、「」！？%*[]<>&_")


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Traits, lower case and a random number of every character; those beyond the first two planes are ideographs."""
    traits, lower = np.zeros(_KNOWN + 1, np.uint16), np.arange(_KNOWN + 1, dtype=np.uint32)
    for c in range(_KNOWN):
        ch = chr(c)
        kind = unicodedata.category(ch)
        t = 0
        if kind[0] in "LM":
            t = LETTER
            if 0x3040 <= c <= 0x30FF:
                t |= SIGN
            elif 0x3400 <= c <= 0x9FFF or 0xF900 <= c <= 0xFAFF:
                t |= SIGN | HAN
            if kind in ("Lu", "Lt"):
                t |= UPPER
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
        elif kind[0] == "N":
            t = DIGIT
        elif ch.isspace() or kind in ("Zs", "Zl", "Zp", "Cc"):
            t = SPACE
        elif ch not in _ORDINARY and kind != "Cs":
            t = MARK
        if ch in ".!?…":
            t |= STOP
        if ch in "。！？":
            t |= STOP | FULL
        if ch in "\n\t,;|/·•、，":
            t |= PARTS
        if ch in "/@=.:":
            t |= JOINT
        if ch in "\"'”’»)]":
            t |= CLOSING
        traits[c] = t
    traits[_KNOWN] = LETTER | SIGN | HAN
    mixed = (np.arange(_KNOWN + 1, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return traits, lower, mixed[lower]


_BASE = 0x5851F42D4C957F2D


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse, for the hash of any run by prefix sums."""
    n = BLOCK + 70_000
    ups, downs = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    ups[0] = downs[0] = 1
    return np.multiply.accumulate(ups), np.multiply.accumulate(downs)


class Words(NamedTuple):
    """Texts of a block with their words, in order."""

    code: np.ndarray  # code points of the parts, a line break behind each
    trait: np.ndarray
    rows: np.ndarray  # the row of each part
    begin: np.ndarray  # where each part begins and ends
    end: np.ndarray
    start: np.ndarray  # where each word begins and stops
    stop: np.ndarray
    part: np.ndarray  # the part of each word
    hash: np.ndarray


def blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Code points, rows, begins and ends of the texts, some at a time; null and empty texts have none."""
    codes, rows, size = [], [], 0

    def out():
        ends = np.cumsum([len(c) for c in codes])
        return np.concatenate(codes), np.array(rows), np.concatenate([[0], ends[:-1]]), ends - 1

    for row in range(len(column)):
        text = column[row].as_py()
        if not text:
            continue
        code = np.frombuffer((text + "\n").encode("utf-32-le", "replace"), np.uint32)
        for at in range(0, len(code) - 1, BLOCK):
            part = code if len(code) <= BLOCK + 1 else np.append(code[at : min(at + BLOCK, len(code) - 1)], np.uint32(10))
            if codes and size + len(part) > BLOCK:
                yield out()
                codes, rows, size = [], [], 0
            codes.append(part)
            rows.append(row)
            size += len(part)
    if codes:
        yield out()


def words(code: np.ndarray, rows: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Words:
    traits, _, mixed = _tables()
    ups, downs = _powers()
    known = np.minimum(code, _KNOWN)
    trait = traits[known]
    sign = (trait & SIGN) > 0
    letter = (trait & LETTER) > 0
    inside = ((trait & (LETTER | DIGIT)) > 0) & ~sign
    quote = (code == 39) | (code == 0x2019)
    at = np.flatnonzero(quote[1:-1] & inside[:-2] & (letter & ~sign)[2:]) + 1
    inside[at] = True  # an apostrophe within a word
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    opens, closes = edge[:-1] == 1, edge[1:] == -1
    start, stop = np.flatnonzero(opens | sign), np.flatnonzero(closes | sign) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed[known] * ups[: len(code)])])
    h = (sums[stop] - sums[start]) * downs[start]
    return Words(code, trait, rows, begin, end, start, stop, np.searchsorted(begin, start, "right") - 1, h)


def per_text(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each part: part, hash, and whether the word is short and no ideograph or number."""
    short = short_words(w)
    order = np.lexsort((w.hash, w.part))
    part, h = w.part[order], w.hash[order]
    first = np.ones(len(h), bool)
    first[1:] = (part[1:] != part[:-1]) | (h[1:] != h[:-1])
    return part[first], h[first], short[order][first]


def short_words(w: Words, letters: int = 4) -> np.ndarray:
    """Whether each word has few letters, and is neither an ideograph nor begins with a digit: function words are such."""
    at = w.trait[w.start]
    return (w.stop - w.start <= letters) & ((at & LETTER) > 0) & ((at & HAN) == 0)


#: What is counted for each stretch; all but the last are out of its words, that out of its characters. Spam lies upward.
FEATURES = ("plain", "small", "unstopped", "unnamed", "repetition", "sameness", "marks", "links")


class Stretches(NamedTuple):
    part: np.ndarray
    n_words: np.ndarray
    n_chars: np.ndarray
    counts: np.ndarray  # a column for each feature


def counted(w: Words, common: np.ndarray) -> Stretches:
    """Counts of all stretches of a block; ``common`` tells of each word whether it is a common one of its text's language."""
    length = w.end - w.begin
    pieces = np.maximum(1, np.round(length / STRETCH).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(pieces)])
    total = int(first[-1])

    def of(at: np.ndarray, part: np.ndarray) -> np.ndarray:
        return first[part] + (at - w.begin[part]) * pieces[part] // np.maximum(length[part], 1)

    def part_of(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(w.begin, at, "right") - 1

    def tally(at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(of(at, part_of(at)), weights, total)[:total]

    trait, inside = w.trait, (w.trait & (LETTER | DIGIT)) > 0
    where = of(w.start, w.part)
    size = w.stop - w.start
    n = np.bincount(where, minlength=total).astype(float)
    uppers = np.concatenate([[0], np.cumsum((trait & UPPER) > 0)])
    letters = np.concatenate([[0], np.cumsum((trait & LETTER) > 0)])
    n_upper, n_letter = uppers[w.stop] - uppers[w.start], letters[w.stop] - letters[w.start]
    title = ((trait[w.start] & UPPER) > 0) & (n_upper == 1)
    sign = (trait[w.start] & SIGN) > 0
    plain = ~(common | (size < 3) & (n_upper == 0) & (n_letter > 0) & ~sign)
    small = plain & ~title & (n_letter > 0)
    # repetition and entropy of the words that aren't common
    key = (where[plain].astype(np.uint64) << np.uint64(46)) | (w.hash[plain] >> np.uint64(18))
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(key)))
    at = (key[new] >> np.uint64(46)).astype(np.int64)
    m = np.bincount(where[plain], minlength=total).astype(float)
    kinds = np.bincount(at, minlength=total)
    clogc = np.bincount(at, times * np.log(times), total)
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = (np.log(m) - clogc / m) / np.log(m)
    sameness = np.where(m > 2, (1 - np.nan_to_num(entropy, nan=1.0)) * m, 0.0)
    # ends of sentences
    follow = np.append(trait[1:], SPACE)
    stops = tally(np.flatnonzero(((trait & STOP) > 0) & (((follow & (SPACE | CLOSING)) > 0) | ((trait & FULL) > 0))))
    # runs of marks that don't stand within a word
    mark = (trait & MARK) > 0
    edge = np.diff(mark.astype(np.int8), prepend=0, append=0)
    run, past = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    before = np.where(run > 0, inside[run - 1], False)
    entity = np.where(run > 0, w.code[run - 1] == 38, False)
    after = np.append(inside, False)[past]
    marks = tally(run[np.where(before, ~after, ~entity)])
    # runs without blanks in which a mark joins words, as in links
    joint = np.flatnonzero((trait[1:-1] & JOINT) > 0) + 1
    c, left, right = w.code[joint], trait[joint - 1], trait[joint + 1]
    word = LETTER | DIGIT
    dotted = ((c == 46) | (c == 58)) & ((left & LETTER) > 0) & ((left & SIGN) == 0) & ((right & word) > 0) & ((right & SIGN) == 0)
    joined = joint[dotted | ~((c == 46) | (c == 58)) & ((left & word) > 0) & ((right & word) > 0) | (c == 58) & (w.code[joint + 1] == 47)]
    blank = ((trait & (SPACE | SIGN | FULL)) > 0) | (w.code == 0x3001)
    edge = np.diff((~blank).astype(np.int8), prepend=0, append=0)
    run, past = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    linked = np.unique(np.searchsorted(run, joined, "right") - 1)
    links = tally(run[linked], (past - run)[linked])
    return Stretches(
        np.repeat(np.arange(len(w.begin)), pieces), n, np.diff(np.concatenate([[0], _cuts(length, pieces)])).astype(float),
        np.column_stack([np.bincount(where[plain], minlength=total), np.bincount(where[small], minlength=total), np.maximum(n - stops, 0), np.maximum(n - _named(w, title, where, total), 0), m - kinds, sameness, marks, links]),
    )


def _cuts(length: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Running number of characters at the end of each stretch."""
    first = np.cumsum(pieces) - pieces
    k = np.arange(int(pieces.sum())) - np.repeat(first, pieces) + 1
    n, p = np.repeat(length, pieces), np.repeat(pieces, pieces)
    return np.repeat(np.cumsum(length) - length, pieces) + -(-k * n // p)


def _named(w: Words, title: np.ndarray, where: np.ndarray, total: int) -> np.ndarray:
    """Words of entries with a name: short stretches between separators with two capitalised words side by side, each kind of
    entry once a stretch. Registers of persons are made of these; lists of keywords repeat what names they have."""
    if len(w.start) < 2:
        return np.zeros(total)
    beside = title[:-1] & title[1:] & (w.start[1:] - w.stop[:-1] == 1) & ((w.trait[w.stop[:-1]] & (SPACE | PARTS)) == SPACE)
    entry = np.concatenate([[0], np.cumsum((w.trait & PARTS) > 0)])[w.start]
    head = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
    size = np.diff(np.append(head, len(entry)))
    pairs = np.add.reduceat(np.append(beside, False).astype(np.int32), head)
    picked = np.flatnonzero((pairs > 0) & (size >= 2) & (size <= 8))
    if not len(picked):
        return np.zeros(total)
    what = np.add.reduceat(w.hash, head)[picked]
    at = where[head[picked]]
    key = (at.astype(np.uint64) << np.uint64(46)) | (what >> np.uint64(18))
    _, one = np.unique(key, return_index=True)
    return np.bincount(at[one], size[picked][one], total)
