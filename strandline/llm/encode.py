"""Encoding of a corpus with a public byte-level BPE vocabulary, and the way back.

A streaming transducer turns text into token ids. It holds back only what later text could still change:

* The split into pieces looks ahead three characters at most (a quote that may become a contraction), so a piece is stable
  once that many characters follow it, and so is all text before a single blank between two non-blanks. Stable stretches
  are encoded at once, by the compiled merge loop of a public library.
* A piece that outgrows the block is encoded byte by byte. Of every prefix the last token is unique: the one that ends there
  and is compatible with the last token of what is before it. Any longer text continues from a prefix that ends within the
  longest token's length of the end; tokens on which all of those agree are stable and are emitted.

Memory is constant but for the ids themselves. Decoding runs an incremental byte-to-text state machine over the tokens.
"""

from __future__ import annotations

import base64
import codecs
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Splits text into pieces before the merges, as the vocabulary's makers fixed it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters past a piece's end after which its split can't change: the longest contraction of the pattern has three.
PIECE_LOOKAHEAD = 3
#: Characters taken at once from a text.
BLOCK = 256
#: Tokens of one batch that is handed back.
OUT_TOKENS = 1_000_000

_CUT = re.compile(r"\S (?=\S)")


def default_vocabulary() -> str:
    """Where the public vocabulary byte_bpe_50k is installed here; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Vocabulary:
    """Ranks of a byte-level BPE, read from a rank file; one for each process and path."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pieces = regex.compile(pattern)
        self.tokens = {i: t for t, i in self.ranks.items()}
        #: Bytes of the longest token: no longer text can continue from further back than this.
        self.longest = max(map(len, self.ranks))
        self._ends: dict | None = None
        self._fits: dict[tuple[int, int], bool] = {}
        self._wholes: dict[int, bool] = {}

    @property
    def ends(self) -> dict:
        """Tokens by their bytes from the last to the first, as a trie; -1 marks a token's id."""
        if self._ends is None:
            self._ends = {}
            for t, i in self.ranks.items():
                node = self._ends
                for byte in reversed(t):
                    node = node.setdefault(byte, {})
                node[-1] = i
        return self._ends

    @property
    def lookahead(self) -> int:
        """Bytes after which a token can't change any more but by what all longer texts agree on: found from the merge list, it is
        the length of its longest token. A token that ends later begins after the end of one that ends this far back or earlier."""
        return self.longest

    def whole(self, t: int) -> bool:
        """Whether the merges make the bytes of a token into that token; some entries of a list can't be reached."""
        known = self._wholes.get(t)
        if known is None:
            known = self._wholes[t] = self.core._encode_single_piece(self.tokens[t]) == [t]
        return known

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave the tokens a and b, one after the other, as they are."""
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) > 500_000:
                self._fits.clear()
            known = self._fits[a, b] = self.core._encode_single_piece(self.tokens[a] + self.tokens[b]) == [a, b]
        return known


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str = PATTERN) -> Vocabulary:
    return Vocabulary(path, pattern)


class PieceStream:
    """Encodes one piece of any length, byte by byte, emitting tokens once they are stable."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.tail = b""  # bytes that tokens may still reach back to
        self.last: list[int] = []  # of each prefix that ends in the tail: its last token, or -1
        self.done = 0  # bytes before the tail, all of which are emitted

    def feed(self, data: bytes) -> list[int]:
        v = self.v
        self.tail += data
        tail, last = self.tail, self.last
        for end in range(len(last) + 1, len(tail) + 1):
            node, at, found = v.ends, end - 1, -1
            while at >= 0:
                node = node.get(tail[at])
                if node is None:
                    break
                t = node.get(-1)
                if t is not None:
                    before = at
                    if before == 0:
                        ok = self.done == 0 or v.fits(self.carry, t)
                    else:
                        ok = last[before - 1] >= 0 and v.fits(last[before - 1], t)
                    if ok and v.whole(t):
                        found = t
                        break
                at -= 1
            last.append(found)
        return self._emit() if len(tail) >= 4 * v.lookahead else []

    def _chain(self, end: int) -> list[int]:
        """Ends of the tokens of the prefix, from the last to the first."""
        ends = []
        while end > 0:
            ends.append(end)
            end -= len(self.v.tokens[self.last[end - 1]])
        return ends

    def _emit(self) -> list[int]:
        n = len(self.tail)
        common: set[int] | None = None
        for end in range(max(1, n - self.v.lookahead + 1), n + 1):
            if self.last[end - 1] >= 0:
                chain = set(self._chain(end))
                common = chain if common is None else common & chain
        stable = max(common, default=0) if common else 0
        if stable >= n or not stable:
            return []
        return self._out(stable)

    def _out(self, stable: int) -> list[int]:
        ids = [self.last[e - 1] for e in reversed(self._chain(stable))]
        self.carry = ids[-1]
        self.tail, self.last, self.done = self.tail[stable:], self.last[stable:], self.done + stable
        return ids

    def finish(self) -> list[int]:
        ids = self._out(len(self.tail)) if self.tail else []
        self.__init__(self.v)
        return ids


class Encoder:
    """Text in parts of any size to ids: ``feed`` gives what is stable, ``finish`` the rest."""

    def __init__(self, v: Vocabulary, block: int = BLOCK):
        self.v, self.block, self.held, self.least = v, block, "", block
        self.stream: PieceStream | None = None

    def feed(self, text: str) -> list[int]:
        ids: list[int] = []
        for at in range(0, len(text), self.block):
            self.held += text[at : at + self.block]
            if len(self.held) >= self.least:
                ids += self._advance()
                self.least = max(self.block, 2 * len(self.held))  # what can't be cut yet isn't read again for every block
        return ids

    def _advance(self) -> list[int]:
        held = self.held
        if self.stream is None:
            cut = -1
            for m in _CUT.finditer(held, max(0, len(held) - 256)):
                cut = m.start() + 1
            if cut > 0:
                self.held = held[cut:]
                return self.v.core.encode_ordinary(held[:cut])
        ids: list[int] = []
        begin = 0
        for m in self.v.pieces.finditer(held):
            if m.end() > len(held) - PIECE_LOOKAHEAD:
                break
            if self.stream is not None:
                ids += self.stream.feed(m[0].encode())
                ids += self.stream.finish()
                self.stream = None
            else:
                ids += self.v.core._encode_single_piece(m[0].encode())
            begin = m.end()
        held = held[begin:]
        if len(held) > self.block // 2:
            held, more = self._outgrown(held)
            ids += more
        self.held = held
        return ids

    def _outgrown(self, held: str) -> tuple[str, list[int]]:
        """Bytes of a piece that goes on past the block; its last characters stay, and so does its kind."""
        keep = PIECE_LOOKAHEAD + 1
        # a run of white space is a piece but for its last character, which is among those kept
        head, rest = held[:-keep], held[-keep:]
        m = self.v.pieces.match(head)
        if m.end() < len(head):
            return held, []
        if self.stream is None:
            self.stream = PieceStream(self.v)
        # what follows is split as a continuation: the leading character shows the kind again
        return rest, self.stream.feed(head.encode())

    def finish(self) -> list[int]:
        ids = self._advance() if len(self.held) >= self.block else []
        if self.stream is not None:
            m = self.v.pieces.match(self.held) if self.held else None
            if m:
                ids += self.stream.feed(m[0].encode())
                self.held = self.held[m.end() :]
            ids += self.stream.finish()
            self.stream = None
        ids += self.v.core.encode_ordinary(self.held)
        self.held, self.least = "", self.block
        return ids


def encode(v: Vocabulary, text: str | None, block: int = BLOCK) -> list[int]:
    """Ids of a text; an empty list for null and empty ones."""
    if not text:
        return []
    e = Encoder(v, block)
    return e.feed(text) + e.finish()


def decode(v: Vocabulary, ids: Iterable[int]) -> Iterator[str]:
    """Text of ids, token by token: bytes go through an incremental machine that holds back unfinished characters."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for i in ids:
        if part := machine.decode(v.tokens[i]):
            yield part
    if part := machine.decode(b"", True):
        yield part


def _lists(parts: list[list[int]]) -> pa.ListArray:
    sizes = np.fromiter(map(len, parts), np.int32, len(parts))
    flat = np.fromiter((i for p in parts for i in p), np.int32, int(sizes.sum()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def _encoder(path: str, block: int, mode: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            keys, parts, tokens, begin = b.column(0), [], 0, 0
            for n, text in enumerate(b.column(1)):
                text = text.as_py()
                ids = encode(v, text, block)
                if mode == "ids":
                    parts.append(ids)
                    tokens += len(ids)
                elif mode == "count":
                    parts.append(len(ids))
                else:
                    parts.append((len(ids), "".join(decode(v, ids)) == (text or "")))
                if tokens >= OUT_TOKENS or n == b.num_rows - 1:
                    k = keys.slice(begin, n + 1 - begin)
                    if mode == "ids":
                        yield pa.RecordBatch.from_arrays([k, _lists(parts)], ["key", "ids"])
                    elif mode == "count":
                        yield pa.RecordBatch.from_arrays([k, pa.array(parts, pa.int32())], ["key", "n_tokens"])
                    else:
                        yield pa.RecordBatch.from_arrays([k, pa.array([x for x, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.bool_())], ["key", "n_tokens", "same"])
                    parts, tokens, begin = [], 0, n + 1

    return run


_OUT = {"ids": "ids array<int>", "count": "n_tokens int", "check": "n_tokens int, same boolean"}


def encoded(df: DataFrame, key: str, text: str, *, vocabulary_path: str | None = None, mode: str = "ids", block: int = BLOCK) -> DataFrame:
    """Each row's key with the ids of its text (mode ids), their number (count), or number and round trip (check).

    Special tokens play no role: their strings are ordinary text. Null and empty texts get an empty list. Every row gives
    one, repeated rows each their own; an empty table gives none; other columns aren't read.
    """
    path = vocabulary_path or default_vocabulary()
    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(_encoder(path, block, mode), f"key {kind}, {_OUT[mode]}").withColumnRenamed("key", key)
