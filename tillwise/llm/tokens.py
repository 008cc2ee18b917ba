"""Token ids of whole texts with a public word-end BPE vocabulary.

The vocabulary never lets a token cross white space or go from letters to digits or signs. So a
batch of texts is cut into such parts with numpy, and only parts not met before are encoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa

from tillwise.llm.words import raw_bytes, slices, span_hashes, worker_state

#: Parts of words that a worker keeps before it starts anew.
CACHE_PARTS = 2_000_000
SMALL_PARTS = 1 << 16
# Characters whose lower case and composition need no context, and how the
# vocabulary splits lower-cased words.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
# Blanks other than the ASCII ones, and the marks of special tokens: such a text is encoded whole.
UNCOMMON = re.compile("[\x1c-\x1f\x85\xa0  -​    　﻿]|<\\|")


def byte_marks() -> dict[int, str]:
    """Code point -> the printable stand-ins of its UTF-8 bytes (the byte-level alphabet)."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    marks = {byte: chr(byte) for byte in printable}
    for byte in range(256):
        if byte not in marks:
            marks[byte] = chr(256 + len(marks) - len(printable))
    return {point: "".join(marks[b] for b in chr(point).encode()) for point in range(0x80, 0x100)}


class Encoder:
    """Ids of single texts, words and parts of words, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.marks = byte_marks()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def unit(self, unit: str) -> bytes:
        """A lower-cased part, or a word that is taken whole."""
        if not PLAIN.fullmatch(unit):
            return self.whole(unit)
        tokens = []
        for part in PARTS.findall(unit) if "'" in unit else [unit]:
            tokens += self.model.tokenize(part if part.isascii() else part.translate(self.marks))
        return pack(f"<{len(tokens)}I", *[token.id for token in tokens])


# Classes of bytes: 0 blank, 1 letter, 2 digit, 3 sign, 4 needs its whole word.
CLASSES = np.full(256, 4, np.uint8)
CLASSES[0x21:0x7F] = 3
CLASSES[[0x20, *range(0x09, 0x0E)]] = 0
CLASSES[ord("0") : ord("9") + 1] = 2
CLASSES[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = 1
CLASSES[ord("'")] = 4
# First bytes of the characters in UNCOMMON.
SUSPECT = np.zeros(256, bool)
SUSPECT[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True


class Known:
    """Hash of a part -> its ids, as sorted arrays that are looked up by the batch.

    New parts go to a small table first, which is merged into the large one when it is full.
    """

    def __init__(self) -> None:
        self.large = self.small = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def __len__(self) -> int:
        return len(self.large[0]) + len(self.small[0])

    @staticmethod
    def merged(table: tuple, more: tuple) -> tuple:
        at = np.searchsorted(table[0], more[0])
        return tuple(np.insert(held, at, new) for held, new in zip(table, more, strict=True))

    def add(self, hashes: np.ndarray, encoded: list[bytes]) -> None:
        count = np.array([len(x) // 4 for x in encoded], np.int32)
        new = np.frombuffer(b"".join(encoded), "<u4")
        if self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(self.ids), len(new)), np.uint32)])
        self.ids[self.used : self.used + len(new)] = new
        first = self.used + np.cumsum(count, dtype=np.int64) - count
        self.used += len(new)
        self.small = self.merged(self.small, (hashes, first, count))
        if len(self.small[0]) > SMALL_PARTS:
            self.large, self.small = self.merged(self.large, self.small), tuple(x[:0] for x in self.small)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each part's ids begin, how many they are, and whether the part is known."""
        first, count = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int32)
        there = np.zeros(len(hashes), bool)
        for table in (self.large, self.small):
            if len(table[0]):
                at = np.minimum(np.searchsorted(table[0], hashes), len(table[0]) - 1)
                hit = table[0][at] == hashes
                first[hit], count[hit] = table[1][at[hit]], table[2][at[hit]]
                there |= hit
        return first, count, there


def gathered(ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """ids[first[k] : first[k] + count[k]] for all k, one after the other."""
    ends = np.cumsum(count)
    steps = np.repeat(first - (ends - count), count)
    return ids[steps + np.arange(len(steps))]


def parts_of(data: np.ndarray, texts: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and first and last byte of each part; texts in ``skip`` have none.

    A word with a byte that needs its context is one part.
    """
    kinds = CLASSES[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    after = data[lead + 1]
    plain = (after != 0x97) & (after != 0xB7)
    kinds[lead[plain]] = kinds[lead[plain] + 1] = 1
    lower = data.copy()
    lower[(data >= ord("A")) & (data <= ord("Z"))] += 32
    lower[lead[(after <= 0x9E) & plain] + 1] += 32
    if skip.any():
        kinds[np.repeat(skip, np.diff(texts))] = 0
    inside = kinds > 0
    word = inside.copy()
    word[1:] &= ~inside[:-1]
    inner = texts[1:-1]
    inner = inner[inner < len(data)]
    word[inner] = inside[inner]
    cut = kinds == 2
    cut[1:] |= kinds[1:] != kinds[:-1]
    if (whole := np.flatnonzero(kinds == 4)).size:
        starts = np.flatnonzero(word)
        odd = np.zeros(len(starts) + 1, bool)
        odd[np.searchsorted(starts, whole, "right")] = True
        cut &= ~odd[np.cumsum(word)]
    begins = inside & (word | cut)
    stops = np.zeros(len(data) + 1, bool)
    stops[1:] = inside
    stops[1:-1] &= ~inside[1:] | begins[1:]
    return lower, np.flatnonzero(begins), np.flatnonzero(stops)


class BatchEncoder:
    """Ids of whole columns of texts; keeps what it has learnt about parts of words."""

    def __init__(self, path: str):
        self.words = Encoder(path)
        self.known = Known()

    def special(self, piece: pa.Array, data: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Which texts hold uncommon blanks or marks of special tokens."""
        suspect = SUSPECT[data]
        if len(data):
            suspect[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        found = np.zeros(len(piece), bool)
        for k in np.unique(np.searchsorted(texts, np.flatnonzero(suspect), "right") - 1):
            found[k] = bool(UNCOMMON.search(piece[int(k)].as_py()))
        return found

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order (a null text has none)."""
        for piece, special, first, count, places in self.pieces(column):
            flat = gathered(self.known.ids, first, count)
            for k, (a, b) in enumerate(zip(places[:-1], places[1:], strict=True)):
                yield np.frombuffer(self.words.whole(piece[k].as_py()), "<u4") if special[k] else flat[a:b]

    def counts(self, column: pa.Array) -> Iterator[int]:
        """How many ids each text has."""
        for piece, special, _, _, places in self.pieces(column):
            for k, (a, b) in enumerate(zip(places[:-1], places[1:], strict=True)):
                yield len(self.words.whole(piece[k].as_py())) // 4 if special[k] else b - a

    def pieces(self, column: pa.Array) -> Iterator[tuple]:
        """Per slice: its texts, which are special, where each part's ids are, and where each text's begin."""
        for _, piece in slices(column):
            data, texts = raw_bytes(piece)
            special = self.special(piece, data, texts)
            lower, starts, ends = parts_of(data, texts, special)
            hashes, back = np.unique(span_hashes(lower, starts, ends), return_inverse=True)
            first, count, there = self.known.find(hashes)
            if not there.all():
                if len(self.known) >= CACHE_PARTS:
                    self.known = Known()
                    there[:] = False
                example = np.zeros(len(hashes), np.int64)
                example[back] = np.arange(len(back))
                content, new = lower.tobytes(), np.flatnonzero(~there)
                spans = zip(starts[example[new]].tolist(), ends[example[new]].tolist(), strict=True)
                self.known.add(hashes[new], [self.words.unit(content[a:b].decode()) for a, b in spans])
                first, count, _ = self.known.find(hashes)
            count = count[back]
            places = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, texts)]
            yield piece, special, first[back], count, places.tolist()


def encoder(path: str) -> BatchEncoder:
    """This worker's encoder for the vocabulary file at ``path``."""
    return worker_state(f"encoder:{path}", lambda: BatchEncoder(path))
