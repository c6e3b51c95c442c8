"""Gram generators: of literals on the driver, of documents as column expressions or in Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of text grams; a character's code is its place.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 \n"
CODE = np.full(256, -1, np.int64)
CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(64)
#: Bytes that one gram is made of.
SPAN = {"gram3": 3, "text4": 4, "hash4": 4, "wide8": 8}
LETTER, OTHER = "[A-Za-z0-9 \\n]", "[^A-Za-z0-9 \\n]"


def _windows(codes: np.ndarray) -> np.ndarray:
    """The text grams of codes, where -1 breaks them."""
    if len(codes) < 4:
        return np.zeros(0, np.int64)
    good = codes >= 0
    at = np.flatnonzero(good[:-3] & good[1:-2] & good[2:-1] & good[3:])
    return codes[at] << 18 | codes[at + 1] << 12 | codes[at + 2] << 6 | codes[at + 3]


def _wide(b: np.ndarray, realign: bool) -> np.ndarray:
    """The text grams of runs of (character, NUL) pairs.

    Where pairs begin depends on what comes before: a character is taken with the byte after it, any other byte alone.
    So within a run of characters every second one begins a pair, and a run's start always does: a NUL is no character,
    and so is what ends the run before, unless that run's last character took it along.
    """
    n = len(b)
    if n < 8:
        return b[:0]
    text = CODE[b] >= 0
    if realign:
        begins = np.zeros(n, bool)
        begins[:-1] = text[:-1] & (b[1:] == 0)
    else:
        # a byte is taken along if the one before it is a character that begins something; runs of characters alternate
        place = np.arange(n)
        first = text.copy()
        first[1:] &= ~text[:-1]
        start = np.maximum.accumulate(np.where(first, place, 0))
        begins = text & ((place - start) % 2 == 0)
        begins[:-1] &= b[1:] == 0
        begins[-1] = False
    # four pairs in a row
    at = np.flatnonzero(begins[: n - 7] & begins[2 : n - 5] & begins[4 : n - 3] & begins[6 : n - 1])
    c = CODE[b]
    return c[at] << 18 | c[at + 2] << 12 | c[at + 4] << 6 | c[at + 6]


def grams_of(data: bytes, kind: str, realign: bool = False) -> np.ndarray:
    """The sorted distinct gram ids of some bytes.

    wide8 pairs a character with the NUL after it and takes a character before another byte together with that byte, so
    a wide text that follows a lone character is missed; ``realign`` takes that character alone instead.
    """
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    if kind == "gram3":
        found = b[:-2] << 16 | b[1:-1] << 8 | b[2:] if len(b) > 2 else b[:0]
    elif kind == "hash4":
        found = ((b[:-3] ^ b[1:-2]) << 16 | (b[1:-2] ^ b[2:-1]) << 8 | (b[2:-1] ^ b[3:])) if len(b) > 3 else b[:0]
    elif kind == "text4":
        found = _windows(CODE[b])
    elif kind == "wide8":
        found = _wide(b, realign)
    else:
        raise ValueError(f"no index type {kind!r}")
    return np.unique(found).astype(np.int32)


def gram_at(kind: str, window: bytes) -> int | None:
    """The gram id of exactly SPAN[kind] bytes, or None where the generator gives none."""
    found = grams_of(window, kind)
    return int(found[0]) if len(found) else None


def latin(content: Column) -> Column:
    """One character per byte."""
    return F.decode(content, "ISO-8859-1")


def _slide(chars: Column, count: int, combine) -> Column:
    """Distinct combinations of ``count`` neighbours of an array."""
    n = F.size(chars)
    slid = F.transform(F.sequence(F.lit(1), n - count + 1), lambda i: combine(*[F.element_at(chars, (i + k).cast("int")) for k in range(count)]))
    return F.when(n >= count, F.array_distinct(slid)).otherwise(F.array().cast("array<int>"))


def _codes(text: Column) -> Column:
    return F.transform(F.split(text, ""), F.ascii)


def gram_column(content: Column, kind: str) -> Column:
    """array<int> of the distinct gram ids of a binary column, by JVM functions only; null content gives null."""
    if kind == "gram3":
        grams = _slide(_codes(latin(content)), 3, lambda a, b, c: a * 65536 + b * 256 + c)
    elif kind == "hash4":
        grams = _slide(_codes(latin(content)), 4, lambda a, b, c, d: a.bitwiseXOR(b) * 65536 + b.bitwiseXOR(c) * 256 + c.bitwiseXOR(d))
    else:
        if kind == "text4":
            runs = F.regexp_extract_all(latin(content), F.lit(f"({LETTER}{{4,}})"), F.lit(1))
        elif kind == "wide8":
            pattern = f"((?:{LETTER}\\x00)+)|{LETTER}[^\\x00]|{OTHER}"
            wide = F.filter(F.regexp_extract_all(latin(content), F.lit(pattern), F.lit(1)), lambda r: F.length(r) >= 8)
            runs = F.transform(wide, lambda r: F.translate(r, "\0", ""))
        else:
            raise ValueError(f"no index type {kind!r}")
        code = lambda c: F.locate(c, F.lit(ALPHABET)) - 1
        pack = lambda a, b, c, d: a * 262144 + b * 4096 + c * 64 + d
        each = lambda r: _slide(F.transform(F.split(r, ""), _place), 4, pack)
        grams = F.array_distinct(F.flatten(F.transform(runs, each)))
    return F.when(content.isNotNull(), grams)


def _place(c: Column) -> Column:
    """A character's code from its number: letters, digits, blank and line break in the alphabet's order."""
    n = F.ascii(c)
    return F.when(n.between(65, 90), n - 65).when(n.between(97, 122), n - 71).when(n.between(48, 57), n + 4).when(n == 32, 62).otherwise(63)
