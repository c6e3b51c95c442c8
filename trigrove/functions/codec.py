"""Posting runs as bytes, and whole indexes as binary files, for exchange with other tools."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Fixed values of the file format.
MAGIC, FORMAT, GRAMS = 0xCA7DA7A, 6, 1 << 24


def encode_run(ids: Iterable[int]) -> bytes:
    """Ascending ids as gaps less one, each in groups of seven bits, lowest first, all but the last marked by the high bit."""
    out, last = bytearray(), -1
    for k in ids:
        gap, last = k - last - 1, k
        if gap < 0:
            raise ValueError("ids must ascend")
        while gap > 0x7F:
            out.append(gap & 0x7F | 0x80)
            gap >>= 7
        out.append(gap)
    return bytes(out)


def decode_run(data: bytes) -> list[int]:
    out, last, gap, shift = [], -1, 0, 0
    for b in data:
        gap |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            last += gap + 1
            out.append(last)
            gap = shift = 0
    return out


def export_index(number: int, runs: Iterable[tuple[int, list[int]]]) -> bytes:
    """An index file of (gram, ascending ids): header, runs by gram, and the offset of each of all possible grams."""
    header = b"".join(x.to_bytes(4, "little") for x in (MAGIC, FORMAT, number, 0))
    sizes, body = np.zeros(GRAMS, np.uint64), []
    for gram, ids in sorted(runs):
        body.append(encode_run(ids))
        sizes[gram] = len(body[-1])
    offsets = np.concatenate([[np.uint64(0)], np.cumsum(sizes, dtype=np.uint64)]) + np.uint64(len(header))
    return header + b"".join(body) + offsets.astype("<u8").tobytes()


def import_index(data: bytes) -> tuple[int, dict[int, list[int]]]:
    """(index number, ids by gram) of an index file."""
    head = [int.from_bytes(data[k : k + 4], "little") for k in (0, 4, 8)]
    if head[:2] != [MAGIC, FORMAT]:
        raise ValueError("no index of a known format")
    offsets = np.frombuffer(data[-8 * (GRAMS + 1) :], "<u8")
    used = np.flatnonzero(offsets[1:] > offsets[:-1])
    return head[2], {int(g): decode_run(data[int(offsets[g]) : int(offsets[g + 1])]) for g in used}
