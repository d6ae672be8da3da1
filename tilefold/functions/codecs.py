"""Byte-stream codecs whose greedy or optimal choices depend on all bytes before.

They work on one stream each; ``encode_column`` runs them over a column, so streams run in
parallel. The run-length and repeat-packet codecs also exist as relations in
``operators.streams``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW, LONGEST = 0xFFFF, 64
ZX0_WINDOW = 32640


def rle_gbdk(data: bytes) -> bytes:
    """Runs of 3 to 127 as (256 - n, value), other bytes in blocks of up to 127 behind their number; 0 ends."""
    out, literal = bytearray(), bytearray()

    def flush() -> None:
        for i in range(0, len(literal), 127):
            out.append(len(literal[i : i + 127]))
            out.extend(literal[i : i + 127])
        literal.clear()

    for value, group in groupby(data):
        n = sum(1 for _ in group)
        while n:
            part = min(n, 127)
            if part > 2:
                flush()
                out.extend((256 - part, value))
            else:
                literal.extend([value] * part)
            n -= part
    flush()
    return bytes(out) + b"\0"


def rle_nes(data: bytes) -> bytes:
    """A tag, literals, and (value, tag, n - 1) for runs of 3 to 255; (tag, 0) ends.

    The tag is the smallest unused byte, else the least used one; its own literals are runs of one.
    """
    counts = [data.count(bytes([v])) for v in range(256)]
    tag = min(range(256), key=lambda v: (counts[v], v))
    out = bytearray([tag])
    for value, group in groupby(data):
        n = sum(1 for _ in group)
        while n:
            part = min(n, 255)
            one = [value, 1] if value == tag else [value]
            out.extend(one * part if part < 3 else [*one, tag, part - 1])
            n -= part
    return bytes(out) + bytes([tag, 0])


def repeat_packets(data: bytes, distance: int) -> bytes:
    """A control byte for each eight bytes; its bits say which equal the byte ``distance`` before."""
    full = bytearray(data)
    if distance == 2 and len(full) % 2:
        full.append(full[-2] if len(full) > 1 else 0)
    while len(full) % 8:
        full.append(full[-distance])
    padded, out = bytes(distance) + bytes(full), bytearray()
    for at in range(0, len(full), 8):
        same = [padded[at + i] == full[at + i] for i in range(8)]
        out.append(sum(128 >> i for i in range(8) if same[i]))
        out.extend(full[at + i] for i in range(8) if not same[i])
    return bytes(out)


def lz_gb(data: bytes) -> bytes:
    """Byte runs, big-endian word runs, copies of what came before, and literals; 0 ends.

    A word at the very end of the data does not start or go on a word run.
    """
    n, out, at, pending = len(data), bytearray(), 0, 0

    def word(i: int) -> bytes | None:
        return data[i : i + 2] if i + 2 < n else None

    def byte_run(i: int) -> int:
        stop = next((j for j in range(i, min(n, i + LONGEST)) if data[j] != data[i]), min(n, i + LONGEST))
        return stop - i

    def word_run(i: int) -> int:
        first, count = word(i), 0
        while first is not None and count < LONGEST and word(i + 2 * count) == first:
            count += 1
        return count

    def copy(i: int) -> tuple[int, int]:
        """Longest earlier string that ends before i, the farthest of equals: (length, distance)."""
        best, where = 0, 0
        lowest = max(0, i - WINDOW)
        while best < LONGEST and i + best < n:
            found = data.find(data[i : i + best + 1], lowest, i)
            if found < 0:
                break
            best, where = best + 1, found
        return best, i - where

    def flush() -> None:
        nonlocal pending
        if pending:
            out.append(0xC0 | pending - 1)
            out.extend(data[at - pending : at])
            pending = 0

    while at < n:
        run, words, (length, distance) = byte_run(at), word_run(at), copy(at)
        if run > 2 and run > max(words, length):
            flush()
            out.extend((run - 1, data[at]))
            at += run
        elif words > 2 and 2 * words > length:
            flush()
            out.extend((0x40 | words - 1, *data[at : at + 2]))
            at += 2 * words
        elif length > 3:
            flush()
            out.append(0x80 | length - 1)
            out.extend((0x10000 - distance).to_bytes(2, "little"))
            at += length
        else:
            if pending == LONGEST:
                flush()
            pending += 1
            at += 1
    flush()
    return bytes(out) + b"\0"


def un_lz_gb(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while data[at]:  # a byte run is never of one, so 0 is the end
        kind, n = data[at] >> 6, (data[at] & 63) + 1
        if kind == 0:
            out.extend(data[at + 1 : at + 2] * n)
        elif kind == 1:
            out.extend(data[at + 1 : at + 3] * n)
        elif kind == 2:
            back = 0x10000 - int.from_bytes(data[at + 1 : at + 3], "little")
            for _ in range(n):
                out.append(out[-back])
        else:
            out.extend(data[at + 1 : at + 1 + n])
        at += {0: 2, 1: 3, 2: 3, 3: 1 + n}[kind]
    return bytes(out)


def _gamma_bits(value: int) -> int:
    return 2 * value.bit_length() - 1


class _Bits:
    """ZX0's interleaved bits and bytes; after an offset's low byte the next bit goes into that byte."""

    def __init__(self) -> None:
        self.out, self.place, self.mask, self.borrow = bytearray(), 0, 0, True

    def bit(self, value: int) -> None:
        if self.borrow:
            self.borrow = False
            if value and self.out:
                self.out[-1] |= 1
            return
        if not self.mask:
            self.mask, self.place = 128, len(self.out)
            self.out.append(0)
        if value:
            self.out[self.place] |= self.mask
        self.mask >>= 1

    def gamma(self, value: int, invert: bool = False) -> None:
        for shift in range(value.bit_length() - 2, -1, -1):
            self.bit(0)
            self.bit((value >> shift & 1) ^ invert)
        self.bit(1)


def _gamma_table(n: int) -> np.ndarray:
    """Bits of the numbers up to n (0 has none)."""
    value = np.arange(n + 2)
    return np.where(value > 0, 2 * np.floor(np.log2(np.maximum(value, 1))).astype(np.int64) + 1, 0)


#: A step of a parse: kind, where it ends, its offset, its length, and the step before it.
_Step = tuple


def zx0_steps(data: bytes, window: int = ZX0_WINDOW) -> tuple[int, list[tuple[str, int, int, int]]]:
    """The fewest bits of a ZX0 stream without its end mark, and its steps (kind, start, offset, length).

    A shortest path over bytes done, last offset, and whether literals came last. What follows an end
    matters in three ways only, which bounds the states that are kept:

    - A copy from a new offset goes on from the cheapest state of a place.
    - Literals go on from the cheapest copy that ends at a place, unless their last offset is used again.
    - It is used again only where a stretch that repeats at this offset begins, and after literals that began
      where an earlier such stretch ended: else the copy could be one byte longer, which costs less than a
      literal. So for each offset the ends of its stretches are kept, without those that another one beats for good.

    Time grows with the square of the bytes; memory with the bytes and the offsets in use.
    """
    n = len(data)
    gamma, values = _gamma_table(n), np.frombuffer(data, np.uint8)
    reach = min(max(n - 1, 1), window)
    price = 8 + _gamma_table(window // 128 + 1)[(np.arange(reach + 1) - 1) // 128 + 1]
    far = np.int64(1 << 60)
    cheapest, copied = np.full(n + 1, far), np.full(n + 1, far)  # any state, and copies alone
    any_step: list[_Step | None] = [None] * (n + 1)
    copy_step: list[_Step | None] = [None] * (n + 1)
    copied[0], copy_step[0] = -1, ("start", 0, 1, 0, None)  # the first literals have no mark
    since, again, now = np.zeros(reach + 1, np.int64), np.full(reach + 1, far), np.full(reach + 1, far)
    running = np.zeros(reach + 1, bool)
    again_step: dict[int, _Step] = {}
    ends: dict[int, list[tuple[int, int, _Step]]] = {1: [(0, -1, copy_step[0])]}
    places = [np.zeros(0, np.int64)] * 256
    filled = [0] * 256

    def copy_of(offset: int, end: int) -> _Step:
        """The step of the cheapest copy at ``offset`` that ends there (its cost is ``now[offset]``)."""
        if again[offset] + 1 + gamma[end - since[offset]] == now[offset]:
            return ("again", end, offset, end - int(since[offset]), again_step[offset])
        starts = np.arange(since[offset], end - 1)
        at = int(starts[np.argmin(cheapest[starts] + gamma[end - starts - 1])])
        return ("copy", end, offset, end - at, any_step[at])

    for end in range(1, n + 1):
        k, byte = end - 1, data[end - 1]
        active = k - places[byte][: filled[byte]]
        active = active[active <= reach]
        on = np.zeros(reach + 1, bool)
        on[active] = True
        for offset in np.flatnonzero(running & ~on):
            if now[offset] < far:
                cost, kept = int(now[offset]), ends.setdefault(int(offset), [])
                kept[:] = [e for e in kept if e[1] + 8 * (k - e[0]) < cost]
                kept.append((k, cost, copy_of(int(offset), k)))
        for offset in np.flatnonzero(on & ~running):
            since[offset], again[offset] = k, far
            for start, cost, step in ends.get(int(offset), ()):
                value = cost + 1 + gamma[k - start] + 8 * (k - start)
                if start < k and value < again[offset]:
                    again[offset], again_step[int(offset)] = value, ("literal", k, 0, k - start, step)
        running = on
        if len(active):
            lowest = int(since[active].min())
            fresh = np.full(end - lowest + 1, far)
            if end - 1 > lowest:
                starts = np.arange(lowest, end - 1)
                fresh[: len(starts)] = np.minimum.accumulate((cheapest[starts] + gamma[end - starts - 1])[::-1])[::-1]
            now[active] = np.minimum(again[active] + 1 + gamma[end - since[active]], fresh[since[active] - lowest] + price[active])
            best = int(active[np.argmin(now[active])])
            if now[best] < far:
                copied[end], copy_step[end] = now[best], copy_of(best, end)
        starts = np.arange(end)
        literal = copied[starts] + 1 + gamma[end - starts] + 8 * (end - starts)
        at = int(np.argmin(literal))
        if literal[at] < copied[end]:
            cheapest[end], any_step[end] = literal[at], ("literal", end, 0, end - at, copy_step[at])
        else:
            cheapest[end], any_step[end] = copied[end], copy_step[end]
        if filled[byte] == len(places[byte]):
            places[byte] = np.concatenate([places[byte], np.zeros(max(8, filled[byte]), np.int64)])
        places[byte][filled[byte]] = k
        filled[byte] += 1
    steps, step = [], any_step[n]
    while step is not None and step[0] != "start":
        kind, end, offset, length, step = step
        steps.append((kind, end - length, offset, length))
    return int(cheapest[n]), steps[::-1]


def zx0(data: bytes) -> bytes:
    """The shortest ZX0 (v2) stream."""
    if not data:
        raise ValueError("there is nothing to compress")
    bits = _Bits()
    for kind, before, offset, length in zx0_steps(data)[1]:
        if kind == "literal":
            bits.bit(0)
            bits.gamma(length)
            bits.out.extend(data[before : before + length])
        elif kind == "again":
            bits.bit(0)
            bits.gamma(length)
        else:
            bits.bit(1)
            bits.gamma((offset - 1) // 128 + 1, invert=True)
            bits.out.append((127 - (offset - 1) % 128) << 1)
            bits.borrow = True
            bits.gamma(length - 1)
    bits.bit(1)
    bits.gamma(256, invert=True)
    return bytes(bits.out)


def un_zx0(data: bytes) -> bytes:
    """Reads a ZX0 (v2) stream."""
    out, at, mask, place, lent = bytearray(), 0, 0, 0, None

    def bit() -> int:
        nonlocal at, mask, place, lent
        if lent is not None:
            value, lent = lent, None
            return value
        if not mask:
            mask, place, at = 128, at, at + 1
        value = 1 if data[place] & mask else 0
        mask >>= 1
        return value

    def gamma(invert: bool = False) -> int:
        value = 1
        while not bit():
            value = value << 1 | bit() ^ invert
        return value

    offset, first, after_copy = 1, True, False
    while True:
        new = 0 if first else bit()
        first_literal, first = first, False
        if not new and (first_literal or after_copy):
            n = gamma()
            out.extend(data[at : at + n])
            at += n
            after_copy = False
            continue
        if not new:
            n = gamma()
        else:
            high = gamma(True)
            if high == 256:
                return bytes(out)
            low = data[at]
            at += 1
            offset, lent = high * 128 - (low >> 1), low & 1
            n = gamma() + 1
        for _ in range(n):
            out.append(out[-offset])
        after_copy = True


CODECS: dict[str, Callable[[bytes], bytes]] = {
    "rle": rle_gbdk,
    "rle_nes": rle_nes,
    "gb": lz_gb,
    "zx0": zx0,
    "pb8": lambda x: repeat_packets(x, 1),
    "pb16": lambda x: repeat_packets(x, 2),
}


def encode_column(column: Column, codec: str) -> Column:
    """A binary column encoded row by row (null stays null)."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if x is None else CODECS[codec](bytes(x)))

    return run(column)
