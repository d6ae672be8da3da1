"""Seeded draws as columns.

The generator's state is the seed plus a multiple of a constant, so each draw follows from its number
alone and no task waits for another.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import let

#: Fixed value: what a state adds to the one before.
STEP = 0x6D2B79F5
_WORD = 1 << 32


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of 32-bit numbers, without leaving 64 bits."""
    low, high = b.bitwiseAND(F.lit(0xFFFF)), F.shiftright(b, 16)
    return (a * low + a * high % 65536 * 65536) % _WORD


def draw(seed: Column, n: Column) -> Column:
    """Draw ``n`` (from 0) of the 32-bit sequence of ``seed``, from 0 to below 1."""
    xor = lambda t, bits: t.bitwiseXOR(F.shiftright(t, bits))
    state = F.pmod(seed.cast("long") + _times(F.pmod(n.cast("long") + 1, F.lit(_WORD)), F.lit(STEP).cast("long")), F.lit(_WORD))

    def last(t: Column) -> Column:
        return let(((t + _times(xor(t, 7), t.bitwiseOR(F.lit(61).cast("long")))) % _WORD).bitwiseXOR(t), lambda u: xor(u, 14).cast("double") / float(_WORD))

    return let(state, lambda a: let(_times(xor(a, 15), a.bitwiseOR(F.lit(1).cast("long"))), last))


#: Odd multiplier of a round of ``permuted``.
_ROUND = 2654435761


def permuted(ids: Column, seed: int, bits: int, rounds: int = 4) -> Column:
    """A seeded permutation of the numbers below 2 ** ``bits`` (even, at most 60), as a column.

    Halves of the number are mixed in turn, which can be undone, so different ids stay different: the
    order of an epoch is a sort key, and no list of ids is shuffled anywhere.
    """
    half = bits // 2
    mask = F.lit((1 << half) - 1).cast("long")

    def mixed(left: Column, right: Column, n: int) -> Column:
        if n == rounds:
            return left * (1 << half) + right
        key = (seed + 1) * (n + 1) * 0x9E3779B1 % _WORD
        turned = left.bitwiseXOR(F.shiftright((right * _ROUND + key) % _WORD, 32 - min(half, 31)).bitwiseAND(mask))
        return let(turned, lambda t: mixed(right, t, n + 1))

    x = ids.cast("long")
    return mixed(F.shiftright(x, half).bitwiseAND(mask), x.bitwiseAND(mask), 0)


def permuted_sql(ids: str, seed: int, bits: int, rounds: int = 4) -> str:
    """The same in SQL, as a query of ``id`` and ``place`` over a relation ``ids`` with the column ``id``."""
    half = bits // 2
    mask = (1 << half) - 1
    out = f"select id, ((id >> {half}) & {mask})::bigint as a, (id & {mask})::bigint as b from {ids}"
    for n in range(rounds):
        key = (seed + 1) * (n + 1) * 0x9E3779B1 % _WORD
        out = f"select id, b as a, xor(a, (((b * {_ROUND} + {key}) % {_WORD}) >> {32 - min(half, 31)}) & {mask})::bigint as b from ({out})"
    return f"select id, (a * {1 << half} + b)::bigint as place from ({out})"
