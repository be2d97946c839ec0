"""Many 0/1 flags as the bits of a few longs, so that a grouped aggregate carries one
``bit_or`` a word instead of a conditional maximum a flag."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 60  # bits used of a long: 60 holds whole groups of 2 to 6, 10, 12, 15, 20 and 30 flags


def places(names: list[str]) -> Column:
    """Map from a name to its place in ``names``."""
    return F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])


def words(place: Column, bits: Column, n: int, width: int = 1) -> list[Column]:
    """The words of ``n`` groups of ``width`` flags with ``bits`` set in group ``place``,
    NULL where a word has none."""
    each = WORD // width
    shifted = F.call_function("shiftleft", bits.cast("long"), (place % each * width).cast("int"))
    return [F.when((place >= k) & (place < k + each), shifted) for k in range(0, n, each)]


def flag(word_names: list[str], group: int, width: int = 1, bit: int = 0) -> Column:
    """0 or 1: flag ``bit`` of a group, NULL where its word is."""
    each = WORD // width
    return F.getbit(F.col(word_names[group // each]), F.lit(group % each * width + bit)).cast("int")


def word_names(n: int, width: int = 1) -> list[str]:
    return [f"_w{k}" for k in range(-(-n // (WORD // width)))]


def pack(flags: list[str]) -> list[Column]:
    """The words of columns that are 0 or 1 (none NULL), named by ``word_names``."""
    names = word_names(len(flags))
    return [reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.col(f).cast("long"), F.lit(i)) for i, f in enumerate(
        flags[k * WORD:(k + 1) * WORD])]).alias(w) for k, w in enumerate(names)]


def unpack(flags: list[str]) -> list[Column]:
    """The columns that ``pack`` packed."""
    names = word_names(len(flags))
    return [flag(names, i).alias(f) for i, f in enumerate(flags)]
