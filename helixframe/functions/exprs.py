"""Column expressions over sequences. All stay in the JVM and need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letters(seq: Column) -> Column:
    """A sequence's letters; indexing this array costs the same at every place, unlike substring()."""
    return F.filter(F.split(seq, ""), lambda c: c != "")


def kmers(chars: Column, k: int) -> Column:
    """All overlapping k-letter windows of an array of letters; none if it is shorter."""
    at = F.sequence(F.lit(1), F.size(chars) - (k - 1))
    made = F.transform(at, lambda i: F.concat(*[F.element_at(chars, i + j) for j in range(k)]))
    return F.when(F.size(chars) >= k, made).otherwise(F.array().cast("array<string>"))


def revcomp(word: Column) -> Column:
    return F.reverse(F.translate(word, "ACGT", "TGCA"))


def lookup(letter: Column, table: dict) -> Column:
    """The value of a small fixed table, null for a letter that it doesn't have. Values: numbers, strings or tuples. Single letters
    are places in a constant array; words are looked for in a constant map."""
    value = lambda v: F.array(*[F.lit(float(x)) for x in v]) if isinstance(v, (tuple, list)) else F.lit(v)
    if all(len(k) == 1 and k.isascii() for k in table):
        kind = next(iter(table.values()))
        empty = F.lit(None).cast("array<double>" if isinstance(kind, (tuple, list)) else "string" if isinstance(kind, str) else "int" if isinstance(kind, int) else "double")
        first, last = min(map(ord, table)), max(map(ord, table))
        held = F.array(*[value(table[chr(c)]) if chr(c) in table else empty for c in range(first, last + 1)])
        return F.when(F.length(letter) == 1, F.get(held, F.ascii(letter) - first))
    pairs = []
    for k, v in table.items():
        pairs += [F.lit(k), value(v)]
    return F.element_at(F.create_map(*pairs), letter)


def fixed(seq: Column, length: int, pad: str = "X") -> Column:
    """Cut to `length` letters or padded with `pad`."""
    return F.rpad(F.substring(seq, 1, length), length, pad)


def rounded(x: Column, digits: int) -> Column:
    """Rounded half up, without negative zeros."""
    return F.round(x, digits) + F.lit(0.0)
