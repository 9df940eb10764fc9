"""Boolean 10 x 10 matrices as ten row masks: bit j of mask i is the entry (i, j).

The text form is one decimal number whose bit ``10 * i + j`` is the entry (i, j).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE = 10
_MASK = (1 << SIZE) - 1


def masks_of_int(x: int) -> list[int]:
    return [(x >> (SIZE * i)) & _MASK for i in range(SIZE)]


def int_of_masks(m: Sequence[int]) -> int:
    return sum(int(v) << (SIZE * i) for i, v in enumerate(m))


def product(a: Sequence[int], b: Sequence[int]) -> list[int]:
    out = []
    for row in a:
        acc = 0
        for k in range(SIZE):
            if row >> k & 1:
                acc |= int(b[k])
        out.append(acc)
    return out


def union(a: Sequence[int], b: Sequence[int]) -> list[int]:
    return [int(x) | int(y) for x, y in zip(a, b)]


def product_batch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise matrix products of two (n, 10) mask arrays."""
    out = np.zeros_like(a)
    for k in range(SIZE):
        out |= ((a >> k) & 1) * b[:, k : k + 1]
    return out


def masks_col(text: Column) -> Column:
    """Decode the decimal text form; 100 bits fit DECIMAL(38,0), so the JVM does it exactly."""
    x = text.cast("decimal(38,0)")

    def row(i: int) -> Column:
        # remainder first: both steps stay whole numbers below 2**100
        hi, lo = F.lit(str(1 << (SIZE * (i + 1)))), F.lit(str(1 << (SIZE * i)))
        hi, lo = hi.cast("decimal(38,0)"), lo.cast("decimal(38,0)")
        part = x % hi - x % lo
        return (part.cast("decimal(31,0)") / lo.cast("decimal(31,0)")).cast("int")

    return F.when(text.isNotNull(), F.array(*[row(i) for i in range(SIZE)]))


def text_col(masks: Column) -> Column:
    """Encode row masks as the decimal text form."""
    total = F.lit(0).cast("decimal(33,0)")
    for i in range(SIZE):
        weight = F.lit(str(1 << (SIZE * i))).cast("decimal(28,0)")
        total = (total + masks[i].cast("decimal(4,0)") * weight).cast("decimal(33,0)")
    return total.cast("string")


def product_col(a: Column, b: Column) -> Column:
    def row(r: Column) -> Column:
        acc = F.lit(0)
        for k in range(SIZE):
            acc = acc.bitwiseOR(F.when(r.bitwiseAND(F.lit(1 << k)) != 0, b[k]).otherwise(F.lit(0)))
        return acc

    # the other operand stays outside the lambda: NULL if it is NULL
    return F.when(b.isNotNull(), F.transform(a, row))


def zero_col() -> Column:
    return F.array(*[F.lit(0)] * SIZE)


def union_col(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def union_agg(m: Column) -> Column:
    """Aggregate: OR of many matrices. Ten ``bit_or`` slots, so it combines before the shuffle."""
    return F.when(F.count(m) > 0, F.array(*[F.bit_or(m[i]) for i in range(SIZE)]))
