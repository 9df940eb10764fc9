"""Tree algebras: what a bottom-up fold computes.

For node values of type ``value_type`` and results of type ``result_type``::

    fold(leaf a)        = hom(a)
    fold(node a kids)   = plus(a, mult(fold(kid 1), ..., fold(kid n)))
    fold(forest roots)  = mult of the root results

``mult`` must be associative. Whether a node has children is always a flag, never a comparison with
a unit value, so no unit is needed.

An algebra can state up to four forms of itself, and each strategy uses the one it needs:

* scalar Python functions: required, used for chunk jobs of user algebras;
* :class:`ColumnForm`: Spark expressions, so that folds stay in the JVM;
* :class:`AffineForm`: a node with one missing child as the function ``x -> k (+) p (*) x``, closed under
  composition; needed to contract chains of a deep tree in parallel, and only for commutative ``mult``;
* ``batch``: numpy operations over whole Arrow batches for chunk jobs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import matrix

#: Node values of ``sum_product`` stay below this, where DOUBLE is exact; any other value is OVERFLOW.
EXACT_LIMIT = 1 << 53
OVERFLOW = -(1 << 63)


@dataclass(frozen=True)
class ColumnForm:
    hom: Callable[[Column], Column]
    plus: Callable[[Column, Column], Column]
    mult: Callable[[Column, Column], Column]
    #: aggregate over children with map-side combine; None if ``mult`` is not commutative
    agg: Callable[[Column], Column] | None


@dataclass(frozen=True)
class AffineForm:
    """Contexts are ``struct<k: result_type, p>``."""

    p_type: T.DataType
    #: node value, known children product (NULL if there is none) -> (k, p)
    of_node: Callable[[Column, Column], tuple[Column, Column]]
    #: (k, p) of the upper and of the lower context -> (k, p)
    compose: Callable[[Column, Column, Column, Column], tuple[Column, Column]]
    apply: Callable[[Column, Column, Column], Column]
    #: scalar form of ``apply``
    apply_value: Callable[[Any, Any, Any], Any]


@dataclass(frozen=True)
class WrapForm:
    """``plus(a, s) = mult(mult(open(a), s), close(a))``: a tree is one ordered product over its brackets.

    For algebras whose ``mult`` is only associative: such a product is formed in ranges, at any height.
    """

    leaf: Callable[[Column], Column]
    open: Callable[[Column], Column]
    close: Callable[[Column], Column]


class BatchForm:
    """Numpy form over aligned arrays of values; node values and results share one dtype."""

    def decode(self, tokens: pa.Array) -> np.ndarray:
        """Token texts (closes are NULL) to a value per token."""
        coded = tokens.dictionary_encode()
        values = self._parse(coded.dictionary)
        codes = coded.indices.fill_null(0).to_numpy(zero_copy_only=False)
        if len(values) == 0:
            return self._parse(pa.array(["0"]))[np.zeros(len(codes), dtype=np.int64)]
        return values[codes]

    def _parse(self, texts: pa.Array) -> np.ndarray:
        return pc.cast(texts, pa.int64()).to_numpy(zero_copy_only=False)

    def from_arrow(self, values: pa.Array) -> np.ndarray:
        return values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)

    def to_arrow(self, values: np.ndarray, valid: np.ndarray) -> pa.Array:
        return pa.array(values.astype(np.int64, copy=False), mask=~valid)

    def scalars(self, values: np.ndarray) -> list:
        """Values for the scalar functions."""
        return values.astype(np.int64).tolist()

    def hom(self, a: np.ndarray) -> np.ndarray:
        return a

    def plus(self, a: np.ndarray, s: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def mult_runs(self, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """``mult`` over consecutive runs that begin at ``starts``."""
        raise NotImplementedError

    def apply(self, k: pa.Array, p: pa.Array, x: np.ndarray) -> np.ndarray:
        """Contexts ``k, p`` of the affine form, applied to one value each."""
        raise NotImplementedError

    #: whether contexts can be formed and composed in numpy; the methods below are needed only then
    composes = False

    def knows(self, k: pa.Array, p: pa.Array) -> np.ndarray:
        """Contexts that the numpy form takes."""
        return np.zeros(len(k), bool)

    def contexts(self, k: pa.Array, p: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.from_arrow(k), self.from_arrow(p)

    def context_arrays(self, k: np.ndarray, p: np.ndarray, valid: np.ndarray) -> tuple[pa.Array, pa.Array]:
        return self.to_arrow(k, valid), self.to_arrow(p, valid)

    def of_node(self, a: np.ndarray, s: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New arrays ``(k, p)``; ``s`` counts where ``has``."""
        raise NotImplementedError

    def compose(self, ku: np.ndarray, pu: np.ndarray, kl: np.ndarray, pl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def through(self, k: np.ndarray, p: np.ndarray, x: np.ndarray) -> np.ndarray:
        """``apply`` to contexts in numpy."""
        raise NotImplementedError


@dataclass(frozen=True)
class TreeAlgebra:
    name: str
    value_type: T.DataType
    result_type: T.DataType
    hom: Callable[[Any], Any]
    plus: Callable[[Any, Any], Any]
    mult: Callable[[Any, Any], Any]
    commutative: bool = False
    parse: Callable[[str], Any] = int
    parse_col: Callable[[Column], Column] = lambda text: text.cast("bigint")
    format_col: Callable[[Column], Column] = lambda value: value.cast("string")
    column: ColumnForm | None = None
    affine: AffineForm | None = None
    batch: BatchForm | None = None
    wrap: WrapForm | None = None
    #: result of a whole tree -> answer; may raise for results that stand for an error
    answer: Callable[[Column], Column] = lambda value: value

    def need_column(self, what: str) -> ColumnForm:
        if self.column is None:
            raise ValueError(f"{what} needs the column form of algebra {self.name!r}; use fold_chunks")
        return self.column

    def need_affine(self, what: str) -> AffineForm:
        if not (self.affine and self.commutative and self.column and self.column.agg):
            raise ValueError(
                f"{what} needs a commutative algebra with column and affine forms, which {self.name!r} is not;"
                " use fold_levels or fold_chunks"
            )
        return self.affine

    def need_wrap(self, what: str) -> WrapForm:
        if self.wrap is None:
            raise ValueError(f"{what} needs the wrap form of algebra {self.name!r}")
        return self.wrap

    def node_value(self, a: Column, s: Column, has: Column) -> Column:
        """Value of a node whose children multiply to ``s``; a leaf if ``has`` is false."""
        form = self.need_column("node_value")
        return F.when(has, form.plus(a, s)).otherwise(form.hom(a))


# ---- largest root-to-leaf sum -------------------------------------------------------------------


class _MaxPathBatch(BatchForm):
    def plus(self, a, s):
        out = a + s
        if (((a ^ out) & (s ^ out)) < 0).any():
            raise OverflowError("max_path_sum left the BIGINT range")
        return out

    def mult_runs(self, values, starts):
        return np.maximum.reduceat(values, starts)

    def apply(self, k, p, x):
        return np.maximum(k.fill_null(-(1 << 63)).to_numpy(), self.plus(p.to_numpy(), x))

    # a context without a finished child has no k, here the least number
    _NO_K = -(1 << 63)
    composes = True

    def knows(self, k, p):
        return p.is_valid().to_numpy(zero_copy_only=False)

    def contexts(self, k, p):
        return k.fill_null(self._NO_K).to_numpy().copy(), p.fill_null(0).to_numpy().copy()

    def context_arrays(self, k, p, valid):
        return self.to_arrow(k, valid & (k != self._NO_K)), self.to_arrow(p, valid)

    def of_node(self, a, s, has):
        k = np.full(len(a), self._NO_K)
        k[has] = self.plus(a[has], s[has])
        return k, a.copy()

    def compose(self, ku, pu, kl, pl):
        k, known = ku.copy(), kl != self._NO_K
        k[known] = np.maximum(ku[known], self.plus(pu[known], kl[known]))
        return k, self.plus(pu, pl)

    def through(self, k, p, x):
        return np.maximum(k, self.plus(p, x))


max_path_sum = TreeAlgebra(
    name="max_path_sum",
    value_type=T.LongType(),
    result_type=T.LongType(),
    hom=lambda a: a,
    plus=lambda a, s: a + s,
    mult=max,
    commutative=True,
    column=ColumnForm(hom=lambda a: a, plus=lambda a, s: a + s, mult=F.greatest, agg=F.max),
    affine=AffineForm(
        p_type=T.LongType(),
        of_node=lambda a, s: (a + s, a),
        compose=lambda ku, pu, kl, pl: (F.greatest(ku, pu + kl), pu + pl),
        apply=lambda k, p, x: F.greatest(k, p + x),
        apply_value=lambda k, p, x: p + x if k is None else max(k, p + x),
    ),
    batch=_MaxPathBatch(),
)


# ---- value + product of the children ------------------------------------------------------------


#
# One rule for all forms: a node whose value or whose children's product leaves the exact range has the value
# OVERFLOW. A product with a zero factor is 0, also beside an OVERFLOW; everything else with OVERFLOW is OVERFLOW.
# So partial products may be formed in any order, and only the answer of a tree raises.


def _within(x: int) -> int:
    return x if -EXACT_LIMIT < x < EXACT_LIMIT else OVERFLOW


def _sum_value(a: int, s: int) -> int:
    return OVERFLOW if OVERFLOW in (_within(a), s) else _within(a + s)


def _product_value(x: int, y: int) -> int:
    if x == 0 or y == 0:
        return 0
    return OVERFLOW if OVERFLOW in (x, y) else _within(x * y)


_TOP = EXACT_LIMIT - 1


def _over() -> Column:
    return F.lit(OVERFLOW).cast("bigint")


def _out(x: Column) -> Column:
    return x.isNull() | (x <= -EXACT_LIMIT) | (x >= EXACT_LIMIT)


def _guard(x: Column) -> Column:
    """BIGINT, NULL if the operation left its range."""
    return F.when(_out(x), _over()).otherwise(x)


def _sum_column(a: Column, s: Column) -> Column:
    return F.when(_out(a) | (s == _over()), _over()).otherwise(_guard(F.try_add(a, s)))


def _product_column(x: Column, y: Column) -> Column:
    zero, over = (x == 0) | (y == 0), (x == _over()) | (y == _over())
    return F.when(zero, F.lit(0).cast("bigint")).when(over, _over()).otherwise(_guard(F.try_multiply(x, y)))


def _product_agg(v: Column) -> Column:
    """Product with map-side combine.

    Partial products of non-zero whole numbers never exceed the final one, so DOUBLE partials are exact
    whenever the result is in range. Zeros are taken out first.
    """
    nonzero = F.product(F.when(v != 0, v.cast("double")))
    over = F.abs(nonzero) >= F.lit(float(EXACT_LIMIT))
    return F.when(F.bool_or(v == 0), F.lit(0).cast("bigint")).when(over, _over()).otherwise(nonzero.cast("bigint"))


# A context is the function of a missing child's value: ``k + p (x - lo)`` for x in ``lo..hi``, where every value
# inside the context is in range, and OVERFLOW elsewhere; with ``any`` it is ``k`` for every x, since a zero sibling
# hides it. Anchored at ``lo``, all numbers stay below 2 * EXACT_LIMIT however many nodes are composed.


def _context(k: Column, lo: Column, hi: Column, p: Column, any_: Column) -> tuple[Column, Column]:
    fields = [c.cast("bigint").alias(n) for c, n in ((lo, "lo"), (hi, "hi"), (p, "p"))]
    return k, F.struct(*fields, any_.alias("any"))


def _pick(cases: list[tuple[Column, tuple[Column, Column]]], default: tuple[Column, Column]) -> tuple[Column, Column]:
    """First case whose condition holds, for both parts of a context."""
    k, p = default
    for condition, (ck, cp) in reversed(cases):
        k, p = F.when(condition, ck).otherwise(k), F.when(condition, cp).otherwise(p)
    return k, p


def _never() -> tuple[Column, Column]:
    return _context(_over(), F.lit(1), F.lit(0), F.lit(0), F.lit(False))


def _product_context(a: Column, s: Column) -> tuple[Column, Column]:
    s = F.coalesce(s, F.lit(1).cast("bigint"))
    by = F.abs(F.when((s == 0) | (s == _over()), F.lit(1).cast("bigint")).otherwise(s))
    # room of s * x below and above zero: the product itself and its sum with a must be in range
    down, up = _TOP + F.least(a, F.lit(0)), _TOP - F.greatest(a, F.lit(0))
    low = F.when(s > 0, -_div(down, by)).otherwise(-_div(up, by))
    high = F.when(s > 0, _div(up, by)).otherwise(_div(down, by))
    return _pick(
        [
            (_out(a), _never()),
            (s == 0, _context(a, F.lit(0), F.lit(0), F.lit(0), F.lit(True))),
            (s == _over(), _context(a, F.lit(0), F.lit(0), F.lit(0), F.lit(False))),
        ],
        _context(a + s * low, low, high, s, F.lit(False)),
    )


def _div(x: Column, y: Column) -> Column:
    """Whole quotient of a non-negative number by a positive one; exact, unlike DOUBLE division."""
    return F.call_function("div", x, y)


def _at(k: Column, p: Column, x: Column) -> Column:
    return F.try_add(k, F.try_multiply(p["p"], F.try_subtract(x, p["lo"])))


def _compose_product(ku: Column, pu: Column, kl: Column, pl: Column) -> tuple[Column, Column]:
    fits = (kl >= pu["lo"]) & (kl <= pu["hi"])
    top = _at(ku, pu, kl)
    # steps t from pl.lo for which the lower value kl + pl.p * t lies within the upper context
    rate = F.greatest(F.abs(pl["p"]), F.lit(1))
    rising = pl["p"] > 0
    ahead = F.when(rising, F.try_subtract(pu["lo"], kl)).otherwise(F.try_subtract(kl, pu["hi"]))
    room = F.when(rising, F.try_subtract(pu["hi"], kl)).otherwise(F.try_subtract(kl, pu["lo"]))
    first = F.when(ahead > 0, _div(ahead + rate - 1, rate)).otherwise(F.lit(0).cast("bigint"))
    last = F.when(room < 0, F.lit(-1).cast("bigint")).otherwise(F.least(_div(room, rate), pl["hi"] - pl["lo"]))
    value = F.try_add(kl, F.try_multiply(pl["p"], first))
    both = F.when(first < last, F.try_multiply(pu["p"], pl["p"])).otherwise(F.lit(0))
    flat = (pl["p"] == 0) | (pl["lo"] == pl["hi"])
    return _pick(
        [
            (pu["any"], (ku, pu)),
            (~pl["any"] & (pl["lo"] > pl["hi"]) | (pu["lo"] > pu["hi"]), _never()),
            ((pl["any"] | flat) & ~fits, _never()),
            (pl["any"] | flat, _context(top, pl["lo"], pl["hi"], F.lit(0), pl["any"])),
            (first > last, _never()),
        ],
        _context(_at(ku, pu, value), F.try_add(pl["lo"], first), F.try_add(pl["lo"], last), both, F.lit(False)),
    )


def _apply_product(k: Column, p: Column, x: Column) -> Column:
    outside = (x < p["lo"]) | (x > p["hi"])
    return F.when(p["any"], k).when(outside, _over()).otherwise(_at(k, p, x))


def _apply_product_value(k: int, p: dict, x: int) -> int:
    if p["any"]:
        return k
    return k + p["p"] * (x - p["lo"]) if p["lo"] <= x <= p["hi"] else OVERFLOW


class _SumProductBatch(BatchForm):
    """Values are DOUBLE; infinity stands for OVERFLOW."""

    @staticmethod
    def _guard(x: np.ndarray) -> np.ndarray:
        return np.where(np.abs(x) < EXACT_LIMIT, x, np.inf)

    def _parse(self, texts):
        return self._guard(super()._parse(texts).astype(np.float64))

    def from_arrow(self, values):
        return self._guard(super().from_arrow(values).astype(np.float64))

    @staticmethod
    def _whole(values: np.ndarray) -> np.ndarray:
        fine = np.isfinite(values)
        return np.where(fine, np.where(fine, values, 0).astype(np.int64), OVERFLOW)

    def to_arrow(self, values, valid):
        return super().to_arrow(self._whole(values), valid)

    def scalars(self, values):
        return self._whole(values).tolist()

    def plus(self, a, s):
        return self._guard(a + s)

    def mult_runs(self, values, starts):
        zero = np.add.reduceat((values == 0).astype(np.int64), starts) > 0
        with np.errstate(over="ignore"):
            out = np.multiply.reduceat(np.where(values == 0, 1.0, values), starts)
        return np.where(zero, 0.0, self._guard(out))

    def apply(self, k, p, x):
        lo, hi, by = (p.field(f).to_numpy() for f in ("lo", "hi", "p"))
        k, known, whole = k.to_numpy(), p.field("any").to_numpy(zero_copy_only=False), self._whole(x)
        inside = np.isfinite(x) & (whole >= lo) & (whole <= hi)
        out = np.where(inside, k + by * np.where(inside, whole - lo, 0), OVERFLOW)
        return self._guard(np.where(known, k, out).astype(np.float64))


sum_product = TreeAlgebra(
    name="sum_product",
    value_type=T.LongType(),
    result_type=T.LongType(),
    hom=_within,
    plus=_sum_value,
    mult=_product_value,
    commutative=True,
    column=ColumnForm(hom=_guard, plus=_sum_column, mult=_product_column, agg=_product_agg),
    affine=AffineForm(
        p_type=T.StructType(
            [*[T.StructField(n, T.LongType()) for n in ("lo", "hi", "p")], T.StructField("any", T.BooleanType())]
        ),
        of_node=_product_context,
        compose=_compose_product,
        apply=_apply_product,
        apply_value=_apply_product_value,
    ),
    batch=_SumProductBatch(),
    answer=lambda v: F.when(v == _over(), F.raise_error("sum_product left the exact range of 2**53")).otherwise(v),
)


# ---- OR over root-to-leaf paths of boolean matrix products --------------------------------------


class _AutomatonBatch(BatchForm):
    def _parse(self, texts):
        rows = [matrix.masks_of_int(int(t)) for t in texts.to_pylist()]
        return np.array(rows, dtype=np.int32).reshape(len(rows), matrix.SIZE)

    def from_arrow(self, values):
        n = len(values)
        out = np.zeros((n, matrix.SIZE), dtype=np.int32)
        out[values.is_valid().to_numpy(zero_copy_only=False)] = (
            values.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, matrix.SIZE)
        )
        return out

    def to_arrow(self, values, valid):
        # a NULL list is a NULL offset; it must cover no elements
        sizes = np.where(valid, matrix.SIZE, 0)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        mask = np.concatenate([~valid, [False]])
        flat = pa.array(values[valid].reshape(-1).astype(np.int32, copy=False))
        return pa.ListArray.from_arrays(pa.array(offsets, mask=mask), flat)

    def plus(self, a, s):
        return matrix.product_batch(a, s)

    def mult_runs(self, values, starts):
        return np.bitwise_or.reduceat(values, starts, axis=0)

    def apply(self, k, p, x):
        return self.through(self.from_arrow(k), self.from_arrow(p), x)

    composes = True

    def knows(self, k, p):
        return k.is_valid().to_numpy(zero_copy_only=False) & p.is_valid().to_numpy(zero_copy_only=False)

    def of_node(self, a, s, has):
        return matrix.product_batch(a, np.where(has[:, None], s, 0)), a.copy()

    def compose(self, ku, pu, kl, pl):
        return ku | matrix.product_batch(pu, kl), matrix.product_batch(pu, pl)

    def through(self, k, p, x):
        return k | matrix.product_batch(p, x)


path_automaton = TreeAlgebra(
    name="path_automaton",
    value_type=T.ArrayType(T.IntegerType()),
    result_type=T.ArrayType(T.IntegerType()),
    hom=lambda a: a,
    plus=matrix.product,
    mult=matrix.union,
    commutative=True,
    parse=lambda text: matrix.masks_of_int(int(text)),
    parse_col=matrix.masks_col,
    format_col=matrix.text_col,
    column=ColumnForm(
        hom=lambda a: a, plus=matrix.product_col, mult=matrix.union_col, agg=matrix.union_agg
    ),
    affine=AffineForm(
        p_type=T.ArrayType(T.IntegerType()),
        of_node=lambda a, s: (F.coalesce(matrix.product_col(a, s), matrix.zero_col()), a),
        compose=lambda ku, pu, kl, pl: (matrix.union_col(ku, matrix.product_col(pu, kl)), matrix.product_col(pu, pl)),
        apply=lambda k, p, x: matrix.union_col(k, matrix.product_col(p, x)),
        apply_value=lambda k, p, x: matrix.union(k, matrix.product(p, x)),
    ),
    batch=_AutomatonBatch(),
)

# ---- sum of all values --------------------------------------------------------------------------


class _ValueSumBatch(BatchForm):
    def plus(self, a, s):
        out = a + s
        if (((a ^ out) & (s ^ out)) < 0).any():
            raise OverflowError("value_sum left the BIGINT range")
        return out

    def mult_runs(self, values, starts):
        out = np.add.reduceat(values, starts)
        with np.errstate(over="ignore"):
            rough = np.add.reduceat(values.astype(np.float64), starts)
        if (np.abs(rough - out.astype(np.float64)) > 2.0**62).any():  # a wrapped sum is off by 2**64
            raise OverflowError("value_sum left the BIGINT range")
        return out

    def apply(self, k, p, x):
        return self.plus(k.to_numpy(), x)

    # p is NULL in every context
    composes = True

    def knows(self, k, p):
        return k.is_valid().to_numpy(zero_copy_only=False)

    def contexts(self, k, p):
        return k.fill_null(0).to_numpy().copy(), np.zeros(len(k), np.int64)

    def context_arrays(self, k, p, valid):
        return self.to_arrow(k, valid), self.to_arrow(p, np.zeros(len(p), bool))

    def of_node(self, a, s, has):
        return self.plus(a, np.where(has, s, 0)), np.zeros(len(a), np.int64)

    def compose(self, ku, pu, kl, pl):
        return self.plus(ku, kl), pu

    def through(self, k, p, x):
        return self.plus(k, x)


value_sum = TreeAlgebra(
    name="value_sum",
    value_type=T.LongType(),
    result_type=T.LongType(),
    hom=lambda a: a,
    plus=lambda a, s: a + s,
    mult=lambda x, y: x + y,
    commutative=True,
    column=ColumnForm(hom=lambda a: a, plus=lambda a, s: a + s, mult=lambda x, y: x + y, agg=F.sum),
    affine=AffineForm(
        p_type=T.LongType(),
        of_node=lambda a, s: (a + F.coalesce(s, F.lit(0)), F.lit(None).cast("bigint")),
        compose=lambda ku, pu, kl, pl: (ku + kl, pu),
        apply=lambda k, p, x: k + x,
        apply_value=lambda k, p, x: k + x,
    ),
    batch=_ValueSumBatch(),
)

ALGEBRAS = {a.name: a for a in (max_path_sum, sum_product, path_automaton)}
