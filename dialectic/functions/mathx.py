"""Numeric column helpers (stable forms of the scoring maths)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softplus(x: Column | str) -> Column:
    """``ln(1 + e^x)`` without overflow: ``max(x, 0) + ln(1 + e^-|x|)``."""
    x = _c(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def neg_log_sigmoid(x: Column | str) -> Column:
    """``-ln(sigmoid(x))`` = ``softplus(-x)``, stable for large ``|x|``."""
    return softplus(-_c(x))


def nan_to_zero(x: Column | str) -> Column:
    """NaN and NULL -> 0.0 (``nan_to_num(nan=0.0)``)."""
    x = _c(x)
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def safe_div(num: Column | str, den: Column | str) -> Column:
    """``num / den`` or NULL when ``den`` is 0 or NULL."""
    num, den = _c(num), _c(den)
    return F.when(den != 0, num / den)


def r6(x: Column | str) -> Column:
    """Round to 6 decimals (output hygiene for cross-engine checks)."""
    return F.round(_c(x), 6)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a lambda
    variable. Catalyst does not share sub-expressions across lambda
    boundaries, so an outer expression used inside ``transform`` would be
    recomputed for every element without this binding."""
    return F.element_at(F.transform(F.array(value), body), 1)


def array_softmax(logits: Column | str) -> Column:
    """Softmax of an array of logits (max-shifted), elements as DOUBLE.
    Linear in the array length."""
    return let(_c(logits).cast("array<double>"), lambda a:
               let(F.array_max(a), lambda m:
                   let(F.transform(a, lambda v: F.exp(v - m)), lambda e:
                       let(F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v), lambda s:
                           F.transform(e, lambda v: v / s)))))


def array_argmax(values: Column | str) -> Column:
    """0-based index of the first maximum of an array (NULL for empty)."""
    return let(_c(values), lambda a: (F.array_position(a, F.array_max(a)) - 1).cast("long"))


def array_logsumexp(logits: Column | str) -> Column:
    """``ln(sum(exp(x)))`` over an array, max-shifted, linear in length."""
    return let(_c(logits).cast("array<double>"), lambda a:
               let(F.array_max(a), lambda m:
                   m + F.log(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + F.exp(v - m)))))


def left_pad_array(a: Column | str, length: int, value) -> Column:
    """Left-pad an array with ``value`` up to ``length``; longer arrays unchanged."""
    a = _c(a)
    n = F.greatest(F.lit(length) - F.size(a), F.lit(0))
    return F.concat(F.array_repeat(F.lit(value), n), a)
