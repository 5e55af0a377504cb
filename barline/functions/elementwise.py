"""Row-wise building blocks. Missing is always null: no NaN and no infinity leaves a function."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_WINDOW = 2520  # fixed value: longest window any rolling function accepts


def as_column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def number(x) -> Column:
    """Column as double; a condition counts as 1.0 / 0.0."""
    return as_column(x).cast("double")


def finite(x) -> Column:
    """Infinity and NaN become null. ``nullif`` evaluates its argument once, so nesting is cheap."""
    out = number(x)
    for bad in (float("inf"), float("-inf"), float("nan")):
        out = F.nullif(out, F.lit(bad))
    return out


def div(a, b) -> Column:
    """a / b, null where the denominator is zero or the quotient overflows."""
    return finite(F.try_divide(number(a), number(b)))


def window_size(n, lo: int = 1, hi: int = MAX_WINDOW) -> int:
    """Check a window length; negative lengths would look ahead."""
    if isinstance(n, (bool, str, Column)) or not isinstance(n, (int, float)):
        raise ValueError(f"window must be a number, got {n!r}")
    if not math.isfinite(n):
        raise ValueError("window is not finite")
    size = int(round(n))
    if not lo <= size <= hi:
        raise ValueError(f"window {size} outside [{lo}, {hi}]")
    return size


# -- arithmetic -------------------------------------------------------------
def add(a, b) -> Column:
    return finite(number(a) + number(b))


def sub(a, b) -> Column:
    return finite(number(a) - number(b))


def mul(a, b) -> Column:
    return finite(number(a) * number(b))


def power(a, b) -> Column:
    return finite(F.pow(number(a), number(b)))


def neg(x) -> Column:
    return -number(x)


def absolute(x) -> Column:
    return F.abs(number(x))


def sign(x) -> Column:
    return F.signum(number(x))


def log(x) -> Column:
    """Natural logarithm; null for x <= 0."""
    return finite(F.ln(number(x)))


def sqrt(x) -> Column:
    return F.when(number(x) >= 0, F.sqrt(number(x)))


def larger(a, b) -> Column:
    """Element-wise maximum that ignores a missing side."""
    return F.greatest(number(a), number(b))


def smaller(a, b) -> Column:
    """Element-wise minimum that ignores a missing side."""
    return F.least(number(a), number(b))


def clip(x, lo, hi) -> Column:
    x = number(x)
    return F.when(x.isNotNull(), F.greatest(F.least(x, number(hi)), number(lo)))


def is_missing(x) -> Column:
    return as_column(x).isNull()


def fill_missing(x, value) -> Column:
    return F.coalesce(number(x), number(value))


# -- comparison and logic ------------------------------------------------------
# A comparison with a missing side is false; "not equal" with a missing side is true.
def lt(a, b) -> Column:
    return F.coalesce(as_column(a) < as_column(b), F.lit(False))


def le(a, b) -> Column:
    return F.coalesce(as_column(a) <= as_column(b), F.lit(False))


def gt(a, b) -> Column:
    return F.coalesce(as_column(a) > as_column(b), F.lit(False))


def ge(a, b) -> Column:
    return F.coalesce(as_column(a) >= as_column(b), F.lit(False))


def eq(a, b) -> Column:
    return F.coalesce(as_column(a) == as_column(b), F.lit(False))


def ne(a, b) -> Column:
    return F.coalesce(as_column(a) != as_column(b), F.lit(True))


def truth(x) -> Column:
    """Truth of any operand: null is false, a non-zero number is true."""
    return F.coalesce(as_column(x).cast("boolean"), F.lit(False))


def both(*conds) -> Column:
    out = truth(conds[0])
    for c in conds[1:]:
        out = out & truth(c)
    return out


def either(*conds) -> Column:
    out = truth(conds[0])
    for c in conds[1:]:
        out = out | truth(c)
    return out


def negate(cond) -> Column:
    return ~truth(cond)


def choose(cond, a, b) -> Column:
    """a where cond holds, else b; an undefined condition takes b."""
    return F.when(truth(cond), number(a)).otherwise(number(b))


# -- outputs -------------------------------------------------------------------
def score(x, mask="mask") -> Column:
    """Final form of a signal: double, finite, null outside the universe."""
    return F.when(F.col(mask), finite(x))


def condition(cond, mask="mask") -> Column:
    """Final form of a rule: false outside the universe and where undefined."""
    return truth(cond) & F.col(mask)
