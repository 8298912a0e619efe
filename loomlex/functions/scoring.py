"""Association scores and small arithmetic as Column expressions: no Python runs for a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: logDice of a pair that only ever occurs together.
TOP = 14.0


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def log_dice(joint, head, collocate) -> Column:
    """14 + log2 of the Dice coefficient, 0 at least; 0 where nothing is joint, an error where a frequency isn't positive."""
    j, h, c = (_c(x).cast("double") for x in (joint, head, collocate))
    bad = F.raise_error(F.lit("head and collocate frequencies must be positive")).cast("double")
    return F.when((h <= 0) | (c <= 0), bad).when(j <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.log2(2.0 * j / (h + c)) + TOP))


def log_dice_or_zero(joint, head, collocate) -> Column:
    """As ``log_dice``; 0 for a collocate whose frequency isn't known."""
    return F.when(F.coalesce(_c(collocate), F.lit(0)) <= 0, F.lit(0.0)).otherwise(log_dice(joint, head, F.greatest(_c(collocate), F.lit(1))))


def upper_bound(joint, head) -> Column:
    """The most that logDice can be: a collocate is at least as frequent as the pair."""
    return log_dice(joint, head, joint)


def relative_frequency(joint, head) -> Column:
    return F.when(_c(head) > 0, _c(joint) / _c(head)).otherwise(F.lit(0.0))


def expected(head, collocate, total) -> Column:
    return _c(head).cast("double") * _c(collocate).cast("double") / _c(total).cast("double")


def mutual_information(joint, head, collocate, total) -> Column:
    return F.log2(_c(joint).cast("double") / expected(head, collocate, total))


def t_score(joint, head, collocate, total) -> Column:
    e = expected(head, collocate, total)
    return (_c(joint).cast("double") - e) / F.sqrt(e)


def log_likelihood(joint, head, collocate, total) -> Column:
    return 2.0 * _c(joint).cast("double") * F.ln(_c(joint).cast("double") / expected(head, collocate, total))


def per_million(joint, total) -> Column:
    return _c(joint).cast("double") / _c(total).cast("double") * 1e6


def round2(x) -> Column:
    """Half up on the scaled value, which differs from decimal rounding for 1.005."""
    return F.floor(_c(x) * 100 + 0.5) / 100


def coverage(shared_by, total) -> Column:
    return F.when(_c(total) > 0, _c(shared_by) / _c(total)).otherwise(F.lit(0.0))


def sharing_category(present, seeds) -> Column:
    return F.when(_c(present) == _c(seeds), "fully_shared").when(_c(present) >= 2, "partially_shared").otherwise("specific")


def commonality(present, average) -> Column:
    return _c(present) * _c(average)


def distinctiveness(highest, present, seeds, variance) -> Column:
    return _c(highest) * (1.0 - _c(present) / _c(seeds)) + F.sqrt(_c(variance))
