"""Forecast scores as columns; ensembles may have any number of members."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stormframe.functions.values import INF, at_least, ratio

# Fixed values.
DEFAULT_THRESHOLD = 35.0
BIN_COUNT = 10
BINS_TYPE = "array<struct<lower:double,count:bigint,observed:bigint,mean_prob:double>>"


def pod(hits: Column, misses: Column) -> Column:
    return ratio(hits, hits + misses)


def far(hits: Column, false_alarms: Column) -> Column:
    return ratio(false_alarms, hits + false_alarms)


def csi(hits: Column, misses: Column, false_alarms: Column) -> Column:
    return ratio(hits, hits + misses + false_alarms)


def bin_edges(n_bins: int = BIN_COUNT) -> tuple[float, ...]:
    """Lower edges of ``n_bins`` even bins: ``i * (1 / n)`` in floating point.

    The fourth of ten is 0.30000000000000004, so 0.3 falls in bin 2 and
    ``floor(p * 10)`` would be wrong (likewise for 0.6 and 0.7).
    """
    step = 1.0 / n_bins
    return tuple(i * step for i in range(n_bins))


def probability_bin(p: Column, n_bins: int = BIN_COUNT) -> Column:
    """Bin index: lower edge inclusive, 1.0 in the top bin."""
    out = F.lit(0)
    for i, edge in enumerate(bin_edges(n_bins)):
        if i:
            out = F.when(p >= F.lit(edge), F.lit(i)).otherwise(out)
    return out


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)


def members_complete(members: Column) -> Column:
    """Every member is finite; an array without members is not complete."""
    return (F.size(members) > 0) & F.forall(members, lambda m: F.coalesce(F.abs(m) < F.lit(INF), F.lit(False)))


def member_mean(members: Column) -> Column:
    """Mean over the members that are not NaN; null when none is.

    The sum runs over the present members only, so an infinite member stays infinite.
    """
    # NaN and null both fail the comparison; infinity passes it.
    present = F.filter(members, lambda m: F.abs(m) <= F.lit(INF))
    return ratio(_total(F.transform(present, lambda m: m.cast("double"))), F.size(present))


def exceedance_probability(members: Column, threshold: Column | float) -> Column:
    """Share of members at or above the threshold."""
    return ratio(F.size(F.filter(members, lambda m: at_least(m, threshold))), F.size(members))


def fair_crps(sorted_members: Column, observed: Column) -> Column:
    """Fair ensemble CRPS of one cell from its *sorted* members; one member gives |x - y|."""
    size = F.size(sorted_members).cast("double")
    error = _total(F.transform(sorted_members, lambda m: F.abs(m.cast("double") - observed))) / size
    weighted = _total(F.transform(sorted_members, lambda m, k: (F.lit(2.0) * (k + 1) - size - F.lit(1.0)) * m.cast("double")))
    return error - F.when(size < 2, F.lit(0.0)).otherwise(F.try_divide(weighted, size * (size - 1)))
