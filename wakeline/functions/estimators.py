"""Two-sample (Chapman) abundance estimate and its interval as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The z used for parity (0.025 quantile of a normal with mean
# 0.975) and the two-sided 95 % z of the standard normal.
Z_REFERENCE = -0.9849639845400538
Z_NORMAL95 = -1.9599639845400538


def chapman(n1: Column, n2: Column, m2: Column) -> Column:
    return (n1 + 1.0) * (n2 + 1.0) / (m2 + 1.0) - 1.0


def chapman_interval(n1: Column, n2: Column, m2: Column, ci: str = "reference"):
    """(lower, upper) limits, untruncated.

    ``reference`` keeps the published scripts' arithmetic: its z, an ungrouped
    ``1/m2 + 0.5`` and an upper limit that mirrors the lower one.
    ``normal95`` uses ±1.96 and the grouped terms.
    """
    only2, only1, both = n2 - m2 + 0.5, n1 - m2 + 0.5, m2 + 0.5
    spread = 1.0 / only2 + 1.0 / only1 + both / (only1 * only2)
    floor_ = n1 + n2 - m2 - 0.5
    unseen = only2 * only1 / both
    if ci == "reference":
        # 1/m2 grows without bound as m2 -> 0, where exp(z*s) -> 0
        s = F.sqrt(F.try_divide(F.lit(1.0), m2) + 0.5 + spread)
        low = floor_ + unseen * F.coalesce(F.exp(F.lit(Z_REFERENCE) * s), F.lit(0.0))
        estimate = chapman(n1, n2, m2)
        return low, estimate + (estimate - low)
    if ci == "normal95":
        s = F.sqrt(1.0 / both + spread)
        return (
            floor_ + unseen * F.exp(F.lit(Z_NORMAL95) * s),
            floor_ + unseen * F.exp(F.lit(-Z_NORMAL95) * s),
        )
    raise ValueError(f"ci must be 'reference' or 'normal95', not {ci!r}")
