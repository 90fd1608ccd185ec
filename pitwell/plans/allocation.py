"""Queries of the batch covariance and allocation operators (J04 to J09)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwell.operators import alloc
from pitwell.operators import windows as W
from pitwell.operators.storage import settled
from pitwell.plans.portfolio import held
from pitwell.plans.registry import register
from pitwell.plans.tables import Tables


def problems(t: Tables, size: int = 24) -> DataFrame:
    """Returns of the formed portfolios (factor and quantile) in windows of two years, one for every date with a whole window."""
    s = held(t).select(F.concat_ws("_", "factor_id", F.col("quantile").cast("string")).alias("asset_id"), "date", F.col("value_weighted_return").alias("ret"))
    # Nine portfolios a date, read three times: the table is written once, as all that comes before it grows with the input.
    s = settled(s, "portfolios")
    s = s.join(F.broadcast(W.session_positions(s)), "date").withColumnRenamed("session", "position")
    ends = s.select("position").distinct().filter(F.col("position") >= size)
    return alloc.windows_of(s, ends, size)


register("j04_ledoit_wolf_covariance", lambda t: alloc.covariances(problems(t)).select("problem", "assets", "shrinkage"))
register("j05_covariance_diagnostics", lambda t: alloc.covariances(problems(t)).select("problem", "condition", "rank", "min_eigenvalue"))
register("j06_allocate_batch", lambda t: alloc.allocate(problems(t), list(alloc.METHODS[:5])))
register("j07_hrp_batch", lambda t: alloc.allocate(problems(t), ["hierarchical_risk_parity"]))
register("j08_cvar_objective", lambda t: alloc.allocate(problems(t), ["minimum_cvar"]))
register("j09_black_litterman", lambda t: alloc.black_litterman(problems(t)))
