"""PO01: the retrieval-policy hook."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Policy = Callable[[DataFrame], DataFrame]


def apply_policy(chunks: DataFrame, policy: Policy | None = None) -> DataFrame:
    """`chunks` through a policy, with whether and why (not) it applied; by default nothing changes."""
    if policy is None:
        return chunks.withColumns({"policy_applied": F.lit(False), "policy_reason": F.lit("policy_disabled")})
    return policy(chunks).withColumns({"policy_applied": F.lit(True), "policy_reason": F.lit("policy_applied")})


def valid_result(chunks: DataFrame) -> DataFrame:
    """PJ12: whether every row of a policy's result has content."""
    return chunks.agg((F.count_if(F.col("content").isNull()) == 0).alias("valid"), F.count(F.lit(1)).alias("n"))
