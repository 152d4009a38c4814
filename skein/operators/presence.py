"""Which sessions running processes work on, from injected claims.

``claims`` has a row for each claim of a process, or one with a null native_id for a process without
any: harness, pid, started_at, native_id, certainty (exact or probable), exact_session, evidence
(array of strings), reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PROCESS = ["harness", "pid", "started_at"]


def _kept(claims: DataFrame, exact_only: bool) -> DataFrame:
    """In exact mode probable claims go before anything is grouped, and a process left with none goes too."""
    if not exact_only:
        return claims
    return claims.where(F.col("native_id").isNull() | (F.col("certainty") == "exact"))


def _evidence(column: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column))))


def matches(claims: DataFrame, sessions: DataFrame, exact_only: bool = False) -> DataFrame:
    """(harness, native_id, certainty, processes, candidates, selected, evidence) for each claimed session that is known.

    ``selected`` is the one session an exact claim names, else the only candidate; null if ambiguous.
    """
    asked = _kept(claims, exact_only).where("native_id is not null")
    candidates = sessions.groupBy("harness", "native_id").agg(F.array_sort(F.collect_set("session")).alias("candidates"))
    groups = asked.groupBy("harness", "native_id").agg(
        F.when(F.bool_or(F.col("certainty") == "exact"), "exact").otherwise("probable").alias("certainty"),
        F.count_distinct("pid", "started_at").alias("processes"),
        F.collect_set("exact_session").alias("named"),
        _evidence("evidence").alias("evidence"),
    )
    both = groups.join(candidates, ["harness", "native_id"])
    chosen = F.when(F.size("named") == 1, F.get("named", F.lit(0))).when((F.size("candidates") == 1), F.get("candidates", F.lit(0)))
    return both.select("harness", "native_id", "certainty", "processes", "candidates", chosen.alias("selected"), "evidence")


def unmatched(claims: DataFrame, sessions: DataFrame, exact_only: bool = False) -> DataFrame:
    """(harness, pid, started_at, claimed, reason, evidence) for each process none of whose claims is known."""
    rows = _kept(claims, exact_only)
    if exact_only:
        lost = claims.where(F.col("native_id").isNotNull()).select(*_PROCESS).distinct()
        left = rows.where(F.col("native_id").isNotNull()).select(*_PROCESS).distinct()
        rows = rows.join(lost.join(left, _PROCESS, "left_anti"), _PROCESS, "left_anti")
    known = sessions.select("harness", "native_id").distinct()
    hit = rows.join(known, ["harness", "native_id"], "left_semi").select(*_PROCESS).distinct()
    claimed = F.array_sort(F.collect_set("native_id"))
    reason = F.coalesce(F.max("reason"), F.when(F.size(claimed) > 0, "unmatched_native_identity").otherwise("no_session_identity"))
    return rows.join(hit, _PROCESS, "left_anti").groupBy(*_PROCESS).agg(claimed.alias("claimed"), reason.alias("reason"), _evidence("evidence").alias("evidence"))
