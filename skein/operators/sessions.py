"""Session listing: activity, order, titles, selectors, presence."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNITS = {"m": 60, "h": 3600, "d": 86400, "w": 7 * 86400}


def activity_between(sessions: DataFrame, since: Column | None, until: Column | None, activity: Column) -> DataFrame:
    """Sessions with activity in the window, both ends included; those without activity go if there is a bound."""
    for bound, keep in ((since, lambda b: activity >= b), (until, lambda b: activity <= b)):
        if bound is not None:
            sessions = sessions.where(activity.isNotNull() & keep(bound))
    return sessions


def listed(sessions: DataFrame, activity: str, harness: str, identity: str) -> DataFrame:
    """Most recent first, without activity last; then by harness and id."""
    return sessions.orderBy(F.desc_nulls_last(activity), harness, identity)


def titles(records: DataFrame, session: str, order: str, kind: str, title: str) -> DataFrame:
    """(session, title): the last non-empty custom title, else the last non-empty automatic one."""

    def last(which: str) -> Column:
        return F.max_by(F.when((F.col(kind) == which) & (F.col(title) != ""), F.col(title)), F.when((F.col(kind) == which) & (F.col(title) != ""), F.col(order)))

    return records.groupBy(session).agg(F.coalesce(last("custom-title"), last("ai-title")).alias("title"))


def selected(ids: DataFrame, selector: str, column: str) -> DataFrame:
    """The ids that ``selector`` may mean: the id itself, else those that start with it, or whose part after the last ``:`` does."""
    name = F.col(column)
    exact = ids.where(name == selector)
    if not exact.isEmpty():
        return exact
    return ids.where(name.startswith(selector) | F.element_at(F.split(name, ":"), -1).startswith(selector))


def relative_time(text: str, now: datetime) -> datetime:
    """``<n>[mhdw]`` before ``now``, or an RFC 3339 time; zero and overflow are errors."""
    if m := re.fullmatch(r"(\d+)([mhdw])", text):
        seconds = int(m[1]) * _UNITS[m[2]]
        if not seconds or seconds > 9_223_372_036:
            raise ValueError(f"{text}: out of range")
        return now - timedelta(seconds=seconds)
    out = datetime.fromisoformat(text)
    if out.tzinfo is None:
        raise ValueError(f"{text}: no time zone")
    return out
