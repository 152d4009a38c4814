"""Tool calls and results paired as they arrive, in either order.

State is one small row for each call id of a session. A pair is reported as soon as both sides are
there, and withdrawn (``valid`` false) if a second call or result with that id turns up. A stream that
runs for ever gives ``idle``: what no event has touched for so long is forgotten, as its session has ended.
A run over what is available gives none: it would wait for the timeout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "session string, call_id string, call string, result string, valid boolean"
STATE = "calls int, results int, call string, result string"


def tool_pairs(events: DataFrame, idle: int | None = None) -> DataFrame:
    """Pairs of the streaming ``events`` (session, call_id, kind, event), kind tool_call or tool_result.

    ``idle`` is in milliseconds of processing time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        calls, results, call, result = state.get if state.exists else (0, 0, None, None)
        was = calls == results == 1
        for batch in batches:
            for kind, event in zip(batch["kind"], batch["event"]):
                if kind == "tool_call":
                    calls, call = calls + 1, call or event
                else:
                    results, result = results + 1, result or event
        state.update((calls, results, call, result))
        if idle is not None:
            state.setTimeoutDuration(idle)
        now = calls == results == 1
        if now != was:
            yield pd.DataFrame([(*key, call, result, now)], columns=["session", "call_id", "call", "result", "valid"])

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    wanted = events.where("kind in ('tool_call', 'tool_result')").select("session", "call_id", "kind", "event")
    return wanted.groupBy("session", "call_id").applyInPandasWithState(step, OUTPUT, STATE, "append", timeout)
