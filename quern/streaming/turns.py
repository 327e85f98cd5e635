"""The history of conversations as a stream: the state of one is its last turns and its last answer.

Turns of a micro-batch are taken in the order of their numbers, those of a later one after them, so
a stream that brings each conversation's turns in order gives the rows of ``operators.conversation.history``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.functions.routing import TRIVIAL

OUTPUT = "conv_id long, turn long, text string, intent string, recent array<struct<turn:long,text:string>>, has_history boolean, last_answer string"
STATE = "recent string, seen long, answer string"


def history(turns: DataFrame, n: int = 3, idle_ms: int | None = None) -> DataFrame:
    """conv_id, turn, text, intent, recent, has_history, last_answer of streamed turns.

    The state of a conversation without turns for ``idle_ms`` is dropped (None: it is kept).
    Rows without a conv_id are one conversation.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent, seen, answer = state.get if state.exists else ("[]", 0, None)
        recent, rows = json.loads(recent), []
        for turn, text, intent in pd.concat(list(batches)).sort_values("turn")[["turn", "text", "intent"]].itertuples(index=False):
            turn = None if pd.isna(turn) else int(turn)
            rows.append((key[0], turn, text, intent, list(recent), seen > 0, answer))
            recent, seen = [*recent, {"turn": turn, "text": text}][-n:], seen + 1
            if text is not None and intent is not None and intent not in TRIVIAL:
                answer = text
        state.update((json.dumps(recent), seen, answer))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=["conv_id", "turn", "text", "intent", "recent", "has_history", "last_answer"])

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    rows = turns.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "text", "intent")
    return rows.groupBy("conv_id").applyInPandasWithState(step, OUTPUT, STATE, "append", timeout)
