"""Chat sessions as state: every user turn is answered with the session's earlier turns at hand."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "conv_id long, turn long, prompt string, answer string, n_history int"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Session(StatefulProcessor):
    """The turns of a session as a list that is appended to: a turn writes one element, however long the session is."""

    def __init__(self, answer: Callable[[str, list[tuple[str, str]]], str], idle_ms: int | None):
        self.answer, self.idle = answer, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.turns = handle, handle.getListState("turns", "prompt string, answer string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        history = [x for prompt, said in self.turns.get() for x in (("user", prompt), ("assistant", said))]
        out = []
        for turn, text in sorted((r.turn, r.text) for batch in rows for r in batch.itertuples()):
            if text == "/clear":
                history = []
                self.turns.clear()
                continue
            said = self.answer(text, history)
            out.append((key[0], turn, text, said, len(history)))
            history = [*history, ("user", text), ("assistant", said)]
            self.turns.appendValue((text, said))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if history:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "prompt", "answer", "n_history"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.turns.clear()
        yield pd.DataFrame([], columns=["conv_id", "turn", "prompt", "answer", "n_history"])

    def close(self) -> None:
        pass


def sessions(turns: DataFrame, answer: Callable[[str, list[tuple[str, str]]], str], idle_ms: int | None = None) -> DataFrame:
    """Answers of a stream (conv_id, turn, text), in turn order within a batch.

    History holds the raw prompts and the answers; a text of "/clear" empties it and gives no row. The history of a
    session ends with ``/clear`` or, if ``idle_ms`` is given, when it has been idle for so long; then its state is freed.
    State lives in RocksDB, which this sets as the session's state store; a query that restarts from its checkpoint goes on with
    the histories that it had.
    """
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    mode = "None" if idle_ms is None else "ProcessingTime"
    return turns.groupBy("conv_id").transformWithStateInPandas(_Session(answer, idle_ms), OUTPUT, "Append", mode)
