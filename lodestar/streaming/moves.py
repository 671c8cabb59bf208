"""The state machine of threads over a stream of requested moves, with the state that Spark keeps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.integrity import problem_of

#: What a move is answered with: problem is null for one that was made.
ANSWER = "id string, seq long, from_status string, to_status string, reason string, problem string, n_moves long"

#: The state store that states of several kinds need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Machine(StatefulProcessor):
    """A thread's status and the moves that were made (seq, to_status), by id; a thread that isn't known is open."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string")
        self.made = handle.getListState("made", "seq long, to_status string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.status.update((initialState["status"].iloc[0],))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        moves = pd.concat(list(rows)).sort_values(["seq", "to_status"], kind="stable")
        now = self.status.get()[0] if self.status.exists() else "open"
        n, new, out = sum(1 for _ in self.made.get()), [], []
        for m in moves.itertuples():
            sources = 0 if pd.isna(m.n_sources) else int(m.n_sources)
            reason = None if pd.isna(m.reason) else m.reason
            problem = problem_of(now, m.to_status, reason, sources)
            if problem is None:
                n += 1
                new.append((int(m.seq), m.to_status))
            out.append((key[0], int(m.seq), now, m.to_status, reason, problem, n))
            now = m.to_status if problem is None else now
        self.status.update((now,))
        if new:
            self.made.appendList(new)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")])

    def close(self) -> None:
        pass


def run_machine(moves: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Answers to a stream of moves (id, seq, to_status, reason, n_sources); initial: (id, status) of threads that are there.

    A thread's moves are taken in the order of batches and within one by seq. The session's state store must be that of STORE.
    """
    first = None if initial is None else initial.groupBy("id")
    return moves.groupBy("id").transformWithStateInPandas(Machine(), outputStructType=ANSWER, outputMode="Append", timeMode="None", initialState=first)
