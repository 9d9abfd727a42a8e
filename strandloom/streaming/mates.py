"""A stateful mate buffer over a stream of reads."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "chr string, qname string, first_ord bigint, second_ord bigint"
STATE = "waiting bigint, until bigint"


def pair_stream(reads: DataFrame, time: str, patience_ms: int = 60_000, late: str = "1 minute") -> DataFrame:
    """Pair reads (chr, qname, ord and an event time) of one name as they come.

    The first read waits in the state; the next of its name on the chromosome pairs with it.
    When the watermark passes its time and ``patience_ms``, it is given up as single
    (second_ord null).  The state holds one number for each waiting name.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out.append((*key, state.get[0], None))
            state.remove()
        else:
            waiting, until = state.get if state.exists else (None, 0)
            rows = pd.concat(frames)
            for ord_, at in sorted(zip(rows["ord"], rows[time])):
                if waiting is None:
                    waiting, until = int(ord_), int(pd.Timestamp(at).timestamp() * 1000) + patience_ms
                else:
                    out.append((*key, waiting, int(ord_)))
                    waiting = None
            if waiting is None:
                if state.exists:
                    state.remove()
            else:
                state.update((waiting, until))
                state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame(out, columns=["chr", "qname", "first_ord", "second_ord"])
        yield frame.astype({"first_ord": "Int64", "second_ord": "Int64"})

    marked = reads.withWatermark(time, late)
    return marked.groupBy("chr", "qname").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
