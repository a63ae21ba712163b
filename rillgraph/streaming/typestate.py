"""The typestate rules over a stream of events: state for each user, findings as they arise.

Events are held until the watermark has passed them, and then taken in order of time, so their order of arrival does not matter, within
a micro-batch or across. Those that come behind the watermark are dropped. The rules are those of the batch operators: releases
without a null store between, and the first use behind a release. A user's state is the events held and the releases that no
null store or signup has ended: all of them can still be released again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FOUND = "source long, rule string, sink1 long, sink2 long"
#: Segment, open releases, those of them that no use has followed yet, and events held: times in microseconds, ids, types.
STATE = "segment long, freed array<long>, unused array<long>, times array<long>, events array<long>, kinds array<string>"


def advance(user: int, state: tuple[int, list[int], list[int]], events: Iterable[tuple[int, str]]) -> tuple[tuple[int, list[int], list[int]], list[tuple]]:
    """The state behind events (event_id, event_type) in order, and what they reveal."""
    segment, freed, unused = state[0], list(state[1]), list(state[2])
    out = []
    for event, kind in events:
        source = (user << 32) + segment
        if kind == "signup":
            segment, freed, unused = segment + 1, [], []
        elif kind == "error":
            freed, unused = [], []
        elif kind == "purchase":
            out += [(source, "double_free", f, event) for f in freed]
            freed.append(event)
            unused.append(event)
        elif kind == "click":
            out += [(source, "use_after_free", f, event) for f in unused]
            unused = []
    return (segment, freed, unused), out


def findings(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """FOUND for a stream of events (event_id, ts, user_id, event_type)."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0, [], [], [], [], [])
        passed = state.getCurrentWatermarkMs()
        held = list(zip(*map(list, now[3:]), strict=True))
        if not state.hasTimedOut:
            rows = pd.concat(list(batches))
            times = rows["ts"].astype("datetime64[us]").astype("int64").tolist()
            new = zip(times, rows["event_id"].tolist(), rows["event_type"].tolist(), strict=True)
            held += [e for e in new if e[0] // 1000 >= passed]
        held.sort()
        ready = [e for e in held if e[0] // 1000 < passed]
        rest = held[len(ready) :]
        after, out = advance(int(key[0]), (now[0], list(now[1]), list(now[2])), [e[1:] for e in ready])
        state.update((*after, *(list(x) for x in zip(*rest, strict=True))) if rest else (*after, [], [], []))
        if rest:
            state.setTimeoutTimestamp(max(rest[0][0] // 1000, passed) + 1)
        yield pd.DataFrame(out, columns=["source", "rule", "sink1", "sink2"])

    given = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type").withWatermark("ts", late)
    return given.groupBy("user_id").applyInPandasWithState(update, FOUND, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n): events of each kind in each window of time."""
    counted = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type").withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")
