"""Per-domain politeness as keyed streaming state: a request starts when its domain is free again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESULT = "domain string, url string, ts timestamp, start timestamp, waited double"


def schedule(targets: DataFrame, gap_seconds: float = 2.0) -> DataFrame:
    """Start time of each target (domain, url, ts): its arrival, or gap_seconds behind its domain's last start.

    A target that arrives while its domain is busy is held back rather than dropped; it is the backoff
    queue's first-in first-out order. The state is one time a domain. Ties in ts are ordered by url.
    """
    gap = pd.Timedelta(seconds=gap_seconds)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = pd.Timestamp(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "url"], kind="stable")
        starts = []
        for ts in rows["ts"]:
            start = ts if free is None or ts >= free else free
            starts.append(start)
            free = start + gap
        state.update((free.to_pydatetime(),))
        out = rows.assign(domain=key[0], start=starts)
        out["waited"] = (out["start"] - out["ts"]).dt.total_seconds()
        yield out[["domain", "url", "ts", "start", "waited"]]

    return targets.groupBy("domain").applyInPandasWithState(run, RESULT, "free timestamp", "append", GroupStateTimeout.NoTimeout)
