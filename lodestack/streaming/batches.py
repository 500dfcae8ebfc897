"""The resource guard over a stream of probes: failures in a row are state, so a stream that starts again goes on counting."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestack.operators.batches import FAILURES, disk_verdict


def guard_stream(probes: DataFrame) -> DataFrame:
    """A stream of probes (key: string, seq: long, workspace, database: long; reachable: boolean) -> key, seq, failures, tier, stop_reason, as ``guard_probes`` gives over all rows.

    Probes of a key must come in the order of seq from one micro-batch to the next; within one they are sorted.
    """
    v = disk_verdict(F.col("workspace"), F.col("database"))
    rows = probes.select("key", "seq", "reachable", v["n"].alias("n"), v["reason"].alias("reason"))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        pdf = pd.concat(list(frames)).sort_values("seq")  # of one key in one micro-batch
        out = []
        for r in pdf.itertuples(index=False):
            asked = r.reachable is not None and not pd.isna(r.reachable)
            if asked:
                count = 0 if r.reachable else count + 1
            lost = asked and not r.reachable and count >= FAILURES
            n = r.n or (2 if lost else 0)
            out.append((key[0], r.seq, count, ("NORMAL", "SOFT_STOP", "HARD_STOP")[n], r.reason if r.n else "ollama_persistently_unreachable" if lost else None))
        state.update((count,))
        yield pd.DataFrame(out, columns=["key", "seq", "failures", "tier", "stop_reason"])

    return rows.groupBy("key").applyInPandasWithState(run, "key string, seq long, failures long, tier string, stop_reason string", "count long", "append", GroupStateTimeout.NoTimeout)
