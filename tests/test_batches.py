"""Guard and batch machine against step-by-step versions, and the stream against the batch, over restarts."""

import random

import pytest

from lodestack.operators import batches
from lodestack.streaming.batches import guard_stream

GIB = batches.GIB
FIELDS = "key string, seq long, workspace long, database long, reachable boolean"


def probes(seed=1):
    rng = random.Random(seed)
    free = [20 * GIB, 20 * GIB, 20 * GIB, 15 * GIB, 12 * GIB, 9 * GIB, 7 * GIB, 1, None]
    return [(k, i, rng.choice(free), rng.choice(free), rng.choice([True, False, False, False, None])) for k in "abc" for i in range(60)]


def guarded(rows):
    out, count = [], {}
    for k, i, w, d, ok in sorted(rows):
        if ok is not None:
            count[k] = 0 if ok else count.get(k, 0) + 1
        worst = (0, None)
        for free, (soft, hard), name in ((w, (15 * GIB, 10 * GIB), "workspace"), (d, (8 * GIB, 5 * GIB), "postgres")):
            n = 0 if free is None else 2 if free < hard else 1 if free < soft else 0
            worst = (n, f"{name}_{'hard' if n == 2 else 'soft'}_stop") if n > worst[0] else worst
        if not worst[0] and ok is False and count[k] >= 3:
            worst = (2, "ollama_persistently_unreachable")
        out.append((k, i, count.get(k, 0), ("NORMAL", "SOFT_STOP", "HARD_STOP")[worst[0]], worst[1]))
    return out


def test_three_failed_probes_stop(spark):
    rows = [("a", i, 20 * GIB, 20 * GIB, ok) for i, ok in enumerate([False, False, None, False, False, True, False, False, True])]
    got = batches.guard_probes(spark.createDataFrame(rows, FIELDS)).orderBy("seq").collect()
    assert [(r.failures, r.tier) for r in got] == [(1, "NORMAL"), (2, "NORMAL"), (2, "NORMAL"), (3, "HARD_STOP"), (4, "HARD_STOP"), (0, "NORMAL"), (1, "NORMAL"), (2, "NORMAL"), (0, "NORMAL")]


def test_guard_in_batch_and_as_a_stream(spark, tmp_path):
    rows = probes()
    want = guarded(rows)
    cols = ["key", "seq", "failures", "tier", "stop_reason"]
    got = batches.guard_probes(spark.createDataFrame(rows, FIELDS)).select(*cols).collect()
    assert sorted(map(tuple, got)) == want and {r[3] for r in want} == {"NORMAL", "SOFT_STOP", "HARD_STOP"}
    # Three starts of the stream from one checkpoint, a file of probes before each.
    for n in range(3):
        part = [r for r in rows if r[1] // 20 == n]
        spark.createDataFrame(part, FIELDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = guard_stream(spark.readStream.schema(FIELDS).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select(*cols).collect()
    assert sorted(map(tuple, got)) == want


ACTIONS = ["start", "pause", "resume", "abort", "complete", "dance"]
REASONS = [*batches.PAUSE_REASONS, *batches.ABORT_REASONS, batches.MANUAL_ABORT, *batches.COMPLETE_REASONS, None]


def machine(rows):
    out, state = [], {}
    for b, i, action, reason, tier in sorted(rows, key=lambda r: r[:2]):
        old = new = state.get(b, "PLANNED")
        problem = None
        if action == "start":
            new = "RUNNING" if old == "PLANNED" else old
        elif action == "pause":
            problem = None if reason in batches.PAUSE_REASONS else "reason"
            new = "PAUSED" if not problem and old == "RUNNING" else old
        elif action == "resume":
            if old == "PAUSED":
                new = {"HARD_STOP": "ABORTED", "SOFT_STOP": "PAUSED"}.get(tier, "RUNNING")
        elif action == "abort":
            problem = None if reason in (*batches.ABORT_REASONS, batches.MANUAL_ABORT) else "reason"
            new = "ABORTED" if not problem and (old == "PAUSED" or (old == "RUNNING" and reason != batches.MANUAL_ABORT)) else old
        elif action == "complete":
            problem = None if reason in batches.COMPLETE_REASONS else "reason"
            new = "COMPLETED" if not problem and old == "RUNNING" else old
        else:
            problem = "action"
        state[b] = new
        out.append((b, i, old, new, old != new, problem, reason if old != new and new != "RUNNING" else None))
    return out


@pytest.mark.parametrize("block", [1, 5, 256])
def test_commands_for_any_block(spark, block):
    rng = random.Random(block)
    rows = [(b, i * 3 - 4, rng.choice([*ACTIONS, "pause", "resume", "resume"]), rng.choice(REASONS), rng.choice(["NORMAL", "NORMAL", "SOFT_STOP", "HARD_STOP", None])) for b in range(40) for i in range(25)]
    # Long lives: no terminal reason for most.
    rows += [(100 + b, i, rng.choice(["start", "pause", "resume", "dance"]), rng.choice(batches.PAUSE_REASONS), None) for b in range(5) for i in range(60)]
    df = spark.createDataFrame(rows, "batch_id long, seq long, action string, reason string, tier string")
    got = sorted(map(tuple, batches.fold_commands(df, block).collect()))
    assert got == machine(rows) and {r[3] for r in got} == set(batches.STATUSES)
    assert batches.fold_commands(df.limit(0)).count() == 0


def test_drawn_intervals(spark):
    """They lie where those of the random module lie, within the error that is stated, for any partitioning."""
    import numpy as np

    from lodestack.operators import evaluate

    rng = np.random.default_rng(2)
    rows = [("a", i, float(x)) for i, x in enumerate(rng.normal(0.3, 1.0, 400))] + [("b", i, float(x)) for i, x in enumerate(rng.exponential(2.0, 150))] + [("c", 1, 5.0), ("c", 2, None)]
    df = spark.createDataFrame(rows, "type string, id long, v double")
    got = {r.type: r for r in evaluate.drawn_intervals(df, ["type"], "v", "id").collect()}
    again = {r.type: r for r in evaluate.drawn_intervals(df.repartition(7), ["type"], "v", "id").collect()}
    exact = {r.type: r for r in evaluate.bootstrap(df.where("v is not null"), ["type"], "v", "id").collect()}
    for k, n in (("a", 400), ("b", 150)):
        sd = np.std([v for t, _, v in rows if t == k])
        error = 3 * 2.7 * sd / np.sqrt(n * 2000) + 2 / n * (exact[k].high - exact[k].low)
        assert abs(got[k].low - exact[k].low) < error and abs(got[k].high - exact[k].high) < error
        assert got[k].n == n and abs(got[k].mean - exact[k].mean) < 1e-9 and abs(got[k].low - again[k].low) < 1e-9
    assert (got["c"].n, got["c"].low, got["c"].high) == (1, 5.0, 5.0)
    assert evaluate.drawn_intervals(df.limit(0), ["type"], "v", "id").count() == 0
    steps = evaluate.poisson_steps()
    assert steps == sorted(steps) and abs(steps[0] - 0.36787944117144233) < 1e-15 and 1 - steps[-1] < 1e-9
