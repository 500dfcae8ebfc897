"""The resource guard and the batch machine over logs of probes and commands (2.10).

A command is a function of a batch's state, and there are five states, so neighbouring commands compose
to a function again. A batch's log is folded in blocks of BLOCK numbers, whose functions are composed
for each batch, so a long log is many rows and no log is gathered in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256

# States, tiers, bytes that must be free (workspace and database: soft, hard), failures in a row that stop, and reasons.
STATUSES = ("PLANNED", "RUNNING", "PAUSED", "COMPLETED", "ABORTED")
GIB = 1024**3
WORKSPACE_FREE, DATABASE_FREE = (15 * GIB, 10 * GIB), (8 * GIB, 5 * GIB)
FAILURES = 3
PAUSE_REASONS = ("workspace_soft_stop", "postgres_soft_stop", "manual_pause")
ABORT_REASONS = ("workspace_hard_stop", "postgres_hard_stop", "ollama_persistently_unreachable", "safety_invariant_violation_detected")
MANUAL_ABORT = "manual_abort"
COMPLETE_REASONS = ("source_work_exhausted", "extracted_bytes_envelope_exhausted", "embeddings_envelope_exhausted", "runtime_budget_exceeded")


def disk_verdict(workspace: Column, database: Column) -> Column:
    """struct(tier, reason) of the worse of two disks; of equally bad ones the workspace. Unknown bytes are no reason to stop."""

    def one(free, least, name):
        soft, hard = least
        return F.when(free < hard, F.struct(F.lit(2).alias("n"), F.lit(f"{name}_hard_stop").alias("reason"))).when(free < soft, F.struct(F.lit(1).alias("n"), F.lit(f"{name}_soft_stop").alias("reason")))

    none = F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("reason"))
    w, d = F.coalesce(one(workspace, WORKSPACE_FREE, "workspace"), none), F.coalesce(one(database, DATABASE_FREE, "postgres"), none)
    return F.when(d["n"] > w["n"], d).otherwise(w)


def guard_probes(probes: DataFrame) -> DataFrame:
    """probes (key, seq, workspace, database: free bytes; reachable: null if not asked) -> the same with failures, tier, stop_reason.

    ``failures`` counts the probes in a row, up to this one, that did not reach the service; a probe that
    did not ask changes nothing. FAILURES of them stop hard, but only where the service is asked for and no
    disk has a reason of its own. Runs are islands: the failures since as many successes.
    """
    order = Window.partitionBy("key").orderBy("seq")
    asked = probes.withColumn("_ok", F.sum(F.when(F.col("reachable"), 1).otherwise(0)).over(order))
    run = Window.partitionBy("key", "_ok").orderBy("seq")
    asked = asked.withColumn("failures", F.sum(F.when(~F.col("reachable"), 1).otherwise(0)).over(run).cast("long"))
    v = disk_verdict(F.col("workspace"), F.col("database"))
    lost = ~F.coalesce("reachable", F.lit(True)) & (F.col("failures") >= FAILURES)
    n = F.when(v["n"] > 0, v["n"]).when(lost, 2).otherwise(0)
    tier = F.element_at(F.lit(["NORMAL", "SOFT_STOP", "HARD_STOP"]), n + 1)
    reason = F.when(v["n"] > 0, v["reason"]).when(lost, "ollama_persistently_unreachable")
    return asked.withColumns({"tier": tier, "stop_reason": reason}).drop("_ok")


def _moves() -> Column:
    """The state after a command, for each state before it, as an array of numbers; null: the reason is none for this action."""
    planned, running, paused, completed, aborted = range(5)
    stay = list(range(5))
    to = lambda **moves: F.lit([moves.get(STATUSES[i], s) for i, s in enumerate(stay)])
    action, reason, tier = F.col("action"), F.col("reason"), F.coalesce("tier", F.lit("NORMAL"))
    either = to(RUNNING=aborted, PAUSED=aborted)
    resume = F.when(tier == "HARD_STOP", to(PAUSED=aborted)).when(tier == "SOFT_STOP", F.lit(stay)).otherwise(to(PAUSED=running))
    abort = F.when(reason.isin(*ABORT_REASONS), either).when(reason == MANUAL_ABORT, to(PAUSED=aborted))
    return (
        F.when(action == "start", to(PLANNED=running))
        .when((action == "pause") & reason.isin(*PAUSE_REASONS), to(RUNNING=paused))
        .when(action == "resume", resume)
        .when(action == "abort", abort)
        .when((action == "complete") & reason.isin(*COMPLETE_REASONS), to(RUNNING=completed))
    )


def fold_commands(commands: DataFrame, block: int = BLOCK) -> DataFrame:
    """commands (batch_id, seq: integer, unique in a batch; action, reason, tier: the guard's at a resume) -> batch_id, seq, old, new, applied, problem, stop_reason.

    A batch begins PLANNED. start, pause, resume, abort and complete move it where its state and the reason
    allow; else nothing happens (``applied`` false). A resume under HARD_STOP aborts with the guard's reason,
    one under SOFT_STOP is refused. ``problem`` says that the reason is none for the action, or that there is
    no such action. ``stop_reason`` is what an applied command leaves: none while running.
    """
    c = commands.select("batch_id", "seq", "action", "reason", "tier", F.floor(F.col("seq") / block).alias("block"), _moves().alias("f"))
    known = F.coalesce("f", F.lit(list(range(5))))
    inner = c.groupBy("batch_id", "block").agg(F.sort_array(F.collect_list(F.struct("seq", "action", "reason", "f", known.alias("g")))).alias("xs"))
    inner = inner.withColumn("whole", F.expr("aggregate(xs, array(0, 1, 2, 3, 4), (a, x) -> transform(a, s -> x.g[s]))"))
    per = inner.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("block", "whole"))).alias("bs"))
    entry = per.select("batch_id", F.explode(F.expr("aggregate(bs, named_struct('s', 0, 'seen', cast(array() as array<struct<block:bigint,s:int>>)), (a, x) -> named_struct('s', x.whole[a.s], 'seen', array_append(a.seen, named_struct('block', x.block, 's', a.s)))).seen")).alias("e"))
    entry = entry.select("batch_id", F.col("e.block").alias("block"), F.col("e.s").alias("s"))
    step = "aggregate(xs, named_struct('s', s, 'out', cast(array() as array<struct<old:int,new:int>>)), (a, x) -> named_struct('s', x.g[a.s], 'out', array_append(a.out, named_struct('old', a.s, 'new', x.g[a.s])))).out"
    rows = inner.join(entry, ["batch_id", "block"]).select("batch_id", F.explode(F.arrays_zip("xs", F.expr(step).alias("out"))).alias("r"))
    name = lambda c: F.element_at(F.lit(list(STATUSES)), c + 1)
    old, new, x = F.col("r.out.old"), F.col("r.out.new"), F.col("r.xs")
    applied = old != new
    wrong = F.when(x["f"].isNull(), F.when(x["action"].isin("pause", "abort", "complete"), "reason").otherwise("action"))
    return rows.select("batch_id", x["seq"].alias("seq"), name(old).alias("old"), name(new).alias("new"), applied.alias("applied"), wrong.alias("problem"), F.when(applied & (new != 1), x["reason"]).alias("stop_reason"))
