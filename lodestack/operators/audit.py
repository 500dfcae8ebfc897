"""Batch reports, audits and constraints (J05 to J07, J10, J25, A23 to A26, F12, F20 to F26, section 2.10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import paths as P

# States and legal transitions.
TERMINAL = ("INGESTED", "FAILED", "EXCLUDED", "UNSUPPORTED")
SUCCESS = ("INGESTED",)
STAGES = ("EXTRACT", "NORMALIZE", "CHUNK", "EMBED")
STATES = ("EXTRACTED", "NORMALIZED", "CHUNKED", "EMBEDDED", "INGESTED")
TRANSITIONS = (("PLANNED", "RUNNING"), ("RUNNING", "PAUSED"), ("RUNNING", "COMPLETED"), ("RUNNING", "ABORTED"), ("PAUSED", "RUNNING"), ("PAUSED", "ABORTED"))


def attempted(instances: DataFrame, attempts: DataFrame) -> DataFrame:
    """Adds attempted: an attempt of the instance itself, or of its group if it has one."""
    own = attempts.where("instance_id is not null").select(F.col("instance_id").alias("_i")).distinct()
    grp = attempts.where("group_id is not null").select(F.col("group_id").alias("_g")).distinct()
    j = instances.join(own, F.col("id") == F.col("_i"), "left").join(grp, F.col("group_id") == F.col("_g"), "left")
    return j.withColumn("attempted", F.col("_i").isNotNull() | F.col("_g").isNotNull()).drop("_i", "_g")


def batch_report(instances: DataFrame, groups: DataFrame, attempts: DataFrame) -> DataFrame:
    """A row a batch: selected, attempted, terminal, successful; ``violated`` where these are not in order.

    instances: id, batch_id, group_id, source_category; groups: group_id, state; attempts:
    instance_id, group_id, outcome, retryable. An archive ends by a success or a lasting failure of
    its own; a loose file by its group's state. Null categories are neither.
    """
    i = attempted(instances, attempts).join(groups.select("group_id", "state"), "group_id", "left")
    done = attempts.where("instance_id is not null").groupBy(F.col("instance_id").alias("_i")).agg(F.bool_or(F.col("outcome") == "SUCCESS").alias("won"), F.bool_or((F.col("outcome") == "FAILURE") & ~F.coalesce("retryable", F.lit(True))).alias("lost"))
    i = i.join(done, F.col("id") == F.col("_i"), "left")
    arc, loose = F.col("source_category") == "ARCHIVE", F.col("source_category") != "ARCHIVE"
    won, lost = F.coalesce("won", F.lit(False)), F.coalesce("lost", F.lit(False))
    ended = (arc & (won | lost)) | (loose & F.col("state").isin(*TERMINAL))
    good = (arc & won) | (loose & F.col("state").isin(*SUCCESS))
    g = i.groupBy("batch_id").agg(F.count(F.lit(1)).alias("selected"), F.count_if("attempted").alias("attempted"), F.count_if(F.col("attempted") & ended).alias("terminal"), F.count_if(F.col("attempted") & good).alias("successful"))
    return g.withColumn("violated", (F.col("attempted") > F.col("selected")) | (F.col("terminal") > F.col("attempted")) | (F.col("successful") > F.col("terminal")))


def is_complete(report: DataFrame) -> Column:
    return (F.col("status") == "RUNNING") & (F.col("selected") == F.col("attempted")) & (F.col("terminal") == F.col("attempted"))


def execution_status(audits: DataFrame, actions: DataFrame) -> DataFrame:
    """audits (execution_id, action_id, audit_id, result) -> execution_id, status, first_failure; PENDING while an action has no audit."""
    n = actions.groupBy("execution_id").agg(F.count(F.lit(1)).alias("actions"))
    ok = F.col("result") == "SUCCESS"
    g = audits.groupBy("execution_id").agg(F.count_distinct("action_id").alias("audited"), F.bool_or(F.col("result") == "UNKNOWN").alias("unknown"), F.bool_and(ok).alias("all"), F.bool_or(ok).alias("any"), F.min(F.when(~ok, F.col("audit_id"))).alias("first_failure"))
    j = n.join(g, "execution_id", "left")
    status = F.when(F.coalesce("audited", F.lit(0)) < F.col("actions"), "PENDING").when(F.col("unknown"), "NEEDS_REVIEW").when(F.col("all"), "COMPLETED").when(~F.col("any"), "FAILED").otherwise("PARTIALLY_COMPLETED")
    return j.select("execution_id", status.alias("status"), "first_failure")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break CHECK rules, with the sorted names of the rules; a rule that is null holds (as in SQL)."""
    broken = F.array_compact(F.array(*[F.when(~cond, name) for name, cond in sorted(rules.items())]))
    return df.withColumn("violations", broken).where(F.size("violations") > 0)


def audit_rules() -> dict[str, Column]:
    """result x mutated (yes, no, unknown) x ended_at of an audit."""
    r, m = F.col("result"), F.col("mutated")
    return {
        "failed_not_mutated": (r != "FAILED") | m.eqNullSafe(F.lit(False)),
        "success_mutated": (r != "SUCCESS") | m.eqNullSafe(F.lit(True)),
        "unknown_mutation": (r != "UNKNOWN") | m.isNull(),
        "ended": (r == "NOT_ATTEMPTED") | F.col("ended_at").isNotNull(),
    }


def file_checks(files: DataFrame, scan: DataFrame, documents: DataFrame) -> DataFrame:
    """files (document_id, path, size, sha as observed; null where nothing was there) against a fresh scan and the documents now.

    Adds document_exists, path_changed, exists_now, type_matches, hash_matches, size_matches and
    valid. scan: path, size, sha; documents: document_id, source, source_type.
    """
    now = scan.select("path", F.col("size").alias("_size"), F.col("sha").alias("_sha"), F.lit(True).alias("_here"))
    docs = documents.select("document_id", F.col("source").alias("_source"), F.col("source_type").alias("_type"), F.lit(True).alias("_doc"))
    j = files.join(now, "path", "left").join(docs, "document_id", "left")
    no = F.lit(False)
    both = F.coalesce(F.col("_here"), no) & F.col("sha").isNotNull()
    checks = {
        "document_exists": F.coalesce("_doc", no),
        "path_changed": ~F.coalesce(F.col("_source") == F.col("path"), no),
        "exists_now": F.coalesce("_here", no),
        "type_matches": F.coalesce(F.ltrim(P.suffix(F.col("path")), F.lit(".")) == F.lower("_type"), no),
        "hash_matches": both & F.coalesce(F.col("_sha") == F.col("sha"), no),
        "size_matches": both & F.coalesce(F.col("_size") == F.col("size"), no),
    }
    j = j.withColumns(checks)
    valid = ~F.col("path_changed") & F.col("document_exists") & F.col("exists_now") & F.col("type_matches") & F.col("hash_matches") & F.col("size_matches")
    return j.withColumn("valid", valid).drop("_size", "_sha", "_here", "_source", "_type", "_doc")


def plan_validity(plans: DataFrame, files: DataFrame, scan: DataFrame, documents: DataFrame) -> DataFrame:
    """plan_id, valid, bad: whether a plan's canonical file (files.canonical) and all its others pass every check; without a canonical file it is not valid."""
    j = file_checks(files, scan, documents)
    g = j.groupBy("plan_id").agg((F.bool_and("valid") & F.bool_or("canonical")).alias("valid"), F.count_if(~F.col("valid")).alias("bad"))
    return plans.join(g, "plan_id", "left").select("plan_id", F.coalesce("valid", F.lit(False)).alias("valid"), F.coalesce("bad", F.lit(0)).alias("bad"))


def actionable(authorizations: DataFrame, validity: DataFrame) -> DataFrame:
    j = authorizations.join(validity, "plan_id", "left")
    return j.withColumn("actionable", (F.col("status") == "AUTHORIZED") & F.coalesce("valid", F.lit(False)))


def authorization_problem(plans: DataFrame, reviews: DataFrame, authorizations: DataFrame, validity: DataFrame) -> DataFrame:
    """plans (plan_id, review_id) -> plan_id, problem: the first precondition of an authorization that does not hold; null if all do."""
    active = authorizations.where("status = 'AUTHORIZED'").select("plan_id").distinct().withColumn("_active", F.lit(True))
    j = plans.join(reviews.select("review_id", F.col("status").alias("_review")), "review_id", "left").join(active, "plan_id", "left").join(validity.select("plan_id", "valid"), "plan_id", "left")
    problem = F.when(F.col("_review").isNull(), "review not found").when(F.col("_review") != "APPROVED", "review not approved").when(F.col("_active"), "already authorized").when(~F.coalesce("valid", F.lit(False)), "no longer valid")
    return j.select("plan_id", problem.alias("problem"))


def state_from_attempts(attempts: DataFrame) -> DataFrame:
    """group_id, stage, outcome, chunks_left -> state: FAILED after any failure, else that of the last stage that succeeded.

    A group is EXTRACTED before its first attempt. An embedding attempt leaves it EMBEDDED, or
    INGESTED once one leaves no chunk without a vector.
    """
    at = F.element_at(F.create_map(*[x for i, s in enumerate(STAGES) for x in (F.lit(s), F.lit(i))]), F.col("stage"))
    at = at + F.when((F.col("stage") == "EMBED") & (F.coalesce("chunks_left", F.lit(0)) == 0), 1).otherwise(0)
    g = attempts.groupBy("group_id").agg(F.bool_or(F.col("outcome") == "FAILURE").alias("failed"), F.max(F.when(F.col("outcome") == "SUCCESS", at)).alias("last"))
    names = F.array(*[F.lit(x) for x in STATES])
    return g.select("group_id", F.when(F.col("failed"), "FAILED").otherwise(F.get(names, F.coalesce("last", F.lit(0)))).alias("state"))


def ledger(entries: DataFrame) -> DataFrame:
    """batch_id, kind, amount -> reserved and consumed: reserve adds, release and recover give back, consume keeps the counter."""
    signed = F.when(F.col("kind") == "reserve", F.col("amount")).when(F.col("kind").isin("release", "recover"), -F.col("amount")).otherwise(0)
    return entries.groupBy("batch_id").agg(F.sum(signed).alias("reserved"), F.sum(F.when(F.col("kind") == "consume", F.col("amount")).otherwise(0)).alias("consumed"))


def ledger_breaks(ledgers: DataFrame, most: Column) -> DataFrame:
    """Ledgers that leave 0 <= reserved <= most."""
    return ledgers.where((F.col("reserved") < 0) | (F.col("reserved") > most))


def corrected_bytes(members: DataFrame) -> DataFrame:
    """archive, estimate, actual (null while not extracted) -> archive, charged: the actual bytes where known, else the estimate."""
    return members.groupBy("archive").agg(F.sum(F.coalesce("actual", "estimate")).alias("charged"))


def worse_tier(a: Column, b: Column) -> Column:
    """The worse of two guard tiers."""
    return F.when((a == "HARD_STOP") | (b == "HARD_STOP"), "HARD_STOP").when((a == "SOFT_STOP") | (b == "SOFT_STOP"), "SOFT_STOP").otherwise("NORMAL")


def illegal_transitions(changes: DataFrame) -> DataFrame:
    """Changes (old, new, reason) that no rule allows; MANUAL_ABORT is legal from PAUSED only."""
    legal = F.concat_ws(">", "old", "new").isin(*[f"{a}>{b}" for a, b in TRANSITIONS])
    return changes.where(~legal | ((F.col("reason") == "MANUAL_ABORT") & (F.col("old") != "PAUSED")))


def guard_tier(free: Column, soft: int, hard: int) -> Column:
    return F.when(free < hard, "HARD_STOP").when(free < soft, "SOFT_STOP").otherwise("NORMAL")


def orphan_runs(runs: DataFrame, uses: DataFrame) -> DataFrame:
    """Discovery runs that no classification run names in any of its three columns."""
    used = uses.select(F.explode(F.array("d0", "d1", "d2")).alias("run_id")).where("run_id is not null").distinct()
    return runs.join(used, "run_id", "left_anti")


def bad_chains(links: DataFrame) -> DataFrame:
    """owner, seq, kind, id, parent: owners whose ancestry is not a file first, then archive members each naming the one before."""
    g = links.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "id", "parent"))).alias("c"))
    fine = F.forall(F.transform("c", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: F.when(y["i"] == 0, (y["x"]["kind"] == "FILE") & y["x"]["parent"].isNull()).otherwise((y["x"]["kind"] == "ARCHIVE_MEMBER") & y["x"]["parent"].eqNullSafe(F.get("c", y["i"] - 1)["id"])))
    return g.where(~fine).select("owner")
