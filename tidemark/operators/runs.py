"""Analytics of run logs: metrics, streaks, findings, states and chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import retryable
from tidemark.operators.ranges import in_ranges, running
from tidemark.sources.storage import written


def metrics(runs: DataFrame) -> DataFrame:
    """Counts by status and scope in one pass over grouping sets, with totals as nulls."""
    sets = [[F.col("status"), F.col("run_scope")], [F.col("status")], [F.col("run_scope")], []]
    grouped = runs.groupingSets(sets, "status", "run_scope")
    return grouped.agg(F.count("*").alias("n"), F.sum("retry_count").alias("retries"), F.sum("duration_s").alias("duration_s"), F.max("duration_s").alias("longest_s"), F.grouping_id().alias("level"))


def queue_metrics(runs: DataFrame, now: Column) -> DataFrame:
    """Queue depth and age, time-outs, retries, dead letters, success and durations of each scope and of all runs, in one pass."""
    is_ = lambda *states: F.col("state").isin(*states)
    age, took = F.unix_timestamp(now) - F.unix_timestamp("created_at"), F.when(F.col("finished_at").isNotNull(), F.col("duration_s"))
    ended = F.count_if(is_("completed", "failed", "dead_letter"))
    return runs.rollup("run_scope").agg(
        F.count("*").alias("runs"), F.count_if(is_("queued")).alias("queue_depth"), F.max(F.when(is_("queued"), age)).alias("oldest_queued_s"), F.count_if(F.col("error_type") == "TimeoutError").alias("timeouts"), F.sum("retry_count").alias("retries"),
        F.count_if(is_("dead_letter")).alias("dead_letters"), F.count_if(is_("dead_letter") & (F.col("dead_state") == "active")).alias("dead_active"), F.try_divide(F.count_if(is_("completed")), ended).alias("success_rate"),
        F.count(took).alias("durations"), F.sum(took).alias("duration_sum"), F.max(took).alias("duration_max"), F.avg(took).alias("duration_mean"),
    )


def waiting(runs: DataFrame) -> DataFrame:
    """Number and earliest time of waiting runs by status, and by status and provider (null provider: all)."""
    sets = [[F.col("status")], [F.col("status"), F.col("provider")]]
    return runs.groupingSets(sets, "status", "provider").agg(F.count("*").alias("n"), F.min("created_at").alias("earliest")).select("status", "provider", "n", "earliest")


def step_states(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """The state of each step (step, upstream) from its runs (step, status): failed, running, blocked by a failure upstream, completed, or skipped without runs."""
    n = {s: F.count_if(F.col("status") == s) for s in ("completed", "failed", "running")}
    counts = runs.groupBy("step").agg(*[c.alias(s) for s, c in n.items()])
    own = steps.join(counts, "step", "left").withColumns({s: F.coalesce(s, F.lit(0)) for s in n})
    rows = own.join(counts.select(F.col("step").alias("upstream"), F.col("failed").alias("above")), "upstream", "left")
    busy, blocked = (F.col("failed") > 0) | (F.col("running") > 0), F.coalesce(F.col("above") > 0, F.lit(False))
    state = F.when(F.col("failed") > 0, "failed").when(F.col("running") > 0, "running").when(blocked, "blocked").when(F.col("completed") > 0, "completed").otherwise("skipped")
    reason = F.when(~busy & blocked, "upstream_failed").when(state == "skipped", "no_runs")
    return rows.select("step", "upstream", *n, state.alias("state"), reason.alias("reason"))


def success_windows(runs: DataFrame, now: Column, hours: dict[str, int]) -> DataFrame:
    """For each window before ``now``: finished runs, passed ones and their rate, null without runs; one pass over the log."""
    aggs = []
    for name, h in hours.items():
        inside = (F.col("finished_at") >= now - F.expr(f"interval {h} hour")) & (F.col("finished_at") <= now)
        aggs += [F.count_if(inside).alias(f"runs_{name}"), F.count_if(inside & (F.col("status") == "completed")).alias(f"passed_{name}")]
    row = runs.agg(*aggs)
    parts = F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"runs_{n}").alias("runs"), F.col(f"passed_{n}").alias("passed")) for n in hours])
    return row.select(F.explode(parts).alias("x")).select("x.*").withColumn("success_rate", F.try_divide("passed", "runs"))


def failure_backoff(runs: DataFrame, by: str = "provider", base: int = 300, most: int = 3600) -> DataFrame:
    """Transient failures since the last success of each provider, and when to try again: the base doubled each time, up to a bound."""
    last = runs.where("status = 'completed'").groupBy(by).agg(F.max("finished_at").alias("last_ok"))
    bad = runs.where((F.col("status") == "failed") & retryable(F.col("error_type"))).join(last, by, "left").where(F.col("last_ok").isNull() | (F.col("finished_at") > F.col("last_ok")))
    out = bad.groupBy(by).agg(F.count("*").alias("streak"), F.max("finished_at").alias("last_failure"))
    delay = F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(F.col("streak") - 1, F.lit(30)))).cast("long")
    return out.withColumn("delay_s", delay).withColumn("retry_at", F.timestamp_seconds(F.unix_timestamp("last_failure") + F.col("delay_s")))


def dedupe_findings(findings: DataFrame, identity: list[str], ts: str, order: str) -> DataFrame:
    """One row for each identity: how often it was met, first and last time, and the run that met it first."""
    return findings.groupBy(*identity).agg(F.count("*").alias("occurrence_count"), F.min(ts).alias("first_observed_at"), F.max(ts).alias("last_observed_at"), F.min_by("run_id", F.struct(ts, order)).alias("first_run_id"))


def transitions(samples: DataFrame, keys: list[str], ts: str, state: str, by: str) -> DataFrame:
    """Samples whose state differs from the one before, with a generation count from 1.

    ``by`` is a coarser column that never falls as ``ts`` rises, such as the date: changes are found inside its values, and
    only one row for each of them goes through a whole key's window.
    """
    inside, whole = Window.partitionBy(*keys, by).orderBy(ts), Window.partitionBy(*keys).orderBy(by)
    ends = samples.groupBy(*keys, by).agg(F.max_by(state, ts).alias("_last")).withColumn("_entry", F.lag("_last").over(whole)).drop("_last")
    marked = samples.withColumns({"_at": F.row_number().over(inside), "_in": F.lag(state).over(inside)}).join(ends, [*keys, by])
    previous = F.when(F.col("_at") == 1, F.col("_entry")).otherwise(F.col("_in"))
    changed = marked.withColumn("previous", previous).where(F.col("previous").isNull() | (F.col("previous") != F.col(state))).drop("_at", "_in", "_entry")
    counts = changed.groupBy(*keys, by).agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(whole) - F.col("_n")).drop("_n")
    return changed.withColumn("_nth", F.row_number().over(inside)).join(counts, [*keys, by]).withColumn("generation", (F.col("_before") + F.col("_nth")).cast("long")).drop("_nth", "_before")


def retry_roots(runs: DataFrame, root: str) -> DataFrame:
    """For each run the first of its chain of retries, its depth in it, and whether the chain is a cycle, which has neither.

    Pointer jumping: each round doubles the stretch that a run looks back, so a chain of n runs takes log2(n) rounds, each
    written below ``root``. A run whose predecessor is not in the log begins a chain. A cycle never ends at a first run: it
    is known by the rounds, which are enough for a chain of all runs.
    """
    known = runs.select(F.col("run_id").alias("up"), F.lit(True).alias("known"))
    # runs that retry none have no key: they are spread by their own ids
    known, rows = known.withColumn("_at", F.xxhash64("up")), runs.select("run_id", F.col("retry_of").alias("up"))
    rows = rows.withColumn("_at", F.xxhash64(F.coalesce("up", "run_id"))).join(known, ["up", "_at"], "left").drop("_at")
    up = F.when(F.col("known"), F.col("up"))
    now = written(rows.select("run_id", F.coalesce(up, "run_id").alias("up"), up.isNotNull().cast("long").alias("depth")), root, "chains-0")
    rounds = max(1, now.count()).bit_length()
    for k in range(1, rounds + 1):
        ahead = now.select(F.col("run_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        now = written(now.join(ahead, "up").select("run_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), "more"), root, f"chains-{k}")
        if now.where("more > 0").isEmpty():
            break
        now = now.drop("more")
    cycle = F.col("depth") >= 2**rounds if "more" not in now.columns else F.lit(False)
    return now.select("run_id", F.when(~cycle, F.col("up")).alias("root"), F.when(~cycle, F.col("depth")).alias("depth"), cycle.alias("cycle"))


def _places(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the place of each row in its key's order, from 0; written in ranges, so that no key is in one task."""
    rows = running(in_ranges(df, keys, order), keys, order, {name: ("sum", F.lit(1).cast("long"))})
    return rows.withColumn(name, F.col(name) - 1).drop("_part")


def retry_order(runs: DataFrame, root: str) -> DataFrame:
    """Every run's place in its chain: (run_id, root, depth, place, relation, cycle), the first run at 0, then breadth first.

    Runs of one depth stand in the order of the runs that they retry, and retries of the same run by (created_at, run_id).
    That is the order of their paths from the first run, which are never made: a run's rank is told by the rank of the run
    above and its own, and each round doubles the stretch of the path that ranks are about, so chains of depth d take log2(d)
    rounds. A run in a cycle has no place, one whose predecessor is not in the log begins a chain.
    """
    ends = retry_roots(runs, root)
    rows = runs.select("run_id", "created_at", "retry_of").join(ends, "run_id")
    chains = rows.where(~F.col("cycle")).select("run_id", "root", "depth", "created_at", F.when(F.col("depth") > 0, F.col("retry_of")).alias("up"))
    now = _places(chains, [], ["created_at", "run_id"], "rank").drop("created_at")
    deepest = now.agg(F.max("depth").alias("d")).first().d or 0
    for _ in range(int(deepest).bit_length()):
        above = now.select(F.col("run_id").alias("up"), F.col("rank").alias("above"), F.col("up").alias("next"))
        # each round more runs have none above; they are spread by their own ids
        above = above.withColumn("_at", F.xxhash64("up"))
        both = now.withColumn("_at", F.xxhash64(F.coalesce("up", "run_id"))).join(above, ["up", "_at"], "left").select("run_id", "root", "depth", F.col("next").alias("up"), "above", F.col("rank").alias("own"))
        now = _places(both, [], ["above", "own"], "rank").drop("above", "own")
    placed = _places(now.drop("up"), ["root"], ["depth", "rank"], "place").drop("rank")
    placed = placed.withColumns({"relation": F.when(F.col("depth") == 0, "origin").otherwise("retry"), "cycle": F.lit(False)})
    return placed.unionByName(ends.where("cycle").select("run_id", "cycle"), allowMissingColumns=True)


def first_wins(df: DataFrame, keys: list[str], order: list[str], payload: Column) -> DataFrame:
    """The first row of each key, and whether other rows of the key carry another payload."""
    w = Window.partitionBy(*keys)
    marked = df.withColumn("_payload", payload).withColumns({"_k": F.row_number().over(w.orderBy(*order)), "_low": F.min("_payload").over(w), "_high": F.max("_payload").over(w)})
    return marked.where("_k = 1").withColumn("conflict", F.col("_low") != F.col("_high")).drop("_k", "_low", "_high", "_payload")


def views(runs: DataFrame, selector: list[str]) -> DataFrame:
    """Stage, outcome, degraded reasons (each once, in order), number of windows and selector of each run.

    Reads readiness, manifest, failure_stage, planned_windows, session_closed, provider_gap and the number of findings.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    status, done = F.col("status"), F.col("status") == "completed"
    stage = F.when(status.isin("queued", "running"), status).when(done, F.when(yes("manifest"), "published").otherwise("verified")).otherwise(F.coalesce("failure_stage", F.lit("execute")))
    reasons = F.array(
        F.when(F.col("readiness") == "degraded", "coverage_degraded").when(F.col("readiness") == "not_ready", "coverage_not_ready"),
        F.when(yes("session_closed"), "session_closed").when(yes("provider_gap"), "provider_gap"),
        F.when(status.isin("queued", "running") & (F.col("retry_count") > 0), "retrying"), F.when(done & (F.col("findings") > 0), "findings_recorded"),
    )
    out = runs.withColumns({"stage": stage, "reasons": F.array_distinct(F.filter(reasons, lambda r: r.isNotNull())), "window_count": F.coalesce("planned_windows", F.lit(1)), "selector": F.concat_ws("/", *selector)})
    return out.withColumn("outcome", F.when(done, F.when(F.size("reasons") > 0, "degraded").otherwise("pass")).otherwise(F.coalesce(status, F.lit("unknown"))))
