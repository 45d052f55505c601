"""Registered queries over run logs, findings, windows and texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as ftext
from tidemark.functions import time as ft
from tidemark.operators import derive, inventory, planner, quality, ranges, runs, windows
from tidemark.operators.versions import ranked_first
from tidemark.plans.fixtures import Tables, query
from tidemark.sources.storage import shared_dir

NOW = "2001-08-01 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


@query(
    "SELECT status, run_scope, count(*) AS n, sum(retry_count)::BIGINT AS retries, sum(duration_s)::BIGINT AS duration_s, max(duration_s) AS longest_s, grouping(status, run_scope) AS level FROM runs GROUP BY GROUPING SETS ((status, run_scope), (status), (run_scope), ())",
    "runs",
)
def d14_run_metrics(t: Tables):
    return runs.metrics(t.runs())


SHOWN = f""", shown AS (SELECT *, CASE WHEN status = 'running' AND retry_count = 0 THEN 'queued' WHEN status = 'failed' AND retry_count = 4 THEN 'dead_letter' ELSE status END AS state FROM runs)"""


@query(
    SHOWN + f"""SELECT run_scope, count(*) AS runs, count(*) FILTER (state = 'queued') AS queue_depth, max(epoch(TIMESTAMP '{NOW}' - created_at)::BIGINT) FILTER (state = 'queued') AS oldest_queued_s, count(*) FILTER (error_type = 'TimeoutError') AS timeouts, sum(retry_count)::BIGINT AS retries,
    count(*) FILTER (state = 'dead_letter') AS dead_letters, count(*) FILTER (state = 'dead_letter' AND run_id % 2 = 0) AS dead_active, count(*) FILTER (state = 'completed') / nullif(count(*) FILTER (state IN ('completed', 'failed', 'dead_letter')), 0) AS success_rate,
    count(finished_at) AS durations, sum(duration_s) FILTER (finished_at IS NOT NULL)::BIGINT AS duration_sum, max(duration_s) FILTER (finished_at IS NOT NULL) AS duration_max, avg(duration_s) FILTER (finished_at IS NOT NULL) AS duration_mean FROM shown GROUP BY ROLLUP (run_scope)""",
    "runs",
)
def d14_queue_metrics(t: Tables):
    """Queue, time-outs, dead letters by state, success and durations of each scope, and of all (a null scope)."""
    state = F.when((F.col("status") == "running") & (F.col("retry_count") == 0), "queued").when((F.col("status") == "failed") & (F.col("retry_count") == 4), "dead_letter").otherwise(F.col("status"))
    return runs.queue_metrics(t.runs().withColumns({"state": state, "dead_state": F.when(F.col("run_id") % 2 == 0, "active").otherwise("resolved")}), now())


@query(
    f"""SELECT w.name AS "window", count(*) FILTER (finished_at >= TIMESTAMP '{NOW}' - to_hours(w.h) AND finished_at <= TIMESTAMP '{NOW}') AS runs, count(*) FILTER (status = 'completed' AND finished_at >= TIMESTAMP '{NOW}' - to_hours(w.h) AND finished_at <= TIMESTAMP '{NOW}') AS passed,
    passed / nullif(count(*) FILTER (finished_at >= TIMESTAMP '{NOW}' - to_hours(w.h) AND finished_at <= TIMESTAMP '{NOW}'), 0) AS success_rate FROM runs, (VALUES ('1h', 1), ('24h', 24), ('7d', 168), ('365d', 8760)) w(name, h) GROUP BY w.name""",
    "runs",
)
def d15_success_windows(t: Tables):
    return runs.success_windows(t.runs(), now(), {"1h": 1, "24h": 24, "7d": 168, "365d": 8760})


@query("SELECT status, provider, count(*) AS n, min(created_at) AS earliest FROM runs WHERE status <> 'completed' GROUP BY GROUPING SETS ((status), (status, provider))", "runs")
def d16_waiting_work(t: Tables):
    """Runs that are not done, by status, and by status and provider."""
    return runs.waiting(t.runs().where("status <> 'completed'"))


@query(
    """, bad AS (SELECT r.* FROM runs r LEFT JOIN (SELECT dataset_id, max(finished_at) AS last_ok FROM runs WHERE status = 'completed' GROUP BY ALL) o USING (dataset_id) WHERE status = 'failed' AND error_type IN ('TimeoutError', 'ConnectionError') AND (last_ok IS NULL OR finished_at > last_ok))
    SELECT *, last_failure + to_seconds(delay_s) AS retry_at FROM (SELECT dataset_id, count(*) AS streak, max(finished_at) AS last_failure, least(3600.0, 300.0 * pow(2.0, least(count(*) - 1, 30)))::BIGINT AS delay_s FROM bad GROUP BY ALL)""",
    "runs",
)
def d17_failure_backoff(t: Tables):
    return runs.failure_backoff(t.runs(), "dataset_id")


@query("SELECT code, part, supplier, count(*) AS occurrence_count, min(observed_at) AS first_observed_at, max(observed_at) AS last_observed_at, arg_min(run_id, observed_at::VARCHAR || lpad((quantity * 100)::BIGINT::VARCHAR, 12, '0') || lpad(run_id::VARCHAR, 20, '0')) AS first_run_id FROM findings GROUP BY ALL", "findings")
def d18_finding_dedupe(t: Tables):
    rows = t.findings().withColumn("tie", F.struct("quantity", "run_id"))
    return runs.dedupe_findings(rows, ["code", "part", "supplier"], "observed_at", "tie")


@query("SELECT state, count(*) AS n FROM (SELECT CASE WHEN part % 7 = 0 THEN 'acknowledged' WHEN part % 11 = 0 THEN 'resolved' ELSE 'open' END AS state FROM findings) GROUP BY state", "findings")
def c6_d19_finding_states(t: Tables):
    """Findings left-joined to recorded states; without one they are open."""
    states = t.table("part").select(F.col("p_partkey").alias("part"), F.when(F.col("p_partkey") % 7 == 0, "acknowledged").when(F.col("p_partkey") % 11 == 0, "resolved").alias("state")).where("state is not null")
    return t.findings().join(states, "part", "left").withColumn("state", F.coalesce("state", F.lit("open"))).groupBy("state").agg(F.count("*").alias("n"))


@query(
    """, steps AS (SELECT concat_ws('/', dataset_id, provider, strftime(created_at, '%Y-%m')) AS step, concat_ws('/', dataset_id, 'p' || ((substr(provider, 2)::INT + 1) % 4), strftime(created_at, '%Y-%m')) AS upstream,
      count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running FROM runs GROUP BY ALL)
    SELECT s.step, s.upstream, coalesce(s.completed, 0) AS completed, coalesce(s.failed, 0) AS failed, coalesce(s.running, 0) AS running, CASE WHEN s.failed > 0 THEN 'failed' WHEN s.running > 0 THEN 'running' WHEN s.completed > 0 AND coalesce(u.failed, 0) = 0 THEN 'completed' WHEN coalesce(u.failed, 0) > 0 THEN 'blocked' ELSE 'skipped' END AS state,
      CASE WHEN NOT (s.failed > 0 OR s.running > 0) AND coalesce(u.failed, 0) > 0 THEN 'upstream_failed' WHEN s.failed = 0 AND s.running = 0 AND s.completed = 0 THEN 'no_runs' END AS reason
    FROM steps s LEFT JOIN steps u ON u.step = s.upstream""",
    "runs",
)
def d20_step_states(t: Tables):
    """Steps of every month's plan with the step that each waits for: a failure upstream blocks one that has not failed itself."""
    number, month = (F.substring("provider", 2, 9).cast("int") + 1) % 4, F.date_format("created_at", "yyyy-MM")
    upstream = F.concat_ws("/", "dataset_id", F.concat(F.lit("p"), number.cast("string")), month)
    rows = t.runs().select(F.concat_ws("/", "dataset_id", "provider", month).alias("step"), upstream.alias("upstream"), "status")
    return runs.step_states(rows.select("step", "upstream").distinct(), rows.select("step", "status"))


@query(
    """SELECT r.dataset_id, max(w.e) FILTER (status = 'completed' AND run_kind = 'ingest') AS boundary FROM runs r LEFT JOIN planned w ON w.window_id = r.run_id GROUP BY r.dataset_id""",
    "runs", "planned",
)
def d21_publication_boundary(t: Tables):
    """The furthest end of the windows that completed raw runs have covered."""
    rows = t.runs().join(t.windows("planned").select(F.col("window_id").alias("run_id"), "end"), "run_id", "left")
    done = (F.col("status") == "completed") & (F.col("run_kind") == "ingest")
    return rows.groupBy("dataset_id").agg(F.max(F.when(done, F.col("end"))).alias("boundary"))


@query("SELECT run_kind, quantile_cont(duration_s::DOUBLE, 0.95) AS p95, sum(duration_s)::BIGINT AS total, max(duration_s) AS longest FROM runs GROUP BY run_kind", "runs")
def d22_latency(t: Tables):
    rows = t.runs()
    p95 = ranges.quantiles(rows, ["run_kind"], "duration_s", 0.95).select("run_kind", F.col("quantile").alias("p95"))
    return rows.groupBy("run_kind").agg(F.sum("duration_s").alias("total"), F.max("duration_s").alias("longest")).join(p95, "run_kind", "left")


@query(
    """SELECT dataset_id, day, failed, total, failed - lag(failed) OVER w AS failed_delta, total - lag(total) OVER w AS total_delta FROM (SELECT dataset_id, date_trunc('month', created_at) AS day, count(*) FILTER (status = 'failed') AS failed, count(*) AS total FROM runs GROUP BY ALL) WINDOW w AS (PARTITION BY dataset_id ORDER BY day)""",
    "runs",
)
def d24_failure_deltas(t: Tables):
    w = Window.partitionBy("dataset_id").orderBy("day")
    samples = t.runs().groupBy("dataset_id", F.date_trunc("month", "created_at").alias("day")).agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("total"))
    return samples.withColumns({"failed_delta": F.col("failed") - F.lag("failed").over(w), "total_delta": F.col("total") - F.lag("total").over(w)})


@query(
    """SELECT dataset_id, CASE WHEN bool_or(outcome = 'failed') THEN 'failed' WHEN bool_or(outcome = 'degraded') THEN 'degraded' ELSE 'pass' END AS outcome, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'degraded') AS degraded, count(*) AS targets
    FROM (SELECT dataset_id, provider, run_kind, CASE WHEN count(*) FILTER (status = 'failed') * 2 > count(*) THEN 'failed' WHEN bool_or(status = 'running') THEN 'degraded' ELSE 'pass' END AS outcome FROM runs GROUP BY ALL) GROUP BY dataset_id""",
    "runs",
)
def d28_outcome_rollup(t: Tables):
    """Runs to targets, and targets to data sets."""
    failed = F.count_if(F.col("status") == "failed") * 2 > F.count("*")
    targets = t.runs().groupBy("dataset_id", "provider", "run_kind").agg(F.when(failed, "failed").when(F.bool_or(F.col("status") == "running"), "degraded").otherwise("pass").alias("outcome"))
    bad, weak = F.count_if(F.col("outcome") == "failed"), F.count_if(F.col("outcome") == "degraded")
    return targets.groupBy("dataset_id").agg(F.when(bad > 0, "failed").when(weak > 0, "degraded").otherwise("pass").alias("outcome"), bad.alias("failed"), weak.alias("degraded"), F.count("*").alias("targets"))


@query("SELECT run_id, dataset_id, provider, status, created_at FROM runs WHERE status = 'failed' AND provider = 'p1' AND created_at BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1999-01-01'", "runs")
def b13_run_filter(t: Tables):
    rows = t.runs().where((F.col("status") == "failed") & (F.col("provider") == "p1") & F.col("created_at").between(F.lit("1998-01-01").cast("timestamp"), F.lit("1999-01-01").cast("timestamp")))
    return rows.select("run_id", "dataset_id", "provider", "status", "created_at")


@query("SELECT code, part, run_id, observed_at, quantity FROM findings WHERE severity = 'error' AND code = 'missing_bars' AND observed_at::DATE BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'", "findings")
def b14_finding_filter(t: Tables):
    rows = t.findings().where((F.col("severity") == "error") & (F.col("code") == "missing_bars") & F.to_date("observed_at").between("1997-01-01", "1998-12-31"))
    return rows.select("code", "part", "run_id", "observed_at", "quantity")


@query(
    """, RECURSIVE chain AS (SELECT run_id, run_id AS root, 0 AS depth FROM runs WHERE retry_of IS NULL UNION ALL SELECT r.run_id, c.root, c.depth + 1 FROM runs r JOIN chain c ON r.retry_of = c.run_id) SELECT run_id, root, depth, false AS cycle FROM chain""",
    "runs",
)
def c13_retry_chains(t: Tables):
    return runs.retry_roots(t.runs(), shared_dir(t.spark))


@query(
    """, RECURSIVE numbered AS (SELECT o_orderkey AS run_id, o_custkey, o_orderdate AS created_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders),
    tree AS (SELECT n.run_id, n.created_at, p.run_id AS retry_of FROM numbered n LEFT JOIN numbered p ON p.o_custkey = n.o_custkey AND p.k = n.k // 2),
    chain AS (SELECT run_id, run_id AS root, 0 AS depth, [(created_at, run_id)] AS path FROM tree WHERE retry_of IS NULL UNION ALL SELECT t.run_id, c.root, c.depth + 1, list_append(c.path, (t.created_at, t.run_id)) FROM tree t JOIN chain c ON t.retry_of = c.run_id)
    SELECT run_id, root, depth, row_number() OVER (PARTITION BY root ORDER BY depth, path) - 1 AS place, CASE depth WHEN 0 THEN 'origin' ELSE 'retry' END AS relation FROM chain""",
    "runs",
)
def c13_retry_order(t: Tables):
    """Orders of each customer as a tree of retries, two for each run, breadth first."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    rows = t.table("orders").select(F.col("o_orderkey").alias("run_id"), "o_custkey", F.col("o_orderdate").alias("created_at"), F.row_number().over(w).alias("k"))
    above = rows.select(F.col("run_id").alias("retry_of"), "o_custkey", F.col("k").alias("half"))
    tree = rows.withColumn("half", F.floor(F.col("k") / 2)).join(above, ["o_custkey", "half"], "left")
    return runs.retry_order(tree, shared_dir(t.spark)).select("run_id", "root", "depth", "place", "relation")


@query("SELECT run_id, dataset_id FROM runs WHERE status = 'failed' AND run_id NOT IN (SELECT run_id FROM findings)", "runs", "findings")
def c7_undelivered(t: Tables):
    """Failed runs that no finding reports."""
    return t.runs().where("status = 'failed'").join(t.findings().select("run_id"), "run_id", "left_anti").select("run_id", "dataset_id")


@query("SELECT dataset_id, created_at, run_id, status, generation FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY created_at, run_id) AS generation FROM (SELECT *, lag(status) OVER (PARTITION BY dataset_id ORDER BY created_at, run_id) AS previous FROM runs) WHERE previous IS NULL OR previous <> status)", "runs")
def e9_transitions(t: Tables):
    rows = t.runs().withColumns({"at": F.struct("created_at", "run_id"), "day": F.to_date("created_at")})
    return runs.transitions(rows, ["dataset_id"], "at", "status", "day").select("dataset_id", "created_at", "run_id", "status", "generation")


@query("SELECT dataset_id, run_id, created_at, status, rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, run_id DESC) AS rank FROM runs) WHERE rank <= 5", "runs")
def e11_latest_per_action(t: Tables):
    w = Window.partitionBy("dataset_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    return t.runs().withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").select("dataset_id", "run_id", "created_at", "status", "rank")


@query("SELECT DISTINCT dataset_id, date_trunc('hour', created_at) AS hour, error_type FROM runs WHERE status = 'failed'", "runs")
def e12_hourly_alerts(t: Tables):
    return t.runs().where("status = 'failed'").select("dataset_id", F.date_trunc("hour", "created_at").alias("hour"), "error_type").dropDuplicates()


@query("SELECT run_id, created_at, status FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 200", "runs")
def f4_newest_runs(t: Tables):
    return t.runs().select("run_id", "created_at", "status").orderBy(F.desc("created_at"), F.desc("run_id")).limit(200)


@query("SELECT error_type, provider, count(*) AS n FROM runs WHERE status = 'failed' GROUP BY ALL ORDER BY n DESC, error_type, provider LIMIT 20", "runs")
def f5_top_failures(t: Tables):
    return t.runs().where("status = 'failed'").groupBy("error_type", "provider").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_type", "provider").limit(20)


@query("SELECT dataset_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, run_id DESC) AS k FROM runs WHERE run_scope = 'repair') WHERE k <= 50", "runs")
def f7_newest_recomputes(t: Tables):
    w = Window.partitionBy("dataset_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    return t.runs().where("run_scope = 'repair'").withColumn("k", F.row_number().over(w)).where("k <= 50").select("dataset_id", "run_id")


@query(
    """SELECT run_id, CASE error_type WHEN 'TimeoutError' THEN 'timeout' WHEN 'RateLimited' THEN 'http' WHEN 'ValidationError' THEN 'contract' WHEN 'SchemaError' THEN 'contract' ELSE CASE WHEN http IS NULL THEN 'internal' ELSE 'http' END END AS category,
    error_type = 'TimeoutError' OR (error_type IN ('RateLimited', 'Other') AND coalesce(http >= 500, false)) AS retryable,
    CASE WHEN status = 'completed' THEN 'published' WHEN run_kind = 'derive' THEN 'not_applicable' ELSE 'missing' END AS manifest
    FROM (SELECT *, CASE run_id % 4 WHEN 0 THEN 404 WHEN 1 THEN 503 END AS http FROM runs) WHERE status = 'failed'""",
    "runs",
)
def h13_h25_failures(t: Tables):
    manifest = F.when(F.col("status") == "completed", "published").when(F.col("run_kind") == "derive", "not_applicable").otherwise("missing")
    rows = t.runs().where("status = 'failed'").withColumn("http", F.when(F.col("run_id") % 4 == 0, 404).when(F.col("run_id") % 4 == 1, 503))
    error = F.col("error_type"), F.col("http")
    return rows.select("run_id", ftext.failure_category(*error).alias("category"), ftext.retryable(*error).alias("retryable"), manifest.alias("manifest"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal / 10000 < 0.05 THEN 'critical' WHEN s_acctbal / 10000 < 0.15 THEN 'warning' ELSE 'ok' END AS capacity FROM supplier")
def h14_capacity(t: Tables):
    return t.table("supplier").select("s_suppkey", ftext.capacity_class(F.col("s_acctbal") / 10000).alias("capacity"))


@query("""SELECT conv_id, turn, left(CASE turn % 3 WHEN 0 THEN 'failed with token=<redacted> ' WHEN 1 THEN '{"Api-Key": <redacted>, "n": 1} ' ELSE 'Authorization: <redacted> ' END || replace(text, ':', ' '), 240) AS summary FROM conversations""")
def h12_redaction(t: Tables):
    """Secrets after an equals sign, as a quoted value in JSON, and behind the name of their scheme."""
    value = F.concat(F.lit("x"), F.hash("text").cast("string"))
    before = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("failed with token="), value, F.lit(" "))).when(F.col("turn") % 3 == 1, F.concat(F.lit('{"Api-Key": "a \\"b, '), value, F.lit('", "n": 1} ')))
    text = F.concat(F.coalesce(before, F.concat(F.lit("Authorization: Bearer "), value, F.lit(" "))), F.translate("text", ":", " "))
    return t.table("conversations").select("conv_id", "turn", ftext.redact(text).alias("summary"))


@query(
    r"""SELECT run_id, sha256('{"dataset":"' || dataset_id || '\\\"\n","flags":[true,' || (retry_of IS NULL)::VARCHAR || '],"plan":{"attempt":' || retry_count || ',"scope":"' || run_scope || '\u00e9\ud83d\ude42"},"price":' || rows_written || ',"retry_of":' || coalesce(retry_of::VARCHAR, 'null') || '}') AS digest FROM runs""",
    "runs",
)
def h8_config_digest(t: Tables):
    """Digests of nested settings with quotes, line ends, characters beyond ASCII, numbers and nulls."""
    first = F.col("retry_of").isNull()
    rows = t.runs().select("run_id", F.struct(
        F.col("rows_written").alias("price"), F.concat("dataset_id", F.lit('\\"\n')).alias("dataset"), F.col("retry_of"), F.array(F.lit(True), first).alias("flags"),
        F.struct(F.concat("run_scope", F.lit("é🙂")).alias("scope"), F.col("retry_count").alias("attempt")).alias("plan"),
    ).alias("settings"))
    return rows.select("run_id", ftext.config_digest(F.col("settings"), rows.schema["settings"].dataType).alias("digest"))


@query("SELECT dataset_id, run_kind, date_trunc('month', created_at) AS month, CASE WHEN count(DISTINCT error_type) = 0 THEN 'unknown' WHEN count(DISTINCT error_type) = 1 THEN min(error_type) ELSE 'mixed' END AS label FROM runs GROUP BY ALL", "runs")
def h21_version_label(t: Tables):
    return t.runs().groupBy("dataset_id", "run_kind", F.date_trunc("month", "created_at").alias("month")).agg(ftext.label_of(F.collect_set("error_type")).alias("label"))


SYMBOLS = "CASE s_suppkey % 4 WHEN 0 THEN 'eurusd' WHEN 1 THEN ' GBP/JPY ' WHEN 2 THEN 'btc-usd' ELSE 'bad' END"


@query(f"SELECT s_suppkey, CASE WHEN length(c) = 6 THEN substr(c, 1, 3) END AS base, CASE WHEN length(c) = 6 THEN substr(c, 4, 3) END AS quote FROM (SELECT s_suppkey, regexp_replace(upper(trim({SYMBOLS})), '[/_-]', '', 'g') AS c FROM supplier)")
def h10_symbols(t: Tables):
    base, quote = ftext.split_symbol(F.expr(SYMBOLS))
    return t.table("supplier").select("s_suppkey", base.alias("base"), quote.alias("quote"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 2 THEN o_orderdate END AS instant FROM orders""")
def h5_instants(t: Tables):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(stamp, F.lit("Z"))).when(F.col("o_orderkey") % 3 == 1, F.concat(stamp, F.lit("+00:00"))).otherwise(stamp)
    return t.table("orders").select("o_orderkey", ft.parse_instant(text).alias("instant"))


@query('SELECT task_id, s AS start, e AS "end" FROM busy', "busy")
def e7_merged_windows(t: Tables):
    return windows.merged(t.windows("planned"), ["task_id"])


@query(
    """, pieces AS (SELECT c.task_id, c.window_id, c.s, c.e, b.s AS bs, b.e AS be FROM candidate c LEFT JOIN busy b ON b.task_id = c.task_id AND b.s < c.e AND c.s < b.e), cuts AS (
      SELECT task_id, window_id, coalesce(lag(be) OVER (PARTITION BY task_id, window_id ORDER BY bs), s) AS f, coalesce(bs, e) AS u FROM pieces UNION ALL
      SELECT task_id, window_id, max(be) AS f, any_value(e) AS u FROM pieces WHERE be IS NOT NULL GROUP BY task_id, window_id)
    SELECT task_id, window_id, f AS start, u AS "end", row_number() OVER (PARTITION BY task_id ORDER BY f, u, window_id) - 1 AS ordinal FROM cuts WHERE f < u""",
    "busy", "candidate",
)
def c5_interval_subtraction(t: Tables):
    return windows.subtract(t.windows("candidate"), t.windows("planned"), ["task_id"], ["window_id"])


@query('SELECT DISTINCT c.task_id, c.window_id, c.s AS start, c.s + INTERVAL 1 DAY AS "end" FROM candidate c JOIN busy b ON b.task_id = c.task_id AND b.s <= c.s AND c.s + INTERVAL 1 DAY <= b.e', "busy", "candidate")
def c4_interval_containment(t: Tables):
    requests = t.windows("candidate").withColumn("end", F.col("start") + F.expr("interval 1 day"))
    return windows.contained(requests, windows.merged(t.windows("planned"), ["task_id"]), ["task_id"], ["window_id"])


@query('SELECT c.task_id, c.window_id, c.s AS start, c.e AS "end", count(*) AS overlaps FROM candidate c JOIN planned p ON p.task_id = c.task_id AND p.s < c.e AND c.s < p.e AND p.window_id > c.window_id GROUP BY ALL', "planned", "candidate")
def c3_overlap_join(t: Tables):
    """Derived windows that a later window of the same task overlaps."""
    hit = windows.overlapping(t.windows("candidate"), t.windows("planned"), ["task_id"]).where("r_window_id > window_id")
    return hit.groupBy("task_id", "window_id", "start", "end").agg(F.count("*").alias("overlaps"))


@query(
    """, parts AS (SELECT task_id, unnest(generate_series(s, e - INTERVAL 1 MICROSECOND, to_days(days))) AS p, e, days FROM (SELECT b.*, least(c_custkey % 3 + 1, 2)::INT AS days FROM busy b JOIN customer ON task_id = 'task-' || c_custkey))
    SELECT task_id, p AS start, least(e, p + to_days(days)) AS "end", row_number() OVER (PARTITION BY task_id ORDER BY p) - 1 AS ordinal FROM parts""",
    "busy",
)
def j15_sharded_windows(t: Tables):
    """Windows no longer than the policy of their task and the provider allow."""
    key = F.col("c_custkey")
    limits = t.table("customer").select(F.concat(F.lit("task-"), key.cast("string")).alias("task_id"), (key % 3 + 1).alias("policy_days"), F.lit(2).cast("long").alias("capability_days"))
    return windows.clamped(windows.merged(t.windows("planned"), ["task_id"]), limits, ["task_id"], ["task_id"])


@query("""SELECT task_id, window_id, date_trunc('week', s - INTERVAL 3 DAY) AS start, CASE WHEN date_trunc('week', e) < e THEN date_trunc('week', e) + INTERVAL 7 DAY ELSE e END AS "end" FROM candidate""", "candidate")
def j4_recompute_windows(t: Tables):
    return windows.recompute(t.windows("candidate"), "1w", "3 days")


@query(
    """SELECT task_id, window_id, u.s AS start, u.e AS "end", u.part AS part FROM (SELECT task_id, window_id, unnest([{'s': s, 'e': m, 'part': 'before'}, {'s': m, 'e': least(m + INTERVAL 1 HOUR, e), 'part': 'missing'}, {'s': least(m + INTERVAL 1 HOUR, e), 'e': e, 'part': 'after'}]) AS u FROM (SELECT *, s + to_hours(window_id % 48) AS m FROM candidate)) WHERE u.s < u.e""",
    "candidate",
)
def j7_split_windows(t: Tables):
    rows = t.windows("candidate").withColumn("missing", F.col("start") + F.make_dt_interval(hours=(F.col("window_id") % 48).cast("int")))
    return windows.split_at(rows, "missing", 3600).select("task_id", "window_id", "start", "end", "part")


@query("SELECT coalesce(o.task_id, n.task_id) AS task_id, coalesce(o.s, n.s) AS start, greatest(o.a, n.a) AS attempts, coalesce(n.r, o.r) AS next_review FROM (SELECT task_id, s, max(window_id % 7) AS a, max(e) AS r FROM planned GROUP BY ALL) o FULL JOIN (SELECT task_id, s, max(window_id % 5) AS a, max(CASE WHEN window_id % 2 = 1 THEN e END) AS r FROM candidate GROUP BY ALL) n ON o.task_id = n.task_id AND o.s = n.s", "planned", "candidate")
def j11_debt_merge(t: Tables):
    old = t.windows("planned").groupBy("task_id", "start").agg(F.max(F.col("window_id") % 7).alias("attempts"), F.max("end").alias("next_review"))
    new = t.windows("candidate").groupBy("task_id", "start").agg(F.max(F.col("window_id") % 5).alias("attempts"), F.max(F.when(F.col("window_id") % 2 == 1, F.col("end"))).alias("next_review"))
    return windows.debt_merge(old, new, ["task_id", "start"])


OWED = """, owed AS (SELECT task_id, s, e, max(window_id % 7) AS attempts, max(CASE WHEN window_id % 3 > 0 THEN e END) AS next_review FROM candidate GROUP BY ALL)"""


def _owed(t: Tables):
    review = F.max(F.when(F.col("window_id") % 3 > 0, F.col("end"))).alias("next_review")
    return t.windows("candidate").groupBy("task_id", "start", "end").agg(F.max(F.col("window_id") % 7).alias("attempts"), review)


@query(OWED + """ SELECT task_id, s AS start, e AS "end", attempts, next_review FROM owed o WHERE NOT EXISTS (SELECT 1 FROM planned p WHERE p.task_id = o.task_id AND p.s <= o.s AND o.e <= p.e)""", "planned", "candidate")
def j11_debt_resolve(t: Tables):
    """Debt that no window done since holds as a whole."""
    return windows.resolved(_owed(t), t.windows("planned"), ["task_id"]).select("task_id", "start", "end", "attempts", "next_review")


@query(OWED + f""" SELECT task_id, s AS start, e AS "end", CASE WHEN next_review > TIMESTAMP '{NOW}' - INTERVAL 900 DAY THEN 'cooling' ELSE 'due' END AS state FROM owed""", "candidate")
def j11_debt_due(t: Tables):
    """Debt that is to be reviewed now, and debt that has been put off."""
    at, debt = now() - F.expr("interval 900 day"), _owed(t)
    state = lambda df, s: df.select("task_id", "start", "end", F.lit(s).alias("state"))
    return state(windows.due(debt, at), "due").unionByName(state(windows.put_off(debt, at), "cooling"))


@query('SELECT task_id, window_id, s AS start, e AS "end", priority, rank, truncated FROM (SELECT *, window_id % 4 AS priority, row_number() OVER (PARTITION BY task_id ORDER BY window_id % 4, s, e, window_id) AS rank, count(*) OVER (PARTITION BY task_id) > 8 AS truncated FROM candidate) WHERE rank <= 8', "candidate")
def f6_budgeted_windows(t: Tables):
    return windows.budgeted(t.windows("candidate").withColumn("priority", F.col("window_id") % 4), ["task_id"], 8)


@query(
    """, planted AS (SELECT task_id, s, CASE WHEN dayofmonth(s) = 13 THEN s ELSE e END AS e, row_number() OVER w - 1 + CASE WHEN dayofmonth(s) = 17 THEN 1 ELSE 0 END AS ordinal, min(s) OVER (PARTITION BY task_id) + CASE WHEN length(task_id) = 7 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS js, max(e) OVER (PARTITION BY task_id) AS je, length(task_id) % 2 = 0 AS repair FROM busy WINDOW w AS (PARTITION BY task_id ORDER BY s))
    SELECT task_id, bool_or(s < js OR e > je) AS outside, bool_or(s >= e) AS empty, coalesce(bool_or(s < prev), false) AS disordered, bool_or(ordinal <> k) AS ordinals, NOT bool_or(repair) AND (min(s) > min(js) OR max(e) < max(je) OR coalesce(bool_or(s > prev), false)) AS uncovered, NOT (outside OR empty OR disordered OR ordinals OR uncovered) AS valid
    FROM (SELECT *, row_number() OVER w - 1 AS k, lag(e) OVER w AS prev FROM planted WINDOW w AS (PARTITION BY task_id ORDER BY ordinal, s)) GROUP BY task_id""",
    "busy",
)
def i9_execution_windows(t: Tables):
    """Jobs with planted faults: empty windows, ordinals that skip, and jobs that begin after their first window."""
    rows = windows.sharded(windows.merged(t.windows("planned"), ["task_id"]), ["task_id"], "3650 days")
    w, day, length = Window.partitionBy("task_id"), F.dayofmonth("start"), F.length("task_id")
    bounds = {"job_start": F.min("start").over(w) + F.make_dt_interval(F.when(length == 7, 1).otherwise(0)), "job_end": F.max("end").over(w), "gap_repair": length % 2 == 0}
    rows = rows.withColumns(bounds).withColumns({"end": F.when(day == 13, F.col("start")).otherwise(F.col("end")), "ordinal": F.col("ordinal") + F.when(day == 17, 1).otherwise(0)})
    return windows.check_execution(rows, ["task_id"])


@query(
    """SELECT n_name AS nation, s.symbol, timeframe, basis, CASE WHEN b.n IS NULL OR basis <> 'bid' OR timeframe = '15m' THEN 'unavailable' WHEN o.owners IS NULL THEN 'unplanned' WHEN o.owners > 5 THEN 'config_drift' ELSE 'planned' END AS status,
    CASE WHEN b.n IS NULL THEN 'no_bars' WHEN basis <> 'bid' THEN 'basis_not_held' WHEN timeframe = '15m' THEN 'no_recipe' END AS reason, coalesce(b.n, 0) AS bars, coalesce(o.owners, 0) AS owners
    FROM nation, (SELECT DISTINCT symbol FROM bars UNION SELECT 'none') s, (VALUES ('1h'), ('1d'), ('15m')) f(timeframe), (VALUES ('bid'), ('ask')) p(basis) LEFT JOIN (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol) b ON b.symbol = s.symbol
    LEFT JOIN (SELECT s_nationkey, count(*) AS owners FROM supplier WHERE s_acctbal > 5000 GROUP BY ALL) o ON o.s_nationkey = n_nationkey""",
    "bars",
)
def c11_availability_matrix(t: Tables):
    """Every cell of a few small dimensions, joined to what the bars hold, which recipes reach, and who owns it."""
    held = t.bars().groupBy("symbol").agg(F.count("*").alias("n"))
    symbols = held.select("symbol").unionByName(t.spark.range(1).select(F.lit("none").alias("symbol")))
    owners = t.table("supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("owners"))
    made = ["1h", *[r.target for r in derive.RECIPES.values() if r.source == "1h"]]
    some = lambda *xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    cells = t.table("nation").crossJoin(symbols).withColumn("timeframe", some("1h", "1d", "15m")).withColumn("basis", some("bid", "ask"))
    cells = cells.join(held, "symbol", "left").join(owners, "n_nationkey", "left")
    reason = F.when(F.col("n").isNull(), "no_bars").when(F.col("basis") != "bid", "basis_not_held").when(~F.col("timeframe").isin(made), "no_recipe")
    status = F.when(reason.isNotNull(), "unavailable").when(F.col("owners").isNull(), "unplanned").when(F.col("owners") > 5, "config_drift").otherwise("planned")
    return cells.select(F.col("n_name").alias("nation"), "symbol", "timeframe", "basis", status.alias("status"), reason.alias("reason"), F.coalesce("n", F.lit(0)).alias("bars"), F.coalesce("owners", F.lit(0)).alias("owners"))


@query(
    """SELECT p_partkey, CASE WHEN days <= 0 THEN 'invalid_window' WHEN days > 31 THEN 'window_exceeds_31_days' WHEN free IS NOT NULL AND free < 0.15 THEN 'capacity_not_ok' WHEN p_partkey % 7 = 0 THEN 'bid_provenance_unconfirmed' WHEN p_partkey % 11 IN (0, 1) THEN 'legacy_price_basis_not_bid' WHEN p_partkey % 13 = 0 THEN 'duplicate_timestamps' WHEN p_partkey % 17 = 0 THEN 'invalid_timestamps' ELSE 'all_migration_gates_pass' END AS decision,
    CASE WHEN days BETWEEN 1 AND 31 AND (free IS NULL OR free >= 0.15) AND p_partkey % 7 <> 0 AND p_partkey % 11 > 1 AND p_partkey % 13 <> 0 AND p_partkey % 17 <> 0 THEN 'ready' ELSE 'rejected' END AS state
    FROM (SELECT p_partkey, p_size - 3 AS days, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 100) / 100.0 END AS free FROM part)"""
)
def h18_migration_decisions(t: Tables):
    """Seven gates in their order for an item and a window each."""
    key, start = F.col("p_partkey"), F.lit("2024-01-01").cast("date")
    types = F.when(key % 11 == 0, F.array(F.lit("ask"))).when(key % 11 == 1, F.array(F.lit("ask"), F.lit("bid"))).otherwise(F.array(F.lit("bid")))
    count = lambda m: F.when(key % m == 0, 2).otherwise(0)
    decision = inventory.migration_decision(start, F.date_add(start, (F.col("p_size") - 3).cast("int")), F.when(key % 5 != 0, key % 100 / 100.0), key % 7 != 0, types, count(13), count(17))
    return t.table("part").select("p_partkey", decision.alias("decision"), F.when(decision == "all_migration_gates_pass", "ready").otherwise("rejected").alias("state"))


@query(
    """SELECT symbol, n, CASE WHEN symbol <> 'click' AND symbol <> 'view' THEN sha256(symbol || '|' || n || '|bid|ledger|ann|2024-01-01') END AS attestation, CASE symbol WHEN 'click' THEN 'basis_not_bid' WHEN 'view' THEN 'incomplete' ELSE 'attested' END AS state FROM (SELECT symbol, count(*)::VARCHAR AS n FROM bars GROUP BY symbol)""",
    "bars",
)
def h19_attestation(t: Tables):
    """An attestation counts only when it is complete and of bid prices."""
    rows = t.bars().groupBy("symbol").agg(F.count("*").cast("string").alias("n"))
    by = {"basis": F.when(F.col("symbol") == "click", "ask").otherwise("bid"), "method": F.lit("ledger"), "attested_by": F.when(F.col("symbol") != "view", "ann"), "attested_at": F.lit("2024-01-01")}
    return rows.withColumns(by).select("symbol", "n", inventory.attestation(["symbol", "n"]).alias("attestation"), inventory.attestation_state().alias("state"))


@query(
    f"""SELECT * FROM (SELECT task_id, watermark, greatest(coalesce(watermark, TIMESTAMP '{NOW}' - INTERVAL 30 DAY), TIMESTAMP '{NOW}' - INTERVAL 180 MINUTE - INTERVAL 400 DAY) AS start, TIMESTAMP '{NOW}' - INTERVAL 180 MINUTE AS "end"
      FROM (SELECT 'task-' || c_custkey AS task_id, max(e) AS watermark FROM customer LEFT JOIN planned ON task_id = 'task-' || c_custkey GROUP BY ALL)) WHERE start < "end\"""",
    "planned",
)
def j2_tail_windows(t: Tables):
    """From each task's watermark, or some days back for customers without orders, clamped to a longest window and the closed lag."""
    tasks = t.table("customer").select(F.concat(F.lit("task-"), F.col("c_custkey").cast("string")).alias("task_id"))
    marks = tasks.join(t.windows("planned").groupBy("task_id").agg(F.max("end").alias("watermark")), "task_id", "left")
    return planner.bounded_tail(marks, now(), 30, "180 minute", "400 day")


DEBT = """, failed AS (SELECT c.*, CASE error_type WHEN 'TimeoutError' THEN 'gap' WHEN 'ValidationError' THEN 'coverage' WHEN 'Other' THEN 'coverage' ELSE 'none' END AS error, finished_at FROM candidate c JOIN runs ON run_id = window_id WHERE status = 'failed'),
    ready AS (SELECT task_id, s, e FROM planned JOIN runs ON run_id = window_id WHERE status = 'completed'),
    merged AS (SELECT task_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY task_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY task_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM ready)) GROUP BY task_id, run),
    pieces AS (SELECT c.task_id, c.window_id, c.s, c.e, b.s AS bs, b.e AS be FROM failed c LEFT JOIN merged b ON b.task_id = c.task_id AND b.s < c.e AND c.s < b.e WHERE error = 'coverage'),
    cuts AS (SELECT task_id, window_id, coalesce(lag(be) OVER (PARTITION BY task_id, window_id ORDER BY bs), s) AS f, coalesce(bs, e) AS u FROM pieces UNION ALL SELECT task_id, window_id, max(be) AS f, any_value(e) AS u FROM pieces WHERE be IS NOT NULL GROUP BY task_id, window_id),
    debt AS (SELECT task_id, window_id, f AS start, u AS "end" FROM cuts WHERE f < u UNION SELECT task_id, window_id, s, e FROM failed WHERE error = 'gap')"""


def _debt(t: Tables):
    run = t.runs().select(F.col("run_id").alias("window_id"), "status", "error_type", "finished_at")
    error = F.when(F.col("error_type") == "TimeoutError", "gap").when(F.col("error_type").isin("ValidationError", "Other"), "coverage").otherwise("none")
    failed = t.windows("candidate").join(run.where("status = 'failed'"), "window_id").withColumn("error", error)
    ready = t.windows("planned").join(run.where("status = 'completed'"), "window_id", "left_semi")
    return windows.gap_debt(failed, ready, ["task_id"], ["window_id"]).join(run.select("window_id", "finished_at"), "window_id")


@query(DEBT + ' SELECT task_id, window_id, start, "end" FROM debt', "planned", "candidate", "runs")
def j5_gap_debt(t: Tables):
    """What failed runs owe: all of a provider's gaps, and of coverage findings what no completed run of the task holds."""
    return _debt(t).select("task_id", "window_id", "start", "end")


@query(DEBT + f""" SELECT task_id, window_id, start, "end" FROM debt JOIN runs ON run_id = window_id WHERE finished_at >= TIMESTAMP '{NOW}' - to_minutes(525600)""", "planned", "candidate", "runs")
def j6_cooldown(t: Tables):
    """The debt of runs that ended within the last year: too fresh to be tried again."""
    return windows.cooling(_debt(t), "finished_at", now(), 525_600).select("task_id", "window_id", "start", "end")


@query("SELECT symbol, bar_ts, 'lineage_incomplete' AS code FROM bars WHERE hour(bar_ts) % 6 = 0", "bars")
def i8_lineage_complete(t: Tables):
    rows = t.bars().withColumn("input_snapshot_id", F.when(F.hour("bar_ts") % 6 != 0, F.col("source_hash")).otherwise(" "))
    return quality.lineage_violations(rows, ("source_hash", "input_snapshot_id")).select("symbol", "bar_ts", "code")


@query("SELECT n_name, s_suppkey, s_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier JOIN nation ON n_nationkey = s_nationkey) WHERE k = 1")
def c1_inner_join(t: Tables):
    rows = t.table("supplier").join(F.broadcast(t.table("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return ranked_first(rows, ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")]).select("n_name", "s_suppkey", "s_acctbal")
