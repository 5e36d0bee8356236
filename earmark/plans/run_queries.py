"""Analysis of logs and progress over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earmark.functions.keys import file_suffix
from earmark.operators import runs
from earmark.plans import standins as s
from earmark.plans.registry import query, table
from earmark.session import pin


@query("A22", sql="WITH " + s.TRAINING_LOG + """, u AS (SELECT run, epoch, coalesce(checkpoint_metric, val_similarity, train_similarity) AS m FROM training_log),
b AS (SELECT run, epoch, m FROM u QUALIFY row_number() OVER (PARTITION BY run ORDER BY m DESC, epoch) = 1),
rec AS (SELECT 'run' || doc_id AS run, doc_id AS e, toxic / 2.0::DOUBLE AS sim FROM labels WHERE quality = 1)
SELECT coalesce(b.run, rec.run) AS run, coalesce(e, epoch) AS best_epoch, round(coalesce(sim, m), 8) AS best_metric FROM b FULL JOIN rec ON b.run = rec.run""")
def best_epochs(spark: SparkSession, folder: str) -> DataFrame:
    """Best epoch per run, from a completion record where there is one."""
    records = table(spark, folder, "labels").filter(F.col("quality") == 1).select(
        F.concat(F.lit("run"), "doc_id").alias("run"), F.col("doc_id").alias("best_epoch"), (F.col("toxic") / 2).alias("best_similarity"))
    return runs.best_epoch(s.training_log(spark, folder), "run", records).withColumn("best_metric", F.round("best_metric", 8))


@query("A22", sql="WITH " + s.TRAINING_LOG + """
SELECT run, epoch AS best_epoch, val_similarity AS best_metric FROM training_log
QUALIFY row_number() OVER (PARTITION BY run ORDER BY val_similarity DESC, epoch) = 1""")
def best_validation_epochs(spark: SparkSession, folder: str) -> DataFrame:
    """Best epoch per run by validation similarity alone."""
    return runs.best_epoch(s.training_log(spark, folder), "run", monitor="val_similarity")


_COMPLETE = s.TRAINING_LOG + """, last AS (SELECT run, user_id, max(epoch) AS last_epoch, arg_max(event_type, epoch) AS t FROM training_log GROUP BY 1, 2),
flagged AS (SELECT 'run' || doc_id AS run FROM labels WHERE toxic = 1),
done AS (SELECT run, user_id, last_epoch, (last_epoch >= 5 AND t <> 'view') OR run IN (SELECT run FROM flagged) AS complete FROM last)"""


def _complete(spark: SparkSession, folder: str) -> DataFrame:
    log = s.training_log(spark, folder)
    log = log.withColumn("val_similarity", F.when(F.col("event_type") != "view", F.col("val_similarity")))
    users = log.select("run").distinct()
    flagged = table(spark, folder, "labels").filter(F.col("toxic") == 1).select(F.concat(F.lit("run"), "doc_id").alias("run")).join(users, "run", "left_semi")
    return runs.run_complete(log, "run", flagged)


@query("A23", sql="WITH " + _COMPLETE + " SELECT run, last_epoch, complete FROM done")
def run_completeness(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each run finished."""
    return _complete(spark, folder)


@query("A23", sql="WITH " + _COMPLETE + """
SELECT 'group' || (user_id % 7) AS group_id, count(*) FILTER (WHERE complete) AS n_complete, count(*) AS n_total,
       CASE WHEN count(*) FILTER (WHERE complete) = count(*) THEN 'done' WHEN count(*) FILTER (WHERE complete) > 0 THEN 'partial' ELSE 'pending' END AS status
FROM done GROUP BY 1""")
def run_group_status(spark: SparkSession, folder: str) -> DataFrame:
    """State of groups of runs."""
    rows = _complete(spark, folder).withColumn("group_id", F.concat(F.lit("group"), F.regexp_extract("run", r"\d+", 0).cast("int") % 7))
    return runs.group_state(rows, "group_id")


@query("A24", sql="WITH " + s.METRICS + """, present AS (SELECT DISTINCT dataset, arm, seed FROM metrics WHERE NOT (dataset = 'N' AND arm = 'home')),
d AS (SELECT unnest(['A', 'N', 'R', 'X']) AS dataset)
SELECT dataset, count(*) FILTER (WHERE arm = 'home') AS n_home, count(*) FILTER (WHERE arm = 'mixed') AS n_mixed, count(arm) AS n_done, 9 AS n_expected,
       CASE WHEN count(arm) >= 9 THEN 'done' WHEN count(arm) > 0 THEN 'partial' ELSE 'pending' END AS eval_state
FROM d LEFT JOIN present USING (dataset) GROUP BY 1""")
def evaluation_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Finished evaluations against the expected grid."""
    present = s.metrics(spark, folder).filter(~((F.col("dataset") == "N") & (F.col("arm") == "home")))
    out = runs.evaluation_coverage(present, ["A", "N", "R", "X"], ["pretrained", "home", "mixed"], 3)
    return out.select("dataset", "n_home", "n_mixed", "n_done", "n_expected", "eval_state")


@query("A24", "J13", sql="WITH " + s.METRICS + """, present AS (SELECT DISTINCT dataset, arm, seed FROM metrics WHERE dataset = 'A' OR (dataset = 'N' AND arm <> 'home')),
d AS (SELECT unnest(['A', 'N', 'R', 'X']) AS dataset), m AS (SELECT ['A', 'N', 'R', 'V'][doc_id % 4 + 1] AS dataset, labels.doc_id IS NOT NULL AS labelled FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT dataset, count(*) AS n_rows, count(*) FILTER (WHERE dataset <> 'N' OR labelled) AS n_ready FROM m GROUP BY 1),
n AS (SELECT dataset, coalesce(n_rows, 0) AS n_rows, coalesce(n_ready, 0) AS n_ready, (SELECT count(*) FROM present p WHERE p.dataset = d.dataset) AS n_done FROM d LEFT JOIN r USING (dataset)),
st AS (SELECT *, CASE WHEN n_rows > 0 AND n_ready >= n_rows THEN 'done' WHEN n_ready > 0 THEN 'partial' ELSE 'pending' END AS prep_state, 9 AS n_expected FROM n),
e AS (SELECT *, CASE WHEN n_done >= n_expected THEN 'done' WHEN n_done > 0 THEN 'partial' WHEN prep_state = 'done' THEN 'next' ELSE 'pending' END AS eval_state FROM st)
SELECT dataset, n_rows, n_ready, prep_state, n_done, CAST(n_expected AS BIGINT) AS n_expected, eval_state FROM e
UNION ALL SELECT 'all', CAST(sum(n_rows) AS BIGINT), CAST(sum(n_ready) AS BIGINT), CASE WHEN count(*) FILTER (WHERE prep_state = 'done') > 0 THEN 'partial' ELSE 'pending' END, CAST(sum(n_done) AS BIGINT),
  CAST(sum(n_expected) FILTER (WHERE prep_state = 'done') AS BIGINT), CASE WHEN count(*) FILTER (WHERE prep_state = 'done' AND eval_state <> 'done') > 0 THEN 'partial' ELSE 'eval pending' END FROM e""")
def evaluation_states(spark: SparkSession, folder: str) -> DataFrame:
    """Files of each data set against its manifest, finished evaluations against the grid, what is next, and the state of it all."""
    rows = s.labelled(spark, folder)
    dataset = F.get(F.array(*[F.lit(x) for x in "ANRV"]), (F.col("doc_id") % 4).cast("int"))
    manifests = rows.select(dataset.alias("dataset"), F.col("audio").alias("audio_path"), "quality")
    inventory = manifests.filter((F.col("dataset") != "N") | F.col("quality").isNotNull()).select(F.col("audio_path").alias("path"))
    present = s.metrics(spark, folder).filter((F.col("dataset") == "A") | ((F.col("dataset") == "N") & (F.col("arm") != "home")))
    ready = runs.audio_readiness(manifests, inventory, ["A", "N", "R", "X"])
    columns = ["dataset", "n_rows", "n_ready", "prep_state", "n_done", F.col("n_expected").cast("bigint").alias("n_expected"), "eval_state"]
    states = pin(runs.coverage_states(ready, present, ["pretrained", "home", "mixed"], 3).select(*columns))
    totals = states.agg(F.struct(F.sum("n_rows").alias("n_rows"), F.sum("n_ready").alias("n_ready"))).scalar()
    overall = runs.overall_state(states, report_exists=False).select(
        F.lit("all").alias("dataset"), totals["n_rows"].alias("n_rows"), totals["n_ready"].alias("n_ready"), F.when(F.col("n_prepared") > 0, "partial").otherwise("pending").alias("prep_state"), "n_done", "n_expected", F.col("state").alias("eval_state"))
    return states.unionByName(overall)


@query("A25", sql="""
WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus <> 'O' AS done, o_totalprice > 250000 AS started FROM orders),
w AS (SELECT *, coalesce(sum(CAST(NOT done AS INTEGER)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM s)
SELECT o_custkey, o_orderkey, CASE WHEN done THEN 'done' WHEN open > 0 THEN 'pending' WHEN started THEN 'running' ELSE 'next' END AS state FROM w""")
def step_states(spark: SparkSession, folder: str) -> DataFrame:
    """State of the ordered steps of every group."""
    o = table(spark, folder, "orders").select(
        "o_custkey", "o_orderkey", (F.col("o_orderstatus") != "O").alias("done"), (F.col("o_totalprice") > 250000).alias("started"))
    return runs.step_states(o, "o_custkey", "o_orderkey", "done", "started").select("o_custkey", "o_orderkey", "state")


@query("A21", "F8", sql="""
WITH b AS (SELECT string_split(rtrim(url, '/'), '/')[-1] AS name FROM pages)
SELECT CASE WHEN regexp_matches(name, '^.+\\.[^.]+$') THEN lower('.' || string_split(name, '.')[-1]) ELSE '<no extension>' END AS suffix, count(*) AS n_files FROM b GROUP BY 1""")
def suffix_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Files per suffix."""
    return runs.suffix_histogram(table(spark, folder, "pages"), file_suffix("url"))


@query("W5", sql="WITH RECURSIVE " + s.TRAINING_LOG + """,
e AS (SELECT run, epoch, val_similarity AS m, row_number() OVER (PARTITION BY run ORDER BY epoch) AS no,
             max(val_similarity) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM training_log),
i AS (SELECT *, best IS NULL OR m > best AS improved FROM e),
l AS (SELECT *, max(CASE WHEN improved THEN no END) OVER (PARTITION BY run ORDER BY epoch) AS last_no FROM i),
st AS (SELECT run, min(epoch) FILTER (WHERE no - last_no >= 3 AND epoch >= 5) AS stop_epoch, count(*) AS n_logged FROM l GROUP BY 1)
SELECT run, any_value(n_logged) AS n_logged, any_value(stop_epoch) AS stop_epoch, max(epoch) FILTER (WHERE improved) AS best_epoch, max(m) AS best_metric
FROM l JOIN st USING (run) WHERE stop_epoch IS NULL OR epoch <= stop_epoch GROUP BY 1""")
def early_stopping(spark: SparkSession, folder: str) -> DataFrame:
    """Where each run would stop, and its best epoch until then."""
    return runs.early_stop(s.training_log(spark, folder), "run", "epoch", "val_similarity", patience=3, min_epochs=5)


@query("W6", sql="WITH RECURSIVE " + s.TRAINING_LOG + """,
e AS (SELECT run, epoch, val_similarity AS m, event_type <> 'signup' AS ok, row_number() OVER (PARTITION BY run ORDER BY epoch) AS no FROM training_log),
walk AS (
  SELECT run, epoch, no, m, 0 AS stagnant, FALSE AS stop FROM e WHERE no = 1
  UNION ALL
  SELECT e.run, e.epoch, e.no, e.m, CASE WHEN NOT (e.m - w.m < 5) THEN 0 WHEN w.stagnant + 1 >= 2 AND NOT e.ok THEN 0 ELSE w.stagnant + 1 END,
         e.m - w.m < 5 AND w.stagnant + 1 >= 2 AND e.ok
  FROM walk w JOIN e ON e.run = w.run AND e.no = w.no + 1 WHERE NOT w.stop)
SELECT run, (SELECT count(*) FROM e WHERE e.run = w.run) AS n_iterations, min(epoch) FILTER (WHERE stop) AS stop_iteration FROM walk w GROUP BY 1""")
def plateau_stopping(spark: SparkSession, folder: str) -> DataFrame:
    """Where the outer loop of each run would stop; the SQL walks the loop step by step."""
    return runs.plateau_stop(s.training_log(spark, folder), "run", "epoch", "val_similarity", 5.0, 2, F.col("event_type") != "signup")
