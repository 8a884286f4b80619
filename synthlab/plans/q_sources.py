"""Registered queries: scans, sinks, resumable appends, streaming ingest.

Each query writes data derived from the test tables into a fresh folder under the shared
checkpoint folder and reads it back through the operator under test."""
from __future__ import annotations

from pyspark.sql import functions as F

from synthlab.functions.exprs import exact_sum, r6
from synthlab.functions.keys import hash_uniform, sql_hash_uniform
from synthlab.plans import fixtures as X
from synthlab.plans.registry import register
from synthlab.sources import files as FS
from synthlab.sources.tables import load

# ---- delimited_scans (S1 S2 S3 S4) --------------------------------------------------------------------------


@register("delimited_scans", """
SELECT v AS variant, CAST(count(*) AS BIGINT) AS n_rows, round(CAST(sum(CAST(value AS DECIMAL(38,10))) AS DOUBLE), 6) AS sum_value,
       CAST(sum(k) AS BIGINT) AS sum_k
FROM (SELECT value, CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) AS k FROM events)
CROSS JOIN (VALUES ('comma_header'), ('semicolon_header'), ('space_gzip_noheader')) t(v) GROUP BY v""")
def q_delimited(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select(
        "event_id", "value", F.regexp_extract("props", r'"k": (\d+)', 1).cast("bigint").alias("k"))
    base = FS.scratch_path(spark, "delimited")
    ev.write.option("header", True).csv(f"{base}/comma")
    ev.write.option("header", True).option("sep", ";").csv(f"{base}/semi")
    ev.write.option("header", False).option("sep", " ").option("compression", "gzip").csv(f"{base}/space")
    schema = "event_id BIGINT, value DOUBLE, k BIGINT"
    a = FS.read_delimited(spark, f"{base}/comma", schema=schema)
    b = FS.read_delimited(spark, f"{base}/semi", schema=schema, sep=";")
    c = FS.read_delimited(spark, f"{base}/space", schema="c0 BIGINT, c1 DOUBLE, c2 BIGINT", header=False, sep=" ",
                          names=["event_id", "value", "k"])
    parts = [d.agg(F.count(F.lit(1)).cast("long").alias("n_rows"), r6(exact_sum("value")).alias("sum_value"),
                   F.sum("k").cast("long").alias("sum_k")).withColumn("variant", F.lit(v))
             for d, v in [(a, "comma_header"), (b, "semicolon_header"), (c, "space_gzip_noheader")]]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("variant", "n_rows", "sum_value", "sum_k")


# ---- result_files_load (S6 S7): schema variants per file, label from the file name -------------------------------

SQL_CANON = f"""SELECT dataset, n, CAST(seed AS INTEGER) AS seed, method, condition, alpha, round(auc, 6) AS auc_roc
FROM ({X.SQL_RESULTS_LONG})"""


@register("result_files_load", SQL_CANON)
def q_result_files(spark, sf_dir):
    r = X.results_long(spark, sf_dir)
    base = FS.scratch_path(spark, "results")
    variants = {
        "A": r.filter("dataset = 'A'").select("seed", "method", "condition", "alpha", F.col("auc").alias("auc_roc"), "n"),
        "N": r.filter("dataset = 'N'").select("n", "seed", F.col("method").alias("generator"), "condition", "alpha", "auc"),
        "R": r.filter("dataset = 'R'").select("seed", "n", "method", "condition", "alpha", "auc",
                                              F.lit(None).cast("string").alias("error")),
    }
    for name, df in variants.items():
        df.write.option("header", True).csv(f"{base}/metrics_{name}.csv")
    loaded = FS.read_result_files(spark, f"{base}/metrics_*.csv", r"metrics_([^/]+)\.csv")
    return loaded.select("dataset", "n", "seed", "method", "condition", "alpha", r6("auc_roc").alias("auc_roc"))


# ---- resume_append (S8 S9 S10 S11) ----------------------------------------------------------------------------------

@register("resume_append", SQL_CANON)
def q_resume_append(spark, sf_dir):
    r = X.results_long(spark, sf_dir).select("dataset", "n", F.col("seed").cast("int"), "method", "condition", "alpha",
                                             F.col("auc").alias("auc_roc"))
    cell = ["dataset", "n", "seed", "method", "alpha"]
    path = FS.scratch_path(spark, "resume")
    u = hash_uniform([F.col("dataset"), F.col("n"), F.col("seed")], "first-run")
    FS.append_new(spark, r.filter(u < 0.5), path, cell)      # first (interrupted) run
    FS.append_new(spark, r, path, cell)                      # resumed run: only the missing cells
    FS.append_new(spark, r, path, cell)                      # re-run: nothing new
    out = spark.read.parquet(path)
    return out.select("dataset", "n", "seed", "method", "condition", "alpha", r6("auc_roc").alias("auc_roc"))


# ---- sink_roundtrip (S8 S9 S11): partitioned sink, prepared table, guarded overwrite ------------------------------------

@register("sink_roundtrip", f"""WITH r AS ({SQL_CANON})
SELECT dataset, CAST(count(*) AS BIGINT) AS n_rows, round(avg(auc_roc), 6) AS mean_auc, CAST(0 AS BIGINT) AS n_built_again,
       true AS kept_larger FROM r GROUP BY dataset""")
def q_sink_roundtrip(spark, sf_dir):
    r = X.results_long(spark, sf_dir).withColumnRenamed("auc", "auc_roc")
    base = FS.scratch_path(spark, "sink")
    FS.write_results(r, f"{base}/by_dataset")                                           # S9
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(f"{base}/by_dataset")
    FS.prepared(spark, f"{base}/prepared", build)                                       # S8: builds
    back = FS.prepared(spark, f"{base}/prepared", build)                                # S8: reads
    FS.guarded_write(spark, back, f"{base}/merged", f"{base}/smaller")                  # S11
    where = FS.guarded_write(spark, back.limit(1), f"{base}/merged", f"{base}/smaller")
    merged = spark.read.parquet(f"{base}/merged")
    return merged.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_rows"), r6(F.avg("auc_roc")).alias("mean_auc")).select(
        "dataset", "n_rows", "mean_auc", F.lit(len(built) - 1).cast("long").alias("n_built_again"),
        F.lit(where == f"{base}/smaller").alias("kept_larger"))


# ---- ingest_synthetic (S12, P5, P12) --------------------------------------------------------------------------------

@register("ingest_synthetic", f"""WITH t AS ({X.sql_events_target()}),
ext AS (SELECT CASE WHEN {sql_hash_uniform(['event_id'], 'bad')} < 0.05 THEN 'bad' ELSE CAST(target AS VARCHAR) || '.0' END AS target,
               CAST(etype AS VARCHAR) AS etype, CAST(user_id AS VARCHAR) AS user_id, CAST(hour AS VARCHAR) AS hour,
               CAST(k AS VARCHAR) AS k, event_id FROM t)
SELECT event_id, TRY_CAST(k AS DOUBLE) AS k, TRY_CAST(hour AS DOUBLE) AS hour, TRY_CAST(user_id AS DOUBLE) AS user_id,
       TRY_CAST(etype AS DOUBLE) AS etype, CAST(trunc(coalesce(TRY_CAST(target AS DOUBLE), 0.0)) AS INTEGER) AS target FROM ext""")
def q_ingest(spark, sf_dir):
    t = X.events_target(spark, sf_dir)
    train_schema = t.select("event_id", *[F.col(c).cast("double").alias(c) for c in X.EVENT_FEATURES], "target").limit(0)
    ext = t.select(
        F.when(hash_uniform(["event_id"], "bad") < 0.05, F.lit("bad"))
         .otherwise(F.concat(F.col("target").cast("string"), F.lit(".0"))).alias("target"),
        *[F.col(c).cast("string").alias(c) for c in reversed(X.EVENT_FEATURES)], "event_id")
    return FS.ingest_synthetic(ext, train_schema, "target")


# ---- stream_results_ingest (S10 streaming + W6) -----------------------------------------------------------------------

LCELL = ["dataset", "n", "seed", "method", "alpha"]


@register("stream_results_ingest", f"""WITH l AS ({X.SQL_RETRY_LOG}),
k AS (SELECT *, row_number() OVER (PARTITION BY dataset, n, seed, method, alpha
                                   ORDER BY (auc IS NOT NULL AND error IS NULL) DESC, attempt DESC) AS rn FROM l)
SELECT dataset, n, seed, method, alpha, attempt, round(auc, 6) AS auc, error FROM k WHERE rn = 1""")
def q_stream(spark, sf_dir):
    from synthlab.streaming.results_log import current_results, ingest_result_files
    log = X.retry_log(spark, sf_dir)
    base = FS.scratch_path(spark, "stream")
    # workers drop result files in three waves; the second wave is delivered twice
    wave = F.floor(hash_uniform([F.col("dataset"), F.col("n"), F.col("seed"), F.col("attempt")], "wave") * 3)
    schema = "dataset STRING, n BIGINT, seed BIGINT, method STRING, alpha DOUBLE, attempt BIGINT, auc DOUBLE, error STRING"
    for w in range(3):
        log.filter(wave == w).write.parquet(f"{base}/in/wave{w}")
    log.filter(wave == 1).write.parquet(f"{base}/in/wave1_replay")
    out = ingest_result_files(spark, f"{base}/in/*", schema, f"{base}/log", f"{base}/ckpt", LCELL + ["attempt"])
    cur = current_results(out, LCELL)
    return cur.select(*LCELL, "attempt", r6("auc").alias("auc"), "error")
