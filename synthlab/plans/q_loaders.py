"""Registered queries: the dataset loaders (L2 L3 L5-L8; L1 is in q_prep, L4 in q_prep) as pipelines over raw stand-in files.

Each query writes a raw file derived from a test table (the reference's downloads are unreachable)
into a fresh folder under the shared checkpoint folder and prepares it with the loader pipeline.
The oracle computes the prepared rows directly from the test table."""
from __future__ import annotations

from pyspark.sql import functions as F

from synthlab.functions.exprs import r6
from synthlab.functions.keys import hash_uniform, sql_hash_hex, sql_hash_uniform
from synthlab.operators import prep as P
from synthlab.operators import sampling as S
from synthlab.plans.registry import register
from synthlab.sources import files as FS
from synthlab.sources.tables import load

# fixed values: target spellings of the reference loaders
BANK_TARGET_CANDIDATES = ["y", "Class", "class", "target"]
BANK_POSITIVE = ["yes", "2", "2.0"]
NOMAO_TARGET_CANDIDATES = ["target", "class", "label"]


# ---- L2 bank marketing: ';' CSV, target by candidate name, membership target, leak column dropped ----

@register("bank_prepare", f"""
WITH raw AS (SELECT o_orderkey, o_orderpriority AS priority, o_orderstatus AS status, o_totalprice AS balance,
                    o_totalprice / 100 AS duration,
                    CASE WHEN o_totalprice > 250000 THEN (CASE WHEN {sql_hash_uniform(['o_orderkey'], 'y')} < 0.5 THEN ' Yes' ELSE '2.0' END)
                         ELSE 'no' END AS y FROM orders)
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY priority) - 1 AS BIGINT) AS priority,
       CAST(dense_rank() OVER (ORDER BY status) - 1 AS BIGINT) AS status, round(balance, 6) AS balance,
       CAST(lower(trim(y)) IN ('yes', '2', '2.0') AS INTEGER) AS target FROM raw""")
def q_bank(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    raw = o.select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
                   F.col("o_totalprice").alias("balance"), (F.col("o_totalprice") / 100).alias("duration"),
                   F.when(F.col("o_totalprice") > 250000,
                          F.when(hash_uniform(["o_orderkey"], "y") < 0.5, " Yes").otherwise("2.0")).otherwise("no").alias("y"))
    path = FS.scratch_path(spark, "bank")
    raw.write.option("header", True).option("sep", ";").csv(path)
    df = FS.read_delimited(spark, path, sep=";",
                           schema="o_orderkey BIGINT, priority STRING, status STRING, balance DOUBLE, duration DOUBLE, y STRING")
    df = P.rename_target(df, BANK_TARGET_CANDIDATES)                      # P2
    df = df.withColumn("target", P.target_in(F.col("target"), BANK_POSITIVE))  # P8
    df = P.drop_columns(df, ["duration", "not_there"])                     # P1 (leak; missing names ignored)
    df = P.label_encode(df, P.string_columns(df))                          # P15 + P10
    P.check_contract(df.drop("o_orderkey"), "target")                      # P13
    return df.select("o_orderkey", "priority", "status", r6("balance").alias("balance"), "target")


# ---- L3 german credit: headerless space-separated, generated names, target 2 -> 1 ------------------------

@register("german_prepare", """
SELECT p_partkey AS f0, CAST(p_size AS BIGINT) AS f1, round(p_retailprice, 6) AS f2,
       CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS BIGINT) AS f3,
       CAST((CASE WHEN p_size > 40 THEN 2 ELSE 1 END) = 2 AS INTEGER) AS target FROM part""")
def q_german(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("bigint"), "p_retailprice", "p_type",
                                          F.when(F.col("p_size") > 40, 2).otherwise(1).alias("t"))
    path = FS.scratch_path(spark, "german")
    p.write.option("header", False).option("sep", " ").csv(path)
    names = FS.generated_names(4)                                          # S3: f0..f3, target
    df = FS.read_delimited(spark, path, header=False, sep=" ", names=names,
                           schema="a BIGINT, b BIGINT, c DOUBLE, d STRING, e STRING")
    df = df.withColumn("target", P.target_equals(F.col("target"), "2"))    # P7
    df = P.label_encode(df, P.string_columns(df))                          # P15 + P10
    return df.select("f0", "f1", r6("f2").alias("f2"), "f3", "target")


# ---- L5 nomao: target by name, minority class -> 1, strings encoded ---------------------------------------

@register("nomao_prepare", """
WITH raw AS (SELECT s.s_suppkey, s.s_name, s.s_acctbal, n.n_regionkey AS label FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey),
h AS (SELECT label, count(*) AS c FROM raw GROUP BY label),
m AS (SELECT label AS ml FROM h ORDER BY c, label LIMIT 1)
SELECT s_suppkey, CAST(dense_rank() OVER (ORDER BY s_name) - 1 AS BIGINT) AS s_name, round(s_acctbal, 6) AS s_acctbal,
       CAST(label = (SELECT ml FROM m) AS INTEGER) AS target FROM raw""")
def q_nomao(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    n = load(spark, sf_dir, "nation")
    raw = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", "s_name", "s_acctbal", F.col("n_regionkey").alias("label"))
    df = FS.read_delimited(spark, FS.raw_file(raw, "nomao"), schema="s_suppkey BIGINT, s_name STRING, s_acctbal DOUBLE, label INT")   # S1
    df = P.rename_target(df, NOMAO_TARGET_CANDIDATES, to="_label")       # P2
    df = P.minority_to_one(df, "_label").drop("_label")                   # P9
    df = P.label_encode(df, P.string_columns(df))                         # P10
    return df.select("s_suppkey", "s_name", r6("s_acctbal").alias("s_acctbal"), "target")


# ---- L6 hillstrom: messy header names, target by name, leak columns dropped, strings encoded -----------------

@register("hillstrom_prepare", """
SELECT event_id, CAST(hour(ts) AS BIGINT) AS recency, round(value, 6) AS history,
       CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS BIGINT) AS channel,
       CAST(event_type = 'purchase' AND value > 150.0 AS INTEGER) AS target FROM events""")
def q_hillstrom(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    raw = ev.select(F.col("event_id").alias("Event_ID"), F.hour("ts").cast("bigint").alias(" Recency "),
                    F.col("value").alias("History"), F.col("event_type").alias("Channel "),
                    (F.col("event_type") != "view").cast("int").alias("Visit"), F.col("value").alias("SPEND"),
                    ((F.col("event_type") == "purchase") & (F.col("value") > 150.0)).cast("int").alias("Conversion"))
    path = FS.scratch_path(spark, "hillstrom")
    raw.write.option("header", True).csv(path)
    df = FS.read_delimited(spark, path)                                    # S1, inferred types
    df = P.normalize_names(df)                                             # P3
    df = P.rename_target(df, ["conversion"])                               # P2
    df = P.drop_columns(df, ["visit", "spend"])                            # P1: outcome leaks
    df = P.label_encode(df, ["channel"])                                   # P10
    return df.select(F.col("event_id").cast("bigint").alias("event_id"), F.col("recency").cast("bigint").alias("recency"),
                     r6("history").alias("history"), "channel", F.col("target").cast("int").alias("target"))


# ---- L7 criteo: gzip, lower names, leak columns dropped, rows with NULL dropped (a cap is cap_sample's)  ----------------

LKEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@register("criteo_prepare", f"""
WITH raw AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS f0,
                    CASE WHEN {sql_hash_uniform(LKEY, 'null')} < 0.02 THEN NULL ELSE l_extendedprice END AS f1,
                    l_tax AS f2, CAST(l_returnflag = 'R' AND l_discount >= 0.09 AS INTEGER) AS conversion FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(f0, 6) AS f0, round(f1, 6) AS f1, round(f2, 6) AS f2,
       conversion AS target FROM raw WHERE f1 IS NOT NULL""")
def q_criteo(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    raw = li.select(*LKEY, F.col("l_quantity").alias("F0"),
                    F.when(hash_uniform(LKEY, "null") < 0.02, F.lit(None)).otherwise(F.col("l_extendedprice")).alias("F1"),
                    F.col("l_tax").alias("F2"), F.lit(1).alias("Treatment"), F.lit(0).alias("Exposure"),
                    ((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09)).cast("int").alias("Conversion"))
    path = FS.scratch_path(spark, "criteo")
    raw.write.option("header", True).option("compression", "gzip").csv(path)
    df = FS.read_delimited(spark, path, schema=("l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_suppkey BIGINT, "
                                                "F0 DOUBLE, F1 DOUBLE, F2 DOUBLE, Treatment INT, Exposure INT, Conversion INT"))
    df = P.normalize_names(df)                                             # P3
    df = P.drop_columns(df, ["treatment", "exposure", "visit"])            # P1
    df = P.rename_target(df, ["conversion"])                               # P2
    df = df.dropna()                                                       # P6
    return df.select(*LKEY, r6("f0").alias("f0"), r6("f1").alias("f1"), r6("f2").alias("f2"), "target")


# ---- L8 KDD: target '1' after strip, missing fraction, strings encoded, numerics filled with 0 ---------------------

@register("kdd_prepare", f"""
WITH raw AS (SELECT c_custkey, CASE WHEN {sql_hash_uniform(['c_custkey'], 'n1')} < 0.2 THEN NULL ELSE c_acctbal END AS bal,
                    CASE WHEN {sql_hash_uniform(['c_custkey'], 'n2')} < 0.1 THEN NULL ELSE c_mktsegment END AS seg,
                    CASE WHEN c_acctbal > 8000 THEN ' 1' ELSE '-1' END AS appetency FROM customer),
mf AS (SELECT (count(*) FILTER (WHERE bal IS NULL) + count(*) FILTER (WHERE seg IS NULL)) / (2.0::DOUBLE * count(*)) AS missing_frac FROM raw)
SELECT c_custkey, round(coalesce(bal, 0.0), 6) AS bal, CAST(dense_rank() OVER (ORDER BY coalesce(seg, 'nan')) - 1 AS BIGINT) AS seg,
       CAST(trim(appetency) = '1' AS INTEGER) AS target, round((SELECT missing_frac FROM mf), 6) AS missing_frac FROM raw""")
def q_kdd(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    raw = c.select("c_custkey",
                   F.when(hash_uniform(["c_custkey"], "n1") < 0.2, F.lit(None)).otherwise(F.col("c_acctbal")).alias("bal"),
                   F.when(hash_uniform(["c_custkey"], "n2") < 0.1, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("seg"),
                   F.when(F.col("c_acctbal") > 8000, " 1").otherwise("-1").alias("appetency"))
    df = FS.read_delimited(spark, FS.raw_file(raw, "kdd", sep="\t"), sep="\t", schema="c_custkey BIGINT, bal DOUBLE, seg STRING, appetency STRING")
    df = P.rename_target(df, ["appetency"])                               # P2
    df = df.withColumn("target", P.target_equals(F.col("target"), "1"))    # P7
    mf = P.cell_fractions(df, ["bal", "seg"]).select("missing_frac")       # A6
    df = P.label_encode(df, ["seg"])                                       # P10 (NULL -> 'nan')
    df = P.fill_zero(df, ["bal"])                                          # P11
    return df.crossJoin(F.broadcast(mf)).select("c_custkey", r6("bal").alias("bal"), "seg", "target",
                                                r6("missing_frac").alias("missing_frac"))
