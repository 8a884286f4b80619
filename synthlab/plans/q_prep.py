"""Registered queries: loaders, cleaning and encoding."""
from __future__ import annotations

from pyspark.sql import functions as F

from synthlab.functions.exprs import r6
from synthlab.functions.keys import hash_uniform, sql_hash_uniform
from synthlab.operators import prep
from synthlab.plans.registry import register
from synthlab.sources.files import raw_file, read_delimited
from synthlab.sources.tables import load

# ---- clv_rollup (L4: A1 A2 P16 P17 P18 P19) -------------------------------------------------

SQL_CLV = """
WITH l AS (
  SELECT o.o_custkey AS customer_id, o.o_orderkey AS invoice, o.o_orderdate AS d, li.l_quantity AS q,
         li.l_quantity * (li.l_extendedprice / li.l_quantity) AS revenue
  FROM lineitem li JOIN orders o ON li.l_orderkey = o.o_orderkey
  WHERE li.l_quantity > 0),
snap AS (SELECT max(d) AS s FROM l)
SELECT customer_id,
       round(ln(1 + CAST(sum(CAST(revenue AS DECIMAL(38,10))) AS DOUBLE)), 6) AS total_spend,
       CAST(count(DISTINCT invoice) AS BIGINT) AS frequency,
       CAST(date_sub('day', max(d), (SELECT s FROM snap)) AS BIGINT) AS recency,
       round(CAST(sum(CAST(revenue AS DECIMAL(38,10))) AS DOUBLE) / count(*), 6) AS avg_order_value,
       round(sum(q), 6) AS num_items
FROM l GROUP BY customer_id HAVING sum(revenue) > 0
"""


def clv(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").withColumn(
        "unit_price", F.col("l_extendedprice") / F.col("l_quantity"))
    orders = load(spark, sf_dir, "orders")
    out = prep.clv_rollup(li.withColumnRenamed("l_orderkey", "o_orderkey"), orders, invoice="o_orderkey",
                          customer="o_custkey", date="o_orderdate", quantity="l_quantity", unit_price="unit_price")
    return out.select("customer_id", r6("total_spend").alias("total_spend"), "frequency", "recency",
                      r6("avg_order_value").alias("avg_order_value"), r6("num_items").alias("num_items"))


register("clv_rollup", SQL_CLV)(clv)


# ---- label_encode (P10, T20 NULL -> 'nan') -----------------------------------------------------
# NULLs are planted on a hash predicate (the test tables hold none)

SQL_LABEL_ENCODE = f"""
WITH c AS (
  SELECT c_custkey,
         CASE WHEN {sql_hash_uniform(['c_custkey'], 'null')} < 0.1 THEN NULL ELSE c_mktsegment END AS seg,
         c_name
  FROM customer)
SELECT c_custkey,
       CAST(dense_rank() OVER (ORDER BY coalesce(seg, 'nan')) - 1 AS BIGINT) AS seg_code,
       CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS BIGINT) AS name_code
FROM c
"""


@register("label_encode", SQL_LABEL_ENCODE)
def q_label_encode(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(hash_uniform(["c_custkey"], "null") < 0.1, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("seg"),
        F.col("c_name").alias("name"))
    enc = prep.label_encode(c, ["seg", "name"], suffix="_code")
    return enc.select("c_custkey", "seg_code", "name_code")


# ---- minority_to_one (P9) ------------------------------------------------------------------------

SQL_MINORITY = """
WITH h AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
m AS (SELECT label AS min_label FROM h ORDER BY n, label LIMIT 1)
SELECT vec_id, label, CAST(label = (SELECT min_label FROM m) AS INTEGER) AS target FROM embeddings
"""


@register("minority_to_one", SQL_MINORITY)
def q_minority(spark, sf_dir):
    em = load(spark, sf_dir, "embeddings").select("vec_id", "label")
    return prep.minority_to_one(em, "label").select("vec_id", "label", "target")


# ---- missing_and_zero_rate (A6 A7) ---------------------------------------------------------------
# lineitem numerics with planted NULLs on a hash predicate per column

MZ_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _planted(c):
    return f"CASE WHEN {sql_hash_uniform(['l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey'], 'null:' + c)} < 0.05 THEN NULL ELSE {c} END AS {c}"


SQL_MISSING_ZERO = f"""
WITH t AS (SELECT {', '.join(_planted(c) for c in MZ_COLS)} FROM lineitem)
SELECT CAST(count(*) AS BIGINT) AS n_rows,
       round(sum({' + '.join(f'CAST({c} IS NULL AS BIGINT)' for c in MZ_COLS)}) / (count(*) * {len(MZ_COLS)}.0::DOUBLE), 6) AS missing_frac,
       round(sum({' + '.join(f'coalesce(CAST({c} = 0 AS BIGINT), 0)' for c in MZ_COLS)}) / (count(*) * {len(MZ_COLS)}.0::DOUBLE), 6) AS zero_frac
FROM t
"""


@register("missing_and_zero_rate", SQL_MISSING_ZERO)
def q_missing_zero(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    t = li.select(*[F.when(hash_uniform(key, "null:" + c) < 0.05, F.lit(None)).otherwise(F.col(c)).alias(c)
                    for c in MZ_COLS])
    out = prep.cell_fractions(t, MZ_COLS)
    return out.select(F.col("n_rows").cast("long"), r6("missing_frac").alias("missing_frac"), r6("zero_frac").alias("zero_frac"))


# ---- numeric_coerce / telco_prepare (L1: P1 P4 P6 P7 P10) ------------------------------------------
# telco-like: one row per customer with its order rollup; TotalCharges is text with blanks

def _telco_raw(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    o = load(spark, sf_dir, "orders")
    per_cust = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("_tot"), F.count(F.lit(1)).alias("tenure"),
                                          F.max(F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)).alias("_open"))
    j = c.join(per_cust, c.c_custkey == per_cust.o_custkey, "inner")
    return j.select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("contract"),
        F.col("c_nationkey").cast("bigint").alias("region_code"), F.col("tenure").cast("bigint").alias("tenure"),
        F.col("c_acctbal").alias("monthly_charges"),
        F.when(hash_uniform(["c_custkey"], "blank") < 0.05, F.lit(" "))
         .otherwise(F.format_string("%.2f", F.col("_tot"))).alias("total_charges"),
        F.when(F.col("_open") == 0, "Yes").otherwise("No").alias("churn"))


SQL_TELCO_RAW = f"""
SELECT c.c_custkey AS customer_id, c.c_mktsegment AS contract, CAST(c.c_nationkey AS BIGINT) AS region_code,
       CAST(p.tenure AS BIGINT) AS tenure, c.c_acctbal AS monthly_charges,
       CASE WHEN {sql_hash_uniform(['c.c_custkey'], 'blank')} < 0.05 THEN ' ' ELSE printf('%.2f', p.tot) END AS total_charges,
       CASE WHEN p.open = 0 THEN 'Yes' ELSE 'No' END AS churn
FROM customer c JOIN (SELECT o_custkey, sum(o_totalprice) AS tot, count(*) AS tenure,
                             max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS open
                      FROM orders GROUP BY o_custkey) p ON c.c_custkey = p.o_custkey
"""

SQL_TELCO = f"""
WITH raw AS ({SQL_TELCO_RAW}),
t AS (SELECT customer_id, contract, region_code, tenure, monthly_charges,
             TRY_CAST(total_charges AS DOUBLE) AS total_charges, churn FROM raw),
k AS (SELECT * FROM t WHERE total_charges IS NOT NULL)
SELECT customer_id, CAST(dense_rank() OVER (ORDER BY contract) - 1 AS BIGINT) AS contract,
       region_code, tenure, round(monthly_charges, 6) AS monthly_charges, round(total_charges, 6) AS total_charges,
       CAST(trim(churn) = 'Yes' AS INTEGER) AS target
FROM k
"""


@register("telco_prepare", SQL_TELCO)
def q_telco(spark, sf_dir):
    path = raw_file(_telco_raw(spark, sf_dir), "telco")
    raw = read_delimited(spark, path, schema=("customer_id BIGINT, contract STRING, region_code BIGINT, tenure BIGINT, "
                                              "monthly_charges DOUBLE, total_charges STRING, churn STRING"))     # S1
    t = prep.coerce_numeric(raw, ["total_charges"]).dropna()
    t = t.withColumn("target", prep.target_equals(F.col("churn"), "Yes")).drop("churn")
    t = prep.label_encode(t, ["contract"])
    return t.select("customer_id", "contract", "region_code", "tenure", r6("monthly_charges").alias("monthly_charges"),
                    r6("total_charges").alias("total_charges"), "target")


SQL_COERCE = f"""
WITH raw AS ({SQL_TELCO_RAW})
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(TRY_CAST(total_charges AS DOUBLE)) AS BIGINT) AS n_numeric,
       CAST(sum(CAST(trunc(coalesce(TRY_CAST(total_charges AS DOUBLE), 0)) AS INTEGER)) AS BIGINT) AS sum_int
FROM raw
"""


@register("numeric_coerce", SQL_COERCE)
def q_coerce(spark, sf_dir):
    raw = _telco_raw(spark, sf_dir)
    return raw.agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                   F.count(F.col("total_charges").try_cast("double")).cast("long").alias("n_numeric"),
                   F.sum(prep.coerce_target_int(F.col("total_charges"))).cast("long").alias("sum_int"))


# ---- align_columns (P12): synthetic rows without key and one feature, columns in another order ----------------------

@register("align_columns", """
SELECT CAST(0 AS BIGINT) AS event_id, CAST(0 AS VARCHAR) AS event_type, value, CAST(event_id + 1 AS BIGINT) AS syn_rank FROM events""")
def q_align(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select("event_id", "event_type", "value")
    syn = ev.select((F.col("event_id") + 1).alias("syn_rank"), "value", F.lit("x").alias("other"))
    return prep.align_columns(syn, ev, extra=["syn_rank"])


# ---- timestamp_parse (P18): two formats and text that is neither ----------------------------------------------------

@register("timestamp_parse", """
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
                  WHEN 1 THEN ' ' || strftime(o_orderdate, '%d/%m/%Y %H:%M') ELSE 'unknown' END AS text FROM orders),
p AS (SELECT o_orderkey, coalesce(try_strptime(trim(text), '%Y-%m-%d %H:%M:%S'), try_strptime(trim(text), '%d/%m/%Y %H:%M')) AS ts FROM t)
SELECT o_orderkey, CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS m, CAST(day(ts) AS BIGINT) AS d FROM p""")
def q_timestamps(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    text = (F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
            .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" "), F.date_format("o_orderdate", "dd/MM/yyyy HH:mm")))
            .otherwise("unknown"))
    ts = prep.parse_timestamp(text, ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm"])
    return o.select("o_orderkey", ts.alias("ts")).select(
        "o_orderkey", *[f("ts").cast("long").alias(n) for f, n in ((F.year, "y"), (F.month, "m"), (F.dayofmonth, "d"))])


# ---- text_slug (P21) -------------------------------------------------------------------------------------------------

@register("text_slug", """
SELECT c_custkey, trim(regexp_replace(lower(c_mktsegment || ' / ' || CAST(c_nationkey AS VARCHAR) || '!'), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
       split_part(c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR), '-', 2) AS second FROM customer""")
def q_slug(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    key = F.col("c_nationkey").cast("string")
    return c.select("c_custkey", prep.slug(F.concat("c_mktsegment", F.lit(" / "), key, F.lit("!"))).alias("slug"),
                    prep.split_part(F.concat("c_mktsegment", F.lit("-"), key), "-", 2).alias("second"))
