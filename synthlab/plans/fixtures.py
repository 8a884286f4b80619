"""Stand-ins for the reference's datasets, derived from the test tables (FIXTURES.md section 3).

Each stand-in has a Spark builder and a SQL twin (a CTE body) for the oracle.  Integer columns are
BIGINT and measures DOUBLE on both sides.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthlab.sources.tables import load

# ---- hillstrom-like: rare purchase target on events (0.9 %) ----------------------------------
# fixed values: thresholds of the two stand-in targets and the event-type codes
RARE_VALUE = 150.0        # purchase with value > 150: ~0.9 % positive
RARER_VALUE = 230.0       # purchase with value > 230: ~0.2 % positive
EVENT_TYPE_CODES = [("view", 0), ("click", 1), ("signup", 2), ("purchase", 3), ("error", 4)]
EVENT_FEATURES = ["k", "hour", "user_id", "etype"]


def _etype(c):
    expr = F.lit(None).cast("bigint")
    for name, code in EVENT_TYPE_CODES:
        expr = F.when(c == name, F.lit(code).cast("bigint")).otherwise(expr)
    return expr


def events_target(spark: SparkSession, sf_dir: str, threshold: float = RARE_VALUE) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        F.regexp_extract("props", r'"k": (\d+)', 1).cast("bigint").alias("k"),
        F.hour("ts").cast("bigint").alias("hour"),
        F.col("user_id").cast("bigint").alias("user_id"),
        _etype(F.col("event_type")).alias("etype"),
        F.col("value").cast("double").alias("value"),
        ((F.col("event_type") == "purchase") & (F.col("value") > F.lit(threshold))).cast("int").alias("target"),
    )


def sql_events_target(threshold: float = RARE_VALUE) -> str:
    cases = " ".join(f"WHEN '{n}' THEN {c}" for n, c in EVENT_TYPE_CODES)
    return (f"SELECT event_id, CAST(regexp_extract(props, '\"k\": (\\d+)', 1) AS BIGINT) AS k, "
            f"CAST(hour(ts) AS BIGINT) AS hour, CAST(user_id AS BIGINT) AS user_id, "
            f"CAST(CASE event_type {cases} END AS BIGINT) AS etype, CAST(value AS DOUBLE) AS value, "
            f"CAST(event_type = 'purchase' AND value > {threshold!r}::DOUBLE AS INTEGER) AS target FROM events")


# ---- per-seed long result table from lineitem --------------------------------------------------
# dataset = l_returnflag, n = line-number band, seed = ship month, method: O -> baseline, F -> method,
# alpha = quantity band (method rows), metric = 10 * mean discount of the cell
ALPHA_BANDS = [(10, 0.1), (20, 0.2), (30, 0.3), (40, 0.5), (None, 1.0)]
N_BANDS = [(2, 100), (4, 500), (None, 1000)]


def _band(c, bands):
    expr = None
    for upper, val in bands:
        if upper is None:
            expr = expr.otherwise(F.lit(val)) if expr is not None else F.lit(val)
        else:
            cond = c <= upper
            expr = F.when(cond, F.lit(val)) if expr is None else expr.when(cond, F.lit(val))
    return expr


def _sql_band(c: str, bands, typ: str) -> str:
    parts = []
    last = None
    for upper, val in bands:
        if upper is None:
            last = val
        else:
            parts.append(f"WHEN {c} <= {upper} THEN {val!r}")
    return f"CAST(CASE {' '.join(parts)} ELSE {last!r} END AS {typ})"


def results_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    base = li.select(
        F.col("l_returnflag").alias("dataset"),
        _band(F.col("l_linenumber"), N_BANDS).cast("bigint").alias("n"),
        F.month("l_shipdate").cast("bigint").alias("seed"),
        F.when(F.col("l_linestatus") == "O", "baseline").otherwise("method").alias("method"),
        F.when(F.col("l_linestatus") == "O", F.lit(None).cast("double"))
         .otherwise(_band(F.col("l_quantity"), ALPHA_BANDS).cast("double")).alias("alpha"),
        F.col("l_discount"))
    return (base.groupBy("dataset", "n", "seed", "method", "alpha")
            .agg((F.avg("l_discount") * 10).alias("auc"))
            .withColumn("condition", F.when(F.col("method") == "baseline", "real_only").otherwise("augmented")))


SQL_RESULTS_LONG = (
    "SELECT dataset, n, seed, method, alpha, avg(l_discount) * 10 AS auc, "
    "CASE WHEN method = 'baseline' THEN 'real_only' ELSE 'augmented' END AS condition FROM ("
    "SELECT l_returnflag AS dataset, " + _sql_band("l_linenumber", N_BANDS, "BIGINT") + " AS n, "
    "CAST(month(l_shipdate) AS BIGINT) AS seed, "
    "CASE WHEN l_linestatus = 'O' THEN 'baseline' ELSE 'method' END AS method, "
    "CASE WHEN l_linestatus = 'O' THEN CAST(NULL AS DOUBLE) ELSE " + _sql_band("l_quantity", ALPHA_BANDS, "DOUBLE")
    + " END AS alpha, l_discount FROM lineitem) GROUP BY dataset, n, seed, method, alpha")


def results_generators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of two generators (by part parity) and one baseline."""
    li = load(spark, sf_dir, "lineitem")
    method = F.when(F.col("l_linestatus") == "O", "baseline").when(F.col("l_partkey") % 2 == 0, "smote").otherwise("copula")
    base = li.select(
        F.col("l_returnflag").alias("dataset"), _band(F.col("l_linenumber"), N_BANDS).cast("bigint").alias("n"),
        F.month("l_shipdate").cast("bigint").alias("seed"), method.alias("method"),
        F.when(F.col("l_linestatus") != "O", _band(F.col("l_quantity"), ALPHA_BANDS).cast("double")).alias("alpha"),
        F.col("l_discount"))
    return (base.groupBy("dataset", "n", "seed", "method", "alpha").agg((F.avg("l_discount") * 10).alias("auc"))
            .withColumn("condition", F.when(F.col("method") == "baseline", "real_only").otherwise("augmented")))


SQL_RESULTS_GENERATORS = (
    "SELECT dataset, n, seed, method, alpha, avg(l_discount) * 10 AS auc, "
    "CASE WHEN method = 'baseline' THEN 'real_only' ELSE 'augmented' END AS condition FROM ("
    "SELECT l_returnflag AS dataset, " + _sql_band("l_linenumber", N_BANDS, "BIGINT") + " AS n, "
    "CAST(month(l_shipdate) AS BIGINT) AS seed, "
    "CASE WHEN l_linestatus = 'O' THEN 'baseline' WHEN l_partkey % 2 = 0 THEN 'smote' ELSE 'copula' END AS method, "
    "CASE WHEN l_linestatus <> 'O' THEN " + _sql_band("l_quantity", ALPHA_BANDS, "DOUBLE")
    + " END AS alpha, l_discount FROM lineitem) GROUP BY dataset, n, seed, method, alpha")


def lineitem_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare target with signal (~1 %): R and discount >= 0.09 and quantity >= 40."""
    li = load(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_tax").alias("tax"), F.month("l_shipdate").cast("double").alias("ship_month"),
        ((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09) & (F.col("l_quantity") >= 40))
        .cast("int").alias("target"))


LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

SQL_LINEITEM_RARE = (
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS quantity, l_extendedprice AS price, "
    "l_tax AS tax, CAST(month(l_shipdate) AS DOUBLE) AS ship_month, "
    "CAST(l_returnflag = 'R' AND l_discount >= 0.09 AND l_quantity >= 40 AS INTEGER) AS target FROM lineitem")


def embeddings_wide(spark: SparkSession, sf_dir: str, dims: int = 64) -> DataFrame:
    """Dense numeric stand-in (nomao-like): 64 features f0..f63, target = label 0 vs rest."""
    em = load(spark, sf_dir, "embeddings")
    return em.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(dims)],
                     (F.col("label") == 0).cast("int").alias("target"))


def sql_embeddings_wide(dims: int = 64) -> str:
    cols = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(dims))
    return f"SELECT vec_id, {cols}, CAST(label = 0 AS INTEGER) AS target FROM embeddings"


# ---- TSTR arm: synthetic-only training (condition synthetic_only), metric = 12.5 * mean tax ----------

def tstr_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == "F")
    return (li.select(F.col("l_returnflag").alias("dataset"), _band(F.col("l_linenumber"), N_BANDS).cast("bigint").alias("n"),
                      F.month("l_shipdate").cast("bigint").alias("seed"), "l_tax")
            .groupBy("dataset", "n", "seed").agg((F.avg("l_tax") * 12.5).alias("auc"))
            .select("dataset", "n", "seed", F.lit("method").alias("method"), F.lit(None).cast("double").alias("alpha"),
                    "auc", F.lit("synthetic_only").alias("condition")))


SQL_TSTR = (
    "SELECT l_returnflag AS dataset, " + _sql_band("l_linenumber", N_BANDS, "BIGINT") + " AS n, "
    "CAST(month(l_shipdate) AS BIGINT) AS seed, 'method' AS method, CAST(NULL AS DOUBLE) AS alpha, "
    "avg(l_tax) * 12.5 AS auc, 'synthetic_only' AS condition FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2, 3")


def results_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results_long(spark, sf_dir).unionByName(tstr_results(spark, sf_dir))


SQL_RESULTS_ALL = f"SELECT dataset, n, seed, method, alpha, auc, condition FROM ({SQL_RESULTS_LONG}) UNION ALL {SQL_TSTR}"


# ---- retry log: planted failed attempts (W6 A30 J6) -------------------------------------------------------
# u < 0.10: a failed attempt then a success; 0.10 <= u < 0.15: only a failed attempt

def _cell_u():
    from synthlab.functions.keys import hash_uniform
    return hash_uniform([F.col("dataset"), F.col("n"), F.col("seed"), F.col("method"),
                         F.coalesce((F.col("alpha") * 10).cast("bigint"), F.lit(-1).cast("bigint"))], "retry")


def retry_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results_long(spark, sf_dir).withColumn("_u", _cell_u())
    cols = ["dataset", "n", "seed", "method", "alpha"]
    failed = r.filter(F.col("_u") < 0.15).select(*cols, F.lit(1).cast("bigint").alias("attempt"),
                                                 F.lit(None).cast("double").alias("auc"), F.lit("fit failed").alias("error"))
    retried = r.filter(F.col("_u") < 0.10).select(*cols, F.lit(2).cast("bigint").alias("attempt"), "auc",
                                                  F.lit(None).cast("string").alias("error"))
    clean = r.filter(F.col("_u") >= 0.15).select(*cols, F.lit(1).cast("bigint").alias("attempt"), "auc",
                                                 F.lit(None).cast("string").alias("error"))
    return failed.unionByName(retried).unionByName(clean)


def _sql_cell_u() -> str:
    from synthlab.functions.keys import sql_uniform_from_hex
    h = ("md5(concat_ws(':', CAST(dataset AS VARCHAR), CAST(n AS VARCHAR), CAST(seed AS VARCHAR), CAST(method AS VARCHAR), "
         "CAST(coalesce(CAST(alpha * 10 AS BIGINT), -1) AS VARCHAR), 'retry'))")
    return sql_uniform_from_hex(h)


SQL_RETRY_LOG = f"""SELECT dataset, n, seed, method, alpha, attempt, auc, error FROM (
  WITH r AS (SELECT *, {_sql_cell_u()} AS u FROM ({SQL_RESULTS_LONG}))
  SELECT dataset, n, seed, method, alpha, CAST(1 AS BIGINT) AS attempt, CAST(NULL AS DOUBLE) AS auc, 'fit failed' AS error FROM r WHERE u < 0.15
  UNION ALL SELECT dataset, n, seed, method, alpha, CAST(2 AS BIGINT), auc, CAST(NULL AS VARCHAR) FROM r WHERE u < 0.10
  UNION ALL SELECT dataset, n, seed, method, alpha, CAST(1 AS BIGINT), auc, CAST(NULL AS VARCHAR) FROM r WHERE u >= 0.15)"""
