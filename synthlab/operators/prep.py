"""Cleaning, encoding and target definition (P1-P24), and the customer-value rollup (A1/A2)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthlab.functions.exprs import exact_sum
from synthlab.operators.ordered import global_rank, tie_ranks
from synthlab.session import materialise


# ---- P1-P3: columns --------------------------------------------------------------------------

def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop, ignoring names that are not present."""
    return df.drop(*cols)


def rename_target(df: DataFrame, candidates: Sequence[str], to: str = "target") -> DataFrame:
    """Rename the first column matching a candidate name (case-insensitive), else the last column."""
    lower = {c.lower(): c for c in df.columns}
    src = next((lower[c.lower()] for c in candidates if c.lower() in lower), df.columns[-1])
    return df if src == to else df.withColumnRenamed(src, to)


def normalize_names(df: DataFrame) -> DataFrame:
    """Lower-case, stripped column names."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def check_contract(df: DataFrame, target: str, features: Sequence[str] | None = None) -> None:
    """Target present, features present and numeric; raises with the offending names."""
    types = dict(df.dtypes)
    if target not in types:
        raise ValueError(f"target column {target!r} missing")
    feats = list(features) if features is not None else [c for c in df.columns if c != target]
    missing = [c for c in feats if c not in types]
    bad = [c for c in feats if c in types and types[c] not in NUMERIC_TYPES]
    if missing or bad:
        raise ValueError(f"contract violated: missing={missing} non_numeric={bad}")


NUMERIC_TYPES = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def string_columns(df: DataFrame) -> list[str]:
    """Columns of string type."""
    return [c for c, t in df.dtypes if t == "string"]


# ---- P4-P8, P11, P12, P22: values ----------------------------------------------------------

def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Bad values become NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def coerce_target_int(c: Column) -> Column:
    """P5: coerce, NULL -> 0, truncate to int."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0)).cast("int")


def target_equals(c: Column, value: str) -> Column:
    """1 when the stripped value equals ``value``."""
    return (F.trim(c.cast("string")) == F.lit(value)).cast("int")


def target_in(c: Column, values: Sequence[str]) -> Column:
    """1 when the case-folded stripped value is one of ``values``."""
    return F.lower(F.trim(c.cast("string"))).isin([v.lower() for v in values]).cast("int")


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P11."""
    return df.fillna(0, subset=list(cols))


def align_columns(df: DataFrame, schema_df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Reindex to the columns of ``schema_df``; missing columns become 0 of the right type.
    Columns in ``extra`` (e.g. ``syn_rank``) are carried through unchanged."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(0)).cast(t).alias(c) for c, t in schema_df.dtypes],
                     *[F.col(c) for c in extra])


def cast_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P22."""
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def parse_timestamp(c: Column, formats: Sequence[str]) -> Column:
    """The first of the formats that parses the trimmed text; NULL if none does."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats])


def slug(c: Column) -> Column:
    """Lower case, runs of anything but letters and digits to one "_", none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def split_part(c: Column, separator: str, part: int) -> Column:
    """The part-th piece (from 1) of the text cut at ``separator``; empty if there is none."""
    return F.split_part(c, F.lit(separator), F.lit(part))


# ---- P9, P10: encodings ----------------------------------------------------------------------

def minority_to_one(df: DataFrame, label: str, out: str = "target") -> DataFrame:
    """The least frequent label value becomes 1, every other value 0 (tie: smallest value).

    The label histogram has one row per distinct label; the single winning row is broadcast."""
    hist = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    minority = hist.agg(F.min(F.struct("_n", F.col(label))).alias("_m")).select(F.col(f"_m.{label}").alias("_min"))
    return (df.crossJoin(F.broadcast(minority))
            .withColumn(out, (F.col(label) == F.col("_min")).cast("int")).drop("_min"))


DICT_ROWS = 1_000_000           # a dictionary within both bounds is broadcast, a larger one is not
DICT_BYTES = 64 * 1024 * 1024


def label_encode(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """P10: ordinal codes by sorted distinct value; NULL becomes the category "nan" (T20).

    One dictionary of (column, value) for all columns, one distributed rank pass over it, one write; the
    number of jobs does not grow with the columns.  A dictionary of proven size is broadcast once and
    looked up for every column without a shuffle of rows.  A larger one never leaves its tasks: rows are
    ranked in long form, spread on (column, value, row), and put together by row."""
    cols = list(cols)
    if not cols:
        return df
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols]
    values = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), v.alias("_v")) for i, v in enumerate(texts)])).alias("_k")).distinct()
    ranked = materialise(global_rank(values, "_k", name="_at"), "dictionary")
    first = ranked.groupBy("_k._i").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"),
                                        F.sum(F.octet_length("_k._v")).alias("_b")).collect()      # one row per column
    if sum(r["_n"] for r in first) <= DICT_ROWS and sum(r["_b"] for r in first) <= DICT_BYTES:
        starts = {r["_i"]: r["_first"] for r in first}
        out = df
        for i, (c, v) in enumerate(zip(cols, texts)):      # the same build side every time: one broadcast, reused
            side = F.broadcast(ranked.select(F.col("_k").alias("_dk"), F.col("_at").alias("_dat")))
            # NULL was made "nan" before; a column encoded earlier is not read again
            key = F.struct(F.lit(i).alias("_i"), v.alias("_v"))
            out = (out.withColumn("_lk", key).join(side, F.col("_lk") == F.col("_dk"), "left")
                   .withColumn(c + suffix, (F.col("_dat") - F.lit(starts.get(i, 0))).cast("long")).drop("_lk", "_dk", "_dat"))
        return out
    base = materialise(df.withColumn("_rid", F.monotonically_increasing_id()), "encoded")     # ids fixed by the write
    long = base.select("_rid", F.posexplode(F.array(*texts)).alias("_i", "_v"))
    codes = tie_ranks(long, ["_i"], "_v").groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("_i", "_dense"))).alias("_codes"))
    return base.join(codes, "_rid").withColumns(
        {c + suffix: F.col("_codes")[i]["_dense"].cast("long") for i, c in enumerate(cols)}).drop("_rid", "_codes")


# ---- P24: regimes ------------------------------------------------------------------------------

def imbalance_regime(pos_rate: Column) -> Column:
    """<1 % extreme, <10 % moderate, else mild."""
    return (F.when(pos_rate < 0.01, "extreme").when(pos_rate < 0.10, "moderate").otherwise("mild"))


def interpolation_unstable(pos_rate: Column) -> Column:
    """True below 1 %, where interpolation between a handful of minority neighbours is unstable."""
    return F.coalesce(pos_rate < 0.01, F.lit(False))


# ---- A6 / A7: cell fractions -----------------------------------------------------------------

def cell_fractions(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fraction of NULL cells and of zero cells over ``cols`` (one pass)."""
    k = len(cols)
    nulls = sum((F.col(c).isNull().cast("long") for c in cols), F.lit(0).cast("long"))
    zeros = sum((F.coalesce((F.col(c) == 0).cast("long"), F.lit(0)) for c in cols), F.lit(0).cast("long"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.sum(nulls).alias("_nulls"), F.sum(zeros).alias("_zeros")) \
        .select("n_rows", F.try_divide(F.col("_nulls"), F.col("n_rows") * k).alias("missing_frac"),
                F.try_divide(F.col("_zeros"), F.col("n_rows") * k).alias("zero_frac"))


# ---- A1 / A2: customer value rollup (L4) ------------------------------------------------------

def clv_rollup(lines: DataFrame, invoices: DataFrame, *, invoice: str, customer: str, date: str,
               quantity: str, unit_price: str) -> DataFrame:
    """Customer lifetime value features (L4): total spend (log1p), distinct invoices, days since
    last purchase at the snapshot (latest purchase overall), mean line revenue, items bought.

    ``invoices`` maps invoice -> (customer, date).  Lines are pre-aggregated per invoice before
    the join (partial aggregation on the large side), which also turns the distinct-invoice count
    into a plain count; the snapshot is a one-row aggregate broadcast to every customer."""
    per_invoice = (lines.filter(F.col(quantity) > 0)
                   .withColumn("_rev", F.col(quantity) * F.col(unit_price))
                   .groupBy(invoice)
                   .agg(exact_sum("_rev").alias("_rev"), F.count(F.lit(1)).alias("_lines"),
                        F.sum(quantity).alias("_qty")))
    joined = per_invoice.join(invoices.select(invoice, customer, date), invoice, "inner")
    per_customer = joined.groupBy(customer).agg(
        exact_sum("_rev").alias("_spend"), F.count(F.lit(1)).alias("frequency"),
        F.max(date).alias("_last"), F.sum("_lines").alias("_lines"), F.sum("_qty").alias("num_items"))
    # the snapshot is a second consumer of the per-customer table; without materialising it the
    # optimizer prunes that branch differently and re-scans and re-aggregates all lines
    per_customer = materialise(per_customer)
    snapshot = per_customer.agg(F.max("_last").alias("_snap"))
    return (per_customer.filter(F.col("_spend") > 0)
            .crossJoin(F.broadcast(snapshot))
            .select(F.col(customer).alias("customer_id"),
                    F.log1p("_spend").alias("total_spend"),
                    F.col("frequency").cast("long").alias("frequency"),
                    F.timestamp_diff("DAY", F.col("_last"), F.col("_snap")).cast("long").alias("recency"),
                    (F.col("_spend") / F.col("_lines")).alias("avg_order_value"),
                    F.col("num_items").cast("double").alias("num_items")))
