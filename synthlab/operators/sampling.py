"""Seeded sampling and splitting.

All randomness is ``md5(key ':' seed)`` (see ``functions.keys``).  A row's place in a sample is
its position in hash order, ties broken by key, so results are identical across runs, engines and
executor retries.

Scale design.  "Take the q smallest-hash rows of each class" is the core of caps, stratified
splits, holdouts and small-n draws.  A window ``row_number() OVER (PARTITION BY class ORDER BY h)``
would put a whole class (half the table for a binary target) into one task.  Instead:

1. count rows per (class, hash bucket), bucket = first 5 hex digits of h (a prefix of the hash
   order, balanced by construction) -- a partial aggregation over the key columns only;
2. a running sum over that table finds, per class, the boundary bucket that contains the q-th row;
   only that bucket's distinct keys (n/2**20 of a class) are ranked, with their numbers of rows,
   which gives the class's cutoff, the (hash, key) of its q-th row;
3. one pass over the table compares each row with the cutoff of its class, broadcast.

Keys may repeat, also on a third of all rows.  Where only some rows of the boundary key are wanted,
its rows are counted by their whole content and chosen by a hash of that, in the same three steps;
rows equal in every column are made again from their count.

``hash_rank`` uses bucket counts as offsets to give every row its exact rank with windows
partitioned by (class, bucket), i.e. a range partitioning of the hash order with no hot task.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthlab.functions.exprs import join_on
from synthlab.functions.keys import hash_bucket, hash_hex, uniform_from_hex
from synthlab.session import materialise

H = "_h"
B = "_b"
BUCKET_DIGITS = 4


def with_hash(df: DataFrame, keys: Sequence[str], seed, name: str = H) -> DataFrame:
    return df.withColumn(name, hash_hex(keys, seed))


def _order(keys: Sequence[str]) -> list[Column]:
    return [F.col(H)] + [F.col(k) for k in keys]


CUT_DIGITS = 5          # 2**20 buckets of each group: a boundary bucket holds n / 2**20 of its rows
BROADCAST_GROUPS = 100_000


def cutoffs(hashed: DataFrame, keys: Sequence[str], by: list[str], quota, digits: int = CUT_DIGITS,
            weight: str | None = None) -> DataFrame:
    """(by, _q, _n, _cut, _part, _same): quota and size of each group, and where 0 < q < n the (hash,
    keys) of its q-th row, how many rows of that key are wanted and how many there are.  A row counts
    ``weight`` times.  Reads only the keys and group columns: counts per bucket, then the distinct
    keys of each group's boundary bucket.  One row per group, written to the shared folder."""
    w1 = F.col(weight) if weight else F.lit(1)
    narrow = hashed.select(*dict.fromkeys([*by, *keys, H]), w1.cast("long").alias("_w")).withColumn(B, hash_bucket(F.col(H), digits))
    counts = narrow.groupBy(*by, B).agg(F.sum("_w").alias("_n"))
    if isinstance(quota, DataFrame):
        counts = (join_on(counts, quota.select(*by, "_quota"), by, "left")
                  .withColumn("_q", F.coalesce(F.col("_quota").cast("long"), F.lit(0).cast("long"))).drop("_quota"))
    else:
        counts = counts.withColumn("_q", F.lit(int(quota)).cast("long"))
    w = Window.partitionBy(*by).orderBy(B).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = (F.col("_cum") >= F.col("_q")) & (F.col("_cum") - F.col("_n") < F.col("_q"))
    groups = materialise(
        counts.withColumn("_cum", F.sum("_n").over(w)).groupBy(*by)
        .agg(F.max("_q").alias("_q"), F.sum("_n").alias("_total"),
             F.max(F.when(edge, F.struct(F.col(B).alias("b"), (F.col("_q") - F.col("_cum") + F.col("_n")).alias("need"))))
             .alias("_edge"))
        .select(*by, "_q", F.col("_total").alias("_n"), F.col("_edge.b").alias("_eb"), F.col("_edge.need").alias("_need")),
        "groups")
    inner = groups.filter("_q > 0 and _q < _n").select(*by, "_eb", "_need")
    near = join_on(narrow, inner, by).filter(F.col(B) == F.col("_eb"))
    named = list(dict.fromkeys([*by, *keys]))
    near = near.groupBy(*named, H, "_need").agg(F.sum("_w").alias("_same"))
    wr = Window.partitionBy(*by).orderBy(*_order(keys)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (near.withColumn("_cum", F.sum("_same").over(wr))
            .filter((F.col("_cum") >= F.col("_need")) & (F.col("_cum") - F.col("_same") < F.col("_need")))
            .select(*by, F.struct(H, *keys).alias("_cut"), (F.col("_need") - F.col("_cum") + F.col("_same")).alias("_part"), "_same"))
    return materialise(join_on(groups.drop("_eb", "_need"), last, by, "left"), "cutoffs")


def select_smallest(df: DataFrame, keys: Sequence[str], seed, quota, by: Sequence[str] = (),
                    flag: str | None = None, digits: int = CUT_DIGITS) -> DataFrame:
    """Exact "q rows with the smallest hash per group".

    ``quota`` is an int or a DataFrame ``(*by, _quota)``; groups missing from it get 0 rows, and NULL
    is a group like any other.  With ``flag`` every row is kept and ``flag`` is true for the chosen
    rows; otherwise only the chosen rows are returned.  Two narrow passes find the cutoff of each
    group; the returned plan reads the input once and compares each row with its group's cutoff.
    Of a key whose rows are wanted in part, rows are chosen by a hash of all their columns.
    """
    by = list(by)
    columns = df.columns
    grouped = bool(by)
    if not grouped:
        df = df.withColumn("_g", F.lit(1))
        by = ["_g"]
        if isinstance(quota, DataFrame):
            quota = quota.withColumn("_g", F.lit(1))
    hashed = with_hash(df, keys, seed)
    cuts = cutoffs(hashed, keys, by, quota, digits)
    joined = join_on(hashed, cuts, by, broadcast=cuts.count() <= BROADCAST_GROUPS)
    own = F.struct(H, *keys)
    chosen = (F.when(F.col("_q") >= F.col("_n"), True).when(F.col("_q") <= 0, False).otherwise(own <= F.col("_cut")))
    split = cuts.where("_part < _same")
    if split.isEmpty():
        out = joined.withColumn("_chosen", chosen)
    else:
        tied = F.coalesce((F.col("_part") < F.col("_same")) & (own == F.col("_cut")), F.lit(False))
        clear = joined.where(~tied).withColumn("_chosen", chosen)
        out = clear.select(*columns, "_chosen").unionByName(
            _some_of_equal(joined.where(tied), columns, by, split, seed, digits))
    out = out.select(*columns, "_chosen")
    if flag:
        return out.withColumnRenamed("_chosen", flag)
    return out.filter("_chosen").drop("_chosen")


def _some_of_equal(tied: DataFrame, columns: list[str], by: list[str], split: DataFrame, seed, digits: int) -> DataFrame:
    """The rows of ``tied`` (one key in each group) with ``_chosen``, true for ``_part`` of each group."""
    extra = [c for c in by if c not in columns]
    row = F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    counted = tied.groupBy(*columns, *extra).agg(F.count(F.lit(1)).alias("_w")).withColumn("_row", row)
    counted = materialise(with_hash(counted, ["_row"], f"{seed}:equal"), "tied")
    cuts = cutoffs(counted, ["_row"], by, split.select(*by, F.col("_part").alias("_quota")), digits, weight="_w")
    own = F.struct(H, "_row")
    # the cutoff names one row content; of its copies the first _part are chosen
    wanted = (F.when(F.col("_q") >= F.col("_n"), F.col("_w")).when(own < F.col("_cut"), F.col("_w"))
              .when(own == F.col("_cut"), F.col("_part")).otherwise(F.lit(0)))
    copies = join_on(counted, cuts, by).withColumn("_take", wanted.cast("long"))
    # copies are made in blocks, so that one content on a third of all rows spreads over tasks
    block = 1 << 14
    starts = copies.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_w") - 1, F.lit(block).cast("long"))))
    spread = starts.repartition(*columns, "_from") if columns else starts
    each = spread.withColumn("_i", F.explode(F.sequence("_from", F.least(F.col("_from") + block, F.col("_w")) - 1)))
    return each.select(*columns, (F.col("_i") < F.col("_take")).alias("_chosen"))


def hash_rank(df: DataFrame, keys: Sequence[str], seed, by: Sequence[str] = (), name: str = "rank",
              digits: int = BUCKET_DIGITS) -> DataFrame:
    """Exact 1-based rank in hash order within ``by`` for every row.

    Window partitions are (group, hash bucket): balanced, each about n/16^digits rows.
    """
    by = list(by)
    hashed = with_hash(df, keys, seed).withColumn(B, hash_bucket(F.col(H), digits))
    counts = hashed.groupBy(*by, B).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(B).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select(*by, B, (F.sum("_n").over(w) - F.col("_n")).alias("_before"))
    ranked = join_on(hashed, offsets, by + [B])
    wr = Window.partitionBy(*by, B).orderBy(*_order(keys))
    return (ranked.withColumn(name, (F.col("_before") + F.row_number().over(wr)).cast("long"))
            .drop(H, B, "_before"))


PART_ROWS = 1 << 20         # rows of one task


def rows_at_ranks(df: DataFrame, keys: Sequence[str], seed, picks: DataFrame, at: str, rows: int, n_picks: int,
                  digits: int = BUCKET_DIGITS) -> DataFrame:
    """``picks`` (``n_picks`` rows) with the columns of the row of ``df`` (``rows`` rows) that has the 0-based
    hash rank ``at``; picks outside the ranks are left out.

    The numbers of rows of each bucket tell the bucket and the place of a pick, so rows and picks are
    each sent once, to their bucket, and meet there by two windows; ``hash_rank`` and a join on the
    rank would send the rows twice.  A hash is sent as 16 bytes, and a single key not at all: equal
    hashes are equal keys."""
    hexed = hash_hex(keys, seed)
    counts = df.select(hash_bucket(hexed, digits).alias(B)).groupBy(B).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(B).rowsBetween(Window.unboundedPreceding, -1)                    # 16^digits rows at most
    offsets = counts.select(B, "_n", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    # equal blocks of ranks, each with the few buckets that meet it: at most buckets + blocks rows
    block = max(1, rows >> (4 * digits))
    spans = offsets.select(B, "_before", "_n", F.explode(F.sequence(
        F.floor(F.col("_before") / block), F.floor((F.col("_before") + F.col("_n") - 1) / block))).alias("_block"))
    own = picks.columns
    placed = (picks.withColumn("_block", F.floor(F.col(at) / block)).join(F.broadcast(spans), "_block")
              .filter((F.col(at) >= F.col("_before")) & (F.col(at) < F.col("_before") + F.col("_n")))
              .select(B, F.lit(1).alias("_side"), (F.col(at) - F.col("_before")).alias("_pos"), F.lit(None).cast("binary").alias(H),
                      *[F.col(c).alias(f"_p_{c}") for c in own]))
    kept = df.select(hash_bucket(hexed, digits).alias(B), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_pos"),
                     F.unhex(hexed).alias(H), *[F.col(c).alias(f"_r_{c}") for c in df.columns])
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(rows + n_picks) // PART_ROWS))
    both = kept.unionByName(placed, allowMissingColumns=True).repartition(parts, B)
    ties = [F.col(f"_r_{k}") for k in keys] if len(keys) > 1 else []
    rank = F.row_number().over(Window.partitionBy(B, "_side").orderBy(H, *ties)) - 1
    both = both.withColumn("_pos", F.when(F.col("_side") == 0, rank.cast("long")).otherwise(F.col("_pos")))
    first = Window.partitionBy(B, "_pos").orderBy("_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.select("_side", *[F.col(f"_p_{c}").alias(c) for c in own],
                       *[F.first(f"_r_{c}").over(first).alias(c) for c in df.columns])
    return both.filter("_side = 1").drop("_side")


# ---- D1 / D6 / D8 ------------------------------------------------------------------------

def cap(df: DataFrame, keys: Sequence[str], n: int, seed) -> DataFrame:
    """min(n, rows) rows without replacement, chosen by hash order."""
    return select_smallest(df, keys, seed, n)


def shuffle(df: DataFrame, keys: Sequence[str], seed, name: str = "rank") -> DataFrame:
    """Deterministic permutation as an explicit rank column."""
    return hash_rank(df, keys, seed, name=name)


# ---- D2 / D3 / D4 / D7: quotas -------------------------------------------------------------

def class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n_class"))


def largest_remainder_quotas(counts: DataFrame, target: str, total: Column) -> DataFrame:
    """Split ``total`` rows over classes in proportion to ``n_class``: floor of the exact share,
    leftover rows to the largest remainders (ties by class value).  ``counts`` has one row per
    class, so the un-partitioned windows here run over a handful of rows."""
    w_all = Window.partitionBy()
    exact = total.cast("double") * F.col("n_class") / F.sum("n_class").over(w_all)
    q = counts.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact").cast("long"))
    q = q.withColumn("_left", (total - F.sum("_floor").over(w_all)).cast("long"))
    w_rem = Window.orderBy(F.desc(F.col("_exact") - F.col("_floor")), F.col(target))
    q = q.withColumn("_r", F.row_number().over(w_rem))
    return q.select(target, (F.col("_floor") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0)).alias("_quota"))


def stratified_split(df: DataFrame, keys: Sequence[str], target: str, seed, test_size: float = 0.2,
                     split_col: str = "split") -> DataFrame:
    """``split`` in {train, test}; n_test = ceil(test_size * n) allocated by largest remainder."""
    counts = class_counts(df, target)
    total = F.ceil(F.lit(float(test_size)) * F.sum("n_class").over(Window.partitionBy()))
    quotas = largest_remainder_quotas(counts, target, total)
    flagged = select_smallest(df, keys, seed, quotas, by=[target], flag="_test")
    return flagged.withColumn(split_col, F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def random_split(df: DataFrame, keys: Sequence[str], seed, test_size: float = 0.2,
                 split_col: str = "split") -> DataFrame:
    """D3: unstratified split (regression targets), n_test = ceil(test_size * n)."""
    n_test = df.agg(F.ceil(F.lit(float(test_size)) * F.count(F.lit(1))).alias("_quota"))
    flagged = select_smallest(df, keys, seed, n_test, flag="_test")
    return flagged.withColumn(split_col, F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def fixed_holdout(df: DataFrame, keys: Sequence[str], target: str, n_rows: int, seed=42) -> DataFrame:
    """Stratified holdout of absolute size ``n_rows``."""
    quotas = largest_remainder_quotas(class_counts(df, target), target, F.lit(int(n_rows)))
    return select_smallest(df, keys, seed, quotas, by=[target])


def pool_without(df: DataFrame, holdout: DataFrame, keys: Sequence[str]) -> DataFrame:
    """pool = df minus holdout (anti-join on key); a NULL key equals a NULL key."""
    return join_on(df, holdout.select(*keys), list(keys), "left_anti")


def small_n(pool: DataFrame, keys: Sequence[str], n: int, seed) -> DataFrame:
    """Simple n-row draw from the pool."""
    return select_smallest(pool, keys, seed, n)


def small_n_stratified_quotas(pool: DataFrame, target: str, n: int) -> DataFrame:
    """D7 quotas: n_pos = max(1, round_half_even(n * p)), n_neg = n - n_pos."""
    p = pool.agg(F.avg(F.col(target).cast("double")).alias("_p"))
    npos = p.select(F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("_p"), 0).cast("long")).alias("_npos"))
    return npos.select(F.explode(F.array(
        F.struct(F.lit(1).alias(target), F.col("_npos").alias("_quota")),
        F.struct(F.lit(0).alias(target), (F.lit(n) - F.col("_npos")).alias("_quota")))).alias("_s")).select("_s.*")


def small_n_stratified(pool: DataFrame, keys: Sequence[str], target: str, n: int, seed) -> DataFrame:
    quotas = small_n_stratified_quotas(pool, target, n)
    quotas = quotas.withColumn(target, F.col(target).cast(dict(pool.dtypes)[target]))
    return select_smallest(pool, keys, seed, quotas, by=[target])


# ---- D9 / D10 / D11 / D12 / D13 / D14 / D15 ---------------------------------------------------

# fixed values: mixing ratios, run seeds and sizes of the published experiments
ALPHAS = (0.1, 0.2, 0.3, 0.5, 1.0)
LOW_DATA_SIZES = (250, 500, 1000, 2000)


def low_data_sizes(n_rows: Column, sizes: Sequence[int] = LOW_DATA_SIZES, frac: float = 0.7) -> Column:
    """Sizes n with n < frac * rows (as an array column)."""
    arr = F.array(*[F.lit(int(s)) for s in sizes])
    return F.filter(arr, lambda s: s < F.lit(frac) * n_rows)


def sparsify(df: DataFrame, keys: Sequence[str], features: Sequence[str], rate: float, seed) -> DataFrame:
    """Zero each feature cell independently with probability ``rate``; salt = seed:column.
    One projection, no shuffle."""
    out = []
    for c in df.columns:
        if c in features:
            u = uniform_from_hex(hash_hex(list(keys), f"{seed}:{c}"))
            out.append(F.when(u < F.lit(float(rate)), F.lit(0).cast(dict(df.dtypes)[c])).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def n_for_alpha(n_real: Column, alpha: Column, rounding: str = "floor") -> Column:
    """T4: n_syn = floor(alpha * n) or round-half-even(alpha * n)."""
    x = alpha.cast("double") * n_real.cast("double")
    return (F.floor(x) if rounding == "floor" else F.bround(x, 0)).cast("long")


def nested_prefix(syn: DataFrame, alphas: DataFrame, n_real, rank_col: str = "syn_rank",
                  rounding: str = "floor") -> DataFrame:
    """Rows 1..n_alpha of one ranked synthetic table for every alpha at once.

    ``alphas`` is a parameter table (alpha DOUBLE), a handful of rows; ``n_real`` an int or a
    one-row DataFrame ``(n_real)``.  The (alpha, n_alpha) table is broadcast and the non-equi
    condition runs as a broadcast nested-loop join that never shuffles ``syn``."""
    a = alphas.select(F.col("alpha").cast("double").alias("alpha"))
    if isinstance(n_real, DataFrame):
        a = a.crossJoin(F.broadcast(n_real.select(F.col("n_real").cast("long").alias("_nr"))))  # one row
    else:
        a = a.withColumn("_nr", F.lit(int(n_real)).cast("long"))
    a = a.select("alpha", n_for_alpha(F.col("_nr"), F.col("alpha"), rounding).alias("n_alpha"))
    return syn.join(F.broadcast(a), F.col(rank_col) <= F.col("n_alpha"), "inner")


def head(df: DataFrame, n: int, rank_col: str = "syn_rank") -> DataFrame:
    """Deterministic head(n) on an explicit rank."""
    return df.filter(F.col(rank_col) <= n)


def minority_budget(df: DataFrame, target: str, split_col: str = "split") -> DataFrame:
    """Rows and positives per split."""
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.sum(F.col(target).cast("long")).alias("n_pos"))


def single_class_guard(sample: DataFrame, target: str, by: Sequence[str]) -> DataFrame:
    """One row per sample with the error text when only one class is present."""
    return sample.groupBy(*by).agg(F.countDistinct(target).cast("long").alias("n_classes")).select(
        *by, "n_classes", F.when(F.col("n_classes") < 2, F.lit("single class in training sample")).alias("error"))


def leak_check(train: DataFrame, holdout: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present in both train and holdout (must be empty); a NULL key equals a NULL key."""
    return join_on(train.select(*keys), holdout.select(*keys), list(keys), "left_semi")
