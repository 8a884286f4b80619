"""Synthetic-row generators, table -> table.

Every generator returns rows with the training schema plus ``syn_rank`` (1..n), so one generated
table serves every mixing ratio through ``sampling.nested_prefix`` (fit once, prefixes, T7).
Randomness is the portable hash keyed by the synthetic row id and the run seed (T23).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthlab.functions.keys import hash_normal, hash_uniform, hash_uniform52
from synthlab.operators.copula import class_targeted, fit_copula, gaussian_copula  # noqa: F401
from synthlab.operators.knn import knn
from synthlab.operators.sampling import hash_rank, rows_at_ranks
from synthlab.session import materialise


def _vec(features: Sequence[str]):
    return F.array(*[F.col(c).cast("double") for c in features])


def smote_guard(n_minority: int, k: int = 5) -> tuple[int, str | None]:
    """Effective k = min(k, minority - 1); fewer than 2 minority rows -> error text."""
    if n_minority < 2:
        return 0, f"minority class has {n_minority} row(s): SMOTE needs at least 2"
    return min(k, n_minority - 1), None


def smote_skip(n_minority: int, k: int = 5) -> str | None:
    """Reason to leave SMOTE out of a run: the minority cannot give k neighbours to each row."""
    return None if n_minority > k else f"skipped: {n_minority} minority rows, SMOTE with k={k} needs {k + 1}"


ID_BLOCK = 1 << 14              # synthetic rows made at once from one base row


def minority_neighbours(train: DataFrame, key: str, features: Sequence[str], target: str, k: int = 5,
                        slab_size: int = 256) -> DataFrame:
    """The min(k, minority - 1) nearest minority neighbours of every minority row, written once: what
    ``smote`` needs of the training rows whatever its seed."""
    minority = train.filter(F.col(target) == 1).select(key, _vec(features).alias("_x"))
    k_eff, err = smote_guard(minority.count(), k)
    if err:
        raise ValueError(err)
    return materialise(knn(minority, key, "_x", k_eff, slab_size=slab_size, dims=len(features)), "neighbours")


def smote(train: DataFrame, key: str, features: Sequence[str], target: str, n: int | DataFrame, seed,
          k: int = 5, slab_size: int = 256, neighbours: DataFrame | None = None) -> DataFrame:
    """G1: ``n`` new minority rows (target = 1): synthetic row i takes base row (i mod m) of the
    minority in hash order, one of its k exact nearest minority neighbours and a step
    lambda in [0, 1): x + lambda * (nn - x).  ``n`` may be a one-row DataFrame ``(n_syn)``.
    ``neighbours`` (``minority_neighbours`` with the same k) may be shared by several seeds.

    A base row is joined with its neighbours first and then makes its own synthetic rows i, i + m, ...,
    so what is shuffled grows with the minority and not with ``n``."""
    minority = train.filter(F.col(target) == 1).select(key, _vec(features).alias("_x"))
    m = minority.count()
    k_eff, err = smote_guard(m, k)
    if err:
        raise ValueError(err)
    nn = knn(minority, key, "_x", k_eff, slab_size=slab_size, dims=len(features)) if neighbours is None else neighbours
    n = int(n.first()["n_syn"] if isinstance(n, DataFrame) else n)
    ends = minority.select(F.col(key).alias("_nk"), F.col("_x").alias("_nx"))
    near = (nn.select(F.col(key).alias("_bk"), "nn_rank", "nn_key").join(ends, F.col("_nk") == F.col("nn_key"), "inner")
            .groupBy("_bk").agg(F.collect_list(F.struct("nn_rank", "nn_key", "_nx")).alias("_near")))   # k ends, more where keys repeat
    base = hash_rank(minority, [key], seed, name="_idx").withColumn("_idx", F.col("_idx") - 1).filter(F.col("_idx") < n)
    j = base.join(near, F.col("_bk") == F.col(key), "inner")
    if -(-n // m) > ID_BLOCK:           # few base rows for many synthetic ones: their ids are made in blocks, spread over tasks
        j = j.withColumn("_from", F.explode(F.sequence(F.col("_idx"), F.lit(n - 1).cast("long"), F.lit(m * ID_BLOCK).cast("long"))))
        j = j.repartition("_from")
        last = F.least(F.col("_from") + F.lit(m * ID_BLOCK - 1).cast("long"), F.lit(n - 1).cast("long"))
    else:
        j, last = j.withColumn("_from", F.col("_idx")), F.lit(n - 1).cast("long")
    j = j.withColumn("id", F.explode(F.sequence("_from", last, F.lit(m).cast("long"))))
    j = (j.withColumn("_rank", (F.floor(hash_uniform(["id"], f"{seed}:nn") * k_eff) + 1).cast("long"))
         .withColumn("_end", F.explode(F.filter("_near", lambda e: e["nn_rank"] == F.col("_rank"))))
         .withColumn("_lam", hash_uniform(["id"], f"{seed}:lam")))
    new = F.zip_with(F.col("_x"), F.col("_end._nx"), lambda a, b: a + F.col("_lam") * (b - a))
    out = j.select((F.col("id") + 1).alias("syn_rank"), F.col(key).alias("base_key"), F.col("_end.nn_key").alias("nn_key"), new.alias("_new"))
    return out.select("syn_rank", "base_key", "nn_key",
                      *[F.col("_new")[i].alias(c) for i, c in enumerate(features)], F.lit(1).alias(target))


def bootstrap_jitter(train: DataFrame, key: str, features: Sequence[str], target: str, n: int, seed,
                     sigma: float = 0.1) -> DataFrame:
    """Resample rows (hash draw with replacement) and add N(0, (sigma * sd)^2) noise per column."""
    spark = train.sparkSession
    m = train.count()
    sds = train.agg(*[F.stddev_samp(c).alias(f"_sd_{c}") for c in features])
    ids = spark.range(0, int(n)).select(
        F.col("id").alias("_i"),
        F.least(F.floor(hash_uniform52(["id"], f"{seed}:pick") * m).cast("long"), F.lit(m - 1)).alias("_idx"))
    j = rows_at_ranks(train, [key], seed, ids, "_idx", m, int(n)).crossJoin(F.broadcast(sds))
    cols = [(F.col(c) + F.lit(sigma) * F.coalesce(F.col(f"_sd_{c}"), F.lit(0.0)) * hash_normal(["_i"], f"{seed}:{c}")).alias(c)
            for c in features]
    return j.select((F.col("_i") + 1).alias("syn_rank"), *cols, F.col(target))


# ---- G7: row textualisation and parse-back ---------------------------------------------------------

#: characters that a value may hold without quotes
_BARE = r"^[^\s,\"\\][^,\"\\]*$"


def row_text(df: DataFrame, key: str, cols: Sequence[str], seed=None) -> DataFrame:
    """G7: "a is 1, b is 2.5, target is 0"; with ``seed`` the column order is a hash permutation per row.

    A value that could be misread (a comma, a quote, a backslash, white space at its ends, an empty
    text, or the word None) is written in double quotes, with backslashes before quotes and
    backslashes; NULL is the bare word None.  Names are written as they are and must not hold
    commas, quotes or `` is ``."""
    def shown(c: str):
        v = F.col(c).cast("string")
        bare = v.rlike(_BARE) & (F.trim(v) == v) & (v != "None") & ~v.rlike(r"\s$")
        quoted = F.concat(F.lit('"'), F.regexp_replace(v, r'(["\\])', r"\\$1"), F.lit('"'))
        return F.when(v.isNull(), F.lit("None")).when(bare, v).otherwise(quoted)
    parts = [F.struct(F.lit(c).alias("name"), shown(c).alias("val")) for c in cols]
    arr = F.array(*parts)
    if seed is not None:
        arr = F.transform(arr, lambda s: F.struct(
            F.md5(F.concat_ws(":", F.col(key).cast("string"), s["name"], F.lit(str(seed)))).alias("h"), s["name"].alias("name"),
            s["val"].alias("val")))
        arr = F.transform(F.array_sort(arr), lambda s: F.struct(s["name"].alias("name"), s["val"].alias("val")))
    text = F.array_join(F.transform(arr, lambda s: F.concat(s["name"], F.lit(" is "), s["val"])), ", ")
    return df.select(key, text.alias("text"))


#: one field: a name, `` is ``, then a quoted or a bare value, up to a comma or the end
_FIELD = r'([^,"]+?) is ("(?:[^"\\]|\\.)*"|[^,"]*)(?:, |$)'


def row_parse(texts: DataFrame, key: str, schema: dict[str, str]) -> DataFrame:
    """G7 inverse: (key, the columns of ``schema``, error).

    Every text gives one row and none ends the job.  ``error`` is the first of: the text is not a
    list of "name is value" fields, a field of the schema is missing, one stands twice, or a value
    does not have its column's type.  A bare None is NULL and no error.  Fields outside the schema
    are passed over.  Values of bad rows are NULL where they cannot be read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    names = F.transform(F.regexp_extract_all(text, F.lit("(?s)" + _FIELD), F.lit(1)), lambda n: F.trim(n))
    values = F.regexp_extract_all(text, F.lit("(?s)" + _FIELD), F.lit(2))
    read = texts.select(F.col(key), names.alias("_n"), values.alias("_v"),
                        (F.regexp_replace(text, "(?s)" + _FIELD, "") == "").alias("_whole"))
    cols, missing, twice, wrong = [], F.lit(False), F.lit(False), F.lit(False)
    for c, kind in schema.items():
        at = F.array_position("_n", F.lit(c)).cast("int")               # 0: not there
        there = F.get("_v", at - 1)
        inside = F.regexp_replace(there.substr(F.lit(2), F.length(there) - 2), r"(?s)\\(.)", "$1")
        raw = F.when(there.startswith('"'), inside).otherwise(F.when(there != "None", there))
        # an unquoted empty value is no value
        cols.append(raw.try_cast(kind).alias(c))
        missing = missing | (at == 0) | F.coalesce(there == "", F.lit(False))
        twice = twice | (F.array_position(F.slice("_n", at + 1, F.size("_n")), F.lit(c)) > 0)
        wrong = wrong | (raw.isNotNull() & raw.try_cast(kind).isNull())
    error = (F.when(~F.col("_whole"), "not a list of fields").when(missing, "missing field")
             .when(twice, "repeated field").when(wrong, "value of another type"))
    return read.select(key, *cols, error.alias("error"))
