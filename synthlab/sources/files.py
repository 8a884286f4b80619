"""Delimited scans, result files and sinks."""
from __future__ import annotations

import csv
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthlab.session import materialise, scratch_path  # noqa: F401  (the source queries use both)


def read_delimited(spark: SparkSession, path: str, schema: str | None = None, header: bool = True, sep: str = ",",
                   names: Sequence[str] | None = None, partitions: int | None = None) -> DataFrame:
    """CSV with header / ';' / headerless whitespace with generated names / gzip.

    With ``schema`` nothing is inferred.  ``.gz`` files, also in a folder, are not splittable, so the scan is
    repartitioned right after reading to spread the rest of the plan."""
    r = spark.read.option("header", header).option("sep", sep)
    df = r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)
    if names is not None:
        df = df.toDF(*names)
    if any(f.endswith(".gz") for f in df.inputFiles()):
        df = df.repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df


def raw_file(df: DataFrame, name: str, sep: str = ",", header: bool = True) -> str:
    """``df`` written as delimited text, blanks of values kept; returns the fresh folder."""
    path = scratch_path(df.sparkSession, name)
    (df.write.option("header", header).option("sep", sep).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def generated_names(n_features: int, target: str = "target") -> list[str]:
    """S3: f0..f{n-1}, target."""
    return [f"f{i}" for i in range(n_features)] + [target]


# canonical result schema (FIXTURES.md): every result loader returns these columns
CANONICAL = [("dataset", "string"), ("n", "bigint"), ("seed", "int"), ("method", "string"), ("condition", "string"),
             ("alpha", "double"), ("classifier", "string"), ("model", "string"), ("auc_roc", "double"),
             ("f1_minority", "double"), ("avg_precision", "double"), ("mape", "double"), ("r2", "double"),
             ("error", "string"), ("run_id", "string"), ("holdout_id", "string")]
ALIASES = {"auc_roc": ["auc_roc", "auc"], "method": ["method", "generator"]}


def canonical_results(df: DataFrame, dataset: F.Column | None = None) -> DataFrame:
    """Map schema variants (auc vs auc_roc, method vs generator, optional columns) to the canonical schema."""
    have = {c.lower(): c for c in df.columns}
    cols = []
    for name, typ in CANONICAL:
        cands = [have[a] for a in ALIASES.get(name, [name]) if a in have]
        if name == "dataset" and dataset is not None and "dataset" not in have:
            expr = dataset
        elif cands:
            expr = F.coalesce(*[F.col(c) for c in cands]) if len(cands) > 1 else F.col(cands[0])
        else:
            expr = F.lit(None)
        if name != "dataset" and typ != "string" and cands and dict(df.dtypes)[cands[0]] == "string":
            expr = expr.try_cast("double")                       # text of "100", "100.0" or nothing
        cols.append(expr.cast(typ).alias(name))
    return df.select(*cols)


def _any_match(spark: SparkSession, pattern: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jpath)
    return found is not None and len(found) > 0


def read_result_files(spark: SparkSession, pattern: str, name_regex: str = r"([^/]+)\.csv(?:/[^/]*)?$",
                      escape: str = "\\") -> DataFrame:
    """Many result CSVs at once, missing files skipped; the dataset label comes from the file
    (or output folder) name.  Tasks find each file's header (its first line); files of one header are one
    CSV scan with its columns, mapped to the canonical schema (S6), and the scans are unioned.  Quoted
    values may hold line breaks, so a file is read by one task; ``escape='"'`` for doubled quotes."""
    if not _any_match(spark, pattern):
        return spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in CANONICAL))
    lines = spark.read.text(pattern).where("_metadata.file_block_start = 0").select(
        "value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_id"))
    heads = lines.groupBy("_file").agg(F.min_by("value", "_id").alias("_head"))
    groups: dict[str, list[str]] = {}
    for file, head in sorted(heads.collect()):                # one row per file: the listing a scan holds anyway
        groups.setdefault(head, []).append(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(
            spark.sparkContext._jvm.java.net.URI(file)).toString())
    out = None
    for head, paths in groups.items():
        schema = ", ".join(f"`{n}` STRING" for n in next(csv.reader([head])))
        df = (spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True)
              .option("escape", escape).csv(paths))
        df = canonical_results(df, dataset=F.regexp_extract(F.col("_metadata.file_path"), name_regex, 1))
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in CANONICAL))


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result sink partitioned by dataset (partition pruning on later reads)."""
    df.write.mode(mode).partitionBy("dataset").parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)


def prepared(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the prepared table if it exists, else build, write (never overwrite) and read it."""
    if not path_exists(spark, path):
        build().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def append_new(spark: SparkSession, rows: DataFrame, path: str, cell: Sequence[str]) -> DataFrame:
    """Idempotent append: only cells not yet in the table are written (re-running is safe)."""
    if path_exists(spark, path):
        done = spark.read.parquet(path).select(*cell)
        todo = rows.join(done, [rows[c].eqNullSafe(done[c]) for c in cell], "left_anti") if cell else rows
    else:
        todo = rows
    todo.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def guarded_write(spark: SparkSession, df: DataFrame, path: str, side_path: str) -> str:
    """Never shrink a merged artifact: fewer rows than the existing table go to ``side_path``."""
    if path_exists(spark, path):
        df = materialise(df, "guarded")             # computed once, counted and written from there
        if df.count() < spark.read.parquet(path).count():
            df.write.mode("overwrite").parquet(side_path)
            return side_path
    df.write.mode("overwrite").parquet(path)
    return path


def ingest_synthetic(external: DataFrame, train_schema: DataFrame, target: str) -> DataFrame:
    """Externally generated rows: reorder to the training columns, coerce types (bad -> NULL,
    target: coerce, NULL -> 0, truncate), reject empty input."""
    missing = [c for c in train_schema.columns if c not in external.columns]
    if missing:
        raise ValueError(f"synthetic rows lack columns {missing}")
    types = dict(train_schema.dtypes)
    cols = []
    for c in train_schema.columns:
        if c == target:
            cols.append(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).cast("int").alias(c))
        else:
            cols.append(F.col(c).try_cast(types[c]).alias(c))
    out = external.select(*cols)
    if out.limit(1).count() == 0:
        raise ValueError("synthetic source is empty")
    return out
