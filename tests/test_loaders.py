"""Loader registry, delimited raw files and the rules on a whole profile."""
import pytest
from pyspark.sql import functions as F

from synthlab.operators.prep import interpolation_unstable
from synthlab.operators.report import recommend_profile
from synthlab.plans.loaders import KEY, LOADERS, dataset
from synthlab.sources.files import raw_file, read_delimited
from conftest import SF_SMALL


@pytest.mark.parametrize("name", ["bank", "retail", "criteo"])
def test_loader_returns_a_dataset_that_meets_the_contract(spark, name):
    ds = LOADERS[name](spark, SF_SMALL)
    types = dict(ds.df.dtypes)
    assert ds.name == name and ds.key == KEY and ds.target not in ds.features
    assert ds.df.columns == [KEY, *ds.features, ds.target] and all(types[c] == "double" for c in ds.features)
    assert ds.df.count() > 0 == ds.df.filter(F.col(KEY).isNull()).count()
    if ds.task == "classification":
        assert {r[0] for r in ds.df.select(ds.target).distinct().collect()} <= {0, 1}


def test_unknown_loader(spark):
    with pytest.raises(KeyError):
        dataset(spark, SF_SMALL, "nothing")


def test_raw_file_keeps_blanks_quotes_separators_and_nulls(spark):
    rows = [(1, " x "), (2, 'say "a, b"'), (3, None), (4, "é\ttab"), (5, "1")]
    df = spark.createDataFrame(rows, "id int, t string")
    for sep in (",", ";", "\t"):
        back = read_delimited(spark, raw_file(df, "raw", sep=sep), sep=sep, schema="id int, t string")
        assert sorted((r["id"], r["t"]) for r in back.collect()) == rows
    none = df.limit(0)
    assert read_delimited(spark, raw_file(none, "raw"), schema="id int, t string").count() == 0


def test_rules_on_a_profile(spark):
    cases = [  # goal, rate, n, smallest group, named features -> advice
        ("share", 0.001, 10, 1, True, "share_copies_and_test_privacy"),
        ("predict", 0.0999, 10 ** 6, 10 ** 5, False, "oversample_minority"),
        ("predict", 0.10, 10 ** 6, 199, True, "language_model_small_alpha"),
        ("predict", 0.10, 10 ** 6, 199, False, "fit_statistical_generator"),
        ("predict", 0.10, 10 ** 6, 199, None, "fit_statistical_generator"),
        ("uplift", 0.50, 10 ** 6, 200, False, "fit_generator_and_grow_2x_to_5x"),
        ("uplift", 0.50, 10 ** 6, 5000, False, "known_process_only"),
        ("predict", 0.50, 50_001, 5000, False, "real_rows_suffice"),
        ("predict", 0.50, 50_000, 5000, False, "sweep_alpha_0.1_to_0.5"),
        ("predict", 0.30, 10 ** 6, 5000, False, "sweep_alpha_0.1_to_0.5"),
        (None, None, None, None, None, "sweep_alpha_0.1_to_0.5"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)],
                               "i int, goal string, rate double, n long, g long, named boolean, want string")
    got = df.select("i", "want", recommend_profile(*[F.col(c) for c in ("goal", "rate", "n", "g", "named")]).alias("got"),
                    interpolation_unstable(F.col("rate")).alias("w"))
    rows = got.orderBy("i").collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    assert [r["w"] for r in rows] == [True] + [False] * 10
