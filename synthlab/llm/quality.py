"""Quality rules: base limits, then a decision list learned from labelled statistics.

``text_statistics`` counts words, symbols, repeated lines and repeated 5-word windows of whole
texts.  ``learn_rules`` builds a decision list by sequential covering: a rule is a conjunction of
thresholds on ratios of those counts; it is grown literal by literal on two thirds of the labelled
rows (information gain), pruned from its end on the other third, kept if it is precise there, and
the rows it covers are taken away before the next rule.  ``rules_column`` turns the list into one
ordered ``CASE WHEN`` expression, so applying it is plain Spark SQL.

The learner sees a bounded sample of the labelled rows (``SAMPLE_ROWS``, chosen by a hash of the
key); the statistics and the verdicts cover every row and whole texts.
"""
from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthlab.llm.common import WORD, fresh_name, one_text, text_udf

#: most labelled rows that reach the learner
SAMPLE_ROWS = 12_000
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: features of the learner, as SQL over the counts; defined for empty texts too
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_per_100_words": "100 * n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}


def count_text(text: str) -> tuple[int, int, int, int, int]:
    """The five counts of one text, in the order of ``COUNTS``."""
    words = WORD.findall(text)
    n = len(words)
    seen = Counter(line for line in text.split("\n") if WORD.search(line))
    repeats = 0
    if n > WINDOW:
        windows = list(zip(*[words[i:] for i in range(WINDOW)]))
        found = Counter(windows)
        if len(found) < len(windows):
            end = 0                                  # words before it are counted
            for i, w in enumerate(windows):
                if found[w] > 1:
                    repeats += i + WINDOW - max(end, i)
                    end = i + WINDOW
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), seen.total() - len(seen), repeats


def _counts(texts: list[str]) -> pa.Array:
    rows = np.array([count_text(t) for t in texts], dtype=np.int64).reshape(-1, len(COUNTS))
    return pa.StructArray.from_arrays([pa.array(c) for c in rows.T], COUNTS)


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``df`` and the five counts (long).  Null and empty texts have none of all.

    An input column named like a count is replaced.
    """
    fields = ", ".join(f"{c}: bigint" for c in COUNTS)
    name = fresh_name(df, "counts")
    counted = df.withColumn(name, text_udf(f"struct<{fields}>", _counts)(F.col(text)))
    others = [F.col(f"`{c}`") for c in df.columns if c.lower() not in COUNTS]
    return counted.select(*others, *[F.col(name).getField(c).alias(c) for c in COUNTS])


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words")


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature]).cast("double")
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.feature] >= self.threshold if self.above else table[self.feature] < self.threshold


Rule = tuple[Literal, ...]


def covers(rule: Rule, table: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(table.values()))), bool)
    for literal in rule:
        out &= literal.holds(table)
    return out


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray]) -> Rule:
    """Add the literal of the largest information gain until the rule covers bad rows only."""
    rule: list[Literal] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < 4:
        p, n = int((inside & bad).sum()), int(inside.sum())
        if p == 0 or p == n:
            break
        best, gain = None, 1e-9
        for name, points in cuts.items():
            for threshold in points:
                above = table[name] >= threshold
                for up in (True, False):
                    new = inside & (above if up else ~above)
                    k, m = int((new & bad).sum()), int(new.sum())
                    g = k * (np.log2(k / m) - np.log2(p / n)) if k else 0.0
                    if g > gain:
                        best, gain = Literal(name, up, float(threshold)), g
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(table)
    return tuple(rule)


def _prune(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop final literals while the share of (bad - good) among covered rows does not fall."""
    def worth(r: Rule) -> float:
        hit = covers(r, table)
        return (2 * (hit & bad).sum() - hit.sum()) / max(1, hit.sum())
    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn_rules(table: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9,
                least: int = 5, most_rules: int = 12, cuts: int = 24) -> list[Rule]:
    """Ordered rules that mark bad rows.  No rows, or no bad ones, give no rules.

    Row i is in the pruning third if i % 3 == 2 (callers order rows by a hash).  A rule stays if it
    covers ``least`` bad rows and is right for ``precision`` of what it covers, on all rows left and
    on the pruning third alone; the first rule that is not ends the list.
    """
    rules: list[Rule] = []
    left = np.arange(len(bad))
    while len(rules) < most_rules:
        sub = {k: v[left] for k, v in table.items()}
        y = bad[left]
        if y.sum() < least:
            break
        third = left % 3 == 2
        grow = {k: v[~third] for k, v in sub.items()}
        test = {k: v[third] for k, v in sub.items()}
        points = {k: np.unique(np.quantile(v[y], np.linspace(0, 1, cuts))) for k, v in sub.items()}
        rule = _prune(_grow(grow, y[~third], points), test, y[third])
        if not rule:
            break
        hit, unseen = covers(rule, sub), covers(rule, test)
        right = (hit & y).sum()
        if right < least or right < precision * hit.sum() or (unseen & y[third]).sum() < precision * unseen.sum():
            break
        rules.append(rule)
        left = left[~hit]
    return rules


def rules_column(rules: list[Rule]) -> Column:
    """First rule that holds, from 1; 0 if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        condition = rule[0].column()
        for literal in rule[1:]:
            condition = condition & literal.column()
        out = F.when(condition, i) if out is None else out.when(condition, i)
    return F.lit(0) if out is None else out.otherwise(0)


def fit_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
              label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learn from at most ``sample_rows`` labelled keys (label 0 is bad), one text of each.

    Keys are drawn by a hash; a key with a null or two different labels is left out, as are rows
    that the base limits reject anyway.  No usable label gives no rules.
    """
    one = (labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
           .groupBy(F.col(key).alias("_k")).agg(F.min(label).alias("_y"), F.max(label).alias("_z"))
           .where("_y = _z").select("_k", "_y"))
    # ordering by the hash with a limit is a top-k per task: bounded, and the same rows each time
    drawn = one.orderBy(F.xxhash64("_k"), "_k").limit(sample_rows)
    # one text of each key, so that no repeated key crowds out others
    found = text_statistics(one_text(docs, drawn, key, text), "_t")
    rows = (found.where(~base_failed())
            .select("_k", "_y", *[F.expr(sql).cast("double").alias(name) for name, sql in FEATURES.items()])
            .orderBy(F.xxhash64("_k"), "_k").toPandas())
    return learn_rules({name: rows[name].to_numpy(float) for name in FEATURES}, (rows["_y"] == 0).to_numpy())


def judge_quality(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """All columns of ``docs``, the five counts, ``rule`` (int; the rule that rejects the row, from
    1, or 0), ``base_failed`` and ``kept`` (boolean).  Input columns of these names are replaced.

    Null and empty texts have no words and fail the base limit.  Equal texts get equal verdicts.
    """
    return (text_statistics(docs.drop("rule", "base_failed", "kept"), text)
            .withColumn("rule", rules_column(rules))
            .withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs`` only."""
    rules = fit_rules(docs, labels)
    packed = docs.select(F.struct("*").alias("doc"), F.col("text"))
    return judge_quality(packed, rules).where("kept").select("doc.*")
