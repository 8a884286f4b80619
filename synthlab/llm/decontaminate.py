"""Benchmark decontamination by winnowing, with DataFrame functions only.

Shared spans of ``SPAN`` words are found without comparing every window: hash every k-gram, keep the
smallest hash of each run of w k-grams.  Two texts that share ``w + k - 1`` words share a whole run,
so both keep the same k-gram of it; with k = 6 and w = 8 every shared span of 13 words leaves a
common fingerprint, at about two fingerprints per nine words.  Fingerprints of documents are joined with
those of the items, and each hit is extended word by word to either side, as far as a window through
it can reach; hits that make a full window mark their words.

An item of fewer words than ``SPAN`` is one window of its own length L; documents are winnowed once
more for each such length that occurs, with a guarantee of L.

Hash and position share a long: 34 bits of hash above 30 bits of position (a string of 2 GB has at
most 2**30 words).  Chance agreements of the hash fall out when words are compared.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthlab.llm.common import fold_column, fresh_name
from synthlab.session import materialise

SPAN, PERCENT = 13, 5
POSITION_BITS = 30
#: largest item fingerprint table that is sent to every task, in rows of about 250 bytes; a larger
#: one is joined by shuffle
BROADCAST_ROWS = 200_000
#: and octets of their words
BROADCAST_OCTETS = 64 << 20
#: runs of ASCII characters other than letters and digits (upper case is folded before)
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"




def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a lambda variable is not copied into every place
    that names it, as a column expression is."""
    return F.transform(F.array(value), use)[0]


def _parts(text: Column, use) -> Column:
    """``use(parts, lead, tail)`` of the folded text cut at what is no word; only the first and the
    last part can be empty, which lead and tail tell (0 or 1)."""
    def run(parts: Column) -> Column:
        return use(parts, F.when(parts[0] == "", 1).otherwise(0),
                   F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0))
    return _let(F.split(fold_column(F.coalesce(text, F.lit(""))), NOT_WORD), run)


def words_of(text: Column) -> Column:
    """Words of the folded text; null has none."""
    return _parts(text, lambda parts, lead, tail: F.slice(parts, lead + 1, F.size(parts) - lead - tail))


def word_count(text: Column) -> Column:
    return _parts(text, lambda parts, lead, tail: (F.size(parts) - lead - tail).cast("long"))


def scheme(span: int) -> tuple[int, int]:
    """(k, w) with k + w - 1 = span; w is a power of two, so that minima of runs double up to it."""
    w = 8 if span >= SPAN else 4 if span >= 9 else 1
    return span - w + 1, w


def _ahead(values: Column, steps: int, less: int) -> Column:
    """The values from place ``steps`` on, ``less`` fewer than there are."""
    return F.slice(values, F.lit(steps + 1), F.size(values) - less)


def _grams(hashes: Column, k: int) -> Column:
    """Hash of each k-gram from the hashes of words, by joining shorter grams."""
    if k == 1:
        return hashes
    half = k // 2
    return _let(_grams(hashes, half), lambda g: _pair(
        _ahead(g, 0, k - half), _ahead(_grams(hashes, k - half) if k % 2 else g, half, half if k % 2 else k - half)))


def _pair(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))


def fingerprints(words: Column, span: int) -> Column:
    """Winnowed fingerprints of an array of words, hash above position (from 0); fewer words than
    ``span`` give none."""
    k, w = scheme(span)
    low = (1 << POSITION_BITS) - 1

    def minima(runs: Column, reach: int) -> Column:
        if reach == w:
            return F.array_distinct(runs)
        doubled = F.zip_with(_ahead(runs, 0, reach), _ahead(runs, reach, reach), lambda a, b: F.least(a, b))
        return _let(doubled, lambda d: minima(d, 2 * reach))
    placed = _let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: F.transform(
        _grams(h, k), lambda g, i: g.bitwiseAND(F.lit(~low)).bitwiseOR(i)))
    return (F.when(F.size(words) >= span, _let(placed, lambda g: minima(g, 1)))
            .otherwise(F.array().cast("array<bigint>")))


def _around(words: Column, at: Column, span: int) -> tuple[Column, Column]:
    """(the words that a window through the k-gram at ``at`` can hold, how many lie before it)."""
    k, _ = scheme(span)
    before = F.least(at, F.lit(span - k))
    return F.slice(words, at - before + 1, before + F.lit(span)), before


def _equal_run(a: Column, a_at: Column, b: Column, b_at: Column, step: int, most: int) -> Column:
    """How many words agree, going by ``step`` from the two places, ``most`` at most."""
    out = F.lit(0)
    for j in range(most - 1, -1, -1):
        same = F.get(a, a_at + step * j) == F.get(b, b_at + step * j)
        out = F.when(same, out + 1).otherwise(0)
    return out


def _each(fingerprints_column: str) -> Column:
    """One row per fingerprint.  The outer form is no filter on its input; from the plain one Spark
    infers a filter and pushes it down to the text, which computes all fingerprints twice.  The
    join drops the null of a text without any."""
    return F.explode_outer(fingerprints_column).alias("v")


def item_fingerprints(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(span, hash, item, item_words, item_before): what a document's fingerprint is compared with.
    Contexts repeated within an item are kept once.  Items without words or without an id have none."""
    words = (items.where(F.col(key).isNotNull())
             .select(F.col(key).cast("string").alias("item"), words_of(F.col(text)).alias("w")))
    words = words.where(F.size("w") > 0).withColumn("span", F.least(F.size("w"), F.lit(SPAN)))
    words = materialise(words, "items")
    out = None
    for span in sorted(r["span"] for r in words.select("span").distinct().collect()):      # 13 values at most
        prints = words.where(F.col("span") == span).select("item", "w", fingerprints(F.col("w"), span).alias("v"))
        each = prints.select("item", "w", _each("v"))
        at = F.col("v").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")
        near, before = _around(F.col("w"), at, span)
        part = each.select(F.lit(span).alias("span"), F.shiftright("v", POSITION_BITS).alias("hash"), "item",
                           near.alias("item_words"), before.alias("item_before")).distinct()
        out = part if out is None else out.union(part)
    if out is None:
        out = items.sparkSession.createDataFrame(
            [], "span int, hash bigint, item string, item_words array<string>, item_before int")
    return materialise(out, "item_prints")


def _hits(docs: DataFrame, prints: DataFrame, span: int, broadcast: bool) -> DataFrame:
    """(doc, text_md5, item, start, end) of every extended hit that makes a full window."""
    k, _ = scheme(span)
    # the digest is taken once a text; a hit then needs its place and the words around it only
    worded = docs.select("doc", F.md5("text").alias("text_md5"), words_of(F.col("text")).alias("w"))
    with_prints = worded.select("doc", "text_md5", "w", fingerprints(F.col("w"), span).alias("v"))
    own = prints.where(F.col("span") == span).drop("span")
    position = F.col("v").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")
    if broadcast:
        each = with_prints.select("doc", "text_md5", "w", _each("v"))
        met = (each.withColumn("hash", F.shiftright("v", POSITION_BITS)).join(F.broadcast(own), "hash")
               .withColumn("at", position))
    else:
        # narrow rows first; texts join again for the documents that met an item
        each = with_prints.select("doc", "text_md5", _each("v"))
        near = (each.withColumn("hash", F.shiftright("v", POSITION_BITS))
                .join(own.select("hash").distinct(), "hash", "left_semi").withColumn("at", position))
        texts = worded.select(F.col("doc").alias("d"), F.col("text_md5").alias("m"), "w").dropDuplicates(["d", "m"])
        met = (near.distinct().join(own, "hash")
               .join(texts, F.col("doc").eqNullSafe(F.col("d")) & (F.col("text_md5") == F.col("m"))))
    around, before = _around(F.col("w"), F.col("at"), span)
    met = met.select("doc", "text_md5", "item", "at", "item_words", "item_before",
                     around.alias("doc_words"), before.alias("doc_before"))
    d, db, i, ib = (F.col(c) for c in ("doc_words", "doc_before", "item_words", "item_before"))
    # as a run of words, not as an equality of arrays, which Spark would make a key of the join
    met = met.where(_equal_run(d, db, i, ib, 1, k) == k)
    left, right = _equal_run(d, db - 1, i, ib - 1, -1, span - k), _equal_run(d, db + k, i, ib + k, 1, span - k)
    return (met.withColumn("l", left).withColumn("r", right).where(F.col("l") + F.col("r") + k >= span)
            .select("doc", "text_md5", "item", (F.col("at") - F.col("l")).alias("start"),
                    (F.col("at") + k + F.col("r")).alias("end")).distinct())


def contaminated_spans(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                       item_key: str = "item_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc, text_md5, item string, start, end): word ranges of documents, from 0 and without the
    end, in which every word lies in a window shared with the item.  Ranges may overlap."""
    prints = item_fingerprints(items, item_key, "text")
    docs = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    octets = F.sum(F.octet_length(F.array_join("item_words", " ")).cast("long"))
    sizes = prints.groupBy("span").agg(F.count(F.lit(1)).alias("n"), octets.alias("octets")).collect()      # 13 rows at most
    small = sum(r["n"] for r in sizes) <= broadcast_rows and sum(r["octets"] for r in sizes) <= BROADCAST_OCTETS
    out = None
    for span in sorted(r["span"] for r in sizes):
        part = _hits(docs, prints, span, small)
        out = part if out is None else out.union(part)
    if out is None:
        out = docs.where(F.lit(False)).select("doc", F.lit("").alias("text_md5"), F.lit("").alias("item"),
                                              F.lit(0).alias("start"), F.lit(0).alias("end"))
    return out


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(key, text_md5, n_words, n_hit, n_items long, items_sha256, contaminated), one row per row.

    ``contaminated``: some word is hit, and hit words are ``PERCENT`` percent of all or more.  Null and
    empty texts have no words.  Items without words or id count nowhere; items that share an id are
    one.  Repeated rows get equal results; null keys are keys.  Other columns are dropped.
    """
    found = contaminated_spans(docs, items, key, text, item_key, broadcast_rows)
    order = Window.partitionBy("doc", "text_md5").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(order), F.lit(0))
    per_doc = (found.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), reached)))
               .groupBy("doc", "text_md5")
               .agg(F.sum("new").cast("long").alias("n_hit"), F.sort_array(F.collect_set("item")).alias("items")))
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("k"), F.md5(body).alias("m"), word_count(body).alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (base.join(per_doc, F.col("k").eqNullSafe(F.col("doc")) & (F.col("m") == F.col("text_md5")), "left")
            .select(F.col("k").alias(key), F.col("m").alias("text_md5"), "n_words", n_hit.alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
                    ((n_hit > 0) & (n_hit * 100 >= F.col("n_words") * PERCENT)).alias("contaminated")))


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all columns of ``docs``."""
    bad = (contamination(docs, items, key, text).where("contaminated")
           .select(F.col(key).alias("bad_key"), F.col("text_md5").alias("bad_md5")).distinct())
    md5 = fresh_name(docs, "md5")
    marked = docs.withColumn(md5, F.md5(F.coalesce(F.col(text), F.lit(""))))
    same = marked[key].eqNullSafe(bad["bad_key"]) & (marked[md5] == bad["bad_md5"])
    return marked.join(bad, same, "left_anti").drop(md5)
