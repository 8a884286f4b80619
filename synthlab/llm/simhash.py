"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64 bits from the XXH64 values of a text's 3-word shingles.  Texts link where their
fingerprints differ in at most ``max_bits`` bits; groups are the connected components.

Search over the distinct fingerprints (exact copies meet there, whatever their number):

1. Bits are grouped by correlation into partitions, so that what is skewed stays in few of them.
2. Each partition i gets its own threshold t_i >= -1 with ``sum(t_i) = max_bits - m + 1``; fingerprints
   within ``max_bits`` then agree within t_i on some partition i.  A dynamic program picks the
   thresholds of the smallest estimated number of candidates, from collision counts over all
   fingerprints; several partitionings compete.
3. Probe and verify: each fingerprint probes the index of partition i with all values within t_i,
   and candidates are verified on all 64 bits.

A group of near copies can put thousands of fingerprints into one bucket, and its pairs grow with
the square.  Buckets above ``BUCKET`` members are therefore linked in another exact way: each
fingerprint that owns or probes such a bucket emits itself and its 64 one-bit neighbours.  Two
fingerprints differ in at most 2 bits exactly if they share such a key, and a key has 65 owners at
most, so linking the owners of a key to their smallest one keeps every link and bounds every group.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synthlab.llm.common import WORD, fold, fresh_name, text_udf
from synthlab.llm.graph import components
from synthlab.session import materialise

SHINGLE, MAX_BITS, SEED = 3, 2, 42
#: members of a bucket whose pairs are compared directly
BUCKET = 64
#: partition sizes that compete
SCHEMES = ((64,), (32, 32), (40, 24), (22, 21, 21), (28, 20, 16))
#: shingles hashed at a time, so that a very long text does not hold all its hashes
BLOCK = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint; 0 without words."""
    words = WORD.findall(fold(text))
    if not words:
        return 0
    joined = " ".join(words).encode("utf-8", "surrogatepass")
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(joined)]])
    size = min(shingle, len(words))
    starts, ends = starts[:len(words) - size + 1], ends[size - 1:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in
                           zip(starts[i:i + BLOCK].tolist(), ends[i:i + BLOCK].tolist())], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long; null counts as empty."""
    def run(texts: list[str]) -> pa.Array:
        return pa.array(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))
    return text_udf("bigint", run)(text)


# ---- partitions and thresholds --------------------------------------------------------------

def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows, and how often bits i and j are both set (64 x 64), over all rows of ``fp``."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            fps = np.ascontiguousarray(batch.column("fp").to_numpy(zero_copy_only=False)).view(np.uint8)
            bits = np.unpackbits(fps.reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
            rows += len(bits)
        if rows:
            i, j = np.divmod(np.arange(64 * 64), 64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(total.ravel(), rows))],
                ["i", "j", "n"])
    sums = prints.select("fp").mapInArrow(partial, "i bigint, j bigint, n bigint").groupBy("i", "j").agg(F.sum("n"))
    rows, table = 0, np.zeros((64, 64), np.int64)
    for i, j, n in sums.collect():                    # 4097 rows at most
        if i < 0:
            rows = n
        else:
            table[i, j] = n
    return rows, table


def correlations(rows: int, table: np.ndarray) -> np.ndarray:
    p = np.diag(table) / max(rows, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs(table / max(rows, 1) - np.outer(p, p)) / np.outer(spread, spread)


def group_bits(related: np.ndarray, sizes: tuple[int, ...]) -> list[list[int]]:
    """Partitions of the given sizes: each starts with the most correlated pair left and takes the
    bit most correlated with its members until it is full."""
    left, out = set(range(64)), []
    for size in sizes[:-1]:
        order = sorted(left)
        sub = related[np.ix_(order, order)] - 2 * np.eye(len(order))
        a, _ = divmod(int(sub.argmax()), len(order))
        part = [order[a]]
        left.remove(order[a])
        while len(part) < size:
            rest = sorted(left)
            nearest = rest[int(related[np.ix_(rest, part)].sum(1).argmax())]
            part.append(nearest)
            left.remove(nearest)
        out.append(sorted(part))
    return [*out, sorted(left)]


def mask_of(bits: list[int]) -> int:
    """The bits as a signed 64-bit mask."""
    return int(np.array(sum(1 << b for b in bits), dtype=np.uint64).view(np.int64))


def collisions(prints: DataFrame, masks: list[int]) -> list[int]:
    """For each mask, the number of ordered pairs of rows that agree on its bits (a row and itself
    included), over all rows."""
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("value"))
                                 for i, m in enumerate(masks)]))
    found = (prints.select(values.alias("x")).groupBy("x.part", "x.value").agg(F.count(F.lit(1)).alias("c"))
             .groupBy("part").agg(F.sum(F.col("c").cast("decimal(38,0)") * F.col("c")).alias("pairs")).collect())
    got = {r["part"]: int(r["pairs"]) for r in found}
    return [got.get(i, 0) for i in range(len(masks))]


def ball(width: int, radius: int) -> int:
    """Values within ``radius`` bits of one value of ``width`` bits."""
    return [0, 1, 1 + width, 1 + width + width * (width - 1) // 2][radius + 1]


def allocate(widths: list[int], pairs: list[int], rows: int, max_bits: int) -> tuple[float, list[int]]:
    """(cost, thresholds) of the smallest estimated work, by dynamic programming over partitions and
    the thresholds spent.  Work of partition i at t: probes ``rows * ball(t)`` and candidates
    ``pairs_i * ball(t)``, nothing for t = -1."""
    budget = max_bits - len(widths) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for width, p in zip(widths, pairs):
        new: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, min(2, max_bits) + 1):
                reach = ball(width, t)
                # a radius that covers the whole cube cannot find more than all pairs
                work = cost + rows * reach + min(float(p) * reach, float(rows) ** 2 if reach else 0.0)
                if spent + t not in new or work < new[spent + t][0]:
                    new[spent + t] = (work, [*chosen, t])
        best = new
    return best[budget]


def plan_search(prints: DataFrame, max_bits: int = MAX_BITS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of every partition that is probed."""
    rows, table = bit_counts(prints)
    related = correlations(rows, table)
    groups = [group_bits(related, s) for s in SCHEMES]
    parts = [(i, p) for i, g in enumerate(groups) for p in g]
    pairs = collisions(prints, [mask_of(p) for _, p in parts])
    options = []
    for i, g in enumerate(groups):
        own = [c for (k, _), c in zip(parts, pairs) if k == i]
        cost, thresholds = allocate([len(p) for p in g], own, rows, max_bits)
        options.append((cost, [(p, t) for p, t in zip(g, thresholds) if t >= 0]))
    return min(options, key=lambda o: o[0])[1]


# ---- links ----------------------------------------------------------------------------------

def _flips(bits: list[int], radius: int) -> list[int]:
    """XOR masks of all changes of at most ``radius`` of the bits."""
    out = [0]
    if radius >= 1:
        out += [mask_of([b]) for b in bits]
    if radius >= 2:
        out += [mask_of([a, b]) for k, a in enumerate(bits) for b in bits[k + 1:]]
    return out


def _flipped(fp: Column, masks: list[int]) -> Column:
    return F.explode(F.transform(F.lit(masks).cast("array<bigint>"), lambda m: fp.bitwiseXOR(m)))


def near_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a long, b long) whose components are those of "differ in at most ``max_bits`` bits"
    (1 or 2) over the distinct ``fp`` of ``prints``.  Every edge is a true link or joins two
    fingerprints with a common neighbour in a crowded bucket; no link between components is lost."""
    if max_bits not in (1, 2):
        raise ValueError("max_bits is 1 or 2")
    probes = index = None
    for i, (bits, radius) in enumerate(plan_search(prints, max_bits)):
        own = prints.select(F.col("fp").alias("b"), F.lit(i).alias("part"),
                            F.col("fp").bitwiseAND(F.lit(mask_of(bits))).alias("value"))
        look = prints.select(F.col("fp").alias("a"), F.lit(i).alias("part"),
                             _flipped(F.col("fp").bitwiseAND(F.lit(mask_of(bits))), _flips(bits, radius)).alias("value"))
        index = own if index is None else index.union(own)
        probes = look if probes is None else probes.union(look)
    sizes = index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    few = index.join(sizes.where(F.col("n") <= BUCKET).select("part", "value"), ["part", "value"])
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = (probes.join(few, ["part", "value"]).where((F.col("a") < F.col("b")) & close)
             .select("a", "b").distinct())
    crowded = sizes.where(F.col("n") > BUCKET).select("part", "value")
    members = probes.join(crowded, ["part", "value"], "left_semi").select(F.col("a").alias("fp")).distinct()
    return pairs.union(_ball_links(members, max_bits))


def _ball_links(members: DataFrame, max_bits: int) -> DataFrame:
    """Edges for the members of crowded buckets, by shared neighbours (see the module text)."""
    if max_bits == 2:
        keys = members.select("fp", _flipped(F.col("fp"), _flips(list(range(64)), 1)).alias("z"))
        owners = keys.groupBy("z").agg(F.sort_array(F.collect_set("fp")).alias("own"))
    else:
        # within one bit: a fingerprint meets another that is one of its own neighbours
        keys = members.select("fp", _flipped(F.col("fp"), _flips(list(range(64)), 1)).alias("z"))
        there = members.select(F.col("fp").alias("z"))
        return (keys.join(there, "z").where("fp < z").select(F.col("fp").alias("a"), F.col("z").alias("b")))
    return (owners.where(F.size("own") > 1)
            .select(F.col("own")[0].alias("a"), F.explode(F.slice("own", 2, 64)).alias("b")).distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(key, fp long, text_md5 string, component_id, root long), one row per row of ``docs``.

    ``component_id`` is the smallest key among the rows that can be reached over links, the row's
    own included; null keys are passed over, so it is null only where all of them are.  ``root``
    (a fingerprint) names the component.  Null and empty texts have no words: fingerprint 0, linked
    like any other.  Equal texts and repeated rows share a fingerprint.  Other columns are dropped.
    An empty table gives an empty table.
    """
    rows = materialise(docs.select(F.col(key), fingerprint_column(F.col(text), shingle).alias("fp"),
                                   F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_md5")), "prints")
    prints = materialise(rows.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    roots = components(near_links(prints, max_bits)).withColumnRenamed("node", "fp")
    prints = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = prints.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(prints.select("fp", "root").join(classes, "root"), "classes")
    return rows.join(named, "fp").select(key, "fp", "text_md5", "component_id", "root")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every component, with the columns of ``docs``: that with the smallest key, then the
    smallest MD5 of the text; of rows equal in both any one."""
    found = near_duplicates(docs, key, text)
    best = (found.groupBy("root").agg(F.min(F.struct(F.col(key).isNull().alias("z"), F.col(key).alias("k"),
                                                     F.col("text_md5").alias("m"))).alias("best")))
    chosen = best.select("best.k", "best.m")
    copies = found.groupBy(F.col(key).alias("k"), F.col("text_md5").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    chosen = materialise(chosen.join(copies, chosen["k"].eqNullSafe(copies["k"]) & (chosen["m"] == copies["m"]))
                         .select(chosen["k"], chosen["m"], "n"), "chosen")
    md5 = fresh_name(docs, "md5")
    marked = docs.withColumn(md5, F.md5(F.coalesce(F.col(text), F.lit(""))))

    def rows_of(part: DataFrame) -> DataFrame:
        same = marked[key].eqNullSafe(part["k"]) & (marked[md5] == part["m"])
        return marked.join(part, same, "left_semi")
    single = rows_of(chosen.where("n = 1"))
    if chosen.where("n > 1").isEmpty():
        return single.drop(md5)
    # rows equal in key and text: one of each
    return single.union(rows_of(chosen.where("n > 1")).dropDuplicates([key, md5])).drop(md5)
