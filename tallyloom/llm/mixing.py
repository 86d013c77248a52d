"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources in code point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and
share all words; a target stops at MOST times its source, and what is over goes
to the others by weight until none is above.

Blocks: a source's documents are dealt by a seeded hash into blocks: about FEW of
them with LEAST_WORDS words at least, and as many as it takes with BLOCK_WORDS at
most.  A source of B blocks is drawn in passes
over its blocks, each in a permuted order of its own, so draw n is a block of pass
n / B.  A target of r times the source needs floor(r) * B draws and those at the
start of the next pass, up to the block that meets the target; that block's
documents are taken up to a cut in an order of their own.

Shards: the count of each source's draws is split among the output shards by a
binary tree that draws multivariate-hypergeometric counts at every node.  A shard
takes the next draws of its quota's number, so quotas are met exactly and no draw
goes twice; a document is taken as often as a shard has drawn its block.  Within a
shard rows are put in a seeded order.

Sums that find the last draw run over groups of GROUP blocks, then over the blocks
of one group, then over the documents of one block, so nothing is summed in order
over a whole source.  The driver sees some numbers for each source and shard.

Everything is decided by hashes of whole rows under a seed, so reruns agree, however
the rows are dealt to tasks.  Rows that differ in any column differ in their hash;
rows that are equal in all are told apart by a number, and as they are equal, the
result doesn't depend on which has which.  `taken` and `mixture` decide alike.

Null texts have size 0, long ones count whole.  Repeated rows are each documents of
their own.  Other columns are carried along as they are.  An empty table gives no rows.  Sources of no words have target 0.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import materialise, numbered

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3.0
SHARDS = 64
BLOCK_WORDS, LEAST_WORDS, FEW, GROUP = 20_000, 500, 256, 4_096
SEED = 20240
MOST_BROADCAST = 10_000


def targets(sizes: dict) -> dict:
    """Words to take of each source; keys None or text, values the source's words."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(1 + k % 3) for k, s in enumerate(order)}
    total, fixed, free = float(sum(sizes.values())), {}, list(order)
    while free:
        left, weights = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / weights > MOST * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / weights for s in free}
        fixed |= {s: MOST * sizes[s] for s in over}
        free = [s for s in free if s not in over]
    return fixed


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of n draws are good; beyond the library's limit by the normal law of the same mean and variance."""
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mean, spread = n * good / total, np.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1)))
    return int(min(max(round(rng.normal(mean, spread)), n - bad, 0), good, n))


def split_tree(colors: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Counts by shard and source: a multivariate-hypergeometric draw at each node of a binary tree over the shards."""
    out = np.zeros((shards, len(colors)), np.int64)

    def split(low: int, high: int, counts: list[int]) -> None:
        if high - low == 1:
            out[low] = counts
            return
        middle = (low + high) // 2
        rest = sum(counts)
        n, left = rest * (middle - low) // (high - low), []
        for c in counts:  # one source after the other, each given those before
            rest -= c
            left.append(hypergeometric(c, rest, n, rng))
            n -= left[-1]
        split(low, middle, left)
        split(middle, high, [c - x for c, x in zip(counts, left, strict=True)])

    split(0, shards, [int(c) for c in colors])
    return out


def permutation(blocks: int, rng: np.random.Generator) -> tuple[int, int]:
    """A multiplier and a shift under which 0 .. blocks - 1 change places."""
    while True:
        a = int(rng.integers(1, max(2, blocks)))
        if math.gcd(a, blocks) == 1:
            return a, int(rng.integers(0, blocks))


def word_count():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(docs: DataFrame):
    """A hash of all columns, in the order of their names; maps count by their entries."""
    kinds = dict(docs.dtypes)
    columns = [F.map_entries(f"`{c}`") if kinds[c].startswith("map<") else F.col(f"`{c}`") for c in sorted(docs.columns)]
    # nulls are skipped by the hash, so each column's being null is hashed as well
    return F.xxhash64(*[x for c in columns for x in (c.isNull(), c)])


def mark_of(seed: int):
    """A number for each row from all it holds, and its number among rows that are equal in all."""
    return F.xxhash64(F.lit(seed), "its_hash", "nth")


KEY = ["doc_id", "source", "size", "its_hash"]


def block_count(words: int) -> int:
    """The blocks of a source: about FEW of them, in bounds for the words of a block."""
    return max(1, words // min(BLOCK_WORDS, max(LEAST_WORDS, words // FEW)))


def planned(base: DataFrame, slim: DataFrame, shards: int, seed: int) -> DataFrame:
    """base with source_size, target and passes, an array of (shard, position): one for each time a shard takes the row.

    base has source and mark; slim has source, size and mark of the same rows.
    """
    spark = base.sparkSession
    sizes = {r["source"]: r["n"] for r in slim.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    aim, rng = targets(sizes), np.random.default_rng(seed)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    passes, plan = int(np.ceil(MOST)), []
    for k, s in enumerate(order):
        n = sizes[s]
        whole = int(min(MOST, np.floor(aim[s] / n + 1e-12))) if n else 0
        blocks = block_count(n)
        turns = [permutation(blocks, rng) for _ in range(passes)]
        plan.append((k, s, n, float(aim[s]), blocks, whole, float(aim[s] - whole * n), [a for a, _ in turns], [c for _, c in turns]))
    kinds = "sid int, its_source string, source_size long, target double, blocks long, whole int, rest double, times array<long>, shifts array<long>"
    table = spark.createDataFrame(plan, kinds)
    # a row for each source; broadcast only while they are few
    small = F.broadcast if len(order) <= MOST_BROADCAST else lambda d: d
    block = F.pmod(F.shiftright("mark", 16), F.col("blocks"))
    turn = lambda p: F.pmod(F.element_at("times", p + 1) * F.col("block") + F.element_at("shifts", p + 1), F.col("blocks"))
    placed = lambda rows, side: rows.join(small(side), F.col("source").eqNullSafe(F.col("its_source"))).withColumn("block", block)

    # the last draw of each source's unfinished pass: the group of blocks, the block and the cut where the target is met
    light = placed(slim, table.where("rest > 0")).withColumn("rank", turn(F.col("whole")))
    blocks = materialise(light.groupBy("sid", "rank", "rest").agg(F.sum("size").alias("size")).withColumn("part", F.floor(F.col("rank") / GROUP)), "blocks")

    def reached(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
        """The row of each of keys where the sum of size, in order of by, first reaches rest; rest becomes what it has to give."""
        run = F.sum("size").over(Window.partitionBy(*keys).orderBy(by))
        return rows.withColumn("so_far", run).where((F.col("so_far") >= F.col("rest")) & (F.col("so_far") - F.col("size") < F.col("rest"))).withColumn("rest", F.col("rest") - F.col("so_far") + F.col("size"))

    parts = reached(blocks.groupBy("sid", "part", "rest").agg(F.sum("size").alias("size")), ["sid"], "part").select("sid", "part", "rest")
    edge = materialise(reached(blocks.drop("rest").join(small(parts), ["sid", "part"]), ["sid"], "rank").select("sid", "rank", "rest"), "edges")
    inside = light.select("sid", "rank", "size", "mark").join(small(edge), ["sid", "rank"])
    run = Window.partitionBy("sid").orderBy("mark").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = inside.withColumn("so_far", F.sum("size").over(run)).where(F.col("so_far") - F.col("size") / 2 <= F.col("rest")).groupBy("sid").agg(F.max("mark").alias("cut"))
    last = {r["sid"]: (r["rank"], r["cut"]) for r in edge.join(cut, "sid", "left").collect()}

    # the tree's quotas decide which draws each shard takes
    numbers = [p[5] * p[4] + (last[p[0]][0] + 1 if p[0] in last else 0) for p in plan]
    ends = np.cumsum(split_tree(np.array(numbers, np.int64), shards, rng), axis=0) if order else np.zeros((shards, 0), np.int64)
    final = [(p[0], p[1], p[2], p[3], p[4], p[7], p[8], [int(x) for x in ends[:, k]], n - 1 if p[0] in last else None, last.get(p[0], (None, None))[1]) for k, (p, n) in enumerate(zip(plan, numbers, strict=True))]
    side = spark.createDataFrame(final, "sid int, its_source string, source_size long, target double, blocks long, times array<long>, shifts array<long>, ends array<long>, edge long, cut long")

    def draw(p):
        number = p * F.col("blocks") + turn(p)
        # at the edge, rows up to the cut; none if the first row is too long already
        beyond = (number == F.col("edge")) & (F.col("cut").isNull() | (F.col("mark") > F.col("cut")))
        shard = F.when(~F.coalesce(beyond, F.lit(False)), F.size(F.filter("ends", lambda e: e <= number)))
        return F.struct(shard.cast("int").alias("shard"), F.xxhash64(F.lit(seed + 2), "mark", p).alias("position"))

    drawn = F.filter(F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), draw), lambda x: x["shard"] < shards)
    kept = [F.col(f"`{c}`") for c in base.columns]
    return placed(base, side).select(*kept, "source_size", "target", drawn.alias("passes"))


def mixture(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: the columns of docs, a row for each copy, in shards, each in its seeded order."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    base = docs.select("source", word_count().alias("size"), row_hash(docs).alias("its_hash"), row.alias("its_row"))
    equal = materialise(base.groupBy("its_hash").count().where("count > 1").select(F.col("its_hash").alias("key")), "equal")
    if equal.isEmpty():
        base = base.withColumn("nth", F.lit(0).cast("long"))
    else:  # rows that are equal in all are numbered; which of them gets which number makes no difference
        base = materialise(base.withColumn("own", F.monotonically_increasing_id()), "rows")
        several = base.select(F.col("its_hash").alias("key"), "own").join(equal, "key", "left_semi")
        numbers = materialise(numbered(several, ["own"], "several").select(F.col("own").alias("its_own"), F.col("idx").alias("nth")), "numbers")
        base = base.join(numbers, F.col("own") == F.col("its_own"), "left").withColumn("nth", F.coalesce("nth", F.lit(0).cast("long")))
    base = base.withColumn("mark", mark_of(seed)).select("source", "size", "mark", "its_row")
    slim = materialise(base.drop("its_row"), "sizes")  # so that the plan reads no text again
    drawn = planned(base, slim, shards, seed).select("its_row", F.explode("passes").alias("at"))
    return drawn.repartitionByRange("at.shard", "at.position").sortWithinPartitions("at.shard", "at.position").select("its_row.*")


def taken(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken and shards (those that take the row, comma-joined) of every row."""
    rows = docs.select("doc_id", "source", word_count().alias("size"), row_hash(docs).alias("its_hash"))
    numbered = rows.groupBy(*KEY).count().withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    slim = materialise(numbered.select("doc_id", "source", "size", mark_of(seed).alias("mark")), "sizes")
    out = planned(slim, slim.drop("doc_id"), shards, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.size("passes") * F.col("size")).cast("long").alias("taken"), F.array_join(F.transform("passes", lambda x: x["shard"].cast("string")), ",").alias("shards"))
