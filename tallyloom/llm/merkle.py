"""A Merkle manifest of a dataset, by levels of windows.

A row is a leaf: the hash of its values, each with its length in bytes before it.
Per source, leaves stand by doc_id; every FAN consecutive nodes become the hash of
theirs until one is left, the subroot.  Subroots, by source, give the root likewise.

Places come from ranges: slim rows (ids and hashes) are dealt to sorted ranges of
(source, doc_id, leaf), written, and numbered by the counts of the ranges before
them, so no source is numbered in one task.  Each level is one window over (source,
parent): its ordered full-frame list of at most FAN hashes is both what the parent
hashes and each node's siblings.  One row for each parent goes on, so a level is a
third of the one below; levels are written, as many as the logarithm of the largest
source.  Proofs go down again: a node's steps to the root are its own siblings, then
its parent's steps, one join a level on (source, parent).

Changes can be found: a row's root, folded from its values as they are now and its
old siblings, differs from the root.

Null sources come first, null doc_ids first in their source, rows of equal ids by
their leaves; equal rows are leaves each.  A null id is never tampered with.  Null
texts and empty ones have different leaves.  An only row's leaf is subroot and root,
its proof the hash of nothing.  Other columns are not looked at.  Empty table: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import materialise, numbered, pick

FAN = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(*values: Column) -> Column:
    """The hash of a row's values: - for null, else the number of UTF-8 bytes, a colon and the value."""
    spelt = [v.cast("string") for v in values]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in spelt]))


def group_key(column: str) -> Column:
    """A text that is never null and sorts like the column, null first."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))


def climb(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The levels of the trees of all groups, from nodes of key, idx, size and hash up to their tops.

    Each has its nodes' parent, left and right (hashes of the siblings) and above (the parent's hash); tops have size 1.
    """
    levels: list[DataFrame] = []
    while True:
        run = F.collect_list("hash").over(Window.partitionBy("key", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        place = F.pmod("idx", F.lit(FAN)).cast("int")
        level = nodes.withColumn("parent", F.floor(F.col("idx") / FAN)).withColumn("run", run)
        level = level.withColumn("left", F.array_join(F.slice("run", F.lit(1), place), "")).withColumn("right", F.array_join(F.slice("run", place + 2, F.lit(FAN)), ""))
        level = materialise(level.withColumn("above", digest(F.array_join("run", ""))).drop("run"), f"{name}-{len(levels)}")
        levels.append(level)
        if (level.agg(F.max("size").alias("most")).first()["most"] or 0) <= 1:
            return levels
        # one row for each parent
        nodes = level.where((F.col("size") > 1) & (F.pmod("idx", F.lit(FAN)) == 0)).select("key", F.col("parent").alias("idx"), F.ceil(F.col("size") / FAN).alias("size"), F.col("above").alias("hash"))


def tops(levels: list[DataFrame]) -> DataFrame:
    """key, hash and height of each group's top."""
    out = None
    for height, level in enumerate(levels):
        found = level.where("size = 1").select("key", "hash", F.lit(height).alias("height"))
        out = found if out is None else out.unionByName(found)
    return out


def descend(levels: list[DataFrame], heads: DataFrame) -> DataFrame:
    """The lowest level's nodes with what heads (key, height, subroot, steps: a row for each top) has, and all steps to the root."""
    out = None
    for height in reversed(range(len(levels))):
        level = levels[height]
        own = heads.where(F.col("height") == height).select("key", "subroot", "steps")
        found = level.where("size = 1").join(own, "key")
        if out is not None:
            parents = out.select("key", F.col("idx").alias("parent"), "subroot", F.col("steps").alias("more"))
            step = F.array(F.struct("left", "right"))
            found = found.unionByName(level.where("size > 1").join(parents, ["key", "parent"]).withColumn("steps", F.concat(step, F.col("more"))).drop("more"))
        out = found
    return out


@dataclass
class Manifest:
    """The trees of a dataset: subroots (source, subroot), proofs (doc_id, leaf, changed, subroot, steps: a row for each row) and the root."""

    subroots: DataFrame
    proofs: DataFrame
    root: str | None


def manifest(docs: DataFrame, now: Column | None = None) -> Manifest:
    """The manifest of documents; now is the text that rows have by now, for changed, the leaf they have by now."""
    docs = pick(docs, *COLUMNS)
    values = [F.col(c) for c in COLUMNS]
    leaf = leaf_of(*values)
    changed = leaf if now is None else leaf_of(*values[:-1], now)
    slim = materialise(docs.select("doc_id", group_key("source").alias("key"), leaf.alias("hash"), changed.alias("changed")), "leaves")
    levels = climb(numbered(slim, ["doc_id", "hash"], "placed"), "level")
    heads = tops(levels)
    sources = heads.select(F.lit("").alias("key"), F.col("key").alias("its_key"), F.col("hash"), F.col("height").alias("its_height"))
    upper = climb(numbered(sources, ["its_key"], "sources"), "upper")
    top = tops(upper).first()
    root = top["hash"] if top else None
    above = descend(upper, tops(upper).select("key", "height", F.col("hash").alias("subroot"), F.array().cast(STEPS).alias("steps")))
    # a row for each source
    ways = materialise(above.select(F.col("its_key").alias("key"), F.col("its_height").alias("height"), F.col("hash").alias("subroot"), "steps"), "ways")
    proofs = descend(levels, ways).select("doc_id", F.col("hash").alias("leaf"), "changed", "subroot", "steps")
    subroots = ways.select(F.when(F.col("key") != "", F.substr("key", F.lit(2))).alias("source"), "subroot")
    return Manifest(subroots, proofs, root)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda below, step: digest(F.concat(step["left"], below, step["right"])))


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; half of the texts lose their line ends before they are verified."""
    tampered = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0, F.lit(False))
    made = manifest(docs, F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    rows = made.proofs.select("doc_id", "leaf", "subroot", F.lit(made.root).cast("string").alias("root"), digest(siblings).alias("proof_sha256"), folded(F.col("changed"), F.col("steps")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle() -> str:
    """The same rows in SQL: levels by a recursive query, proofs by joins on places, roots folded step by step."""
    spelt = lambda v: f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(spelt(v) for v in COLUMNS[:-1])} || {spelt(text)})"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    crc = f"xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT), lambda c, b: {bits}), 4294967295)"
    return f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, coalesce('=' || source, '') AS key, {leaf("text")} AS leaf,
    CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS changed
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (ORDER BY key, doc_id NULLS FIRST, leaf) AS id,
    row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY key) AS size
  FROM hashed
), nodes AS (
  SELECT key, 0 AS height, idx, size, leaf AS hash FROM leaves
  UNION ALL
  SELECT key, height + 1, idx // {FAN}, (size + {FAN - 1}) // {FAN}, sha256(string_agg(hash, '' ORDER BY idx))
  FROM nodes WHERE size > 1 GROUP BY key, height, idx // {FAN}, size
), subroots AS (
  SELECT key, hash AS subroot, row_number() OVER (ORDER BY key) - 1 AS idx, count(*) OVER () AS size FROM nodes WHERE size = 1
), uppers AS (
  SELECT 0 AS height, idx, size, subroot AS hash FROM subroots
  UNION ALL
  SELECT height + 1, idx // {FAN}, (size + {FAN - 1}) // {FAN}, sha256(string_agg(hash, '' ORDER BY idx))
  FROM uppers WHERE size > 1 GROUP BY height, idx // {FAN}, size
), lists AS (
  SELECT key, height, idx // {FAN} AS parent, list(hash ORDER BY idx) AS run FROM nodes WHERE size > 1 GROUP BY ALL
), upper_lists AS (
  SELECT height, idx // {FAN} AS parent, list(hash ORDER BY idx) AS run FROM uppers WHERE size > 1 GROUP BY ALL
), lower AS (
  SELECT l.id, n.height, l.idx // pow({FAN}, n.height)::BIGINT AS node, n.run
  FROM leaves l JOIN lists n ON n.key = l.key AND n.parent = l.idx // pow({FAN}, n.height + 1)::BIGINT
), tall AS (SELECT key, max(height) AS top FROM nodes GROUP BY key),
steps AS (
  SELECT id, height, node % {FAN} AS place, run FROM lower
  UNION ALL
  SELECT l.id, t.top + u.height, (s.idx // pow({FAN}, u.height)::BIGINT) % {FAN}, u.run
  FROM leaves l JOIN tall t ON t.key = l.key JOIN subroots s ON s.key = l.key JOIN upper_lists u ON u.parent = s.idx // pow({FAN}, u.height + 1)::BIGINT
), ways AS (
  SELECT id, list({{'l': array_to_string(run[1:place], ''), 'r': array_to_string(run[place + 2:], '')}} ORDER BY height) AS way FROM steps GROUP BY id
), fold AS (
  SELECT l.id, 1 AS k, l.changed AS hash, w.way FROM leaves l LEFT JOIN ways w ON w.id = l.id
  UNION ALL
  SELECT id, k + 1, sha256(way[k].l || hash || way[k].r), way FROM fold WHERE k <= len(way)
), done AS (SELECT id, arg_max(hash, k) AS folded FROM fold GROUP BY id)
SELECT l.doc_id, l.leaf, s.subroot, r.hash AS root, sha256(coalesce(array_to_string(list_transform(w.way, lambda x: x.l || x.r), ''), '')) AS proof_sha256,
  d.folded AS folded_root, d.folded = r.hash AS verified
FROM leaves l JOIN subroots s ON s.key = l.key JOIN done d ON d.id = l.id JOIN (SELECT hash FROM uppers WHERE size = 1) r ON true LEFT JOIN ways w ON w.id = l.id"""
