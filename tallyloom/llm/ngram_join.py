"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of hashed runs of SHINGLE lowered words (a text of fewer words is
one run).  Texts of equal words form a class; classes whose sets have a Jaccard
similarity of at least THRESHOLD are linked.

1. Each class gets HASHES MinHash values.  BANDS bands of them deal classes into
   buckets; a pair at the threshold misses every bucket with probability
   (1 - 0.8^4)^32 < 5e-8.  Buckets with the same members count once.
2. Within a bucket pairs are compared STEP MinHash values at a time.  With m of n
   equal, the posterior of reaching the threshold under a uniform prior is
   P(Bin(n + 1, THRESHOLD) <= m); a pair below TOLERANCE is dropped.
3. The survivors' connected parts are gathered.  The sets of their texts are
   computed where the texts are read (a Bloom filter of fixed size tells which;
   false hits fall out in the join), so no text is shuffled.  Pairs within a part
   are pruned in the same way and the rest verified by their exact Jaccard
   similarity.

Buckets and parts of over BLOCK members are split into blocks, and each pair of
blocks is a piece of work of its own, so no task holds a whole group.  Pieces give
a star of edges and a count for each member, never a row for each pair.  What
the driver sees are counts of rows.

Null and empty texts are one class without links.  Repeated rows are members of
their class.  Ties: a class and a group are named by their smallest doc_id (null
if all are null).  Texts of any length are compared whole.  Empty table: no rows.
Where whole rows are returned, other columns are carried along as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import WordHash, cut_rows, materialise, mix64, ngram_hashes

SHINGLE, THRESHOLD = 5, 0.8
HASHES, BANDS = 128, 32
ROWS = HASHES // BANDS
STEP, TOLERANCE = 16, 1e-8
BLOCK = 1024
BLOOM_BITS = 26


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def shingles(words: list[bytes], hashes: WordHash, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    return np.unique(ngram_hashes(h, min(n, len(h))))


def minhash_parameters() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_11)
    return rng.integers(1, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, HASHES, np.uint64)


def minhash(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """HASHES 32-bit minima; all ones for an empty set."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 2048):
        np.minimum(low, (items[None, at : at + 2048] * a[:, None] + b[:, None]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """For each number n of values compared: the fewest matches that keep a pair."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def surviving_pairs(x: np.ndarray, y: np.ndarray | None, rules: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs (of x and y, or within x) that no step of the comparison drops."""
    left, right = [], []
    other = x if y is None else y
    for at in range(0, len(x), 64):
        part = x[at : at + 64]
        n, least = rules[0]
        matches = (part[:, None, :n] == other[None, :, :n]).sum(axis=2, dtype=np.int16)
        ok = matches >= least
        if y is None:
            ok &= np.arange(len(other))[None, :] > np.arange(at, at + len(part))[:, None]
        i, j = np.nonzero(ok)
        m = matches[i, j]
        for (was, _), (n, least) in zip(rules, rules[1:], strict=False):
            if not len(i):
                break
            m = m + (part[i, was:n] == other[j, was:n]).sum(axis=1, dtype=np.int16)
            i, j, m = i[m >= least], j[m >= least], m[m >= least]
        left.append(i + at)
        right.append(j)
    return np.concatenate(left) if left else np.empty(0, np.int64), np.concatenate(right) if right else np.empty(0, np.int64)


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n items is connected to."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        new = new[root]
        if np.array_equal(new, root):
            break
        root = new
    return root


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the named pairs."""
    if len(i) <= 4 * len(sets):
        return np.array([np.intersect1d(sets[a], sets[b], assume_unique=True).size for a, b in zip(i, j, strict=True)], np.int64)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, item, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[item] > 1
    owner, item = owner[shared], item[shared]
    _, item = np.unique(item, return_inverse=True)
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    total, wide = np.zeros((len(sets), len(sets)), np.float32), 2048
    for at in range(0, int(item[-1]) + 1 if len(item) else 0, wide):
        a, b = np.searchsorted(item, [at, at + wide])
        grid = np.zeros((len(sets), wide), np.float32)
        grid[owner[a:b], item[a:b] - at] = 1
        total += grid @ grid.T
    return total[i, j].astype(np.int64)


def pieces(batches, key_columns: list[str]):
    """Rows of sorted batches, piece by piece: those with equal keys, which may run over batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in key_columns])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(keys[:, a].tolist())
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def in_blocks(rows: DataFrame, group: str, size: str, member: str) -> DataFrame:
    """Each row to the pairs of blocks that need it: columns low, high and block; groups within BLOCK stay whole."""
    n = F.ceil(F.col(size) / BLOCK).cast("int")
    placed = rows.withColumn("n_blocks", n).withColumn("block", F.pmod(F.xxhash64(F.lit(7), member), F.col("n_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    placed = placed.withColumn("other", other)
    return placed.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "n_blocks", size)


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (u, v) that isn't the smallest of its connected part."""
    spark = edges.sparkSession
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    found = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = materialise(both.groupBy("u").agg(F.min("v").alias("m")).where("m < u"), "hooks")
        while True:  # each pass halves the way to the root
            up = hook.select(F.col("u").alias("m"), F.col("m").alias("up"))
            hook = materialise(hook.join(up, "m", "left").select("u", F.coalesce("up", "m").alias("m"), F.col("up").isNotNull().alias("moved")), "hooks")
            moved = not hook.where("moved").isEmpty()
            hook = hook.select("u", "m")
            if not moved:
                break
        if found is None:
            found = hook.select(F.col("u").alias("node"), F.col("m").alias("root"))
        else:
            step = hook.select(F.col("u").alias("root"), F.col("m").alias("up"))
            found = found.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root")).union(hook.select(F.col("u").alias("node"), F.col("m").alias("root")))
        found = materialise(found, "roots")
        a, b = hook.select("u", F.col("m").alias("ru")), hook.select(F.col("u").alias("v"), F.col("m").alias("rv"))
        moved_edges = edges.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("ru", "u").alias("x"), F.coalesce("rv", "v").alias("y")).where("x <> y")
        edges = materialise(moved_edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    return spark.createDataFrame([], "node long, root long") if found is None else found


def signatures(docs: DataFrame) -> DataFrame:
    """The rows of docs as structs, with rid (a number of the row), the class key (k1, k2) and the MinHash values, written once."""
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("rid"))
    plain = f"row {base.schema['row'].dataType.simpleString()}, rid long"

    def run(batches):
        a, b = minhash_parameters()
        hashes = WordHash()
        for batch in (part for whole in batches for part in cut_rows(whole, pc.struct_field(whole.column("row"), "text"))):
            k1, k2, sigs = [], [], []
            for text in pc.struct_field(batch.column("row"), "text").to_pylist():
                words = words_of(text or "")
                key = xxhash.xxh3_128_digest(b" ".join(words))
                k1.append(int.from_bytes(key[:8], "little", signed=True))
                k2.append(int.from_bytes(key[8:], "little", signed=True))
                sigs.append(minhash(shingles(words, hashes), a, b).view(np.int32) if words else np.empty(0, np.int32))
            ends = np.cumsum([0, *map(len, sigs)]).astype(np.int32)
            flat = np.concatenate(sigs) if sigs else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["row", "rid", "k1", "k2", "sig"])

    return materialise(base.mapInArrow(run, f"{plain}, k1 long, k2 long, sig array<int>"), "signatures")


def candidate_edges(classes: DataFrame) -> DataFrame:
    """Stars over the pairs that share a bucket and survive the comparison; classes: rep, sig."""
    bands = [F.xxhash64(F.lit(b), *[F.col("sig")[b * ROWS + k] for k in range(ROWS)]) for b in range(BANDS)]
    keyed = classes.where(F.size("sig") > 0).select("rep", F.explode(F.array(*bands)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("first"), F.bit_xor(F.xxhash64("rep")).alias("who")).where("n > 1")
    chosen = sizes.groupBy("n", "first", "who").agg(F.min("key").alias("key")).select("key", "n")
    # both sides grow with the corpus, so neither is left to be broadcast while it happens to be small
    members = keyed.join(chosen.hint("merge"), "key").select("key", "n", "rep").join(classes.select("rep", "sig").hint("merge"), "rep")
    dealt = in_blocks(members, "key", "n", "rep")
    rules = least_matches()
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        us, vs = [], []
        for (_, low, high), rows in pieces(batches, ["key", "low", "high"]):
            reps, block = rows.column("rep").to_numpy(), rows.column("block").to_numpy()
            sig = rows.column("sig").combine_chunks().flatten().to_numpy().reshape(len(reps), HASHES)
            if low == high:
                i, j = surviving_pairs(sig, None, rules)
            else:
                a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
                i, j = surviving_pairs(sig[a], sig[b], rules)
                i, j = a[i], b[j]
            root = local_roots(len(reps), i, j)
            at = np.flatnonzero(root != np.arange(len(reps)))
            us.append(reps[at])
            vs.append(reps[root[at]])
            if len(us) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], schema=schema)
                us, vs = [], []
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], schema=schema)

    return dealt.select("key", "low", "high", "block", "rep", "sig").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(run, "u long, v long")


def bloom_places(keys: np.ndarray) -> np.ndarray:
    """Two bits for each key, one row of them after the other."""
    h = mix64(keys.astype(np.int64).view(np.uint64) + np.uint64(1))
    return np.stack([h >> np.uint64(64 - BLOOM_BITS), (h << np.uint64(BLOOM_BITS)) >> np.uint64(64 - BLOOM_BITS)]).astype(np.int64)


def bloom(rows: DataFrame, key: str) -> np.ndarray:
    """Packed bits of a Bloom filter over a column: 2^BLOOM_BITS bits, whatever the input."""

    def bits(batches):
        for batch in batches:
            at = bloom_places(batch.column(0).to_numpy(zero_copy_only=False)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bit"])

    found = rows.select(key).mapInArrow(bits, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    words = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return words.view(np.uint8)


def verified(table: DataFrame, sized: DataFrame) -> DataFrame:
    """rep, links, root of each member with a link; table: rid, text, sig; sized: rid, part, size."""
    rules = least_matches()
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    shared = table.sparkSession.sparkContext.broadcast(bloom(sized, "rid"))

    def to_sets(batches):
        hashes, bits = WordHash(), shared.value
        for batch in batches:
            at = bloom_places(batch.column("rid").to_numpy())
            hit = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)
            batch = batch.filter(pa.array(hit))
            sets = [shingles(words_of(t or ""), hashes).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("sig"), pa.array(sets, pa.binary())], names=["rid", "sig", "set"])

    def run(batches):
        for (_, low, high), rows in pieces(batches, ["part", "low", "high"]):
            reps, block = rows.column("rep").to_numpy(), rows.column("block").to_numpy()
            sig = rows.column("sig").combine_chunks().flatten().to_numpy().reshape(len(reps), HASHES)
            sets = [np.frombuffer(x, np.uint64) for x in rows.column("set").to_pylist()]
            if low == high:
                i, j = surviving_pairs(sig, None, rules)
            else:
                a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
                i, j = surviving_pairs(sig[a], sig[b], rules)
                i, j = a[i], b[j]
            sizes = np.array([len(s) for s in sets], np.int64)
            common = intersections(sets, i, j)
            ok = 5 * common >= 4 * (sizes[i] + sizes[j] - common)  # exactly 0.8, in whole numbers
            i, j = i[ok], j[ok]
            links = np.bincount(i, minlength=len(reps)) + np.bincount(j, minlength=len(reps))
            root = local_roots(len(reps), i, j)
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(reps[at]), pa.array(links[at].astype(np.int64)), pa.array(reps[root[at]])], schema=schema)

    sets = table.select("rid", "text", "sig").mapInArrow(to_sets, "rid long, sig array<int>, set binary").join(sized.hint("merge"), "rid").withColumnRenamed("rid", "rep")
    dealt = in_blocks(sets, "part", "size", "rep").select("part", "low", "high", "block", "rep", "sig", "set")
    return dealt.repartition("part", "low", "high").sortWithinPartitions("part", "low", "high").mapInArrow(run, "rep long, links long, root long")


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written rows of docs, and for each rid: doc_id, copy_of, class_id, n_links and first.

    copy_of is the smallest doc_id of the texts with equal words, class_id that of the linked group, n_links the number
    of different texts linked to this one; first marks one row of each group, that of the smallest doc_id.
    """
    written = signatures(docs)
    table = written.select("rid", "row.doc_id", "row.text", "k1", "k2", "sig")
    classes = table.groupBy("k1", "k2").agg(F.min("rid").alias("rep"))
    one = table.join(classes.select(F.col("rep").alias("rid")), "rid", "left_semi")
    parts = components(candidate_edges(one.select(F.col("rid").alias("rep"), "sig")))
    whole = parts.select("node", "root").union(parts.select(F.col("root").alias("node"), "root").distinct())
    sized = whole.join(whole.groupBy("root").agg(F.count("*").alias("size")), "root").select(F.col("node").alias("rid"), F.col("root").alias("part"), "size")
    checked = materialise(verified(table, materialise(sized, "parts")), "links")
    links = checked.groupBy("rep").agg(F.sum("links").alias("n_links"))
    groups = components(checked.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v")))
    slim = table.select("rid", "doc_id", "k1", "k2")
    # by class first: few rows are left when groups meet, and a class of many copies is summed up where its rows are
    named = slim.groupBy("k1", "k2").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("copy_of"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("lead"))
    named = named.join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    named = materialise(named.select("k1", "k2", "copy_of", "lead", "root", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "classes")
    heads = named.groupBy("root").agg(F.min("lead").alias("head"))
    told = named.join(heads, "root").select("k1", "k2", "copy_of", "n_links", "head")
    result = slim.join(told, ["k1", "k2"]).select("rid", "doc_id", "copy_of", F.col("head.doc_id").alias("class_id"), "n_links", (F.col("rid") == F.col("head.rid")).alias("first"))
    return written, result


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, copy_of for every row of docs."""
    return join(docs.select("doc_id", "text"))[1].select("doc_id", "class_id", "n_links", "copy_of")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without those that follow another of their group."""
    written, result = join(docs)
    return written.join(result.where("first").select("rid"), "rid", "left_semi").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
