"""Language-model scores: a hashed maximum-entropy model with class-factored softmax.

Tokens of a text are its words with A-Z lowered, then one end.  Documents outside
the held-out tenth train.

Base: a smoothed unigram score from corpus counts over all training documents.

Model: words are dealt to BRANCHES classes of like total frequency, the words of a
class to classes of their own, and so on down to single words, so
P(word | context) = P(class | context) * P(class in class | class, context) * ...
Each factor is a softmax over at most BRANCHES outcomes, with a fixed bias (the
outcomes' shares) and the weights of two hashed features: the class with the word
before (bigram) and the class with the word before that (skip).  Words beyond the
MOST_FREQUENT most frequent ones are one class; it is dealt by hash to
BRANCHES^2 groups, whose softmax is learnt in the same way, and a word's share of
its group is its smoothed count.  One unseen word belongs to each group.  So the
probabilities of all words add up to 1 in every context, like the base's.

Training: ROUNDS rounds over as many shares of the training texts (dealt by a hash
of the text, so every text trains once).  In each, tasks sum the gradient of the
likelihood of the round's texts under the weights so far (how often each outcome
came with each feature, less how often the model expected it); the sums meet by
feature, and each weight takes a step that is scaled by its own expectation, so
what a feature's weight is doesn't depend on how many tasks have met it.
Probabilities are summed in whole multiples of 2^-QUANTUM, so the weights don't
depend on how texts are dealt to tasks either.  Weights are 2^ROW_BITS rows of
BRANCHES numbers.  Scoring gathers the rows of the features that occur.

Counts of frequent words (at most MOST_FREQUENT) are broadcast; all others are
joined by word, so each text's score uses exact counts of all its words.  What is
gathered from the corpus (a row for each word and task) grows with the input.
Words are told apart by their bytes in the counts and where rare words are joined;
the broadcast words are found by 64-bit hashes of their bytes, which two words of a
corpus of V share by chance, with a probability of about V^2 / 2^65.

Null texts are empty: just the end token.  Without training documents counts are
0 and words differ by their groups alone.  Repeated rows count and are scored each, those of null
doc_id too (the empty id decides whether they are held out).  Texts of any length are
scored whole.  Empty table: no rows.
Only doc_id and text are read: other columns, also of clashing names, change nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import LONG, ByteWords, cut_rows, id_bucket, materialise, mix64, pick
from tallyloom.llm.pieces import text_bytes

END = b""
SMOOTH = 0.1
MOST_FREQUENT = 200_000
BRANCHES = 16
ROW_BITS = 16
ROUNDS, PRIOR, QUANTUM = 2, 4.0, 14
BATCH, PART = 16_384, 4_000_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
END_HASH = np.uint64(0x6A09E667F3BCC909)
ODD = np.uint64(0x9E3779B97F4A7C15)
HASHES: list[ByteWords] = []


def hasher() -> ByteWords:
    if not HASHES:
        HASHES.append(ByteWords())
    return HASHES[0]


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts start and end; no word runs on into the next text."""
    full = np.zeros(len(data) + 2, bool)
    full[1:-1] = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    begin, finish = full[1:] & ~full[:-1], full[:-1] & ~full[1:]
    at = offsets[:-1][np.diff(offsets) > 0]
    begin[at[full[at + 1]]] = True
    finish[at[full[at]]] = True
    return np.flatnonzero(begin[:-1]), np.flatnonzero(finish)


class Tokens:
    """The tokens of a column of texts: hash, owner, and for words their place."""

    def __init__(self, column: pa.Array):
        raw, offsets = text_bytes(column)
        self.data = LOWER[raw]
        self.start, self.end = word_places(self.data, offsets)
        n = len(column)
        owner = np.searchsorted(offsets, self.start, "right") - 1
        # an empty text shares its offset with the next one; words belong to the last text that starts there
        self.sizes = np.bincount(owner, minlength=n) + 1
        last = np.cumsum(self.sizes) - 1
        self.hash = np.full(len(owner) + n, END_HASH)
        self.word = np.arange(len(owner)) + owner  # the token of each word
        self.hash[self.word] = hasher().of(self.data, self.start, self.end)
        self.owner = np.repeat(np.arange(n), self.sizes)
        self.place = np.full(len(self.hash), -1)  # the word of each token
        self.place[self.word] = np.arange(len(owner))
        first = np.arange(len(self.hash)) - np.repeat(last - self.sizes + 1, self.sizes)
        self.near, self.skip = np.zeros(len(self.hash), np.uint64), np.zeros(len(self.hash), np.uint64)
        self.near[1:], self.skip[2:] = self.hash[:-1], self.hash[:-2]
        self.near[first < 1] = 0  # a text begins with no words before it
        self.skip[first < 2] = 0

    def alike(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the tokens x are of the same bytes as the tokens y."""
        a, b = self.place[x], self.place[y]
        out = a == b
        words = np.flatnonzero((a >= 0) & (b >= 0))
        a, b = self.start[a[words]], self.start[b[words]]
        size, other = self.end[self.place[x[words]]] - a, self.end[self.place[y[words]]] - b
        even = size == other
        words, a, b, size = words[even], a[even], b[even], size[even]
        if (size > LONG).any():
            long = size > LONG
            out[words[long]] = [bool((self.data[i : i + n] == self.data[j : j + n]).all()) for i, j, n in zip(a[long].tolist(), b[long].tolist(), size[long].tolist(), strict=True)]
            words, a, b, size = words[~long], a[~long], b[~long], size[~long]
        eights = np.ndarray(len(self.data) + 1, "<u8", np.concatenate([self.data, np.zeros(8, np.uint8)]), strides=(1,))
        while len(words):
            same = (eights[a] ^ eights[b]) << ((8 - np.minimum(size, 8)) * 8).astype(np.uint64) == 0
            out[words[same & (size <= 8)]] = True
            more = same & (size > 8)
            words, a, b, size = words[more], a[more] + 8, b[more] + 8, size[more] - 8
        return out

    def runs(self, tokens: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens in order of key, cut where key or bytes change: the first of each run, and its length."""
        order = np.argsort(key, kind="stable")
        tokens, key = tokens[order], key[order]
        first = np.ones(len(tokens), bool)
        at = np.flatnonzero(key[1:] == key[:-1]) + 1
        first[at] = ~self.alike(tokens[at - 1], tokens[at])
        at = np.flatnonzero(first)
        return tokens[at], np.diff(at, append=len(tokens))

    def bytes_of(self, tokens: np.ndarray) -> pa.Array:
        """The words of tokens; the end is the empty word."""
        place = self.place[tokens]
        real = place >= 0
        start, size = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
        start[real] = self.start[place[real]]
        size[real] = self.end[place[real]] - start[real]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.data[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)]
        return pa.Array.from_buffers(pa.binary(), len(tokens), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])


def counts(docs: DataFrame) -> DataFrame:
    """word (binary), n over all training documents; the end is the empty word.  Written once."""

    def run(batches):
        for batch in batches:
            for part in cut_rows(batch, "text", PART):
                t = Tokens(part.column("text"))
                first, n = t.runs(np.arange(len(t.hash)), t.hash)
                yield pa.RecordBatch.from_arrays([t.bytes_of(first), pa.array(n)], names=["word", "n"])

    train = docs.where("not held_out").select("text")
    return materialise(train.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def frequent(words: DataFrame, most: int) -> list:
    """The words that occur most, at most that many: all with a count that fewer than that many words reach."""
    sizes = words.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.col("n").desc()).limit(most).collect()
    total, least = 0, None
    for r in sizes:
        total += r["k"]
        if total > most:
            break
        least = r["n"]
    if least is None:
        return []
    return sorted(((bytes(r["word"]), r["n"]) for r in words.where(F.col("n") >= least).collect()), key=lambda x: (-x[1], x[0]))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The hashes that Tokens gives to these words."""
    out = np.full(len(words), END_HASH)
    real = [k for k, w in enumerate(words) if w]
    size = np.array([len(words[k]) for k in real], np.int64)
    data = np.frombuffer(b"".join([words[k] for k in real]), np.uint8)
    end = np.cumsum(size)
    out[real] = hasher().of(data, end - size, end)
    return out


def groups_of(hashes: np.ndarray) -> np.ndarray:
    """The group of each rare word."""
    return (mix64(hashes) >> np.uint64(64 - 2 * (BRANCHES.bit_length() - 1))).astype(np.int64)


def group_sums(rare: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Count of tokens and of words by group; rare: word, n."""

    def run(batches):
        tokens, words = np.zeros(BRANCHES**2, np.int64), np.zeros(BRANCHES**2, np.int64)
        for batch in batches:
            g = groups_of(word_hashes(batch.column("word").to_pylist()))
            np.add.at(tokens, g, batch.column("n").to_numpy())
            words += np.bincount(g, minlength=BRANCHES**2)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BRANCHES**2)), pa.array(tokens), pa.array(words)], names=["g", "tokens", "words"])

    found = rare.mapInArrow(run, "g long, tokens long, words long").groupBy("g").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).toPandas()
    out = np.zeros((2, BRANCHES**2))
    out[:, found["g"].to_numpy(np.int64)] = found[["tokens", "words"]].to_numpy(float).T
    return out[0], out[1]


class Classes:
    """The nested classes: a path of (class, outcome) for each frequent word and for each group of rare ones."""

    def __init__(self, common: list, tokens: np.ndarray, members: np.ndarray):
        words, n = [w for w, _ in common], np.array([c for _, c in common], np.int64)
        k = len(words)
        self.count = np.append(n, 0)
        self.total = tokens + SMOOTH * (members + 1)  # of each group, with its unseen word
        mass = np.append(n.astype(float), self.total.sum())
        order = np.argsort(-mass, kind="stable")
        sums = np.concatenate([[0.0], np.cumsum(mass[order])])
        bias: list[np.ndarray] = []
        paths: list[list[tuple[int, int]]] = [[] for _ in range(k + 1)]
        open_ranges: list[tuple[int, int, list]] = [(0, k + 1, [])]
        while open_ranges:
            low, high, path = open_ranges.pop()
            if high - low == 1:
                paths[order[low]] = path
                continue
            aims = sums[low] + (sums[high] - sums[low]) * np.arange(1, BRANCHES) / BRANCHES
            cut = np.searchsorted(sums[low + 1 : high], aims) + low + 1 if high - low > BRANCHES else np.arange(low + 1, high)
            ends = [low, *sorted({low + 1, *(int(c) for c in cut if c < high)})[: BRANCHES - 1], high]
            node = len(bias)
            share = np.full(BRANCHES, -1e9)
            share[: len(ends) - 1] = np.log(np.diff(sums[ends]) / (sums[high] - sums[low]))
            bias.append(share)
            open_ranges += [(a, b, [*path, (node, c)]) for c, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]
        self.rest_depth = len(paths[k])
        self.rest_node = len(bias)
        square = self.total.reshape(BRANCHES, BRANCHES)
        bias.append(np.log(square.sum(axis=1) / square.sum()))
        bias += list(np.log(square / square.sum(axis=1, keepdims=True)))
        paths[k] = [*paths[k], (self.rest_node, 0), (self.rest_node + 1, 0)]
        self.bias = np.array(bias, np.float32)
        self.depth = np.array([len(p) for p in paths], np.int8)
        self.node, self.outcome = np.zeros((int(self.depth.max()), k + 1), np.int32), np.zeros((int(self.depth.max()), k + 1), np.int8)
        for w, path in enumerate(paths):
            for level, (node, c) in enumerate(path):
                self.node[level, w], self.outcome[level, w] = node, c
        self.mark = mix64(np.arange(1, len(bias) + 1, dtype=np.uint64) * ODD)  # a random number for each class
        self.bits = max(4, int(2 * k + 1).bit_length() + 1)
        self.keys, self.which = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, k, np.int32)
        left, key = np.arange(k), word_hashes(words)
        step = 0
        while len(left):  # open addressing, all words a step further at a time
            slot = self.slot(key[left], step)
            free = self.keys[slot] == 0
            _, first = np.unique(np.where(free, slot, -1 - left), return_index=True)
            put = first[free[first]]
            self.keys[slot[put]], self.which[slot[put]] = key[left[put]], left[put]
            left = np.delete(left, put)
            step += 1
        self.steps = max(1, step)

    def slot(self, key: np.ndarray, step: int) -> np.ndarray:
        return ((key >> np.uint64(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The frequent word of each hash; the number of frequent words for all others."""
        out = np.full(len(key), len(self.count) - 1, np.int32)
        left = np.arange(len(key))
        for step in range(self.steps):
            slot = self.slot(key[left], step)
            hit = self.keys[slot] == key[left]
            out[left[hit]] = self.which[slot[hit]]
            left = left[~hit & (self.keys[slot] != 0)]
            if not len(left):
                break
        return out

    def factors(self, word: np.ndarray, hashes: np.ndarray, near: np.ndarray, skip: np.ndarray):
        """For each level: the tokens that have it, their class, outcome, and rows of weights for the two features."""
        group = None
        for level in range(len(self.node)):
            at = np.flatnonzero(self.depth[word] > level) if level else np.arange(len(word))
            if not len(at):
                return
            w = word[at]
            node, outcome = self.node[level][w].astype(np.int64), self.outcome[level][w].astype(np.int64)
            if self.rest_depth <= level <= self.rest_depth + 1:
                rare = np.flatnonzero(w == len(self.count) - 1)
                group = groups_of(hashes[at[rare]])
                if level == self.rest_depth:
                    outcome[rare] = group // BRANCHES
                else:
                    node[rare] += group // BRANCHES
                    outcome[rare] = group % BRANCHES
            mark = self.mark[node]
            shift = np.uint64(64 - ROW_BITS)
            yield at, node, outcome, (((near[at] ^ mark) * ODD) >> shift).astype(np.int64), (((skip[at] + ODD ^ mark) * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift).astype(np.int64)


class Scores:
    """The sums of bias and weights at factors; batches share its memory, so each overwrites the last one's."""

    def __init__(self, classes: Classes, weights: np.ndarray):
        self.classes, self.weights = classes, weights
        self.sums = self.rows = np.empty((0, BRANCHES), np.float32)

    def of(self, node: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if len(self.sums) < len(node):
            self.sums, self.rows = (np.empty((len(node) * 5 // 4, BRANCHES), np.float32) for _ in range(2))
        z, row = self.sums[: len(node)], self.rows[: len(node)]
        self.classes.bias.take(node, axis=0, out=z, mode="clip")
        for f in (a, b):
            z += self.weights.take(f, axis=0, out=row, mode="clip")
        return z


def gradient(scores: Scores, column: pa.Array, seen: np.ndarray, hoped: np.ndarray) -> None:
    """Add to seen how often outcomes came with features, and to hoped (by outcome, then row) how often the model expects that (times 2^QUANTUM)."""
    classes, t = scores.classes, Tokens(column)
    word = classes.find(t.hash)
    cells = []
    for low in range(0, len(word), BATCH):
        part = slice(low, low + BATCH)
        _, node, outcome, a, b = map(np.concatenate, zip(*classes.factors(word[part], t.hash[part], t.near[part], t.skip[part]), strict=True))
        p = scores.of(node, a, b)
        np.exp(p, out=p)
        p *= (np.float32(1 << QUANTUM) / np.einsum("ij->i", p))[:, None]
        whole = np.ascontiguousarray(np.rint(p, out=p).T, np.float64)  # whole numbers, so sums don't depend on their order
        for f in (a, b):
            for outcomes, expected in zip(hoped, whole, strict=True):
                outcomes += np.bincount(f, weights=expected, minlength=len(outcomes))
            cells.append(f * BRANCHES + outcome)
    seen += np.bincount(np.concatenate(cells), minlength=len(seen))


def step(seen: np.ndarray, hoped: np.ndarray) -> np.ndarray:
    """The step of each weight: its gradient (seen - hoped) scaled by what is expected, damped, and shared by two features."""
    return (np.log1p((seen - hoped) / (hoped + PRIOR)) / 2).astype(np.float32)


def train(docs: DataFrame, shared) -> np.ndarray:
    """Weights, 2^ROW_BITS x BRANCHES; shared holds the classes."""
    spark = docs.sparkSession
    weights = np.zeros((1 << ROW_BITS, BRANCHES), np.float32)
    kinds = "row long, seen binary, hoped binary"

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, x, y in zip(*(batch.column(c).to_pylist() for c in ("row", "seen", "hoped")), strict=True):
                both = np.stack([np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8")])
                total[r] = total[r] + both if r in total else both
        steps = [step(x.astype(float), y.astype(float) / (1 << QUANTUM)).astype("<f4").tobytes() for x, y in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(steps, pa.binary())], names=["row", "step"])

    training = docs.where("not held_out").select("text", F.pmod(F.xxhash64("text"), F.lit(ROUNDS)).alias("share"))
    for share in range(ROUNDS):
        now = spark.sparkContext.broadcast(weights)

        def run(batches, now=now):
            classes, w = shared.value, now.value
            scores, seen, expected = Scores(classes, w), np.zeros(w.size, np.int64), np.zeros(w.shape[::-1])
            for batch in batches:
                for part in cut_rows(batch, "text", PART):
                    gradient(scores, part.column("text"), seen, expected)
            hoped = np.ascontiguousarray(expected.T, np.int64)
            at = np.flatnonzero(hoped.any(axis=1))
            rows = lambda x: pa.array([r.tobytes() for r in x.reshape(w.shape)[at]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(at), rows(seen), rows(hoped)], names=["row", "seen", "hoped"])

        parts = training.where(F.col("share") == share).select("text").mapInArrow(run, kinds)
        # a feature's rows meet in one task: as many as there are tasks
        found = parts.repartition("row").mapInArrow(add, "row long, step binary").toPandas()
        weights = weights.copy()
        for r, x in zip(found["row"], found["step"], strict=True):
            weights[r] += np.frombuffer(x, "<f4")
        now.unpersist()
    return weights


def log_probabilities(scores: Scores, t: Tokens, word: np.ndarray) -> np.ndarray:
    """log10 of each token's probability, less what the count of a rare word adds to it."""
    classes, out = scores.classes, np.zeros(len(word))
    for low in range(0, len(word), BATCH):
        part = slice(low, low + BATCH)
        at, node, outcome, a, b = map(np.concatenate, zip(*classes.factors(word[part], t.hash[part], t.near[part], t.skip[part]), strict=True))
        z = scores.of(node, a, b)
        chosen = z[np.arange(len(z)), outcome]
        np.exp(z, out=z)
        out[part] = np.bincount(at, weights=chosen - np.log(np.einsum("ij->i", z)), minlength=len(out[part]))
    rare = word == len(classes.count) - 1
    out /= math.log(10)
    out[rare] -= np.log10(classes.total[groups_of(t.hash[rare])])
    return out


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    spark = docs.sparkSession
    docs = pick(docs, "doc_id", "text").select("doc_id", (id_bucket(F.col("doc_id"), 10) == 0).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    words = counts(docs)
    sums = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = sums["n"] or 0, sums["v"]
    common = frequent(words, MOST_FREQUENT)
    # words counted in the broadcast table carry their share already
    least = common[-1][1] if common else None
    rare_words = words if least is None else words.where(F.col("n") < least)
    shared = spark.sparkContext.broadcast(Classes(common, *group_sums(rare_words)))
    weights = spark.sparkContext.broadcast(train(docs, shared))
    base_low = total + SMOOTH * (distinct + 1)

    def run(batches):
        classes, scores = shared.value, Scores(shared.value, weights.value)
        for batch in batches:
            for part in cut_rows(batch, "text", PART):
                t = Tokens(part.column("text"))
                word = classes.find(t.hash)
                c = classes.count[word]
                own = c > 0
                n = part.num_rows
                logp = log_probabilities(scores, t, word)
                base = np.bincount(t.owner, weights=np.where(own, np.log10(c + SMOOTH), 0.0) - math.log10(base_low), minlength=n)
                model = np.bincount(t.owner, weights=logp, minlength=n)
                known = np.bincount(t.owner, weights=own, minlength=n).astype(np.int64)
                ids, held, rows = part.column("doc_id"), part.column("held_out"), part.column("row")
                # a row for each document, its word unlike any other so that no task gets them all
                marks = [b"\n" + str(r).encode() for r in rows.to_pylist()]
                yield pa.RecordBatch.from_arrays([rows, ids, held, pa.array(marks, pa.binary()), pa.array(np.zeros(n, np.int64)), pa.array(t.sizes.astype(np.int64)), pa.array(known), pa.array(base), pa.array(model)], names=names)
                rest = np.flatnonzero(~own)
                if len(rest):
                    one, times = t.runs(rest, mix64(t.hash[rest] + t.owner[rest].astype(np.uint64) * ODD))
                    m = len(one)
                    none = pa.nulls(m, pa.float64())
                    yield pa.RecordBatch.from_arrays([rows.take(pa.array(t.owner[one])), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), t.bytes_of(one), pa.array(times.astype(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), none, none], names=names)

    names = ["row", "doc_id", "held_out", "word", "times", "n_tokens", "known", "base", "model"]
    scored = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "row long, doc_id long, held_out boolean, word binary, times long, n_tokens long, known long, base double, model double")
    joined = scored.join(rare_words, "word", "left")
    share = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)
    found = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("known") + F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0))).cast("long").alias("n_known"),
        (F.max("base") + F.sum(share)).alias("base_score"),
        (F.max("model") + F.sum(share)).alias("score"),
    )
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
