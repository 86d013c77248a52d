"""Line deduplication by a join of deletion neighbourhoods.

A line is its lowered words; only lines without a word (under MIN_WORDS) are left
alone.  Two lines match if their words are equal or, when both have at least
EDIT_WORDS words, if one word put in, left out or changed makes them equal (edit
bound 1).  Shorter lines must be equal: there one word is a third of the line or
more, and most lines within the bound are chance (figures in the README).
A line goes if the corpus has an earlier one that matches, in the order of doc_id
(null last), then text, then place in the text.  What it matches may itself have
gone, so the result doesn't depend on the order of work.

All variants of a line that lack one word are hashed keys; equal variants join.
A key holds the place of the gap and the hashes of what lies before and after it,
so lines that share the key of a changed word differ in just that word, and a
line that equals another's variant lacks just one of its words.  The edit distance
is verified by a second hash of the same words under another seed, down to the
words' bytes, that goes with each key: lines match only if both agree, within a
batch and across them.  A hash adds up its words, each mixed with its place, and a
word's hash mixes its bytes step by step, so no pattern of bytes or words makes
lines agree, only chance: words are never compared across batches.

Long lines have many variants and few partners.  So a first pass joins coarse
variants, about a dozen a line: the words before and after a gap of some words,
both counted in steps of a third of the line.  Lines within the bound always share
one.  A Bloom filter of fixed size holds the coarse keys that several lines share
(a false hit costs work, no match is lost); the second pass emits the one-word
variants inside such gaps only.

Copies of a line in a batch are settled there, so a line that a third of all
documents hold reaches the join once for each batch.  So are lines that differ in
the same one word: all but the earliest go, and it alone stands under their key.
Groups are scanned in order of sorted rows, never held.

Null texts have no lines.  Rows of equal doc_id and text count as one document and
get the same result.  Texts of any length are cut whole.  Empty table: no rows.  Other
columns are carried along as they are, also those named like ours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import ByteWords, cut_rows, mix64, pick

MIN_WORDS, EDIT_WORDS = 1, 4
BLOOM_BITS = 26
PART = 2_000_000  # bytes of text worked on at a time
PLACE = np.uint64(0x9E3779B97F4A7C15)
FROM_START, MOVED_UP, FROM_END = 0, 1, 2
SELF, LACKS, CHANGED, EQUAL, COUNT, GONE = 0, 1, 2, 3, 8, 9


def step_of(n: int) -> int:
    """Words by which the coarse gaps of a line of n words are placed: a power of two from two on, about a third of n."""
    return 1 << max(1, (n // 3).bit_length() - 1)


def gaps(n: int) -> np.ndarray:
    """Words kept before and after each coarse gap; lines of n and n + 1 words within one edit share one."""
    pairs = set()
    for step in {step_of(n), step_of(n - 1)}:
        for p in range(n + 1):
            for after in (n - 1 - p, n - p):
                if after >= 0:
                    pairs.add((p // step * step, after // step * step))
    return np.array(sorted(x for x in pairs if sum(x) < n or n == 0), np.int64).reshape(-1, 2)


class Lines:
    """The lines of some texts with hashes of any run of their words."""

    def __init__(self, texts: list[str], hashes: tuple[ByteWords, ByteWords]):
        lowered = [text.lower().encode("utf-8", "surrogatepass") for text in texts]
        count = np.array([x.count(b"\n") + 1 for x in lowered], np.int64)
        self.counts = np.where([len(x) > 0 for x in lowered], count, 0).tolist()
        data = np.frombuffer(b"\n".join([*lowered, b""]), np.uint8)
        start, end = hashes[0].places(data)
        line = np.searchsorted(np.flatnonzero(data == 10), start)  # of each word
        size = np.bincount(line, minlength=int(count.sum()))
        long = size >= MIN_WORDS
        kept = long[line]
        streams = [h.of(data, start[kept], end[kept]) for h in hashes]
        self.owner = np.repeat(np.arange(len(texts)), count)[long]
        self.place = (np.arange(len(size)) - np.repeat(np.cumsum(count) - count, count))[long]
        self.size = size[long]
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        # each word with its number from the line's start, that number less one, and its number from the line's end
        at = np.arange(len(streams[0])) - np.repeat(self.start, self.size) + 1
        rest = np.repeat(self.size, self.size) - at
        numbers = (at, at - 1, ~rest)
        self.sums = [[np.concatenate([[np.uint64(0)], np.cumsum(mix64(x + n.astype(np.uint64) * PLACE))]) for n in numbers] for x in streams]

    def run(self, start: np.ndarray, end: np.ndarray, which: int = 0, by: int = FROM_START) -> np.ndarray:
        """Hash of the words from start to end of a line, each mixed with its place, so that no order of words cancels out."""
        s = self.sums[which][by]
        return s[end] - s[start]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        n = self.size.astype(np.uint64)
        return mix64(self.run(self.start, self.end) + n), mix64(self.run(self.start, self.end, 1) + n)

    def coarse(self, which: np.ndarray, known: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the lines named: line, words before, words after and key of each coarse variant."""
        sizes = self.size[which].tolist()
        parts = []
        for n in sizes:
            if n not in known:
                known[n] = gaps(n)
            parts.append(known[n])
        line = np.repeat(which, [len(p) for p in parts])
        pairs = np.concatenate(parts) if parts else np.empty((0, 2), np.int64)
        a, b = pairs[:, 0], pairs[:, 1]
        s, e = self.start[line], self.end[line]
        return line, a, b, two(self.run(s, s + a), self.run(e - b, e, by=FROM_END), a, b)


def two(x: np.ndarray, y: np.ndarray, a, b) -> np.ndarray:
    """One hash of two hashes and two numbers."""
    x = mix64(x + np.asarray(a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return mix64(x * np.uint64(0xC2B2AE3D27D4EB4F) + y + np.asarray(b).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def bloom_places(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([keys >> np.uint64(64 - BLOOM_BITS), mix64(keys) >> np.uint64(64 - BLOOM_BITS)]).astype(np.int64)


def ready(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("mark"))


def shared_gaps(docs: DataFrame) -> np.ndarray:
    """Bits of the Bloom filter over the coarse keys that lines of different words share: 2^BLOOM_BITS bits, whatever the input."""

    def emit(batches):
        hashes, known, seen = both_hashes(), {}, set()
        for batch in batches:
            for part in cut_rows(batch, "text", PART):
                lines = Lines(part.column("text").to_pylist(), hashes)
                k1, _ = lines.keys()
                _, first = np.unique(k1, return_index=True)
                first = first[lines.size[first] >= EDIT_WORDS]
                if len(seen) > 200_000:
                    seen.clear()
                new = [i for i, k in zip(first.tolist(), k1[first].tolist(), strict=True) if k not in seen]
                seen.update(k1[new].tolist())
                line, _, _, key = lines.coarse(np.array(new, np.int64), known)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(k1[line].view(np.int64))], names=["key", "line"])

    def places(batches):
        last_key = last_line = None
        for batch in batches:
            key, line = batch.column("key").to_numpy(), batch.column("line").to_numpy()
            if last_key is not None:
                key, line = np.concatenate([[last_key], key]), np.concatenate([[last_line], line])
            if not len(key):
                continue
            several = np.unique(key[1:][(key[1:] == key[:-1]) & (line[1:] != line[:-1])])
            last_key, last_line = key[-1], line[-1]
            at = bloom_places(several.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bit"])

    coarse = ready(docs).mapInArrow(emit, "key long, line long")
    bits = coarse.repartition("key").sortWithinPartitions("key", "line").mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    words = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    words[bits["word"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64)
    return words.view(np.uint8)


def both_hashes() -> tuple[ByteWords, ByteWords]:
    return ByteWords(), ByteWords(0xA0761D6478BD642F)


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), rows, n_lines and dropped (sorted places) of each different document."""
    shared = docs.sparkSession.sparkContext.broadcast(shared_gaps(docs))
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("other", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("place", pa.int64())])

    def emit(batches):
        bits, hashes, known = shared.value, both_hashes(), {}
        for batch in batches:
            for part in cut_rows(batch, "text", PART):
                lines = Lines(part.column("text").to_pylist(), hashes)
                ids = part.column("doc_id")
                none, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
                marks = part.column("mark").to_numpy(zero_copy_only=False)
                k1, k2 = lines.keys()
                o = lines.owner
                order = np.lexsort((lines.place, marks[o], ids[o], none[o], k2, k1))
                fresh = np.ones(len(order), bool)
                fresh[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
                head = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))] if len(order) else order
                twin = (marks[o[head]] == marks[o[order]]) & (ids[o[head]] == ids[o[order]]) & (none[o[head]] == none[o[order]]) & (lines.place[head] == lines.place[order])
                first, gone = order[fresh], order[~fresh & ~twin]
                rows = [(COUNT, marks.view(np.uint64), np.zeros(len(marks), np.uint64), np.arange(len(marks)), np.array(lines.counts, np.int64))]
                rows.append((GONE, mix64(k1[gone] + lines.place[gone].astype(np.uint64) + marks[o[gone]].view(np.uint64)), k2[gone], o[gone], lines.place[gone]))
                rows.append((EQUAL, k1[first], k2[first], o[first], lines.place[first]))
                line, a, b, key = lines.coarse(first[lines.size[first] >= EDIT_WORDS], known)
                at = bloom_places(key)
                on = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
                hit = (on[: len(key)] & on[len(key) :]).astype(bool)
                line, a, b = line[hit], a[hit], b[hit]
                width = lines.size[line] - a - b
                word = np.repeat(lines.start[line] + a, width) + (np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width))
                inside = np.unique(np.stack([np.repeat(line, width), word], axis=1), axis=0)
                line, word = inside[:, 0], inside[:, 1]
                s, e = lines.start[line], lines.end[line]
                n = lines.size[line]
                # each key twice, from independent hashes of the words
                before = [lines.run(s, word, k) for k in (0, 1)]
                changed, changed2 = (two(before[k], lines.run(word + 1, e, k), word - s, n) for k in (0, 1))
                lacks, lacks2 = (two(before[k] + lines.run(word + 1, e, k, MOVED_UP), np.uint64(0), n - 1, 0) for k in (0, 1))
                order = np.lexsort((lines.place[line], marks[o[line]], ids[o[line]], none[o[line]], changed2, changed))
                lead = np.ones(len(order), bool)
                lead[1:] = (changed[order][1:] != changed[order][:-1]) | (changed2[order][1:] != changed2[order][:-1])
                lead, late = order[lead], np.unique(line[order[~lead]])
                rows.append((GONE, mix64(k1[late] + lines.place[late].astype(np.uint64) + marks[o[late]].view(np.uint64)), k2[late], o[late], lines.place[late]))
                led = line[lead]
                rows.append((CHANGED, changed[lead], changed2[lead], o[led], lines.place[led]))
                rows.append((LACKS, lacks[lead], lacks2[lead], o[led], lines.place[led]))
                whole = np.unique(line)
                own, own2 = (two(lines.run(lines.start[whole], lines.end[whole], k), np.uint64(0), lines.size[whole], 0) for k in (0, 1))
                rows.append((SELF, own, own2, o[whole], lines.place[whole]))
                for kind, key, other, who, place in rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(other.view(np.int64)), pa.array(ids[who], mask=none[who]), pa.array(marks[who]), pa.array(place)], schema=schema)

    def scan(batches):
        last = None  # key, other, and the earliest row of each kind under them
        first: dict[int, tuple] = {}
        for batch in batches:
            kind, key, other, mark, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "key", "other", "mark", "place"))
            ids = batch.column("doc_id")
            none, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            keep = (kind == GONE) | (kind == COUNT)
            # rows alone under their key need no look
            same = np.zeros(len(key) + 1, bool)
            same[1:-1] = (key[1:] == key[:-1]) & (other[1:] == other[:-1])
            crowd = same[:-1] | same[1:]
            if len(key):
                crowd[-1] = True
                crowd[0] = True
            for i in np.flatnonzero(crowd & ~keep).tolist():
                group = (key[i], other[i])
                if group != last:
                    last, first = group, {}
                k, row = int(kind[i]), (none[i], ids[i], mark[i], place[i])
                rival = first.get({SELF: LACKS, LACKS: SELF}.get(k, k))
                if rival is not None and rival != row:
                    keep[i] = True
                first.setdefault(k, row)
            at = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(kind[at] == COUNT), pa.array(ids[at], mask=none[at]), pa.array(mark[at]), pa.array(place[at])], names=["is_count", "doc_id", "mark", "place"])

    rows = ready(docs).mapInArrow(emit, "kind int, key long, other long, doc_id long, mark long, place long")
    ordered = rows.repartition("key", "other").sortWithinPartitions("key", "other", F.col("doc_id").isNull(), "doc_id", "mark", "place")
    found = ordered.mapInArrow(scan, "is_count boolean, doc_id long, mark long, place long")
    return found.groupBy("doc_id", "mark").agg(
        F.count_if("is_count").alias("rows"),
        F.max(F.when(F.col("is_count"), F.col("place"))).alias("n_lines"),
        F.sort_array(F.collect_set(F.when(~F.col("is_count"), F.col("place")))).alias("dropped"),
    )


def line_marks(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept and dropped_lines (places from 0, comma-joined) for every row of docs."""
    found = dropped_lines(docs)
    each = F.explode(F.sequence(F.lit(1), F.col("rows")))
    return found.select("doc_id", "n_lines", (F.col("n_lines") - F.size("dropped")).alias("n_kept"), F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped_lines"), each.alias("row")).drop("row")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs, their texts without the lines that go; other columns as they are."""
    found = dropped_lines(docs).where(F.size("dropped") > 0)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("its_id"), F.xxhash64("text").alias("its_mark"))
    joined = rows.join(found, F.col("its_id").eqNullSafe(F.col("doc_id")) & (F.col("its_mark") == F.col("mark")), "left").select("row", "dropped", F.split("row.text", "\n", -1).alias("lines"))
    # the places that stay by a set difference: long texts take time in proportion
    places = joined.withColumn("kept", F.array_except(F.transform(F.sequence(F.lit(1), F.size("lines")), lambda i: i.cast("long") - 1), "dropped"))
    left = F.array_join(F.transform("kept", lambda i: F.get("lines", i.cast("int"))), "\n")
    text = F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(left)
    return places.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
