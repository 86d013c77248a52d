"""BPE encoding and decoding with reuse of content-defined chunks.

A hash over the last WINDOW bytes cuts each text into chunks at places that depend
on the text alone, so a passage that stands in many documents gives the same
chunks in each.  A chunk is encoded once, at its first use, and its ids are reused
wherever it comes again, in this document or another.  Chunks are known by their
bytes: hashes cut and deal texts, but never decide that two chunks are equal.

Sharing over the cluster: each document is named by the least hash of its chunks.
Documents that share most chunks likely share this name, so rows are dealt to
ranges of names: copies stand in one task, or in neighbouring ones where a group
is larger than a task, as the row's number divides equal names.  Only texts are
shuffled, never ids.  Results don't depend on how rows are dealt.

A chunk is cut anywhere, also inside a word, so its ids are right only for what
lies between its first and its last blank (both sides of a blank are encoded apart
from each other: the pre-tokenizer drops blanks and no match crosses one).  Each
join of two chunks is repaired: the span around it grows, over chunks without
blanks too, until it starts and ends at blanks, where the ids before and after it
agree exactly with those of the text; the span is encoded anew.

Within new chunks and spans, the library encodes each different piece of text once
(pieces.py); as letters are lowered by the tokenizer anyway, A-Z are lowered first.
Texts that may hold a special token's text go to the library whole.  Decoding
follows the tokenizer's decoder: with none, tokens are joined by blanks; with the
byte-level one, their bytes are.  It works on the ids.

Null texts count as empty ones: no tokens.  Repeated rows get one row each, those of
null doc_id too.  Texts of any length are encoded whole.  Empty table: no rows.
Only doc_id and text are read: other columns, also of clashing names, change nothing.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import ByteWords, cut_rows, mix64, pick
from tallyloom.llm.pieces import PieceTable, cuts, load, special_texts, table_for, text_bytes

WINDOW, CHUNK_BITS = 8, 7  # a chunk has about 2^CHUNK_BITS bytes
CHUNKS, CHUNK_BYTES = 100_000, 32_000_000  # kept by a task at most, but for those of the texts at hand
#: One pre-token in normal form: small Latin letters that every version of Unicode in use knows.
PLAIN = "[a-zß-öø-ÿ]+"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPELL = 65_536  # ids spelt at a time
PART = 1_000_000  # bytes of text worked on at a time


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Speller:
    """The text that ids decode to."""

    def __init__(self, spec: str):
        alphabet, model = byte_alphabet(), json.loads(spec)
        names = {i: t for t, i in model["model"]["vocab"].items()} | {x["id"]: x["content"] for x in model.get("added_tokens", [])}
        if not model.get("decoder"):
            self.between, spelt = 1, {i: t.encode() + b" " for i, t in names.items()}
        elif model["decoder"]["type"] == "ByteLevel":
            self.between, spelt = 0, {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for i, t in names.items()}
        else:
            raise ValueError("only tokenizers without a decoder or with the byte-level one are supported")
        rows = [spelt.get(i, b"") for i in range(max(spelt) + 1)]
        self.length = np.array([len(r) for r in rows], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(rows), np.uint8)

    def spell(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The decoded bytes of runs of ids: from ends[k] to ends[k + 1]."""
        parts = []
        for low in range(0, len(ids), SPELL):
            some = ids[low : low + SPELL]
            size = self.length[some]
            before = np.cumsum(size) - size
            parts.append(self.bytes[np.arange(size.sum()) + np.repeat(self.offset[some] - before, size)].tobytes())
        data = b"".join(parts)
        bounds = np.concatenate([[0], np.cumsum(self.length[ids])])[ends].tolist()
        out = [data[a : b - self.between if b > a else b] for a, b in zip(bounds, bounds[1:], strict=False)]
        # bytes that aren't UTF-8 become the replacement character, as in the library
        return out if self.between else [x.decode("utf-8", "replace").encode() for x in out]


def chunk_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the content-defined chunks of texts start and end; empty texts have none."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    flag = np.zeros(len(data) + 1, bool)
    if len(data) > WINDOW:
        before = np.ndarray(len(data) - WINDOW + 1, "<u8", np.ascontiguousarray(data), strides=(1,))  # the WINDOW bytes from each place on
        at = np.flatnonzero((before * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CHUNK_BITS) == 0) + WINDOW
        own = starts[np.searchsorted(starts, at - 1, "right") - 1]
        flag[at[at - own >= WINDOW]] = True
    flag[starts] = True
    start = np.flatnonzero(flag[:-1])
    return start, np.append(start[1:], len(data)) if len(start) else start


class ChunkCoder:
    """encode(column): ids of texts by chunks, kept while there are at most CHUNKS of them."""

    def __init__(self, spec: str):
        self.table: PieceTable = table_for(spec, PLAIN)
        self.chunks: dict[bytes, int] = {}  # by their bytes, so that equal keys are equal chunks
        self.held = self.reused = self.seen = 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's end (and the first one's start) is."""
        if self.table.count > self.table.most or len(self.chunks) > CHUNKS or self.held > CHUNK_BYTES:
            self.table.clear()
            self.chunks.clear()
            self.held = 0
        table = self.table
        raw, offsets = text_bytes(texts)
        data = LOWER[raw]
        special = special_texts(data, offsets)
        start, end = chunk_spans(data, offsets)
        flat = data.tobytes()
        keys = [flat[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        blanks = np.flatnonzero((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
        low, high = np.searchsorted(blanks, start), np.searchsorted(blanks, end) - 1
        inner = high > low
        first, last = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        first[inner], last[inner] = blanks[low[inner]], blanks[high[inner]]
        new: dict[bytes, int] = {}
        for k in np.flatnonzero(inner).tolist():
            if keys[k] not in self.chunks:
                new.setdefault(keys[k], k)
        self.seen += len(keys)
        self.reused += int(inner.sum()) - len(new)
        is_new = np.zeros(len(start), bool)
        is_new[list(new.values())] = True
        s, e = cuts(data, offsets[:-1], keep_blanks=False)
        chunk = np.searchsorted(start, s, "right") - 1
        inside = inner[chunk] & (s > first[chunk]) & (e <= last[chunk])
        wanted = ~inside | is_new[chunk]
        s, e, chunk, inside = s[wanted], e[wanted], chunk[wanted], inside[wanted]
        if len(special):
            free = ~np.isin(np.searchsorted(offsets, s, "right") - 1, special)
            inside_all = inside
            s, e, chunk, inside = s[free | inside_all], e[free | inside_all], chunk[free | inside_all], inside[free | inside_all]
        entries = table.entries(data, s, e)
        # encode new chunks once
        order = np.array(list(new.values()), np.int64)
        flat, ends = table.gather(entries[inside])
        each = np.searchsorted(chunk[inside], [order, order + 1])
        made = table.add(flat, ends[each[1]] - ends[each[0]]) if len(order) else np.empty(0, np.int64)
        self.chunks.update(zip(new, made.tolist(), strict=True))
        self.held += sum(map(len, new))
        whole = np.flatnonzero(inner)
        places = [s[~inside], first[whole] + 1]
        items = [entries[~inside], np.fromiter((self.chunks[keys[k]] for k in whole.tolist()), np.int64, len(whole))]
        if len(special):  # these texts aren't cut
            keep = ~np.isin(np.searchsorted(offsets, places[1], "right") - 1, special)
            free = ~np.isin(np.searchsorted(offsets, places[0], "right") - 1, special)
            places = [places[0][free], places[1][keep], offsets[special]]
            items = [items[0][free], items[1][keep], table.whole([raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "surrogatepass") for k in special])]
        place, item = np.concatenate(places), np.concatenate(items)
        order = np.argsort(place, kind="stable")
        flat, ends = table.gather(item[order])
        return flat, ends[np.searchsorted(place[order], offsets)]


def least_chunk(texts: pa.Array, hashes: ByteWords) -> np.ndarray:
    """A name for each text from the least hash of its chunks, mixed again, as long texts have smaller ones; 0 for an empty text."""
    data, offsets = text_bytes(texts)
    start, end = chunk_spans(data, offsets)
    out = np.zeros(len(texts), np.uint64)
    full = np.diff(offsets) > 0
    if len(start):
        out[full] = mix64(np.minimum.reduceat(mix64(hashes.of(data, start, end)), np.searchsorted(start, offsets[:-1][full])))
    return out.view(np.int64)


def by_chunks(docs: DataFrame) -> DataFrame:
    """doc_id and text, dealt so that texts of like chunks stand in one task or in neighbouring ones."""

    def run(batches):
        hashes = ByteWords()
        for batch in batches:
            for part in cut_rows(batch, "text", PART):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(least_chunk(part.column("text"), hashes))], names=["doc_id", "text", "name"])

    texts = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named = texts.mapInArrow(run, "doc_id long, text string, name long")
    return named.repartitionByRange(F.col("name"), F.xxhash64("text"), F.monotonically_increasing_id()).sortWithinPartitions("name").select("doc_id", "text")


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves; one row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(load(tokenizer_path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.binary())])

    def run(batches):
        coder, speller = ChunkCoder(shared.value), Speller(shared.value)
        for batch in batches:
            for part in cut_rows(batch, "text", PART):
                flat, ends = coder.encode(part.column("text"))
                data = flat.astype("<u4").tobytes()
                at = (4 * ends).tolist()
                ids = [data[a:b] for a, b in zip(at, at[1:], strict=False)]
                decoded = [hashlib.sha256(x).hexdigest() for x in speller.spell(flat, ends)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends)), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(decoded), pa.array(ids, pa.binary())], schema=schema)

    return by_chunks(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")
