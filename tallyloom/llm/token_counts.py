"""Token counts by the whole-token shortcut.

Offline: every string of the vocabulary goes alone through the whole tokenizer, and
those that come back as their one token are proven (`whole_tokens`).  A table of
them, of a size that the vocabulary bounds, is broadcast.

Texts stay the UTF-8 bytes that Arrow brings, A-Z lowered as the tokenizer does.
pieces.cuts cuts them only where the tokenizer surely encodes both sides apart from
each other, so the tokens of a text are those of its pieces.  A piece that is a
proven string counts as one token without any merge.  Only the rest is merged, each
different piece once while a bounded table holds it.  Texts that may hold a special
token's text go to the library whole.

Null texts count as empty: 0 bytes, 0 tokens.  Texts of any length are counted
whole.  Each row of docs, repeated ones and those of null doc_id too, gives one
row; other columns are not looked at.  Empty table: no rows.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.bpe import LOWER, PLAIN, byte_alphabet
from tallyloom.llm.common import cut_rows, mix64, pick
from tallyloom.llm.pieces import SHORT, PieceTable, cuts, load, special_texts, table_for, text_bytes, tokenizer

LIMIT = 2048
PART = 2_000_000  # bytes of text worked on at a time
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


@functools.cache
def whole_tokens(spec: str) -> tuple[bytes, ...]:
    """The strings that the tokenizer, given them alone, encodes as the one token of theirs, in ascending order."""
    model, alphabet = json.loads(spec)["model"], byte_alphabet()
    suffix = model.get("end_of_word_suffix") or ""
    spelt = {}
    for token, number in model["vocab"].items():
        if token.endswith(suffix) and len(token) > len(suffix):
            word = token[: len(token) - len(suffix)]
            if all(c in alphabet for c in word):
                try:
                    spelt[bytes(alphabet[c] for c in word).decode()] = number
                except UnicodeDecodeError:
                    continue  # a part of a character: no text is spelt so
    found = tokenizer(spec).encode_batch_fast(list(spelt), add_special_tokens=False)
    return tuple(sorted(text.encode() for (text, number), e in zip(spelt.items(), found, strict=True) if e.ids == [number]))


class ProvenTokens:
    """match() tells which pieces of texts are proven strings."""

    def __init__(self, strings: tuple[bytes, ...]):
        self.long = {s for s in strings if len(s) > SHORT}
        short = [s for s in strings if len(s) <= SHORT]
        self.bits = max(4, (4 * len(short)).bit_length())
        self.low, self.high = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
        size = np.array([len(s) for s in short], np.int64)
        low, high = self.keys(np.frombuffer(b"".join(short), np.uint8), np.cumsum(size) - size, size)
        left, self.steps = np.arange(len(short)), 0
        while len(left):  # open addressing, all strings a step further at a time
            slot = self.slot(low[left], high[left], self.steps)
            free = self.high[slot] == 0
            _, first = np.unique(np.where(free, slot, -1 - left), return_index=True)
            put = first[free[first]]
            self.low[slot[put]], self.high[slot[put]] = low[left[put]], high[left[put]]
            left = np.delete(left, put)
            self.steps += 1

    @staticmethod
    def keys(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers that hold the bytes and the length of each piece of up to SHORT bytes: never 0, equal only for equal pieces."""
        eights = np.ndarray(len(data) + 9, "<u8", np.concatenate([data, np.zeros(16, np.uint8)]), strides=(1,))
        few = np.minimum(size, 8)
        low = eights[start] & (FULL >> ((8 - few) * 8).astype(np.uint64))
        more = (np.uint64(1) << ((size - few) * 8).astype(np.uint64)) - np.uint64(1)
        return low, (eights[start + 8] & more) | (size.astype(np.uint64) << np.uint64(56))

    def slot(self, low: np.ndarray, high: np.ndarray, step: int) -> np.ndarray:
        return ((mix64(low * np.uint64(0x9E3779B97F4A7C15) + high) >> np.uint64(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def match(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), bool)
        at = np.flatnonzero(end - start <= SHORT)
        low, high = self.keys(data, start[at], (end - start)[at])
        for step in range(self.steps):
            slot = self.slot(low, high, step)
            hit = (self.low[slot] == low) & (self.high[slot] == high)
            out[at[hit]] = True
            left = ~hit & (self.high[slot] != 0)
            at, low, high = at[left], low[left], high[left]
            if not len(at):
                break
        if self.long:
            long = np.flatnonzero(end - start > SHORT)
            out[long] = [data[a:b].tobytes() in self.long for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
        return out


def count(proven: ProvenTokens, table: PieceTable, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each text of a column without nulls."""
    table.room()
    raw, offsets = text_bytes(texts)
    data = LOWER[raw]
    start, end = cuts(data, offsets[:-1], keep_blanks=False)
    owner = np.searchsorted(offsets, start, "right") - 1
    special = special_texts(data, offsets)
    if len(special):
        free = ~np.isin(owner, special)
        start, end, owner = start[free], end[free], owner[free]
    each = np.ones(len(start), np.int64)
    rest = np.flatnonzero(~proven.match(data, start, end))
    merged = table.entries(data, start[rest], end[rest])
    each[rest] = table.length[merged]
    sums = np.concatenate([[0], np.cumsum(each)])
    tokens = np.diff(sums[np.searchsorted(owner, np.arange(len(offsets)))])
    if len(special):
        merged = table.whole([raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "surrogatepass") for k in special])
        tokens[special] = table.length[merged]
    return np.diff(offsets), tokens


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs."""
    spec = load(tokenizer_path)
    shared = docs.sparkSession.sparkContext.broadcast((spec, whole_tokens(spec)))

    def run(batches):
        text, strings = shared.value
        proven, table = ProvenTokens(strings), table_for(text, PLAIN)
        for batch in batches:
            for part in cut_rows(batch, "text", PART):
                n_bytes, n_tokens = count(proven, table, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    texts = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
