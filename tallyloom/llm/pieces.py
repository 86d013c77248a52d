"""Token ids of short pieces of text, each different piece encoded once while a bounded table holds it.

Texts stay the UTF-8 bytes that Arrow brings: pieces are places in them, looked up
by numpy, without a Python object for each.  A piece of up to SHORT bytes is its
own key (its bytes and length fill two 64-bit numbers), so equal keys are equal
pieces; longer ones are looked up by their bytes.

Pieces are cut only where the tokenizers' patterns never join the two sides:
before a single blank and around a single line end between characters that
surely aren't white space, and before an ASCII mark after a Latin letter or an
ASCII digit.  All else stays together and is left to the library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from tallyloom.llm.common import mix64

SHORT = 15
SLOT_BITS = 20
PIECES = 800_000
BLANK, LINE_END, MARK, NEXT_OK, PREV_OK, ALNUM, CONTINUED = 1, 2, 4, 8, 16, 32, 64


def byte_kinds() -> np.ndarray:
    """What each byte can be: bits of the names above."""
    out = np.zeros(256, np.uint8)
    out[0x20], out[0x0A] = BLANK, LINE_END
    for b in range(33, 127):
        out[b] = NEXT_OK | PREV_OK | (ALNUM if chr(b).isalnum() else MARK)
    out[0x80:0xC0] = CONTINUED
    # first bytes of characters that no version of Unicode counts as white space
    out[0xC3:0xE0] = out[0xE4:0xEE] = NEXT_OK
    return out


KINDS = byte_kinds()
#: Last bytes of the two signs among the letters from U+00C0 to U+024F, and of the I whose small form ends in a dot of its own.
TIMES, DIVIDE, DOTTED_I = 0x97, 0xB7, 0xB0


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of strings without nulls."""
    if column.type == pa.large_string():
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def cuts(data: np.ndarray, starts: np.ndarray, keep_blanks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces start and end; texts start at starts.

    With keep_blanks pieces cover all bytes, and a blank belongs to what follows it.  Without, blanks are left out.
    """
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = KINDS[data]
    at = np.flatnonzero(kind & (BLANK | LINE_END | MARK if keep_blanks else MARK))
    inside = at[at > 0]
    own, before = kind[inside], kind[inside - 1]
    # the character before, if it takes several bytes
    back = np.maximum(inside - 2, 0)
    far = np.maximum(inside - 3, 0)
    two = (before & CONTINUED != 0) & (data[back] >= 0xC3) & (data[back] < 0xE0)
    three = (before & CONTINUED != 0) & (kind[back] & CONTINUED != 0) & (data[far] >= 0xE4) & (data[far] < 0xEE)
    last = data[inside - 1]
    letter = two & (data[back] <= 0xC9) & ~((data[back] == 0xC3) & ((last == TIMES) | (last == DIVIDE))) & ~((data[back] == 0xC4) & (last == DOTTED_I))
    mark = (own & MARK != 0) & ((before & ALNUM != 0) | letter)
    if keep_blanks:
        following = kind[np.minimum(inside + 1, len(data) - 1)]
        free = ((before & PREV_OK != 0) | two | three) & (following & NEXT_OK != 0) & (inside + 1 < len(data))
        blank, line = free & (own & BLANK != 0), free & (own & LINE_END != 0)
        parts = [starts[starts < len(data)], inside[mark | blank | line], inside[line] + 1]
        flag = np.zeros(len(data) + 1, bool)
        for p in parts:
            flag[p] = True
        start = np.flatnonzero(flag[:-1])
        return start, np.append(start[1:], len(data))
    full = np.ones(len(data) + 2, bool)
    full[0] = full[-1] = False
    full[1:-1] = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    begin = full[1:] & ~full[:-1]
    finish = full[:-1] & ~full[1:]
    for p in (starts[starts < len(data)], inside[mark]):
        p = p[full[p + 1]]
        begin[p] = True
        p = p[full[p]]
        finish[p] = True
    return np.flatnonzero(begin[:-1]), np.flatnonzero(finish)


def load(path: str) -> str:
    """The tokenizer file as text, to be broadcast (a few MB, whatever the corpus)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def tokenizer(spec: str):
    """The library's tokenizer without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    t.no_truncation()
    t.no_padding()
    return t


class PlainWords:
    """The same merges for pieces known to be one pre-token in normal form: many are encoded in a call, a line each."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer, pre_tokenizers
        from tokenizers.models import BPE

        model = json.loads(spec)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        more = {"end_of_word_suffix": model["end_of_word_suffix"]} if model.get("end_of_word_suffix") else {}
        self.library = Tokenizer(BPE(model["vocab"], merges, cache_capacity=0, **more))
        self.library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        (self.line_end,) = self.library.encode("\n").ids

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each has."""
        parts = [np.array(self.library.encode_batch_fast(["\n".join([*pieces[k : k + 500], ""])], add_special_tokens=False)[0].ids, np.int32) for k in range(0, len(pieces), 500)]
        flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
        ends = np.flatnonzero(flat == self.line_end)
        return np.delete(flat, ends), np.diff(ends, prepend=-1) - 1


class PieceTable:
    """Ids of pieces: entries() gives each piece's entry, encoding what isn't known yet; gather() the ids of entries.

    plain matches pieces that are one pre-token in normal form; all others go through the whole tokenizer.
    """

    def __init__(self, spec: str, plain: str, most: int = PIECES):
        self.library, self.words, self.plain, self.most = tokenizer(spec), PlainWords(spec), re.compile(plain), most
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}  # of long pieces
        self.pool, self.used = np.empty(1 << 20, np.int32), 0
        self.offset, self.length = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        self.count = 0
        slots = 1 << SLOT_BITS
        self.low, self.high, self.which = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.int32)

    def add(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Put ids into the pool; the numbers of the new entries, of counts ids each."""
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while self.count + len(counts) > len(self.offset):
            self.offset, self.length = (np.concatenate([x, np.empty_like(x)]) for x in (self.offset, self.length))
        self.pool[self.used : self.used + len(flat)] = flat
        new = np.arange(self.count, self.count + len(counts))
        self.offset[new], self.length[new] = self.used + np.cumsum(counts) - counts, counts
        self.used += len(flat)
        self.count += len(counts)
        return new

    def whole(self, texts: list[str]) -> np.ndarray:
        """Entries of texts that go through the whole tokenizer."""
        rows = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return self.add(np.array([i for r in rows for i in r], np.int32), np.array([len(r) for r in rows], np.int64))

    def encode(self, pieces: list[bytes]) -> np.ndarray:
        """New entries of different pieces."""
        spelt = [p.decode("utf-8", "surrogatepass") for p in pieces]
        out, match = np.empty(len(pieces), np.int64), self.plain.fullmatch
        plain = np.array([match(t) is not None for t in spelt], bool)
        at, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        out[at] = self.add(*self.words.encode([spelt[k] for k in at]))
        if len(rest):
            out[rest] = self.whole([spelt[k] for k in rest])
        return out

    def of_long(self, pieces: list[bytes]) -> np.ndarray:
        known = self.known
        new = [p for p in dict.fromkeys(pieces) if p not in known]
        known.update(zip(new, self.encode(new).tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def entries(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The entry of each piece data[start:end]."""
        out = np.empty(len(start), np.int64)
        size = end - start
        short = size <= SHORT
        everything = bool(short.all())
        a, n = (start, size) if everything else (start[short], size[short])
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        words = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))
        few = np.minimum(n, 8).astype(np.uint64)
        more = (n - few.astype(np.int64)).astype(np.uint64)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        low = words[a] & (full >> ((np.uint64(8) - few) * np.uint64(8)))  # no piece is empty
        ones = (np.uint64(1) << (more * np.uint64(8))) - np.uint64(1)
        high = (words[a + 8] & ones) | (n.astype(np.uint64) << np.uint64(56))
        slot = (mix64(low * np.uint64(0x9E3779B97F4A7C15) + high) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        found = self.which[slot].astype(np.int64)
        missed = np.flatnonzero((self.low[slot] != low) | (self.high[slot] != high))
        if len(missed):  # the neighbouring slot takes what finds its own one taken
            slot, low, high, a, n = slot[missed] ^ 1, low[missed], high[missed], a[missed], n[missed]
            there = (self.low[slot] == low) & (self.high[slot] == high)
            found[missed[there]] = self.which[slot[there]]
            new = np.flatnonzero(~there)
            order = new[np.lexsort((high[new], low[new]))]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
            one = order[fresh]
            entry = self.encode([data[x : x + m].tobytes() for x, m in zip(a[one].tolist(), n[one].tolist(), strict=True)])
            found[missed[order]] = entry[np.cumsum(fresh) - 1]
            own = slot[one] ^ 1
            own = np.where(self.high[own] == 0, own, slot[one])
            self.low[own], self.high[own], self.which[own] = low[one], high[one], entry
        if everything:
            return found
        out[short] = found
        long = np.flatnonzero(~short)
        out[long] = self.of_long([data[x:y].tobytes() for x, y in zip(start[long].tolist(), end[long].tolist(), strict=True)])
        return out

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries, one after the other, and the running count of ids before each and after the last."""
        length = self.length[entries]
        ends = np.concatenate([[0], np.cumsum(length)])
        return self.pool[np.arange(ends[-1]) + np.repeat(self.offset[entries] - ends[:-1], length)], ends

    def room(self) -> None:
        """Forget everything if there is too much of it; entries given out before then mean nothing any more."""
        if self.count > self.most or len(self.known) > self.most // 10:
            self.clear()


TABLES: dict[tuple[int, str], PieceTable] = {}


def table_for(spec: str, plain: str) -> PieceTable:
    """A worker's table for a tokenizer: tasks that follow each other in a worker find what those before them learnt."""
    key = (hash(spec), plain)
    if key not in TABLES:
        TABLES.clear()
        TABLES[key] = PieceTable(spec, plain)
    return TABLES[key]


def special_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The texts that may hold the name of a special token: those with "<|"."""
    at = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
    return np.unique(np.searchsorted(offsets, at, "right") - 1)
