"""Token counts, Merkle manifests and whitening against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import merkle, pieces, token_counts, whitening

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, idx long, n_tokens long, hash string"


def table(spark, rows, parts=3):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, s, None if t is None else len(t), "k", 5, -1, "h") for i, t, s in rows], SCHEMA).repartition(parts)


WORDS = ["the", "Zebra", "it's", "DON'T", "foo.bar", "naïve", "ﬁre", "K", "İstanbul", "日本語", "x1y2", "...", "<|endoftext|>", "<|startoftext|>a", "á", "́b", "≮", "😀", "\x1c", " ", "a b", "'s", "'ll", "it's", "internationalization", "antidisestablishmentarianism" * 9, "_", "--", "#tag", "@me", "a--b", "½", "٣", "ß", "ǅ"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) + rng.choice([" ", " ", "\n", "\t", "  ", "", ","]) for _ in range(rng.choice([1, 3, 20, 200]))) for _ in range(n)]


def test_token_counts_agree_with_the_library(spark):
    rows = [(k, t, "s") for k, t in enumerate(texts(150, 1))]
    rows += [(900, None, "s"), (901, "", None), (902, " \n ", "s"), (None, "no id", "s"), (None, "no id", "s"), (903, "word " * 2049, "s"), (904, "word " * 2048, "s"), (905, "Some longer words, " * 60_000, "s"), (906, "ab" * 200_000, "s")]
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    want = sorted(((-1 if i is None else i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, _ in rows)
    for parts in (1, 5):
        got = token_counts.token_counts(table(spark, rows, parts), PATH)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == want
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_proven_strings_are_single_tokens_and_only_they_match():
    spec = pieces.load(PATH)
    strings = token_counts.whole_tokens(spec)
    library = pieces.tokenizer(spec)
    assert len(strings) > 20_000 and all(len(e.ids) == 1 for e in library.encode_batch_fast([s.decode() for s in strings], add_special_tokens=False))
    proven = token_counts.ProvenTokens(strings)
    others = [b"q" * k for k in range(1, 40)] + ["日".encode() * 3, b"thx", b"zebr", b"\x00", strings[7] + b"\x00"]
    every = list(strings) + others
    ends = np.cumsum([len(s) for s in every])
    starts = ends - [len(s) for s in every]
    assert proven.match(np.frombuffer(b"".join(every), np.uint8), starts, ends).tolist() == [s in set(strings) for s in every]


def test_only_unproven_pieces_are_merged(monkeypatch):
    spec = pieces.load(PATH)
    merged = []
    monkeypatch.setattr(pieces.PieceTable, "encode", lambda self, some, f=pieces.PieceTable.encode: (merged.extend(some), f(self, some))[1])
    n_bytes, n_tokens = token_counts.count(token_counts.ProvenTokens(token_counts.whole_tokens(spec)), pieces.PieceTable(spec, token_counts.PLAIN), pa.array(["The house, the qzxwv house", "of the qzxwv"]))
    assert merged == [b"qzxwv"] and n_bytes.tolist() == [26, 12] and n_tokens[0] - n_tokens[1] == 3


def hexed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """Plain lists: (doc_id, leaf, subroot, root, proof, folded root, verified) of every row."""

    def leaf(i, t, s):
        values = (i, s, "en" if (i or 0) % 2 else None, None if t is None else len(t), t)
        return hexed(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    def tree(hashes):
        paths, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
        while len(level) > 1:
            for k in range(len(hashes)):
                low = at[k] // 3 * 3
                paths[k].append((level[low : at[k]], level[at[k] + 1 : low + 3]))
                at[k] //= 3
            level = [hexed(*level[k : k + 3]) for k in range(0, len(level), 3)]
        return level[0], paths

    groups = {}
    for i, t, s in rows:
        groups.setdefault(s, []).append((i is not None, i or 0, leaf(i, t, s), i, t))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: tree([r[2] for r in sorted(groups[s], key=lambda r: r[:3])]) for s in order}
    root, upper = tree([made[s][0] for s in order])
    out = []
    for s, above in zip(order, upper, strict=True):
        for (_, _, h, i, t), path in zip(sorted(groups[s], key=lambda r: r[:3]), made[s][1], strict=True):
            now = h
            if i is not None and t is not None and zlib.crc32(str(i).encode()) % 2 == 0:
                values = (i, s, "en" if i % 2 else None, len(t), t.replace("\n", ""))
                now = hexed(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])
            for left, right in path + above:
                now = hexed(*left, now, *right)
            out.append((i, h, made[s][0], root, hexed(*[x for left, right in path + above for x in left + right]), now, now == root))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


MANIFESTS = [
    [(1, "only", "a")],
    [(k, f"text\n{k}" * (k % 4), f"s{k % 5}" if k % 7 else None) for k in range(60)] + [(70, None, "one"), (71, "", "two"), (None, "no id\n", "s1"), (None, "other", "s1"), (3, "same id", "s3"), (3, "same id", "s3"), (3, "same id", "s3"), (80, "é" * 3000 + "\n", "ü"), (81, "x" * 300_000, "z"), (82, "null?", ""), (83, "a\nb", "-")],
    [(k, f"a\n{k}", "hot") for k in range(28)] + [(k + 100, "b", f"many {k}") for k in range(28)],
]


@pytest.mark.parametrize("which", range(len(MANIFESTS)))
def test_manifest_agrees_with_plain_lists_and_sql(spark, which):
    rows = MANIFESTS[which]
    want = sorted(brute_manifest(rows), key=key)
    docs = table(spark, rows)
    got = merkle.verified(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=key) == want
    documents = docs.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"})
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pandas(documents))
    assert sorted(con.execute(merkle.oracle()).fetchall(), key=key) == want
    changed = {r[0] for r in want if not r[-1]}
    assert changed == {i for i, t, _ in rows if i is not None and t and "\n" in t and zlib.crc32(str(i).encode()) % 2 == 0}


def test_manifest_of_parts_and_of_nothing(spark):
    rows = MANIFESTS[1]
    one, two = merkle.manifest(table(spark, rows, 1)), merkle.manifest(table(spark, rows, 7))
    assert one.root == two.root
    assert {(r.source, r.subroot) for r in one.subroots.collect()} == {(r.source, r.subroot) for r in two.subroots.collect()}
    assert {r.source for r in one.subroots.collect()} == {s for _, _, s in rows}
    assert merkle.manifest(table(spark, rows[:-1], 2)).root != one.root
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(none).root is None and merkle.verified(none).count() == 0


VECTORS = "vec_id long, embedding array<float>, n long, component int"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(k, v, 1, 2) for k, v in enumerate(rows)], VECTORS).repartition(parts)


def whitened(spark, rows, parts=3, components=32):
    out = {}
    for r in whitening.whitened(vectors(spark, rows, parts), components).collect():
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


def test_whitening_agrees_with_numpy(spark):
    rng = np.random.default_rng(5)
    base = (rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40)) + 1000).astype(np.float32)
    rows = base.tolist() + [None, [], [1.0] * 39, [float("nan")] + [0.0] * 39, [float("inf")] + [0.0] * 39, [None] + [0.0] * 39] + base[:20].tolist()
    good = [k for k, v in enumerate(rows) if k < 300 or k >= 306]
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in rows[k]] for k in good], dtype=object)
    n, sums = len(good), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    centred = (n * x - sums).astype(float) / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    for parts in (1, 4, 30):
        got = whitened(spark, rows, parts)
        assert sorted(got) == good
        for c in (1, 2, 17, 32):
            mine = np.array([got[k][c].whitened for k in good])
            real = centred @ axes[:, c - 1] / np.sqrt(values[c - 1])
            assert np.allclose(mine * np.sign(mine[0] * real[0]), real, atol=1e-8)
            assert np.isclose(got[0][c].explained, values[c - 1] / np.trace(cov), rtol=1e-9)
        assert all(set(r) == set(range(1, 33)) for r in got.values())
        assert [got[k][1].deviation for k in good] == deviation.tolist()
        assert {(r.n, r.identity_error < 1e-9) for one in got.values() for r in one.values()} == {(n, True)}


def test_whitening_without_variance_and_with_huge_numbers(spark):
    flat = whitened(spark, [[1.0, 2.0, 3.0]] * 5)
    assert len(flat) == 5 and all((r.whitened, r.explained, r.deviation, r.identity_error) == (None, 0.0, 0, None) for one in flat.values() for r in one.values())
    follows = whitened(spark, [[float(k), 2.0 * k, 5.0] for k in range(9)])
    assert follows[0][1].whitened is not None and follows[0][2].whitened is None and abs(follows[0][1].explained - 1) < 1e-12 and follows[0][1].identity_error < 1e-12
    huge = whitened(spark, [[1e30, 0.0], [0.0, 1.0], [-1e30, 3.0], [2.0, 5.0]])
    assert all(one[1].deviation is None for k, one in huge.items() if k in (0, 2)) and huge[0][1].identity_error < 1e-9
    only = whitened(spark, [[0.5, 0.25]])
    assert only[0][1].n == 1 and only[0][1].whitened is None
    assert whitened(spark, []) == {} and whitened(spark, [None, []]) == {}
    none = whitening.whitened(spark.createDataFrame([], VECTORS))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_merging_moments_is_exact_far_from_zero():
    rng = np.random.default_rng(2)
    rows = rng.integers(-50, 50, (1000, 6)) + 10**12
    parts = [whitening.moments_of(rows[a:b]) for a, b in ((0, 1), (1, 400), (400, 1000))]
    n, sums, scatter = whitening.merge(whitening.merge(None, parts[2]), whitening.merge(parts[0], parts[1]))
    near = (rows - 10**12).astype(float)
    assert n == 1000 and sums == rows.sum(axis=0).tolist()
    assert np.allclose(scatter, (near - near.mean(axis=0)).T @ (near - near.mean(axis=0)), rtol=1e-8, atol=1e-3)
