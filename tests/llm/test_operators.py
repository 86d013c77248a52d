"""Corpus operators against brute force on small tables, with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import bpe, fingerprint, licenses, line_dedup, maxent_lm, mixing, ngram_join, pieces, quality, queries, tokenstore, toxicity

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, key string, size long, score double, word string"
WORDS = [f"w{k}" for k in range(60)]
BLANK = re.compile(rb"[^\x20\x09-\x0D]+")


def table(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, None, 7, "k", -1, 0.5, "w") for i, t, s in rows], SCHEMA).repartition(3)


def texts(seed, n=60):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.4:
            words = (rng.choice(out) or "").split(" ")
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            out.append(" ".join(words))
        else:
            out.append(" ".join(rng.choice(WORDS) + rng.choice(["", "", ",", ".\n"]) for _ in range(rng.choice([1, 4, 30, 80, 300]))))
    return out


EDGE = [(1000, None, "a"), (1001, "", None), (1002, " \n\t ", "a"), (1003, "x" * 5000, "b"), (None, "no id here", "b"), (1004, "é 日本語 😀 \x1c z", None), (1005, "<|endoftext|> and <|startoftext|> a  b", "b")]


@pytest.fixture(scope="module")
def rows():
    made = [(i, t, f"s{i % 4}" if i % 9 else None) for i, t in enumerate(texts(3))]
    return made + EDGE + [made[5], made[5], (7, "another text of an id that stands twice", "s1")]


def test_empty_tables(spark):
    none = table(spark, []).limit(0) if False else spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    for out in (
        toxicity.toxicity(none, labels),
        licenses.scan(none),
        tokenstore.store_and_index(none, path),
        ngram_join.near_duplicates(none),
        ngram_join.one_of_each(none),
        quality.quality(none, labels),
        bpe.encode_decode(none, path),
        maxent_lm.score(none),
        line_dedup.line_marks(none),
        line_dedup.deduplicate(none),
        mixing.taken(none),
        mixing.mixture(none),
        fingerprint.edited_fingerprints(none),
        fingerprint.fingerprints(none),
    ):
        assert out.count() == 0


def test_toxicity_learns_and_keeps_held_out_rows_apart(spark):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(900):
        words = [rng.choice(WORDS) for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            words[rng.randrange(40)] = rng.choice(["vile", "viler", "vilest"])
        rows.append((i, " ".join(words), "s"))
        marks.append((i, 1, int(bad)))
    docs = table(spark, rows + EDGE)
    out = toxicity.toxicity(docs, spark.createDataFrame([*marks, (1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")).toPandas()
    assert len(out) == len(rows) + len(EDGE) and out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()
    held = out[out.held_out & (out.doc_id < 900)]
    assert all(zlib.crc32(str(int(i)).encode()) % 4 == 2 for i in held.doc_id)
    truth = (held.doc_id % 5 == 0).astype(int)
    assert (held.predicted == truth).mean() > 0.95
    assert out[out.doc_id.isin([1000, 1001])].score.nunique() == 1


def test_toxicity_counts_only_shards_that_trained(spark, monkeypatch):
    """Labels of both kinds in one shard: its weights stand as they are.  Repeated rows of an id count once."""
    rng = random.Random(8)
    order = {r["i"]: r["o"] for r in spark.range(4000).selectExpr("id as i", f"pmod(xxhash64(id), {toxicity.SHARDS}) as o").collect()}
    free = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 4 != 2]
    mixed, alone = [i for i in free if order[i] == 0][:300], [i for i in free if order[i] == 1][:200]
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(30)) + (" vile" if i in mixed and k % 3 == 0 else ""), "s") for k, i in enumerate(mixed + alone)]
    marks = [(i, 1, int(t.endswith("vile"))) for i, t, _ in rows]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = toxicity.train(table(spark, rows + rows[:50] * 3), labels)
    weights = dict(zip(found["at"].tolist(), found["weight"].tolist(), strict=True))
    mine = [(i, t, y) for (i, t, _), (_, _, y) in zip(rows, marks, strict=True) if i in set(mixed)]
    mine = [sorted(mine)[k] for k in np.random.default_rng(0).permutation(len(mine))]
    at, w = toxicity.ftrl([t for _, t, _ in mine], [y for _, _, y in mine])
    assert weights == {int(a): pytest.approx(x) for a, x in zip(at, w, strict=True)}


def test_ftrl_against_plain_loops():
    rng = random.Random(3)
    made = [" ".join(rng.choice(WORDS) for _ in range(12)) + (" bad" if k % 3 == 0 else "") for k in range(60)]
    truth = [int(k % 3 == 0) for k in range(60)]
    features, z, n = toxicity.Features(), defaultdict(float), defaultdict(float)
    rows = [[*features.of(t).tolist(), toxicity.DIMENSIONS] for t in made]

    def weight(i):
        l1 = 0.0 if i == toxicity.DIMENSIONS else toxicity.L1
        return -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2) if abs(z[i]) > l1 else 0.0

    for _ in range(toxicity.EPOCHS):
        for row, y in zip(rows, truth, strict=True):
            w = {i: weight(i) for i in row}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in row:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
    at, w = toxicity.ftrl(made, truth)
    plain = {i: weight(i) for i in z if weight(i)}
    assert dict(zip(at.tolist(), w.tolist(), strict=True)) == {i: pytest.approx(x) for i, x in plain.items()}


def test_toxicity_without_labels_is_undecided(spark):
    out = toxicity.toxicity(table(spark, EDGE), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["score"] for r in out.collect()} == {0.5}


def test_toxicity_on_held_out_documents(spark):
    out = queries.op1_toxicity(spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    held = out[out.held_out]
    assert held[held.toxic == 1].score.mean() > held[held.toxic == 0].score.mean() + 0.2


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (None, ""),
        ("Nothing here.", ""),
        ("A line.\nReleased under the MIT License.", "MIT"),
        ("LICENSED under the apache license, version 2.0!", "Apache-2.0"),
        ("Licensed under the Apache License, Version 2.0. Released under the MIT License. More.", "Apache-2.0,MIT"),
        (MIT, "MIT"),
        ("It mentions the MIT License in passing.", ""),
        ("This work is licensed under the GNU General Public License, version 3", "GPL-3.0-only"),
    ],
)
def test_licenses(spark, text, found):
    row = licenses.scan(table(spark, [(1, text, "s")])).first()
    assert row["licenses"] == found and row["n_licenses"] == len([x for x in found.split(",") if x])


GPL = "This work is licensed under the GNU General Public License, version 3\nand more text that goes on"


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (f"{MIT}\n\n{GPL}", "GPL-3.0-only,MIT"),
        (f"{GPL}\n \n{MIT}\n\n\nReleased under\nthe MIT License", "GPL-3.0-only,MIT"),
        (f"{GPL}\nReleased under the MIT License\nwords\n\n{MIT}", "GPL-3.0-only,MIT"),
        (f"{GPL}.\n{MIT}\nThis work is licensed\nunder CC BY 4.0", "GPL-3.0-only,MIT"),
    ],
)
def test_licenses_of_both_layouts_in_one_text(spark, text, found):
    assert licenses.scan(table(spark, [(1, text, "s")])).first()["licenses"] == found


def test_licenses_of_both_layouts_match_sql(spark):
    both = [f"{MIT}\n\n{GPL}", f"{GPL}\n\n{MIT}", f"{GPL}.\n{MIT}\nThis work is licensed\nunder CC BY 4.0", f"x\n{GPL}\n", MIT.replace("\n", " "), "permission", "\n\n", "", None]
    names = ["doc_id", "n_cuts", "n_known", "sentence_ids", "licenses", "n_licenses"]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array(range(len(both)), pa.int64()), "text": pa.array(both, pa.string())}))
    theirs = con.execute(f"SELECT {', '.join(names)} FROM ({licenses.oracle()})").fetchall()
    mine = licenses.scan(table(spark, [(i, text, "s") for i, text in enumerate(both)])).select(*names).collect()
    assert sorted(map(tuple, mine)) == sorted(theirs) and dict(zip(names, sorted(theirs)[0], strict=True))["licenses"] == "GPL-3.0-only,MIT"


def test_license_rules_are_ordered(spark):
    sentences = {"a": "software one", "b": "software two"}
    rules = [("BOTH", ["a", "b"]), ("FIRST", ["a"]), ("SECOND", ["b"])]
    scan = lambda t: licenses.scan(table(spark, [(1, t, "s")]), sentences, rules).first()["licenses"]
    assert scan("Software one. Unknown words. Software two.") == "BOTH"
    assert scan("Software two. Software one.") == "FIRST,SECOND"


def test_licenses_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    names = ["doc_id", "n_cuts", "n_known", "sentence_ids", "licenses", "n_licenses"]
    theirs = con.execute(f"SELECT {', '.join(names)} FROM ({licenses.oracle()})").fetchall()
    mine = queries.op2_license_scan(spark, DATA).select(*names).collect()
    assert sorted(map(tuple, mine)) == sorted(theirs)


def test_token_store_round_trip(spark, rows):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = tokenstore.store_and_index(table(spark, rows), public_tokenizers.path("byte_bpe_50k.json")).collect()
    got = sorted(map(tuple, got), key=lambda r: r[1])
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, expected = 0, []
    for i, t, _ in ordered:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected


def test_token_store_lookup_is_pushed_down(spark, rows, tmp_path):
    tokenstore.write(table(spark, rows), f"{tmp_path}/ids", public_tokenizers.path("byte_bpe_50k.json"))
    found = tokenstore.lookup(spark, f"{tmp_path}/ids", [3, 4])
    assert {r["doc_id"] for r in found.collect()} == {3, 4}
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()


def test_bpe_round_trip(spark, rows):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = Counter(tuple(r)[:4] for r in bpe.encode_decode(table(spark, rows), public_tokenizers.path("word_bpe_49k.json")).collect())
    expected = Counter()
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())] += 1
    assert got == expected


def test_chunks_are_reused_and_cut_by_content():
    coder = bpe.ChunkCoder(pieces.load(public_tokenizers.path("word_bpe_49k.json")))
    passage = " ".join(f"passage{k * k}" for k in range(200))
    alone = coder.encode(pa.array([passage]))[0].tolist()
    coder.encode(pa.array(["other words first " + passage]))
    assert coder.reused > 0.5 * len(bpe.chunk_spans(*pieces.text_bytes(pa.array([passage])))[0])
    assert coder.encode(pa.array([passage]))[0].tolist() == alone


def test_texts_of_like_chunks_meet(spark):
    passage = " ".join(f"passage{k * k}" for k in range(300))
    rows = [(i, f"start {i} {passage} end {i}" if i % 2 else " ".join(f"word{i}x{k}" for k in range(200)), "s") for i in range(60)]
    parts = bpe.by_chunks(table(spark, rows)).select("doc_id", F.spark_partition_id().alias("p")).collect()
    assert len({r["p"] for r in parts if r["doc_id"] % 2}) <= 2 and len(parts) == 60


ODD = [*"ab1'.,! \n\t  éÉßİΣσς×÷ \u0085\u3000 \u0301\u20dd<|>_-日本語ᾼ\x1c\x00\x0bsStTdDAB  ", "'s", "'LL", " 're", "<|endoftext|>", "<|STARTOFTEXT|>", "\r\n", "...", " the long words of a passage that comes again and again in texts, so that chunks are met twice. "]


def odd_texts(n):
    rng = random.Random(3)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_pieces_agree_with_the_library_on_odd_texts():
    made = odd_texts(8000) + ["long " * 400_000 + "x" * 300_000]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        spec = pieces.load(public_tokenizers.path(name))
        library = pieces.tokenizer(spec)
        coder, speller = bpe.ChunkCoder(spec), bpe.Speller(spec)
        for at in range(0, len(made), 500):
            part = made[at : at + 500]
            expected = [e.ids for e in library.encode_batch_fast(part, add_special_tokens=False)]
            if name.startswith("byte"):
                flat, ends = tokenstore.encode(pieces.table_for(spec, tokenstore.PLAIN), pa.array(part))
            else:
                flat, ends = coder.encode(pa.array(part))
            assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == expected
            assert [x.decode() for x in speller.spell(flat, ends)] == [library.decode(x, skip_special_tokens=False) for x in expected]


def test_piece_table_forgets_and_stays_right(monkeypatch):
    spec = pieces.load(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(pieces, "SLOT_BITS", 3)
    small, made = pieces.PieceTable(spec, tokenstore.PLAIN, most=50), odd_texts(400)
    library = pieces.tokenizer(spec)
    for at in range(0, len(made), 20):
        flat, ends = tokenstore.encode(small, pa.array(made[at : at + 20]))
        assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [e.ids for e in library.encode_batch(made[at : at + 20], add_special_tokens=False)]


def brute_links(rows):
    words = [tuple((t or "").lower().encode("utf-8", "surrogatepass").split()) for _, t, _ in rows]
    classes = sorted(set(words))
    sets = {w: {w[k : k + 5] for k in range(max(1, len(w) - 4))} if w else set() for w in classes}
    links, parent = Counter(), {w: w for w in classes}

    def root(w):
        while parent[w] != w:
            w = parent[w]
        return w

    for a in range(len(classes)):
        for b in range(a):
            x, y = sets[classes[a]], sets[classes[b]]
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                links[classes[a]] += 1
                links[classes[b]] += 1
                parent[root(classes[a])] = root(classes[b])
    groups = defaultdict(list)
    for (i, _, _), w in zip(rows, words, strict=True):
        groups[root(w)].append(i)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    copies = defaultdict(list)
    for (i, _, _), w in zip(rows, words, strict=True):
        copies[w].append(i)
    return Counter((i, least(groups[root(w)]), links[w], least(copies[w])) for (i, _, _), w in zip(rows, words, strict=True)), len(groups)


@pytest.mark.parametrize("block", [1024, 4])
def test_ngram_join(spark, rows, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    docs = table(spark, rows)
    expected, n_groups = brute_links(rows)
    assert Counter(map(tuple, ngram_join.near_duplicates(docs).collect())) == expected
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == n_groups
    assert {(r["rid"], r["key"], r["size"], r["score"]) for r in kept.collect()} == {(7, "k", -1, 0.5)}


def test_bayesian_rules_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**31, (400, ngram_join.HASHES)).astype(np.int32)
    b = np.where(rng.random(a.shape) < 0.8, a, -1).astype(np.int32)
    i, j = ngram_join.surviving_pairs(a, b, ngram_join.least_matches())
    assert {(k, k) for k in range(400)} <= set(zip(i.tolist(), j.tolist(), strict=True)) and len(i) == 400


def test_intersections_agree():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, 120).astype(np.uint64)) for _ in range(40)]
    i, j = np.triu_indices(40, 1)
    assert ngram_join.intersections(sets, i, j).tolist() == [len(set(sets[a]) & set(sets[b])) for a, b in zip(i, j, strict=True)]


def brute_base(text):
    words = BLANK.findall((text or "").encode("utf-8", "surrogatepass"))
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if BLANK.search(line.encode("utf-8", "surrogatepass")):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {k + d for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for d in range(8)}
    chars = sum(len(w.decode("utf-8", "surrogatepass")) for w in words)
    return len(words), chars, sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_counts_and_scores(spark, rows):
    more = [(2000, "a b c d e f g h i j " * 6, "s"), (2001, "one\none\n two\none", "s"), (2002, "x* y# | <z> " * 10, "s")]
    docs = table(spark, rows + more)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    out = quality.quality(docs, labels).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out) == Counter((i, *brute_base(t)) for i, t, _ in rows + more)
    hashes = quality.WordHash()
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, t, _ in rows + more:
        at = quality.buckets_of(t or "", hashes)
        np.add.at(raw, at, 1)
        if i is not None and i < 60 and i % 3 > 0:
            np.add.at(target, at, 1)
    p = lambda c: np.log((c + quality.SMOOTH) / (c.sum() + quality.SMOOTH * quality.BUCKETS))
    ratio = p(target) - p(raw)
    for r in out:
        at = quality.buckets_of(r["text"] or "", hashes)
        expected = ratio[at].mean() if len(at) else 0.0
        assert r["score"] == pytest.approx(expected)
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)
    assert set(docs.columns) - {"score"} <= set(out[0].asDict())


def test_quality_keeps_clean_documents(spark):
    out = queries.op5_quality_rules(spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    out = out[~out.base_failed]
    assert out[out.quality == 1].kept.mean() > 0.99
    assert out[out.quality == 0].kept.mean() < 0.2


def lm_tokens(text):
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


def lm_held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


@pytest.mark.parametrize("most", [20, 100_000])
def test_lm_base_scores(spark, rows, monkeypatch, most):
    monkeypatch.setattr(maxent_lm, "MOST_FREQUENT", most)
    got = maxent_lm.score(table(spark, rows)).collect()
    tally = Counter()
    for i, t, _ in rows:
        if not lm_held(i):
            tally.update(lm_tokens(t))
    total, distinct = sum(tally.values()), len(tally)
    expected = Counter()
    for i, t, _ in rows:
        tokens = lm_tokens(t)
        base = sum(math.log10((tally[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        expected[(i, lm_held(i), len(tokens), sum(tally[w] > 0 for w in tokens), total, round(base, 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == expected
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def brute_lm(texts, shares, common, rare):
    """Classes, weights and a plain probability function, from nested loops over words and outcomes."""
    words, tally = [w for w, _ in common], dict(rare)
    group = {w: int(g) for w, g in zip(tally, maxent_lm.groups_of(maxent_lm.word_hashes(list(tally))), strict=True)}
    tokens, members = np.zeros(256), np.zeros(256)
    for w, n in rare:
        tokens[group[w]] += n
        members[group[w]] += 1
    classes = maxent_lm.Classes(common, tokens, members)
    index = {w: k for k, w in enumerate(words)}
    weights = defaultdict(lambda: np.zeros(16))

    def path(word):
        k = index.get(word, len(words))
        out = [(int(classes.node[level, k]), int(classes.outcome[level, k])) for level in range(classes.depth[k])]
        if k == len(words):
            g = int(maxent_lm.groups_of(maxent_lm.word_hashes([word]))[0])
            out[-2:] = [(classes.rest_node, g // 16), (classes.rest_node + 1 + g // 16, g % 16)]
        return out

    def features(node, near, skip):
        mask = (1 << 64) - 1
        h = lambda w: 0 if w is None else int(maxent_lm.word_hashes([w])[0])
        mark = int(classes.mark[node])
        return ("row", ((h(near) ^ mark) * int(maxent_lm.ODD) & mask) >> 48), ("row", (((h(skip) + int(maxent_lm.ODD) & mask) ^ mark) * 0xC2B2AE3D27D4EB4F & mask) >> 48)

    def softmax(node, near, skip):
        z = np.exp(classes.bias[node] + sum(weights[f] for f in features(node, near, skip)))
        return z / z.sum()

    def contexts(text):
        t = lm_tokens(text)
        return [(w, t[k - 1] if k else None, t[k - 2] if k > 1 else None) for k, w in enumerate(t)]

    for share in range(maxent_lm.ROUNDS):
        seen, hoped = defaultdict(lambda: np.zeros(16)), defaultdict(lambda: np.zeros(16))
        for text, s in zip(texts, shares, strict=True):
            for w, near, skip in contexts(text) if s == share else []:
                for node, c in path(w):
                    p = softmax(node, near, skip)
                    for f in features(node, near, skip):
                        seen[f][c] += 1
                        hoped[f] += p
        for f, h in hoped.items():
            weights[f] = weights[f] + np.log1p((seen[f] - h) / (h + maxent_lm.PRIOR)) / 2

    def log10_of(word, near, skip):
        out = sum(math.log10(softmax(node, near, skip)[c]) for node, c in path(word))
        if word not in index:
            g = int(maxent_lm.groups_of(maxent_lm.word_hashes([word]))[0])
            out += math.log10((tally.get(word, 0) + 0.1) / classes.total[g])
        return out

    return lambda text: sum(log10_of(*x) for x in contexts(text)), log10_of, classes


def test_lm_scores_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "MOST_FREQUENT", 30)
    made = [(i, t, "s") for i, t in enumerate(texts(8, 25))] + [(900, None, "s"), (901, "", "s"), (None, "some words w1 w2 w3", "s")]
    docs = table(spark, made)
    shares = {t: s for t, s in docs.select(F.coalesce("text", F.lit("")), F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(maxent_lm.ROUNDS))).collect()}
    train = [t or "" for i, t, _ in made if not lm_held(i)]
    tally = Counter(w for t in train for w in lm_tokens(t))
    by_count = Counter(tally.values())
    total, least = 0, None
    for n in sorted(by_count, reverse=True):
        total += by_count[n]
        if total > 30:
            break
        least = n
    common = sorted(((w, n) for w, n in tally.items() if least and n >= least), key=lambda x: (-x[1], x[0]))
    rare = [(w, n) for w, n in tally.items() if not least or n < least]
    score, log10_of, _ = brute_lm(train, [shares[t] for t in train], common, rare)
    got = sorted((r["doc_id"] or -1, r["score"]) for r in maxent_lm.score(docs).collect())
    assert got == [(i, pytest.approx(x, rel=2e-3)) for i, x in sorted((i or -1, score(t or "")) for i, t, _ in made)]
    # all words and an unseen one of each group share the whole probability
    for near, skip in ((None, None), (b"w1", None), (b"w2", b"w1"), (b"never", b"seen")):
        known = sum(10 ** log10_of(w, near, skip) for w in tally)
        assert known < 1
    others = [maxent_lm.score(docs.repartition(n)).select("doc_id", "score").collect() for n in (1, 5)]
    first, second = (sorted((r["doc_id"] or -1, round(r["score"], 6)) for r in o) for o in others)
    assert first == second


def test_lm_probabilities_add_up_to_one():
    rng = np.random.default_rng(1)
    common = sorted(((f"c{k}".encode(), int(10_000 / (k + 1)) + 3) for k in range(700)), key=lambda x: (-x[1], x[0])) + [(b"", 2)]
    rare = [f"r{k}".encode() for k in range(2000)]
    tokens, members = np.zeros(256), np.zeros(256)
    g = maxent_lm.groups_of(maxent_lm.word_hashes(rare))
    np.add.at(tokens, g, 1)
    np.add.at(members, g, 1)
    classes = maxent_lm.Classes(common, tokens, members)
    weights = rng.normal(0, 1, (1 << maxent_lm.ROW_BITS, 16)).astype(np.float32)
    words = [w for w, _ in common] + rare
    t = maxent_lm.Tokens(pa.array(["x"]))
    t.hash = maxent_lm.word_hashes(words)
    t.near, t.skip = np.full(len(words), 77, np.uint64), np.full(len(words), 99, np.uint64)
    found = classes.find(t.hash)
    assert found.tolist() == [*range(len(common)), *[len(common)] * len(rare)]
    p = 10 ** maxent_lm.log_probabilities(maxent_lm.Scores(classes, weights), t, found)
    p[len(common) :] *= 1.1
    # what the groups keep for unseen words, a word each
    unseen_hash, left = {}, 0.0
    k = 0
    while len(unseen_hash) < 256:
        w = f"unseen{k}".encode()
        unseen_hash.setdefault(int(maxent_lm.groups_of(maxent_lm.word_hashes([w]))[0]), w)
        k += 1
    t.hash = maxent_lm.word_hashes(list(unseen_hash.values()))
    t.near, t.skip = np.full(256, 77, np.uint64), np.full(256, 99, np.uint64)
    left = (10 ** maxent_lm.log_probabilities(maxent_lm.Scores(classes, weights), t, classes.find(t.hash)) * 0.1).sum()
    assert p.sum() + left == pytest.approx(1, abs=1e-4)


def test_lm_model_beats_the_unigram_base(spark):
    out = queries.op7_lm_scores(spark, "/root/testdata/sf0.01").toPandas()
    held = out[out.held_out]
    assert held.score.sum() > held.base_score.sum()


def near_lines(x, y):
    if x == y:
        return True
    if min(len(x), len(y)) < line_dedup.EDIT_WORDS or abs(len(x) - len(y)) > 1:
        return False
    p = q = 0
    while p < min(len(x), len(y)) and x[p] == y[p]:
        p += 1
    while q < min(len(x), len(y)) - p and x[-1 - q] == y[-1 - q]:
        q += 1
    return max(len(x), len(y)) - p - q <= 1


def brute_lines(documents):
    lines = [(i is None, i or 0, k, tuple(x.split())) for i, t in documents for k, x in enumerate((t or "").lower().encode("utf-8", "surrogatepass").split(b"\n"))]
    lines = sorted(x for x in lines if len(x[3]) >= line_dedup.MIN_WORDS)
    gone = defaultdict(set)
    for n, (none, i, k, w) in enumerate(lines):
        if any(near_lines(w, v) for _, _, _, v in lines[:n]):
            gone[None if none else i].add(k)
    return gone


def test_line_dedup(spark):
    rng = random.Random(9)
    made = []
    for i in range(120):
        lines = []
        for _ in range(3):
            words = rng.choice(rng.choice(made)[1].split("\n")).split() if made and rng.random() < 0.5 else [rng.choice(WORDS) for _ in range(rng.choice([2, 7, 8, 11, 12, 23, 24, 47, 48, 95, 96]))]
            for _ in range(rng.choice([0, 1, 1, 2])):
                at, what = rng.randrange(len(words)), rng.random()
                if what < 0.4:
                    words[at] = rng.choice(WORDS)
                elif what < 0.7:
                    words.insert(at, rng.choice(WORDS))
                elif len(words) > 1:
                    del words[at]
            lines.append(" ".join(words))
        made.append((i, "\n".join(lines)))
    made += [(500, None), (501, ""), (502, "\n\n"), (None, made[3][1]), made[7], made[7]]
    docs = table(spark, [(i, t, "s") for i, t in made])
    gone = brute_lines(list(dict.fromkeys(made)))
    expected = Counter((i, len(t.split("\n")) if t else 0, ",".join(map(str, sorted(gone[i])))) for i, t in made)
    assert Counter((r["doc_id"], r["n_lines"], r["dropped_lines"]) for r in line_dedup.line_marks(docs).collect()) == expected
    out = line_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    kept = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert kept == Counter((i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])) for i, t in made)


def test_line_dedup_of_short_lines(spark):
    made = [(1, "Contents\nPage 1 of 9\n\nall rights are reserved here"), (2, "contents\nNext page\nPage 2 of 9\n "), (3, "next PAGE\nlast page\nall rights reserved here\nPage 3 of 9"), (4, "a b c\na b d\nof 9\npage of 9")]
    got = {r["doc_id"]: r["dropped_lines"] for r in line_dedup.line_marks(table(spark, [(i, t, "s") for i, t in made])).collect()}
    assert got == {1: "", 2: "0,2", 3: "0,2,3", 4: ""}


def test_lines_within_the_bound_share_a_gap():
    for n in range(line_dedup.EDIT_WORDS, 130):
        own, longer = (set(map(tuple, line_dedup.gaps(k).tolist())) for k in (n, n + 1))
        assert all(any(a <= p and b <= n - 1 - p for a, b in own) for p in range(n))
        assert all(any(a <= p and b <= n - p for a, b in own & longer) for p in range(n + 1))


def test_line_dedup_of_one_word_variants(spark):
    rng = random.Random(10)
    made = []
    for i in range(200):
        words = rng.choice(["page one of the book", "page of the book", "the the of of", "all of the the rights"]).split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(["x", "y", "z", "the", "of"])
        made.append((i, " ".join(words) + rng.choice(["", "\nend", "\nthe end"])))
    gone = brute_lines(made)
    for parts in (1, 7):
        got = {r["doc_id"]: r["dropped_lines"] for r in line_dedup.line_marks(table(spark, [(i, t, "s") for i, t in made]).repartition(parts)).collect()}
        assert got == {i: ",".join(map(str, sorted(gone[i]))) for i, _ in made}


def test_mixing_targets():
    got = mixing.targets({"b": 100, "a": 1000, None: 10})
    assert got[None] == 30 and sum(got.values()) == pytest.approx(1110)
    assert got["b"] == 300 and got["a"] == pytest.approx(780)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def test_splitting_tree_is_exact():
    colors = np.array([100, 7, 0, 2000])
    out = mixing.split_tree(colors, 10, np.random.default_rng(1))
    assert (out.sum(axis=0) == colors).all() and out.min() >= 0
    assert out.sum(axis=1).max() - out.sum(axis=1).min() <= 4


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)] + EDGE
    docs = table(spark, rows)
    got = mixing.taken(docs).toPandas()
    again = mixing.taken(docs.repartition(5)).toPandas()
    order = ["doc_id", "size", "taken"]
    assert got.sort_values(order)[order].reset_index(drop=True).equals(again.sort_values(order)[order].reset_index(drop=True))
    sizes = Counter((i, len(BLANK.findall((t or "").encode()))) for i, t, _ in rows)
    assert Counter((None if pd.isna(i) else int(i), n) for i, n in zip(got.doc_id, got["size"], strict=True)) == sizes
    assert (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    for _, g in got.groupby("source_size"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
    mix = mixing.mixture(docs)
    assert mix.columns == docs.columns
    assert {(r["rid"], r["key"], r["size"], r["score"]) for r in mix.collect()} == {(7, "k", -1, 0.5)}
    assert mix.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0] is not None
    assert mix.count() == sum(len(x.split(",")) for x in got.shards if x)
    assert Counter((r["doc_id"], r["text"]) for r in mix.select("doc_id", "text").collect()).keys() <= {(i, t) for i, t, _ in rows}


def mixing_rows():
    rng = random.Random(6)
    made = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40))), rng.choice("aab")) for i in range(300)]
    made += [(None, " ".join(rng.choice(WORDS) for _ in range(100)), "null ids") for _ in range(300)]
    return made + [(4000, "one text of rows that are equal", "equal")] * 400 + [(5000, " ".join(["long"] * 50_000), "c"), (5001, "", "d")] + EDGE


def test_mixing_meets_targets_with_null_and_repeated_ids(spark):
    got = mixing.taken(table(spark, mixing_rows())).toPandas()
    assert len(got) == len(mixing_rows())
    for _, g in got.groupby(["target", "source_size"]):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() / 2 + 1
    whole = mixing.mixture(table(spark, mixing_rows()))
    words = lambda t: len(BLANK.findall((t or "").encode()))
    sums, named = Counter(), {i: s for i, _, s in mixing_rows()}
    for r in whole.collect():
        sums[r["source"]] += words(r["text"])
    sizes = Counter()
    for _, t, s in mixing_rows():
        sizes[s] += words(t)
    for s, aim in mixing.targets(dict(sizes)).items():
        assert abs(sums[s] - aim) <= max(words(t) for _, t, x in mixing_rows() if x == s) / 2 + 1, (s, named)


def test_mixes_agree_however_rows_are_dealt(spark):
    """Rows equal in id and text differ in other columns; others are equal in all."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(30)), "ab"[i % 2], None) for i in range(80)] + [(500, "one text " * 20, "a", n) for n in [*range(60), *[7] * 30]] + [(None, None, None, 1)] * 3
    kinds = "doc_id long, text string, source string, n_chars long"
    mixes, takes = [], []
    for parts in (1, 3, 5):
        docs = spark.createDataFrame(rows, kinds).repartition(parts)
        mixes.append(Counter(tuple(r) for r in mixing.mixture(docs, shards=8).collect()))
        takes.append(Counter(tuple(r) for r in mixing.taken(docs, shards=8).collect()))
    assert mixes[0] == mixes[1] == mixes[2] and takes[0] == takes[1] == takes[2]
    often = Counter()
    for r, n in takes[0].items():
        often[r[0], r[1]] += n * len([x for x in r[5].split(",") if x])
    assert sum(often.values()) == sum(mixes[0].values())
    for (i, size), n in often.items():
        assert n == sum(m for r, m in mixes[0].items() if r[0] == i and len((r[1] or "").split()) == size)


def test_blocks_follow_the_size_of_their_source():
    assert [mixing.block_count(n) for n in (0, 499, 5_000, 200_000, 2_560_000, 5_120_000, 51_200_000)] == [1, 1, 10, 256, 256, 256, 2_560]


def plain_mix(rows, block_words, quotas):
    """The shards that take each of rows (id, source, size, mark), and the number of draws by source; quotas: by shard and source."""
    sizes, taken, counts = Counter(), defaultdict(list), []
    for _, s, n, _ in rows:
        sizes[s] += n
    aim, rng = mixing.targets(dict(sizes)), np.random.default_rng(mixing.SEED)
    for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        n_blocks = max(1, sizes[s] // block_words)
        turns = [mixing.permutation(n_blocks, rng) for _ in range(3)]
        draws = [sorted((x for x in rows if x[1] == s and (a * ((x[3] >> 16) % n_blocks) + c) % n_blocks == r), key=lambda x: x[3]) for a, c in turns for r in range(n_blocks)]
        need, number, chosen = aim[s], 0, []
        whole = int(min(3, math.floor(aim[s] / sizes[s] + 1e-12))) if sizes[s] else 0
        need -= whole * sizes[s]
        for number, block in enumerate(draws):
            words = sum(x[2] for x in block)
            if number < whole * n_blocks:
                chosen.append(block)
            elif need > 0:
                so_far, part = 0, []
                for x in block:
                    so_far += x[2]
                    if words >= need and so_far - x[2] / 2 > need:
                        break
                    part.append(x)
                chosen.append(part)
                need -= words
        counts.append(len(chosen))
        owner = [shard for shard, q in enumerate(quotas[:, k]) for _ in range(q)]
        for part, shard in zip(chosen, owner, strict=False):
            for x in part:
                taken[x].append(str(shard))
    return taken, counts


@pytest.mark.parametrize("lost", [False, True])
def test_mixing_by_plain_loops_over_the_draws_of_each_shard(spark, monkeypatch, lost):
    """Blocks, permutations, cuts and shards worked out anew; with lost, a shard's quota is taken from the tree."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 300)
    monkeypatch.setattr(mixing, "GROUP", 4)
    tree, seen = mixing.split_tree, {}

    def split(colors, shards, rng):
        out = tree(colors, shards, rng)
        if lost:
            out[shards - 1] = 0
        seen["numbers"], seen["quotas"] = [int(c) for c in colors], out
        return out

    monkeypatch.setattr(mixing, "split_tree", split)
    docs = table(spark, mixing_rows())
    got = Counter((r["doc_id"], r["size"], r["taken"], r["shards"]) for r in mixing.taken(docs, shards=8).collect())
    keyed = docs.select("doc_id", "source", mixing.word_count().alias("size"), mixing.row_hash(docs).alias("its_hash")).groupBy(*mixing.KEY).count()
    numbered = keyed.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    rows = [(r["doc_id"], r["source"], r["size"], r["mark"]) for r in numbered.withColumn("mark", mixing.mark_of(mixing.SEED)).collect()]
    shards, counts = plain_mix(rows, 300, seen["quotas"])
    assert counts == seen["numbers"]
    assert got == Counter((x[0], x[2], x[2] * len(shards[x]), ",".join(shards[x])) for x in rows)


def brute_edits(spark, rows):
    mark = {r["text"]: r["mark"] for r in table(spark, rows).select(F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), mark[r[1] or ""]))
    out = []
    for k, (i, t, _) in enumerate(ordered):
        t, nxt = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        new = (t[: len(t) - half] + nxt[:half]).encode("utf-8", "surrogatepass")
        own = fingerprint.digest(t.encode("utf-8", "surrogatepass"))
        out.append((i, len(t), hashlib.sha256(new).hexdigest(), own, fingerprint.digest(new), round(fingerprint.likeness(own, fingerprint.digest(new)), 9), round(fingerprint.likeness(own, fingerprint.digest(nxt.encode("utf-8", "surrogatepass"))), 9)))
    return out


def brute_digest(text):
    """The digest from plain counts of triplets."""
    counts = [0] * 128
    for k in range(len(text) - 2):
        number = text[k] | text[k + 1] << 8 | text[k + 2] << 16
        counts[(number * 2654435761 & 0xFFFFFFFF) >> 25] += 1
    ranked = sorted(counts)
    q = [ranked[31], ranked[63], ranked[95]]
    bits = [sum(c > x for x in q) for c in counts]
    body = bytes(bits[k] | bits[k + 1] << 2 | bits[k + 2] << 4 | bits[k + 3] << 6 for k in range(0, 128, 4))
    if len(text) < 3:
        body = text.ljust(32, b"\0")
    first, second = (min(15, q[k] * 15 // q[2]) if q[2] else 0 for k in (0, 1))
    return (bytes([min(255, round(8 * math.log2(len(text) + 1))), first << 4 | second]) + body).hex()


def brute_likeness(a, b):
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    total = min(30, 3 * abs(x[0] - y[0]) // 8) + sum(min(16, 2 * abs((x[1] >> s & 15) - (y[1] >> s & 15))) for s in (4, 0))
    cost = {0: 0, 1: 1, 2: 2, 3: 6}
    for p, q in zip(x[2:], y[2:], strict=True):
        total += sum(cost[abs((p >> s & 3) - (q >> s & 3))] for s in (0, 2, 4, 6))
    return max(0.0, 1 - total / (0.3 * (30 + 32 + 6 * 128)))


def test_digests_and_likeness_from_plain_counts():
    rng = random.Random(2)
    made = [b"", b"a", b"ab", b"abc"] + [bytes(rng.randrange(97, 97 + rng.choice([2, 20])) for _ in range(rng.choice([10, 200, 3000]))) for _ in range(40)]
    marks = [fingerprint.digest(x) for x in made]
    assert marks == [brute_digest(x) for x in made]
    assert all(fingerprint.likeness(a, b) == pytest.approx(brute_likeness(a, b)) for a in marks for b in marks)


def test_fingerprints_of_many_rows_without_an_id_or_of_one(spark):
    rng = random.Random(7)
    made = [(rng.choice([None, None, 5, 5, k]), " ".join(rng.choice(WORDS) for _ in range(20)), "s") for k in range(400)]
    docs = table(spark, made)
    dealt = fingerprint.with_next(docs).where("not extra").groupBy("run").count().toPandas()
    assert dealt["count"].max() < 80
    got = fingerprint.edited_fingerprints(docs).collect()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert Counter(tuple(round(r[c], 9) if c.startswith("near") else r[c] for c in names) for r in got) == Counter(brute_edits(spark, made))


def test_fingerprints(spark, rows):
    got = fingerprint.edited_fingerprints(table(spark, rows)).collect()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert Counter(tuple(round(r[c], 9) if c.startswith("near") else r[c] for c in names) for r in got) == Counter(brute_edits(spark, rows))
    one = fingerprint.edited_fingerprints(table(spark, [(1, "abcdef", "s")])).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and one[0]["near_next"] == 1.0


def test_digest_properties():
    rng = random.Random(1)
    a = " ".join(rng.choice(WORDS) for _ in range(400))
    b = a[:-20] + " ".join(rng.choice(WORDS) for _ in range(5))
    c = "".join(chr(rng.randrange(33, 500)) for _ in range(1500))
    near, far = (fingerprint.likeness(fingerprint.digest(a.encode()), fingerprint.digest(x.encode())) for x in (b, c))
    assert near > 0.7 > far and fingerprint.likeness(fingerprint.digest(a.encode()), fingerprint.digest(a.encode())) == 1
    assert fingerprint.difference(fingerprint.digest(b""), fingerprint.digest(c.encode())) <= fingerprint.MOST


def thue_morse(n):
    return ["b" if bin(k).count("1") % 2 else "a" for k in range(n)]


@pytest.mark.parametrize("size", [512, 1024, 2048, 4096])
def test_texts_of_alternating_patterns_are_told_apart(spark, size):
    """Two complementary Thue-Morse sequences have equal sums under every polynomial modulo 2^64."""
    one = thue_morse(size)
    other = ["a" if x == "b" else "b" for x in one]
    # whole words
    docs = [(k, f"x {''.join(w)} y z", "s") for k, w in enumerate((one, other))]
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for r in bpe.encode_decode(table(spark, docs), path).collect():
        ids = library.encode(docs[r.doc_id][1], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
    column = pa.array([t for _, t, _ in docs])
    t = maxent_lm.Tokens(column)
    assert len(set(t.hash.tolist())) == 6  # both long words, x, y, z and the end
    trained = [(k, t, "s") for k, t, _ in docs * 8 for k in [k + 10 * len(docs)]]
    counted = {bytes(r.word): r.n for r in maxent_lm.counts(table(spark, trained).selectExpr("text", "false as held_out")).collect()}
    assert counted == Counter(w.encode() for _, t, _ in trained for w in [*t.split(" "), ""])
    # lines of many words
    lines = [(0, " ".join(one), "s"), (1, " ".join(other), "s"), (2, " ".join([*one[:5], "c", *one[6:]]), "s"), (3, " ".join(other[:9] + other[10:]), "s")]
    for parts in (1, 4):
        kept = {r.doc_id: r.n_kept for r in line_dedup.line_marks(table(spark, lines).repartition(parts)).collect()}
        assert kept == {0: 1, 1: 1, 2: 0, 3: 0}


def test_words_of_equal_hashes_are_counted_by_their_bytes(monkeypatch):
    monkeypatch.setattr(maxent_lm.ByteWords, "of", lambda self, data, start, end: np.full(len(start), 7, np.uint64))
    text = "a b a longer-than-eight longer-than-nine longer-than-eight " + "y" * 300 + " " + "y" * 300 + " " + "y" * 299 + "z"
    t = maxent_lm.Tokens(pa.array([text, "b b"]))
    first, n = t.runs(np.arange(len(t.hash)), t.hash)
    total = Counter()
    for word, k in zip(t.bytes_of(first).to_pylist(), n.tolist(), strict=True):
        total[word] += k
    assert total == Counter([w.encode() for w in f"{text} b b".split(" ")] + [b"", b""])
