"""The pipeline's stages against the operators they call, and its rows against a plain recomputation."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from tallyloom.llm import mixing, quality
from tallyloom.llm.common import documents, labels
from tests.llm import test_operators as brute

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = documents(spark, DATA)
    names, docs_columns, seen = [n for n, _ in P.STAGES], docs.columns, {}
    assert len(names) == 5
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, DATA)
        assert out.columns == docs_columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.count()
    assert 0 < seen["n-gram Jaccard join"] <= seen["line dedup"] == seen["quality rules"] < documents(spark, DATA).count()
    mixed = docs.toPandas()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for i, t in zip(mixed.doc_id, mixed.text, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in P.STAGES[-1][1](spark, docs, DATA).collect()]
    assert sorted(got) == sorted(expected)
    ran = [(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in P.run(spark, DATA).collect()]
    assert sorted(ran) == sorted(expected)


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, dropped array<long>, its_id long, its_mark long, row string, rid long, score double, kept boolean, n_words long, its_row string, mark long, passes int, lines string"


def odd_documents(spark, clean):
    more = [clean[0], clean[0], (None, None), (None, ""), (7001, " \n "), (7002, None), (None, clean[1][1]), (7003, clean[2][1] + "\n" + clean[3][1]), (7004, ("a long line of words\n" * 20 + clean[4][1] + "\n") * 3000)]
    rows = [(i, t, "en", f"s{(i or 0) % 3}" if (i or 0) % 5 else None, None, [5], 6, 7, "r", 8, 5.5, True, 9, "q", 10, 11, "l") for i, t in clean + more]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


def test_stages_take_odd_rows_and_clashing_columns(spark):
    clean = [(r["doc_id"], r["text"]) for r in documents(spark, DATA).where("n_chars < 6000").collect()]
    docs = odd_documents(spark, clean)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        got = out.drop("doc_id", "text", "lang", "source", "n_chars").distinct().collect()
        assert [tuple(r) for r in got] == [([5], 6, 7, "r", 8, 5.5, True, 9, "q", 10, 11, "l")], name
    assert P.STAGES[-1][1](spark, docs, DATA).count() == docs.count()


def test_stages_of_empty_tables(spark):
    docs = spark.createDataFrame([], EXTRA)
    for _, stage in P.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def rows_of(df):
    return Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect())


def test_the_first_four_stages_by_plain_loops(spark, tmp_path, monkeypatch):
    """Each stage worked out anew from what the one before has written."""
    quality_rules, line_dedup, near_copies, mix = (f for _, f in P.STAGES[:-1])

    def written(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    docs = written(documents(spark, DATA).where("n_chars < 2500").repartition(3), "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    hashes, raw, target = quality.WordHash(), np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    trusted = {r["doc_id"] for r in labels(spark, DATA).where("quality = 1").collect()}
    buckets = [quality.buckets_of(r[1] or "", hashes) for r in rows]
    for r, at in zip(rows, buckets, strict=True):
        np.add.at(raw, at, 1)
        if r[0] in trusted:
            np.add.at(target, at, 1)
    p = lambda c: np.log((c + quality.SMOOTH) / (c.sum() + quality.SMOOTH * quality.BUCKETS))
    ratio, good = p(target) - p(raw), Counter()
    for r, at in zip(rows, buckets, strict=True):
        n, _, _, _, repeated = brute.brute_base(r[1])
        if n >= 20 and 100 * repeated <= 30 * n and (ratio[at].mean() if len(at) else 0.0) >= quality.THRESHOLD:
            good[r] += 1
    kept = written(quality_rules(spark, docs, DATA), "good")
    assert 20 < sum(good.values()) < len(rows) and rows_of(kept) == good

    gone = brute.brute_lines([(r[0], r[1]) for r in good])
    texts = {r: "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone[r[0]]) for r in good}
    fewer = Counter((r[0], t, r[2], r[3], len(t)) for r, t in texts.items())
    kept = written(line_dedup(spark, kept, DATA), "lines")
    assert any(gone.values()) and rows_of(kept) == fewer

    groups, n_groups = brute.brute_links([(r[0], r[1], None) for r in fewer])
    firsts = {group for _, group, _, _ in groups}
    kept = written(near_copies(spark, kept, DATA), "copies")
    assert len(firsts) == n_groups < len(fewer) and rows_of(kept) == Counter(r for r in fewer if r[0] in firsts)

    tree, seen = mixing.split_tree, {}
    monkeypatch.setattr(mixing, "split_tree", lambda *a: seen.setdefault("quotas", tree(*a)))
    mixed = rows_of(written(mix(spark, kept, DATA), "mix"))
    sized = kept.select("doc_id", "source", mixing.word_count().alias("size"), mixing.row_hash(kept).alias("its_hash"), F.lit(0).cast("long").alias("nth"))
    own = [(r["doc_id"], r["source"], r["size"], r["mark"]) for r in sized.withColumn("mark", mixing.mark_of(mixing.SEED)).collect()]
    assert all(mixing.block_count(n) == max(1, n // mixing.LEAST_WORDS) for n in Counter({s: sum(x[2] for x in own if x[1] == s) for s in {x[1] for x in own}}).values())
    shards, _ = brute.plain_mix(own, mixing.LEAST_WORDS, seen["quotas"])
    times = {x[0]: len(shards[x]) for x in own}
    assert mixed == Counter({r: times[r[0]] for r in rows_of(kept) if times[r[0]]})
