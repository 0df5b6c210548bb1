"""Operators 11 to 13 against plain Python: the divergence audit, byte-level BPE, annulus search."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quadloom.llm import annulus, bpe, divergence

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


# the audit


def brute_audit(rows, min_docs, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [[t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)] for _, _, text in rows]
    df, out = defaultdict(Counter), []
    for (lang, _, _), own in zip(rows, terms, strict=True):
        df[lang].update(set(own))
    kept = {lang: sorted(t for t, n in df[lang].items() if n >= min_docs) for lang, _, _ in rows}
    count = defaultdict(Counter)
    for (lang, source, _), own in zip(rows, terms, strict=True):
        for key in ((lang, source), (lang, None)):
            count[key].update(t for t in own if t in set(kept[lang]))
    p = {}
    for lang, source in count:
        whole = sum(count[lang, source].values()) + 2 * len(kept[lang])
        p[lang, source] = {t: 1 + 10**9 * (count[lang, source][t] + 2) // whole for t in kept[lang]}
    for lang, source in [k for k in count if k[1] is not None]:
        mine = p[lang, source]
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = [(sum(f(mine[t], p[lang, o][t]) for t in mine), o) for la, o in count if la == lang and o not in (None, source)]
        over = [(f(mine[t], p[lang, None][t]), t) for t in mine if count[lang, source][t] > 0 and mine[t] > p[lang, None][t]]
        for part, found, cut in (("pair", pairs, None), ("term", over, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, r + 1) for r, (value, item) in enumerate(found[:cut])]
    return sorted(out)


AUDIT = "lang string, source string, text string"


def audited(df, **kw):
    return sorted(tuple(r) for r in divergence.audit(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


def audit_rows(n=160):
    rng = random.Random(3)
    words = ["Alpha", "beta", "GAMMA", "É", "é", "straße", "日本", "x_y", "don't", "a1b2", "№", "z"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    rows = [(rng.choice(["en", "de", None]), rng.choice([f"s{i}" for i in range(7)] + ["S", None]), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(n)]
    rows += [("fr", "only", "un deux"), ("it", "a", None), ("it", "b", ""), ("it", "c", "raro"), ("en", "s1", "beta " * 40_000)]
    return rows + rows[:5]


@pytest.mark.parametrize("chunk,block,band", [(4096, 32, 8), (3, 2, 2)])
def test_audit_equals_brute_force(spark, monkeypatch, chunk, block, band):
    for name, value in (("CHUNK", chunk), ("BLOCK", block), ("BAND", band)):
        monkeypatch.setattr(divergence, name, value)
    rows = audit_rows()
    assert audited(spark.createDataFrame(rows, AUDIT), min_docs=3) == brute_audit(rows, 3)


def test_audit_with_a_hot_source_and_one_partition_or_many(spark):
    rows = audit_rows(60) + [("en", "hot", f"common word{chr(97 + i % 26)} {'rare' * (i % 3)}") for i in range(300)]
    want = brute_audit(rows, 10)
    assert audited(spark.createDataFrame(rows, AUDIT).coalesce(1)) == want
    assert audited(spark.createDataFrame(rows, AUDIT).repartition(11)) == want


def test_audit_of_no_kept_terms_and_of_an_empty_table(spark):
    df = spark.createDataFrame([("it", "a", None), ("it", "b", ""), ("it", "c", "raro")], AUDIT).withColumn("term", F.lit("own")).withColumn("n", F.lit(1))
    assert audited(df) == sorted(("it", a, "pair", b, 0, r) for a, o in (("a", "bc"), ("b", "ac"), ("c", "ab")) for r, b in enumerate(o, 1))
    assert audited(spark.createDataFrame([], AUDIT)) == []


def test_shares_are_exact_beyond_a_long(spark):
    n, whole = 9_000_000_000_000, 9_000_000_000_007
    want = 1 + 10**9 * (n + 2) // whole
    assert divergence._shares(np.array([n]), whole)[0] == want
    assert spark.range(1).select(F.lit(n).alias("n"), F.lit(whole).alias("whole")).select(divergence.share("n", "whole")).first()[0] == want


# byte-level BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


@pytest.fixture(scope="module")
def encoder():
    with open(BYTE_BPE) as f:
        return bpe.Encoder(f.read())


def same(encoder, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    own = encoder.encode(text)
    assert own == np.array(ids, "<u4").tobytes()
    assert encoder.decode(own) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60))
def test_bpe_of_any_text_equals_the_library(encoder, library, text):
    same(encoder, library, text)


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet="abehinorst -='\n\t0éÃ ՘\x1c\x85²Ⅷ_日", max_size=120))
def test_bpe_of_repeated_characters_equals_the_library(encoder, library, text):
    same(encoder, library, text)


def test_bpe_of_each_characters_class_equals_the_library(encoder, library):
    """Characters of every block: where Python's class differs from the library's too."""
    for c in [*range(0x20, 0x3000), *range(0x3000, 0xD800, 97), *range(0xE000, 0x110000, 397)]:
        same(encoder, library, f"a{chr(c)}b 1{chr(c)}2 !{chr(c)}? {chr(c)}{chr(c)}")


def test_bpe_of_long_pieces_is_linear_and_right(encoder, library):
    for text in ("a" * 200_000, "ab" * 50_000, "-=" * 40_000, " " * 90_000 + "x", "word " * 300_000):
        same(encoder, library, text)


def test_every_token_is_its_own_encoding_or_left_out(encoder):
    v = encoder.vocabulary
    rng = random.Random(4)
    for token in rng.sample(sorted(v.size), 3000):
        piece = v.bytes[v.offsets[token] : v.offsets[token + 1]].tobytes()
        assert v.encode_piece(piece) == [token]


def test_compatible_pairs_are_those_that_the_merges_keep(encoder):
    """The table against merges done one by one."""
    v = encoder.vocabulary

    def merged(ids):
        while True:
            best = min(((v.rank[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in v.rank), default=None)
            if best is None:
                return ids
            rank = best[0]
            whole = next(w for w in v.order if v.order[w] == rank)
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and v.rank.get((ids[i], ids[i + 1])) == rank:
                    out.append(whole)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out

    rng = random.Random(5)
    pool = [t for t in sorted(v.size) if v.size[t] <= 4]
    for _ in range(150):
        a, b = rng.choice(pool), rng.choice(pool)
        raw = v.bytes[v.offsets[a] : v.offsets[a + 1]].tobytes() + v.bytes[v.offsets[b] : v.offsets[b + 1]].tobytes()
        assert v.compatible(a, b) == (merged([v.byte_id[x] for x in raw]) == [a, b])


def test_encode_and_decode_on_spark(spark, library):
    texts = [None, "", "Hello  world's end", "<|endoftext|>x<|endoftext|><|endof", "é՘日本", "long " * 5000, "Hello  world's end"]
    df = spark.createDataFrame([(i if i < 6 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("ids", F.lit("own"))
    rows = bpe.decode(bpe.encode(df, BYTE_BPE), BYTE_BPE).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded) for r in rows) == sorted(
        (str(i if i < 6 else None), len(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in enumerate(texts))
    assert bpe.decode(bpe.encode(df.limit(0), BYTE_BPE), BYTE_BPE).count() == 0


def test_bpe_query_equals_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = bpe.op12_backtracking_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        with open(public_tokenizers.path("word_bpe_49k.json")) as f:
            bpe.Vocabulary(f.read())


# annulus search


def brute_clusters(rows, dims, k, rounds):
    """rows (id, vector) -> sorted (id, cluster, distance, cluster's inertia, inertia, digest)."""
    kept = [(i, [min(max(math.floor(64 * x), -(2**62)), 2**62) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in seeds[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        own = assigned()
        for n in range(len(cents)):
            mine = [v for (_, v), (_, c) in zip(kept, own, strict=True) if c == n]
            if mine:
                cents[n] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    own = assigned() if cents else []
    per = Counter()
    for d, c in own:
        per[c] += d
    long = lambda x: x if x < 2**63 else None
    broken = {c for d, c in own if d >= 2**63}
    total = None if broken else long(sum(per.values()))
    return sorted(((i, c, long(d), None if c in broken else long(per[c]), total, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, own, strict=True)), key=str)


def clustered(spark, rows, dims=4, k=5, rounds=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("own")).repartition(3)
    out = annulus.with_inertia(*annulus.cluster(df, dims=dims, k=k, rounds=rounds))
    return sorted((tuple(r) for r in out.collect()), key=str)


def vectors(n=200, dims=4):
    rng = random.Random(8)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0, -1.0]) * rng.choice([1, 2, 3]) + rng.choice([0, rng.random() / 9]) for _ in range(dims)]) for i in range(n)]
    rows += [(n, [0.1] * (dims - 1)), (n + 1, None), (n + 2, [0.1] * (dims - 1) + [None]), (n + 3, [float("nan")] * dims), (n + 4, [float("inf")] * dims), (n + 5, []), (None, [0.25] * dims), (n + 6, [0.0] * dims)]
    return rows + rows[:4] + rows[:2]


def test_clusters_equal_brute_force(spark):
    rows = vectors()
    assert clustered(spark, rows) == brute_clusters(rows, 4, 5, 3)


def test_clusters_of_few_equal_and_huge_vectors(spark):
    few = [(i, [float(i % 2)] * 4) for i in range(6)]
    assert clustered(spark, few) == brute_clusters(few, 4, 5, 3)
    huge = [(i, [1e6 * i, -(10.0**i), 3.0, 1e300 if i > 17 else 0.0]) for i in range(20)]
    assert clustered(spark, huge) == brute_clusters(huge, 4, 5, 3)
    assert clustered(spark, []) == [] and clustered(spark, [(1, None)]) == []


def test_annuli_hold_all_ties_and_skip_far_norms():
    rng = np.random.default_rng(2)
    cents = [[int(x) for x in v] for v in rng.integers(-3, 4, (12, 3)) * np.arange(1, 13)[:, None]] + [[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 0, 0]]
    v = rng.integers(-30, 31, (500, 3))
    for last in (np.full(500, -1), rng.integers(0, 16, 500)):
        number, best, compared = annulus.Centroids(cents).nearest(v, last)
        want = [min((int(((x - np.array(c)) ** 2).sum()), n) for n, c in enumerate(cents)) for x in v]
        assert list(zip(best.tolist(), number.tolist(), strict=True)) == want
    number, _, compared = annulus.Centroids(cents).nearest(v, annulus.Centroids(cents).nearest(v, np.full(500, -1))[0])
    assert compared.mean() < 0.8 * len(cents)


def test_clustering_query_equals_brute_force(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = annulus.op13_annulus_clustering(spark, "/root/testdata/sf0.001").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_clusters(rows, 64, 16, 3)
