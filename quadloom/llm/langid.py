"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased and every run without letters becomes one blank. For each language, n-grams up to ORDER are
counted: raw counts at the highest order, numbers of distinct left neighbours below, absolute discounts estimated per
order. The n-grams of all languages share one sorted array of 64-bit hashes per order, beside it the discounted
probabilities and, for contexts, the interpolation weights of every language; scoring looks hashes up by binary search.
The language with the lowest cross-entropy per character wins. A softmax over the cross-entropies, its temperature
fitted on documents that were not counted, gives the score; a text whose cross-entropy is beyond what all but
REJECT_RATE of those documents' pieces reach in their own language is marked as rejected.

Edge cases: a null text or one without a letter (as str.isalpha has it) is ``und`` with score 0. Very long texts are
summed over pieces. Repeated rows are predicted alike. Rows without text or language are not learned from; if none is
left, fit() raises ValueError and train() gives a model that predicts ``und``. Other columns are not read. An empty table
gives an empty table.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadloom import runtime
from quadloom.llm import sampling

ORDER = 4
#: Labelled documents per language for fitting: the documented bound. Every fifth calibrates.
PER_LANG = 400
PIECE = 200_000
#: Share of pieces of the calibrating documents that may be rejected in their own language, for pieces of each length, and
#: what is added to their largest entropies: other documents vary more than the pieces of a few.
REJECT_RATE, PIECE_CHARS, REJECT_MARGIN = 0.001, (12, 25, 50, 100, 200, 400, 800, 1600), 0.08
#: Numbers that \w holds beside letters and \d, such as fractions and Roman numerals.
_NUMBERS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
_BLANKS = dict.fromkeys(map(ord, _NUMBERS), " ")
_NO_LETTERS = re.compile(r"[\W\d_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    grams: tuple[np.ndarray, ...]  # per order, sorted hashes
    alpha: tuple[np.ndarray, ...]  # per order, (grams + 1) x langs; the last row is for unseen ones
    gamma: tuple[np.ndarray, ...]  # per order of the context, (contexts + 1) x langs
    floor: np.ndarray  # the uniform share below order 1
    temperature: float
    limits: np.ndarray  # cross-entropy beyond which a text of each length in PIECE_CHARS is rejected: lengths by languages


def normal(text: str | None) -> str:
    low = (text or "").lower()
    if not low.isascii() and not _NUMBERS.isdisjoint(low):
        low = low.translate(_BLANKS)
    return _NO_LETTERS.sub(" ", low).strip()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32).astype(np.uint64)


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """Per order, the hash of the n-gram that ends at each position (0 where there is none)."""
    out = [(codes + np.uint64(1)) * _MULT]
    for n in range(2, ORDER + 1):
        h = np.zeros_like(codes)
        h[n - 1 :] = (out[-1][n - 2 : -1] ^ (out[-1][n - 2 : -1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + out[0][n - 1 :]
        out.append(h)
    return out


def _counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per order: distinct n-grams, their counts, and the hash of each one's context (the n-1 characters before)."""
    hs: list[list[np.ndarray]] = [[] for _ in range(ORDER)]
    cs: list[list[np.ndarray]] = [[] for _ in range(ORDER)]
    lower: list[list[np.ndarray]] = [[] for _ in range(ORDER)]
    for t in texts:
        h = _hashes(_codes(t))
        for n in range(ORDER):
            hs[n].append(h[n][n:])
            cs[n].append(h[n - 1][n - 1 : -1] if n else np.zeros(len(h[0]), np.uint64))
            lower[n].append(h[n - 1][n:] if n else np.zeros(len(h[0]), np.uint64))
    out = []
    shorter = None
    for n in reversed(range(ORDER)):
        g, at, c = np.unique(np.concatenate(hs[n]), return_index=True, return_counts=True)
        ctx = np.concatenate(cs[n])[at]
        if shorter is not None:  # continuation counts: distinct (n+1)-grams whose last n characters these are
            u, k = np.unique(shorter, return_counts=True)
            c = np.zeros(len(g), np.int64)
            c[np.searchsorted(g, u)] = k
            g, ctx, c = g[c > 0], ctx[c > 0], c[c > 0]
        shorter = np.concatenate(lower[n])[at] if n else None
        out.append((g, c, ctx))
    return out[::-1]


def fit(texts: dict[str, list[str]]) -> Model:
    langs = tuple(sorted(texts))
    normed = {k: [x for x in map(normal, v) if x] for k, v in texts.items()}
    langs = tuple(k for k in langs if normed[k])
    if not langs:
        raise ValueError("language models need labelled documents")
    held = {k: [t for i, t in enumerate(normed[k]) if i % 5 == 4] for k in langs}
    counted = [_counts([t for i, t in enumerate(normed[k]) if i % 5 != 4]) for k in langs]
    grams = [np.unique(np.concatenate([c[n][0] for c in counted])) for n in range(ORDER)]
    alpha = [np.zeros((len(g) + 1, len(langs)), np.float32) for g in grams]
    gamma = [np.ones((len(g) + 1, len(langs)), np.float32) for g in grams]
    floor = np.zeros(len(langs), np.float32)
    for j, c in enumerate(counted):
        for n in range(ORDER):
            g, k, ctx = c[n]
            n1, n2 = (k == 1).sum(), (k == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            u, inv = np.unique(ctx, return_inverse=True)
            total, kinds = np.bincount(inv, k), np.bincount(inv)
            alpha[n][np.searchsorted(grams[n], g), j] = (k - discount) / total[inv]
            share = discount * kinds / total
            if n:
                at = np.searchsorted(grams[n - 1], u)
                ok = grams[n - 1][np.minimum(at, len(grams[n - 1]) - 1)] == u
                gamma[n - 1][at[ok], j] = share[ok]
            else:
                floor[j] = share[0] / (len(grams[0]) + 1)
    m = Model(langs, tuple(grams), tuple(alpha), tuple(gamma), floor, 1.0, np.full((len(PIECE_CHARS), len(langs)), np.inf))
    ents, gold, sizes = [], [], []
    for j, k in enumerate(langs):
        e, n = entropies(held[k] or normed[k][:5], m)
        ents.append(e)
        sizes.append(n)
        gold += [j] * len(n)
    e, n, y = np.vstack(ents), np.concatenate(sizes), np.array(gold)
    limits = np.full((len(PIECE_CHARS), len(langs)), np.inf)
    for j, k in enumerate(langs):
        text = " ".join(held[k] or normed[k][:5])
        for r, size in enumerate(PIECE_CHARS):
            pieces = [text[i : i + size] for i in range(0, max(1, len(text) - size + 1), size)]
            own = np.sort(entropies([x for x in pieces if x.strip()] or [text], m)[0][:, j])
            limits[r, j] = own[min(len(own) - 1, int(np.ceil((1 - REJECT_RATE) * (len(own) + 1))) - 1)] * (1 + REJECT_MARGIN)
    limits = np.maximum.accumulate(limits[::-1], axis=0)[::-1]  # a longer text varies less
    # short samples of the held documents, as long ones are never in doubt
    best = min((0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0), key=lambda t: -np.log(_softmax(e, np.minimum(n, 20), t)[np.arange(len(y)), y] + 1e-12).sum())
    return Model(langs, m.grams, m.alpha, m.gamma, floor, best, limits)


def _softmax(e: np.ndarray, n: np.ndarray, temperature: float) -> np.ndarray:
    z = -(e - e.min(1, keepdims=True)) * np.log(2) * (n * temperature)[:, None]
    p = np.exp(z)
    return p / p.sum(1, keepdims=True)


def _log_probs(codes: np.ndarray, m: Model) -> np.ndarray:
    """log2 of each character's probability in each language."""
    p = np.broadcast_to(m.floor, (len(codes), len(m.langs)))
    before = None
    for n, h in enumerate(_hashes(codes)):
        g = m.grams[n]
        at = np.minimum(np.searchsorted(g, h), len(g) - 1)
        at = np.where(g[at] == h, at, len(g))
        if n:
            ctx = np.empty_like(at)
            ctx[0], ctx[1:] = len(m.grams[n - 1]), before[:-1]
            p = m.alpha[n][at] + m.gamma[n - 1][ctx] * p
        else:
            p = m.alpha[0][at] + p
        before = at
    return np.log2(np.maximum(p, 1e-12))


def entropies(texts: list[str], m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per character of normalised texts in each language, and their lengths."""
    sums, sizes = np.zeros((len(texts), len(m.langs))), np.zeros(len(texts))
    parts: list[np.ndarray] = []
    owner: list[tuple[int, int]] = []

    def run():
        if not parts:
            return
        lp = _log_probs(np.concatenate(parts), m)
        # a document's first ORDER - 1 characters have their context in the blank before it, not in its neighbour
        ends = np.cumsum([len(x) for x in parts])
        for (i, skip), e, x in zip(owner, ends, parts, strict=True):
            own = lp[e - len(x) + skip : e]
            sums[i] += own.sum(0, dtype=np.float64)
            sizes[i] += len(own)
        parts.clear()
        owner.clear()

    held = 0
    for i, t in enumerate(texts):
        codes = _codes(t)
        for k in range(0, len(codes), PIECE):
            lo = max(0, k - ORDER)
            parts.append(codes[lo : k + PIECE])
            owner.append((i, k - lo if k else min(ORDER - 1, len(codes) - 1)))
            held += len(parts[-1])
            if held > PIECE:
                run()
                held = 0
    run()
    return -sums / np.maximum(sizes, 1)[:, None], sizes


def predict(texts: list[str | None], m: Model) -> list[tuple[str, float, float | None, bool]]:
    """Language, score, cross-entropy and whether it is rejected."""
    own = [normal(t) if m.langs else "" for t in texts]
    e, n = entropies([t for t in own if t], m)
    p, best = (_softmax(e, n, m.temperature), e.argmin(1)) if len(e) else (e, e)
    out, k = [], 0
    for t in own:
        if not t:
            out.append(("und", 0.0, None, True))
            continue
        j = int(best[k])
        limit = np.interp(np.log2(max(n[k], 1)), np.log2(PIECE_CHARS), m.limits[:, j])
        out.append((m.langs[j], float(p[k, j]), float(e[k, j]), bool(e[k, j] > limit)))
        k += 1
    return out


COLUMNS = "doc_id bigint, lang_pred string, score double, cross_entropy double, rejected boolean"


def _predicted(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
    for batch in batches:
        rows = predict(batch.column(1).to_pylist(), model.value)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = docs.sparkSession
    runtime.ship(spark)
    runtime.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded by the sample: PER_LANG documents a language
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lambda it: _predicted(it, sent), COLUMNS)


def sample_ids(docs: DataFrame, per_lang: int = PER_LANG, id_col: str = "doc_id") -> DataFrame:
    """i and lang of at most ``per_lang`` documents of each language, those with the smallest id hashes. A language's number
    of documents gives a hash below which some more than that lie, all but surely: only these are ordered, so that a task
    sends few rows of a language on, however many tasks there are."""
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col(id_col).alias("i"), F.col("lang").cast("string").alias("lang"))
    sizes = runtime.materialize(own.groupBy("lang").agg(F.count("*").alias("n")), "language-sizes")  # a row for each language
    enough = per_lang + 12 * per_lang**0.5 + 40
    place = F.xxhash64("i").cast("double") / 2.0**64 + 0.5  # from 0 to 1
    near = own.join(sizes, "lang").where(place * F.col("n") <= enough).select("i", "lang").distinct()
    first = Window.partitionBy("lang").orderBy(F.xxhash64("i"), "i")
    return near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_lang).select("i", "lang")


def train(docs: DataFrame, per_lang: int = PER_LANG, id_col: str = "doc_id") -> Model:
    """Fits on the documents of sample_ids(), in one task: their texts come to it from parallel scans."""
    runtime.ship(docs.sparkSession)
    runtime.small_batches(docs.sparkSession)
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col(id_col).alias("i"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    ids = runtime.materialize(sample_ids(docs, per_lang, id_col), "language-ids")
    few = ids.limit(50 * PER_LANG + 1).count() <= 50 * PER_LANG  # of 50 languages
    rows = own.join(F.broadcast(ids) if few else ids, ["i", "lang"]).select("lang", "text").repartition(1)

    def learn(got: list[tuple]) -> Model:
        texts: dict[str, list[str]] = {}
        for lang, text in sorted(got):
            texts.setdefault(lang, []).append(text)
        texts = {k: v[: 2 * per_lang] for k, v in texts.items()}  # a repeated id comes with all its texts
        if not any(normal(t) for v in texts.values() for t in v):
            return Model((), (), (), (), np.zeros(0), 1.0, np.zeros((len(PIECE_CHARS), 0)))
        return fit(texts)

    return sampling.fit_in_task(rows, learn)


def op3_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents")
    model = train(docs.where(sampling.fold("doc_id", 4) != 2))
    return identify(docs, model).select("doc_id", (sampling.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
