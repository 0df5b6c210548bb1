"""Harmonic packing of tokenised documents into fixed-length sequences.

Lengths fall into reciprocal-capacity classes: class j holds the lengths in (C/(j+1), C/j], and a bin of class j
takes exactly j pieces. A document gives whole-capacity pieces first; what remains is cut at most ``max_cuts`` times
to pieces of exactly floor(C/j) tokens, so that nearly all bins are full. Workers count their pieces per class; the
exclusive sums of these counts (a table of tasks x classes) give every piece its bin and slot, so bins are filled
independently across workers. At most one bin per class stays partial; their pieces (a number bounded by the
capacity, whatever the input) are packed first-fit decreasing.

Edge cases: a null text is an empty text, which holds the end id alone. Each row is a document of its own, whether or
not ids or texts repeat; a null doc_id stays null. An empty table gives no pieces. Columns other than the id and the
text are not read, whatever their names.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadloom import runtime

CAPACITY = 2048
END_ID = 1


def _byte_letters() -> list[str]:
    """The printable character that byte-level BPE vocabularies use for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


_LETTERS = _byte_letters()
#: As the vocabulary file's own pre-tokenizer splits.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters below U+0250 have no combining marks among them, so NFC leaves them alone.
_POINTS = frozenset(".,;:!?")
_PLAIN = re.compile("[!-\x7e\xa1-\u024f]+")


def _whole_patterns() -> tuple[re.Pattern, re.Pattern]:
    """Of texts that need no look at their chunks: all plain characters whose lower case is one, and spaces; and the
    splits of _WORDS for such a text, by classes that list their characters."""
    plain = [c for c in map(chr, (*range(0x21, 0x7F), *range(0xA1, 0x250))) if len(c.lower()) == 1 and _PLAIN.fullmatch(c.lower())]
    letters, numbers = (re.escape("".join(c for c in plain if regex.fullmatch(p, c))) for p in (r"\p{L}", r"\p{N}"))
    splits = _WORDS.pattern.replace(r"[\p{L}]+", f"[{letters}]+").replace(r"[\p{N}]", f"[{numbers}]").replace(r"[^\s\p{L}\p{N}]+", f"[^ \t\n\r{letters}{numbers}]+")
    return re.compile(f"[ \t\n\r{re.escape(''.join(plain))}]*"), re.compile(splits)


_WHOLE, _WHOLE_WORDS = _whole_patterns()


class WordIds(dict):
    """Lower-case word -> ids as bytes, by the tokenizer's BPE model; bounded."""

    def __init__(self, model, limit: int):
        super().__init__()
        self.model, self.limit = model, limit

    def __missing__(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join([_LETTERS[b] for b in word.encode()])
        ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = ids
        return ids


class ChunkIds(dict):
    """White-space delimited chunk -> little-endian 32-bit ids; bounded. The tokenizer never joins chunks, so a text's
    ids are those of its chunks. Plain chunks go through the tokenizer's model word by word, all others through the
    whole tokenizer."""

    def __init__(self, tokenizer_json: str, limit: int = 100_000, words: int = 200_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_str(tokenizer_json), limit
        spec = json.loads(tokenizer_json)
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])], [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        own = kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
        if own:  # the same splits and replacements as here, else every chunk takes the whole tokenizer
            split, level = spec["pre_tokenizer"]["pretokenizers"]
            swap = spec["normalizer"]["normalizers"][1]
            own = (split["pattern"].get("Regex") == _WORDS.pattern and split.get("behavior") == "Removed" and split.get("invert") is True and not level.get("add_prefix_space")
                   and swap["pattern"].get("Regex") == r"\s+" and swap["content"] == " ")
            own = own and all("<|" in t["content"] for t in spec.get("added_tokens") or [])
        self.words = WordIds(self.tokenizer.model, words) if own else None

    def __missing__(self, chunk: str) -> bytes:
        if self.words is not None and "<|" not in chunk and _PLAIN.fullmatch(chunk):
            low = chunk.lower()
            if low.isalpha():
                ids = self.words[low]
            elif low[-1] in _POINTS and low[:-1].isalpha():  # most chunks: spares the pattern
                ids = self.words[low[:-1]] + self.words[low[-1]]
            else:
                ids = b"".join(map(self.words.__getitem__, _WORDS.findall(low)))
        else:
            ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(chunk) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = ids
        return ids


@functools.lru_cache(2)
def _chunks(tokenizer_json: str) -> ChunkIds:
    """A worker keeps its cache from task to task."""
    return ChunkIds(tokenizer_json)


_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[ \t\n\r]+")


def text_ids(text: str | None, chunks: ChunkIds, end_id: int = END_ID) -> bytes:
    """Ids of the text and the end id, as little-endian 32-bit integers."""
    text = text or ""
    if chunks.words is not None and "<|" not in text and _WHOLE.fullmatch(text):
        return b"".join(map(chunks.words.__getitem__, _WHOLE_WORDS.findall(text.lower()))) + np.array([end_id], "<u4").tobytes()
    # str.split() also splits at 1c-1f, which the tokenizer takes for ordinary characters
    parts = [x for x in _SPACE.split(text) if x] if _ODD_SPACE.search(text) else text.split()
    return b"".join(map(chunks.__getitem__, parts)) + np.array([end_id], "<u4").tobytes()


def cut_lengths(total: int, capacity: int = CAPACITY, max_cuts: int = 2, max_waste: float = 0.01) -> list[int]:
    """Piece lengths of a document of ``total`` tokens."""
    out = [capacity] * (total // capacity)
    rest = total % capacity
    for _ in range(max_cuts):
        if not rest or (capacity // rest) * rest >= (1 - max_waste) * capacity:
            break
        piece = capacity // (capacity // rest + 1)  # the largest reciprocal that the rest exceeds
        out.append(piece)
        rest -= piece
    return out + [rest] if rest else out


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, class int, part int, k bigint"


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer_json, capacity: int, end_id: int, max_cuts: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    chunks = _chunks(tokenizer_json.value)
    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        cols: list[list] = [[] for _ in range(9)]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = text_ids(text.as_py(), chunks, end_id)
            total, start = len(ids) // 4, 0
            for n in cut_lengths(total, capacity, max_cuts):
                own, j = ids[4 * start : 4 * (start + n)], capacity // n
                k = seen[j] = seen.get(j, -1) + 1
                for c, v in zip(cols, (doc_id, start, n, zlib.crc32(own), total, j, part, k, own), strict=True):
                    c.append(v)
                start += n
        types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64(), pa.binary()]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "part", "k", "ids"]
        take = 9 if keep_ids else 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:take], types, strict=False)], names[:take])


def _first_fit_decreasing(capacity: int):
    def pack(pdf):
        pdf = pdf.drop(columns="leftovers")
        # bounded: fewer than `class` pieces from each of the ~2*sqrt(capacity) classes
        pdf = pdf.sort_values(["length", "class", "idx"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        used: list[int] = []
        seq, off, first = [], [], 0
        for n in pdf["length"]:
            while first < len(used) and used[first] >= capacity:
                first += 1
            b = next((i for i in range(first, len(used)) if used[i] + n <= capacity), len(used))
            if b == len(used):
                used.append(0)
            seq.append(b)
            off.append(used[b])
            used[b] += n
        return pdf.assign(bin=seq, offset=off)

    return pack


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, max_cuts: int = 2, keep_ids: bool = False) -> DataFrame:
    """Pieces of the documents with their sequence and offset; ``keep_ids`` adds the ids as little-endian bytes."""
    spark = docs.sparkSession
    runtime.ship(spark)
    runtime.small_batches(spark)
    tok = spark.sparkContext.broadcast(Path(tokenizer_path).read_text())  # a vocabulary file: 2 MB, whatever the input
    schema = PIECES + (", ids binary" if keep_ids else "")
    cut = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        lambda it: _pieces(it, tok, capacity, end_id, max_cuts, keep_ids), schema)
    pieces = runtime.materialize(cut, "pieces")  # part and k must not change if a task runs again

    counts = pieces.groupBy("class", "part").agg(F.count("*").alias("n"))
    by_class = Window.partitionBy("class")
    starts = counts.select("class", "part",
                           (F.sum("n").over(by_class.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
                           F.sum("n").over(by_class).alias("in_class"))
    # one row per class: at most ~2*sqrt(capacity), so the unpartitioned window is bounded
    classes = counts.groupBy("class").agg(F.expr(f"sum(n) div class").alias("bins"))
    classes = classes.select("class", (F.sum("bins").over(Window.orderBy("class").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bins")).alias("first_bin"),
                             F.sum("bins").over(Window.partitionBy()).alias("all_bins"))
    placed = (pieces.join(starts, ["class", "part"]).join(F.broadcast(classes), "class")
              .withColumn("idx", F.col("before") + F.col("k"))
              .withColumn("bin", F.expr("idx div class")))
    full = placed.where(F.expr("bin < in_class div class"))
    in_bin = Window.partitionBy("sequence_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    extra = ["ids"] if keep_ids else []
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *extra]
    full = (full.withColumn("sequence_id", F.col("first_bin") + F.col("bin"))
            .withColumn("offset", F.sum("length").over(in_bin) - F.col("length")).select(*out))
    left = placed.where(F.expr("bin >= in_class div class")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "idx", "all_bins", *extra)
    left = (left.withColumn("leftovers", F.lit(True)).groupBy("leftovers").applyInPandas(_first_fit_decreasing(capacity), ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in left.schema.fields) + ", bin bigint, offset bigint")
        .withColumn("sequence_id", F.col("all_bins") + F.col("bin")).select(*out))
    return full.unionByName(left)


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(runtime.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
