"""Byte-level BPE by backtracking, and decoding by an offset table.

A sequence of tokens is the result of the merges exactly if every token is what the merges make of its own bytes and no
merge ever crosses the border of two neighbours. So a piece of text is encoded from left to right: the longest token at
the position (the longest tokens that follow each other come from one pass of an Aho-Corasick automaton) is taken if it is compatible with
the token before it, else the next shorter one that starts it; where none is left, the token before is given up and its
position is marked, so that no position is tried twice. That is linear in the piece's length, whatever it holds.

Whether two tokens are compatible follows from undoing their merges, the later one first, and looking for a merge of the
two parts at the border that would have come earlier; results are kept in a table. Decoding gathers the tokens' bytes from
one array by a table of offsets.

Text is cut into pieces as the vocabulary's own pre-tokenizer does (letters, digits, others, white space); a character
that Python's tables put into another class than the library's is replaced by one of the library's class before the cut.

Edge cases: a null text is the empty text: no tokens. Added tokens in a text become their ids. Very long texts are cut
piece by piece, so that only their ids are held. Repeated rows are encoded each; null ids stay null; other columns are
not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import runtime

#: The pre-tokenizer's pattern, a fixed value of the format, in the classes of Python's re.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Pieces kept by a worker: at most so many, none longer than so many characters; and pairs kept in the table.
PIECES, PIECE_CHARS, PAIRS = 400_000, 48, 1_000_000
#: Texts longer than this are cut piece by piece; ids decoded at once.
LONG_TEXT, AT_ONCE = 1 << 20, 1 << 16


def byte_characters() -> dict[str, int]:
    """The format's character of each byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, their merges and the tables of the encoder, from a tokenizer file's text."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model, cut, added = spec["model"], spec["pre_tokenizer"] or {}, spec.get("added_tokens") or []
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if odd or spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"not a plain byte-level vocabulary: {odd or cut}")
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that look at their neighbours")
        chars = byte_characters()
        raw = lambda token: bytes(chars[c] for c in token)
        ids = {raw(t): i for t, i in model["vocab"].items() if all(c in chars for c in t)}
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.order: dict[int, int] = dict.fromkeys(self.byte_id, -1)  # when a token comes to be
        for n, (a, b) in enumerate(merges):
            left, right = ids[raw(a)], ids[raw(b)]
            whole = ids[raw(a) + raw(b)]
            if whole in self.order:
                raise ValueError("two merges make one token")
            self.rank[left, right], self.parts[whole], self.order[whole] = n, (left, right), n
        self.pairs: dict[tuple[int, int], bool] = {}
        sound = set(self.byte_id)  # tokens that the merges make of their own bytes; parts come before wholes
        for whole, (left, right) in self.parts.items():
            if left in sound and right in sound and not self._crosses(left, right, self.order[whole]):
                sound.add(whole)
        own = {b: i for b, i in ids.items() if i in sound}
        self.size = {i: len(b) for b, i in own.items()}
        self.shorter = {i: next((own[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in own), -1) for b, i in own.items()}
        self.widest = max(self.size.values())
        self.automaton = ahocorasick.Automaton()
        for b, i in own.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.added = {t["content"]: t["id"] for t in added}
        texts = dict.fromkeys(range(max([*ids.values(), *self.added.values()]) + 1), b"") | {i: b for b, i in ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.offsets = np.cumsum([0, *map(len, texts.values())])
        self.bytes = np.frombuffer(b"".join(texts.values()), np.uint8)

    def _crosses(self, a: int, b: int, before: int) -> bool:
        """Whether a merge over the border of a and b comes to pass before merge number ``before``: their merges are
        undone from the last to the first, and of each state the pair at the border is looked up."""
        order, parts, rank = self.order, self.parts, self.rank
        limit = before
        while True:
            n = rank.get((a, b))
            if n is not None and n < limit:
                return True
            # which of the two came last? Of equal tokens the left one is merged first, so the right one is undone first
            if order[a] > order[b]:
                if order[a] < 0:
                    return False
                limit = min(limit, order[a])
                a = parts[a][1]
            else:
                if order[b] < 0:
                    return False
                limit = min(limit, order[b] + 1)
                b = parts[b][0]

    def compatible(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = not self._crosses(a, b, len(self.rank))
        return found

    def _longest(self, text: str, at: int) -> int:
        return next(self.automaton.iter_long(text[at : at + self.widest]))[1][1]

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece, as the merges give them."""
        text, n = piece.decode("latin-1"), len(piece)
        # where one longest token follows the other; those at other positions are asked for when the search gets there
        longest = {end + 1 - size: token for end, (size, token) in self.automaton.iter_long(text)}
        size, pairs, closed = self.size, self.pairs, set()
        out: list[int] = []
        at, before, token = 0, -1, longest.get(0, -1)
        while at < n:
            while token >= 0:
                if at + size[token] not in closed:
                    if before < 0:
                        break
                    fits = pairs.get((before, token))
                    if self.compatible(before, token) if fits is None else fits:
                        break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at, before = at + size[token], token
                token = longest.get(at, -1)
                if token < 0 and at < n:
                    token = longest[at] = self._longest(text, at)
            else:  # nothing fits behind the token before: it ends at a wrong place
                closed.add(at)
                token = out.pop()
                at, before = at - size[token], out[-1] if out else -1
                token = self.shorter[token]
        return out


class Encoder(dict):
    """Pieces' ids as bytes, kept while there are few."""

    def __init__(self, tokenizer_json: str):
        super().__init__()
        self.vocabulary = Vocabulary(tokenizer_json)
        self.piece, self.plain = re.compile(PIECE), re.compile(PIECE, re.ASCII)
        self.added = re.compile("|".join(map(re.escape, sorted(self.vocabulary.added, key=len, reverse=True)))) if self.vocabulary.added else None
        self.seen: set[str] = set()  # characters whose class is known
        self.stand_in: dict[str, str] = {}  # characters of another class in the library

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.vocabulary.encode_piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= PIECE_CHARS:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def _learn_classes(self, chars: set[str]) -> None:
        """Compares Python's classes of new characters with the library's."""
        from tokenizers.pre_tokenizers import ByteLevel

        cut = ByteLevel(add_prefix_space=False).pre_tokenize_str
        for c in chars:
            probe = f"a{c}1{c}!"
            spans = [s for _, s in cut(probe)]
            if spans != [m.span() for m in self.piece.finditer(probe)]:
                self.stand_in[c] = next(x for x in "b2?\t" if [m.span() for m in self.piece.finditer(f"a{x}1{x}!")] == spans)
        self.seen |= chars

    def _cut(self, text: str) -> Iterable[str]:
        if text.isascii():
            return self.plain.findall(text) if len(text) <= LONG_TEXT else (m.group() for m in self.plain.finditer(text))
        chars = set(text)
        if not chars <= self.seen:
            self._learn_classes(chars - self.seen)
        odd = chars & self.stand_in.keys()
        if odd:
            shadow = text.translate({ord(c): self.stand_in[c] for c in odd})
            return (text[m.start() : m.end()] for m in self.piece.finditer(shadow))
        return self.piece.findall(text) if len(text) <= LONG_TEXT else (m.group() for m in self.piece.finditer(text))

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if self.added is None or not self.added.search(text):
            return b"".join(map(self.__getitem__, self._cut(text)))
        out, at = [], 0
        for m in self.added.finditer(text):
            out += map(self.__getitem__, self._cut(text[at : m.start()]))
            out.append(np.array([self.vocabulary.added[m.group()]], "<u4").tobytes())
            at = m.end()
        out += map(self.__getitem__, self._cut(text[at:]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        every, v, out = np.frombuffer(ids, "<u4"), self.vocabulary, []
        for i in range(0, len(every), AT_ONCE):
            own = every[i : i + AT_ONCE]
            start = v.offsets[own]
            size = v.offsets[own + 1] - start
            ends = np.cumsum(size)
            out.append(v.bytes[np.repeat(start - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(out).decode("utf-8", "replace")


@functools.lru_cache(1)
def _encoder(tokenizer_json: str) -> Encoder:
    """A worker keeps its tables from task to task."""
    return Encoder(tokenizer_json)


def encode(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every text."""
    spark = docs.sparkSession
    runtime.ship(spark)
    runtime.small_batches(spark)
    file = spark.sparkContext.broadcast(Path(tokenizer_path).read_text())  # a vocabulary file: some MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(file.value)
        for batch in batches:
            ids = [encoder.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """The columns of encode() and decoded, the text of the ids; null ids give a null text."""
    spark = encoded.sparkSession
    runtime.ship(spark)
    file = spark.sparkContext.broadcast(Path(tokenizer_path).read_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(file.value)
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in (v.as_py() for v in batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded string")


def op12_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = decode(encode(runtime.table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
