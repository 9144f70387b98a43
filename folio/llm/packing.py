"""Best-fit packing: whole documents into token sequences of fixed capacity by minimum bin slack.

Three steps, none of which gathers documents anywhere:

1. Each partition tokenizes its texts, cuts what is longer than the capacity
   and numbers its pieces within each length.
2. The histogram of lengths - at most ``capacity`` rows, whatever the corpus -
   is packed on the driver. For each bin the longest length left is fixed and
   a bitset subset-sum over the lengths available finds the fullest feasible
   rest; the combination found is removed as often as the counts allow.
   Every round leaves some length with fewer pieces than a bin used of it, so
   there are at most ``capacity * H(capacity)`` rounds, about 17,000 for 2048.
3. A piece's number within its length (numbers of its partition plus those of
   the partitions before it) says which bin and place are its own: arithmetic
   on the plan's segments, without a sort of the pieces and without a hot length.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.shared import Memo, shared_folder, tokenizer_file, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"


class Combination(NamedTuple):
    """``times`` bins, each of ``used``: (length, pieces of this length)."""

    used: tuple[tuple[int, int], ...]
    times: int


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to ``room``: bitset subset-sum, longest first."""
    goal, reach, mask = 1 << room, 1, (2 << room) - 1
    history: list[tuple[int, int, int]] = []
    for length in sorted((x for x in available if x <= room), reverse=True):
        left, step = min(available[length], room // length), 1
        while left:
            take = min(step, left)
            history.append((length, take, reach))
            reach = (reach | reach << length * take) & mask
            if reach & goal:
                break
            left -= take
            step *= 2
        if reach & goal:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(history):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[Combination]:
    """Bins for ``counts`` pieces of each length, as combinations with multiplicity."""
    left = {length: n for length, n in counts.items() if n > 0}
    plan = []
    while left:
        longest = max(left)
        used = {longest: 1}
        if room := capacity - longest:
            rest = left | {longest: left[longest] - 1}
            for length, n in fullest({x: n for x, n in rest.items() if n}, room).items():
                used[length] = used.get(length, 0) + n
        times = min(left[length] // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
        plan.append(Combination(tuple(sorted(used.items(), reverse=True)), times))
    return plan


def segments(plan: list[Combination]) -> np.ndarray:
    """Rows (length, first number, bin of the first, pieces a bin, offset in the bin), sorted by length and number."""
    rows, given, bins = [], {}, 0
    for combination in plan:
        offset = 0
        for length, n in combination.used:
            rows.append((length, given.get(length, 0), bins, n, offset))
            given[length] = given.get(length, 0) + n * combination.times
            offset += length * n
        bins += combination.times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordPieces:
    """Ids of white-space delimited chunks (UTF-8), as little-endian unsigned 32-bit integers in bytes.

    This vocabulary drops white space before splitting into words, so ids of a
    text are those of its chunks in a row. Chunks of Latin characters are split
    into words here, by the tokenizer's own pattern, and only words not seen
    before go to its model; any other chunk (other scripts, controls, special
    tokens, another kind of tokenizer) goes through the whole tokenizer.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str) -> None:
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        steps = [x["type"] for x in (kind["normalizer"] or {}).get("normalizers", ())]
        split = next((x for x in (kind["pre_tokenizer"] or {}).get("pretokenizers", ()) if x["type"] == "Split"), {})
        self.known = steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern", {}).get("Regex") == self.PATTERN and split.get("invert") is True
        self.special = [x["content"].encode() for x in kind["added_tokens"]]
        self.find = regex.compile(self.PATTERN).findall
        self.latin = regex.compile("[\x21-\x7e\xa1-\u024f]+").fullmatch
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shown = dict(zip(printable, map(chr, printable)))
        others = (b for b in range(256) if b not in shown)
        self.shown = shown | {b: chr(256 + i) for i, b in enumerate(others)}  # byte-level BPE's letters for bytes
        self.points = {bytes((b,)) for b in b".,;:!?"}
        self.words = Memo(self.word, 100_000)
        self.chunks = Memo(self.chunk, 200_000)

    def word(self, word: str) -> bytes:
        letters = word if word.isascii() else "".join(map(self.shown.__getitem__, word.encode()))
        return packed([t.id for t in self.model.tokenize(letters)])

    def chunk(self, chunk: bytes) -> bytes:
        if self.known:
            if chunk.isalpha():  # ASCII letters
                return packed([t.id for t in self.model.tokenize(chunk.decode().lower())])
            if chunk[-1:] in self.points and chunk[:-1].isalpha():
                return self.chunks[chunk[:-1]] + self.words[chunk[-1:].decode()]
        text = chunk.decode()
        if self.known and self.latin(text) and not any(x in chunk for x in self.special):
            text = text.lower() if text.isascii() else "".join(map(str.lower, text))
            if text.isalpha():
                return self.word(text)
            return b"".join(map(self.words.__getitem__, self.find(text)))
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def forget(self) -> None:
        """Frees the memos."""
        for memo in (self.words, self.chunks):
            memo.clear()
            memo.older = {}

    def text(self, text: bytes) -> bytes:
        """Ids of a whole text; A-Z are lower-cased at once where no special token's sign is about."""
        if self.known and b"<|" not in text:
            text = text.lower()
        return b"".join(map(self.chunks.__getitem__, text.split()))


_word_pieces: dict[str, WordPieces] = {}


def word_pieces(path: str) -> WordPieces:
    """One a process: later tasks of the same worker go on with its memo."""
    if path not in _word_pieces:
        _word_pieces[path] = WordPieces(path)
    return _word_pieces[path]


def cut(path: str, capacity: int, separator: int):
    """The pieces of each partition's texts: ``PIECES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        ids_of = word_pieces(path).text
        end = np.array([separator], "<u4").tobytes()
        part, numbers = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                ids = ids_of(text or b"") + end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[start : start + 4 * capacity]
                    length = len(own) // 4
                    out.append((doc_id, piece, start // 4, length, zlib.crc32(own), part, int(numbers[length])))
                    numbers[length] += 1
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], PIECES.replace(",", "").split()[::2])

    return run


def place(table: np.ndarray):
    """Sequence and offset of pieces by their number within their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            own = table[np.searchsorted(keys, length << 44 | number, "right") - 1]
            nth = number - own[:, 1]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(own[:, 2] + nth // own[:, 3]), pa.array(own[:, 4] + nth % own[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, *, capacity: int = 2048, separator: int = 0, tokenizer: str | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the separator alone. Rows with equal or null
    doc_id are packed like any other, each by itself. No rows: no pieces.
    Other columns of ``docs`` are not read. Only documents longer than the
    capacity are cut; ``sequence_id`` runs from 0 without gaps and every
    sequence is filled from offset 0 without gaps.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    path = tokenizer or tokenizer_file("word_bpe_49k.json")
    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = written(pieces.mapInArrow(cut(path, capacity, separator), PIECES), folder, "pieces")
    counts = written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), folder, "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = segments(minimum_bin_slack(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = pieces.join(first, ["part", "length"]).withColumn("number", F.col("number") + F.col("first"))
    kept = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    return kept.mapInArrow(place(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
