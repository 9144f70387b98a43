"""Removal of repeated line runs, with a suffix array over line ids built by distributed prefix doubling.

The corpus is one sequence of lines (blank ones left out). Level 0 ranks the
lines that occur twice or more; level j+1 ranks the pairs of level-j ranks at
a line and 2^j lines on. A rank is the place of a run of 2^j lines in the
sorted order of all repeated runs of that length, so the suffixes of one rank
are one interval of the suffix array whose longest common prefix is at least
2^j; runs that occur once leave the doubling. An interval of depth m, not a
power of two, is the pair of level-j ranks (2^j <= m) at its start and at m -
2^j lines on.

A run is repeated text from more than ``min_words`` words. For each line, the
shortest run that begins there and exceeds this, and the shortest that ends
there, are looked up as such intervals; in each interval the run at the first
place in the corpus stays and all later ones go. Every maximal repeated run is
the union of these runs, so it goes as a whole, and m never exceeds
``min_words`` + 1: the number of doublings is fixed, whatever the corpus.

Ranks come from grouping, which combines before it shuffles, and a range sort
of the groups: a line that makes up a third of the corpus is one group. All
tables hold ids of lines, not texts, and are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.shared import bit_map, shared_folder, written

MIN_WORDS = 50
LINES = "doc_id long, doc_hash long, line int, h1 long, h2 long, ahead int, behind int"
KEY = ("doc_id", "doc_hash")


def shortest_runs(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line, lines of the shortest run of more than ``least`` words that begins or ends there; 0 for none."""
    n = len(words)
    total = np.concatenate(([0], np.cumsum(words)))
    end = np.searchsorted(total, total[:-1] + least, "right")  # the first prefix that exceeds it
    ahead = np.where(end <= n, end - np.arange(n), 0)
    start = np.searchsorted(total, total[1:] - least, "left") - 1  # the last prefix that is smaller by more
    behind = np.where(start >= 0, np.arange(n) + 1 - start, 0)
    return ahead, behind


def content_lines(text: bytes | None) -> tuple[list[bytes], list[int]]:
    """Stripped lines that aren't blank, and the number of each among all lines."""
    lines, places = [], []
    for i, line in enumerate((text or b"").split(b"\n")):
        if stripped := line.strip():
            lines.append(stripped)
            places.append(i)
    return lines, places


def scan(least: int):
    """Lines of each text: ids (two hashes) and the shortest runs that may be repeated text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, docs, numbers, hashes, ahead, behind = [], [], [], [], [], []
            for doc_id, text, doc in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                lines, _ = content_lines(text)
                if not lines:
                    continue
                a, b = shortest_runs(np.array([len(x.split()) for x in lines], np.int64), least)
                if not a.any():
                    continue  # no run of this text is long enough
                ids += [doc_id] * len(lines)
                docs += [doc] * len(lines)
                numbers.append(np.arange(len(lines), dtype=np.int32))
                hashes += map(digest, lines)
                ahead.append(a)
                behind.append(b)
            if ids:
                both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                columns = [pa.array(ids, pa.int64()), pa.array(docs, pa.int64()), pa.array(np.concatenate(numbers)), pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))]
                columns += [pa.array(np.concatenate(x).astype(np.int32)) for x in (ahead, behind)]
                yield pa.RecordBatch.from_arrays(columns, LINES.replace(",", "").split()[::2])

    return run


def ranked(groups: DataFrame, keys: list[str], folder: str, name: str) -> DataFrame:
    """Groups with their place in the sorted order of all: increasing, not dense."""
    ordered = groups.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(ordered.select(*keys, F.monotonically_increasing_id().alias("rank")), folder, name)


def levels(lines: DataFrame, depth: int, folder: str) -> list[DataFrame]:
    """Per level j: (doc_id, doc_hash, line, rank) of every run of 2^j lines that occurs twice or more."""
    groups = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    names = ranked(groups, ["h1", "h2"], folder, "ranks-0")
    out = [written(lines.join(names, ["h1", "h2"]).select(*KEY, "line", "rank"), folder, "level-0")]
    for j in range(depth):
        step = 2**j
        on = Window.partitionBy(*KEY).orderBy("line").rangeBetween(step, step)
        pairs = out[-1].withColumn("next", F.max("rank").over(on)).where("next is not null")
        pairs = written(pairs, folder, f"pairs-{j + 1}")
        groups = pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        names = ranked(groups.withColumnRenamed("rank", "here"), ["here", "next"], folder, f"ranks-{j + 1}")
        out.append(written(pairs.withColumnRenamed("rank", "here").join(names, ["here", "next"]).select(*KEY, "line", "rank"), folder, f"level-{j + 1}"))
    return out


def later_runs(docs: DataFrame, min_words: int, folder: str) -> DataFrame:
    """(doc_id, doc_hash, runs) where runs are the (first line, lines) that are later copies of repeated text."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain = plain.withColumn("doc_hash", F.xxhash64("doc_id", "text"))
    lines = written(plain.mapInArrow(scan(min_words), LINES), folder, "lines")
    depth = int(min_words + 1).bit_length() - 1
    ranks = levels(lines.select(*KEY, "line", "h1", "h2"), depth, folder)
    everywhere = ranks[0].select(*KEY, "line", F.lit(0).alias("level"), "rank")
    for j, level in enumerate(ranks[1:], 1):
        everywhere = everywhere.union(level.select(*KEY, "line", F.lit(j), "rank"))
    begins = lines.where("ahead > 0").select(*KEY, "line", F.col("ahead").alias("size"))
    ends = lines.where("behind > 0").select(*KEY, (F.col("line") - F.col("behind") + 1).alias("line"), F.col("behind").alias("size"))
    # a run's ranks: at its start and where its last 2^level lines begin
    runs = begins.union(ends).distinct().withColumn("level", F.floor(F.log2("size") + F.lit(1e-9)).cast("int"))
    runs = runs.withColumn("tail", F.expr("line + size - cast(pow(2, level) as int)"))
    head = everywhere.withColumnRenamed("rank", "head")
    first = runs.alias("r").join(head.alias("h"), F.expr("r.doc_id <=> h.doc_id and r.doc_hash = h.doc_hash and r.line = h.line and r.level = h.level")).select("r.*", "h.head")
    found = first.alias("r").join(everywhere.alias("t"), F.expr("r.doc_id <=> t.doc_id and r.doc_hash = t.doc_hash and r.tail = t.line and r.level = t.level")).select("r.doc_id", "r.doc_hash", "r.line", "r.size", "r.head", "t.rank")
    found = written(found, folder, "runs")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "doc_hash", "line")
    earliest = found.groupBy("size", "head", "rank").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = found.join(earliest, ["size", "head", "rank"]).where(place > F.col("first"))
    return later.groupBy(*KEY).agg(F.collect_list(F.struct("line", "size")).alias("runs"))


def without_runs(text: bytes | None, runs: list[tuple[int, int]]) -> tuple[bytes | None, int, int]:
    """The text without the lines of ``runs``, its content lines and how many went."""
    _, places = content_lines(text)
    if not runs:
        return text, len(places), 0
    step = np.zeros(len(places) + 1, np.int64)
    for line, size in runs:
        step[line] += 1
        step[line + size] -= 1
    gone = {places[i] for i in np.flatnonzero(np.cumsum(step[:-1]) > 0)}
    return b"\n".join(x for i, x in enumerate((text or b"").split(b"\n")) if i not in gone), len(places), len(gone)


RUNS, HASH, SPOT, HAD = "__folio_runs", "__folio_hash", "__folio_spot", "__folio_had"


def cut_texts(texts: pa.Array, runs: list[list[dict] | None]) -> list[tuple[bytes | None, int, int]]:
    return [without_runs(t, [(r["line"], r["size"]) for r in own or ()]) for t, own in zip(texts.cast(pa.binary()).to_pylist(), runs)]


class Cut:
    """Output rows of documents: with their line counts, or as they were with ``n_chars`` renewed where lines went."""

    def __init__(self, docs: DataFrame, counted: bool) -> None:
        self.names, self.counted = docs.columns, counted
        self.text = docs.columns.index("text")
        self.size = docs.columns.index("n_chars") if "n_chars" in docs.columns and not counted else None
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        self.schema = f"{kinds}, {'n_lines long, n_removed long' if counted else HAD + ' boolean'}"

    def rows(self, batch: pa.RecordBatch, runs: list[list[dict] | None]) -> pa.RecordBatch:
        """``batch`` begins with the documents' columns."""
        arrays = list(batch.columns[: len(self.names)])
        old = arrays[self.text]
        new = cut_texts(old, runs)
        arrays[self.text] = pa.array([x[0] for x in new], pa.binary()).cast(pa.string())
        if self.size is not None:
            sizes = [len(x[0].decode()) if r and n is not None else n for x, r, n in zip(new, runs, arrays[self.size].to_pylist())]
            arrays[self.size] = pa.array(sizes, arrays[self.size].type)
        if self.counted:
            return pa.RecordBatch.from_arrays([*arrays, pa.array([x[1] for x in new], pa.int64()), pa.array([x[2] for x in new], pa.int64())], [*self.names, "n_lines", "n_removed"])
        return pa.RecordBatch.from_arrays([*arrays, pa.array([x[1] > 0 for x in new])], [*self.names, HAD])

    def unmarked(self, shared: Broadcast):
        """Rows that the bit map doesn't mark: nothing goes from them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for batch in batches:
                own = batch.filter(pa.array(~is_marked(batch, shared)))
                if own.num_rows:
                    yield self.rows(own, [None] * own.num_rows)

        return run

    def marked(self, shared: Broadcast):
        """Rows that it marks, with their hash, on the way to their runs."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for batch in batches:
                own = batch.filter(pa.array(is_marked(batch, shared)))
                yield pa.RecordBatch.from_arrays(own.columns[:-1], own.schema.names[:-1])

        return run

    def joined(self, batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            yield self.rows(batch, batch.column(batch.num_columns - 1).to_pylist())


def is_marked(batch: pa.RecordBatch, shared: Broadcast) -> np.ndarray:
    bits, at = shared.value, batch.column(batch.num_columns - 1).to_numpy()
    return (bits[at >> 6] >> (at & 63) & 1).astype(bool)


def cut_documents(docs: DataFrame, min_words: int, counted: bool) -> DataFrame:
    """``docs`` without the later copies; only texts that a bit map marks are shuffled to meet their runs."""
    folder, cut = shared_folder(docs.sparkSession), Cut(docs, counted)
    later = written(later_runs(docs, min_words, folder), folder, "later")
    shared, power = bit_map(later, "doc_hash")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = docs.select(*columns, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias(HASH))
    key = key.withColumn(SPOT, F.pmod(F.xxhash64(HASH), F.lit(1 << power)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    hit = key.mapInArrow(cut.marked(shared), f"{kinds}, {HASH} long")
    # a merge join whatever the size: a broadcast of the runs would only fit while they are few
    own = later.select(F.col("doc_id").alias("__folio_id"), F.col("doc_hash").alias("__folio_own"), F.col("runs").alias(RUNS)).hint("merge")
    met = hit.join(own, F.col("doc_id").cast("long").eqNullSafe(F.col("__folio_id")) & (F.col(HASH) == F.col("__folio_own")), "left")
    return met.select(*columns, RUNS).mapInArrow(cut.joined, cut.schema).unionByName(key.mapInArrow(cut.unmarked(shared), cut.schema))


def dedup_lines(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per row of ``docs``: doc_id, text, n_lines, n_removed.

    Of every run of lines with more than ``min_words`` words that occurs twice
    or more, the first copy stays and all later ones are deleted from their
    texts, within a document too; first is by doc_id (nulls last), then by the
    hash of the text, then by line. Lines are compared without the white space
    around them; blank lines lie outside runs and stay. ``n_lines`` counts the
    lines with text, ``n_removed`` those deleted. Null texts stay null, empty
    ones empty. Rows equal in doc_id and text are one document: they get the
    same result. Other columns are not read.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut_documents(plain, min_words, True)


def remove_repeats(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated runs deleted from ``text`` and, where there is such a column, ``n_chars`` renewed.

    A document of which no line is left goes, unless it had none before.
    """
    cut = cut_documents(docs, min_words, False)
    return cut.where(~F.col(HAD) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop(HAD)
