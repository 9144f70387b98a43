"""Benchmark decontamination with suffix arrays of the training text.

Every batch of documents is a shard. Its words become ids of the benchmark's
vocabulary; words outside it end every match, so the suffix array holds the
stretches of known words that are long enough for a window (shorter ones can't
contain any) and is sorted by prefix doubling to the length of the longest
item (no match is longer). Every suffix of every item is binary-searched in
it; the interval of suffixes that begin with the item's window are the
window's occurrences, and each is then extended to its longest match.

Documents stay where they are: no shuffle. The benchmark is cut into parts of
about ``PART_BYTES`` of text, each built on an executor into flat arrays and
written to the shared folder; a worker has one part at a time (about ten times
its text; a longer item is a part of its own) and puts what the parts find in
a shard together. A benchmark of one part is loaded once a process.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import filesystem, shared_folder

WINDOW = 10
PART_BYTES = 8 << 20
SHARD_WORDS = 1_000_000

#: A-Z to lower case; every other ASCII character that isn't a letter or digit separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def split_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class Benchmark:
    """Items as word ids (from 1) in a row, and their distinct windows with the places and items of each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        texts = [(number[name], np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in own], np.int32)) for name, text in items if (own := split_words(text))]
        lengths = np.array([len(x) for _, x in texts], np.int64)
        self.owner = np.array([x for x, _ in texts], np.int64)
        self.words = np.concatenate([x for _, x in texts]) if texts else np.zeros(0, np.int32)
        self.first = np.cumsum(lengths) - lengths
        self.last = self.first + lengths
        size = np.minimum(lengths, window)
        count = lengths - size + 1
        text = np.repeat(np.arange(len(texts)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - self.first, count)
        self.shortest = int(size.min()) if len(size) else 0
        self.longest = int(lengths.max()) if len(size) else 0
        self.bits = max(1, int(len(self.ids)).bit_length())
        self.per = 62 // self.bits  # words in one packed integer
        table = np.zeros((len(at), -(-window // self.per) * self.per), np.int32)
        for i in range(window):
            inside = size[text] > i
            table[inside, i] = self.words[at[inside] + i]
        rows = pack_rows(table, self.per, self.bits)
        self.packed, inverse = np.unique(rows, axis=0, return_inverse=True)
        inverse = inverse.reshape(-1)
        order = np.argsort(inverse, kind="stable")
        self.sizes = np.zeros(len(self.packed), np.int64)
        self.sizes[inverse] = size[text]
        #: places by window: word in the row, text
        self.place, self.text = at[order], text[order]
        self.place_first = np.searchsorted(inverse[order], np.arange(len(self.packed) + 1))
        pairs = np.unique(np.stack((inverse, self.owner[text]), 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        self.item = pairs[:, 1]
        self.item_first = np.searchsorted(pairs[:, 0], np.arange(len(self.packed) + 1))


def pack_rows(table: np.ndarray, per: int, bits: int) -> np.ndarray:
    """Rows of ids as rows of integers of ``per`` ids, in the same order."""
    blocks = table.reshape(len(table), table.shape[1] // per, per)
    weights = np.array([1 << bits * (per - 1 - i) for i in range(per)], np.int64)
    out = np.zeros(blocks.shape[:2], np.int64)
    for i, weight in enumerate(weights):
        out += blocks[:, :, i] * weight
    return out


def known_stretches(words: np.ndarray, least: int) -> np.ndarray:
    """Positions of stretches of at least ``least`` known words (ids above 0), in order."""
    known = np.concatenate(([0], (words > 0).view(np.int8), [0]))
    edge = np.diff(known)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = last - first >= least
    first, last = first[keep], last[keep]
    sizes = last - first
    if not len(sizes):
        return np.zeros(0, np.int64)
    return np.repeat(first - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())


class Shard:
    """The suffix array of a shard's known stretches, with one 0 after each."""

    def __init__(self, words: np.ndarray, bench: Benchmark) -> None:
        self.bench = bench
        at = known_stretches(words, bench.shortest)
        gap = np.flatnonzero(np.diff(at) > 1) + 1
        self.text = np.concatenate((np.insert(words[at], gap, 0), [0])) if len(at) else np.zeros(0, np.int64)
        self.at = np.concatenate((np.insert(at, gap, -1), [-1])) if len(at) else np.zeros(0, np.int64)
        n, per, bits = len(self.text), bench.per, bench.bits
        # the first ``per`` words of each suffix in one integer, with nothing after a 0
        self.packed = np.zeros(n, np.int64)
        alive = np.ones(n, bool)
        for i in range(per):
            here = np.zeros(n, np.int64)
            here[: max(0, n - i)] = self.text[i:]
            alive &= here > 0
            self.packed |= np.where(alive, here, 0) << bits * (per - 1 - i)
        self.order = np.argsort(self.packed, kind="stable")
        rank = self.ranks(self.packed[self.order])
        depth = per
        while n and depth < bench.longest and rank.max() < n - 1:
            after = np.zeros(n, np.int64)
            after[: max(0, n - depth)] = rank[depth:] + 1
            after[self.packed & ((1 << bits) - 1) == 0] = 0  # it ended within the first words: equal for good
            key = rank * (n + 1) + after
            self.order = np.argsort(key, kind="stable")
            new = self.ranks(key[self.order])
            if np.array_equal(new, rank):
                break
            rank, depth = new, depth * 2

    def ranks(self, ordered: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ordered), np.int64)
        if len(ordered):
            out[self.order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        return out

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window, the interval of the suffix array that begins with it, by binary search."""
        bench, n = self.bench, len(self.text)
        lower, upper = (np.zeros(len(bench.sizes), np.int64) for _ in range(2))
        for out, strict in ((lower, False), (upper, True)):
            low, high = out, np.full(len(bench.sizes), n, np.int64)
            while (open_ := low < high).any():
                middle = (low + high) >> 1
                sign = self.compare(middle, open_)
                right = open_ & ((sign <= 0) if strict else (sign < 0))
                low[right] = middle[right] + 1
                high[open_ & ~right] = middle[open_ & ~right]
        return lower, upper

    def compare(self, ranks: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Suffix against window, cut to the window's length: -1, 0 or 1."""
        bench, n = self.bench, len(self.text)
        sign, todo = np.zeros(len(ranks), np.int64), np.flatnonzero(which)
        for block in range(bench.packed.shape[1]):
            start = self.order[ranks[todo]] + block * bench.per
            theirs = np.where(start < n, self.packed[np.minimum(start, n - 1)], 0)
            inside = np.clip(bench.sizes[todo] - block * bench.per, 0, bench.per)
            shift = bench.bits * (bench.per - inside)
            difference = np.sign((theirs >> shift) - (bench.packed[todo, block] >> shift))
            sign[todo] = difference
            todo = todo[(difference == 0) & (bench.sizes[todo] > (block + 1) * bench.per)]
            if not len(todo):
                break
        return sign

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """Windows and the positions in the shard's words where they occur."""
        lower, upper = self.bounds()
        sizes = upper - lower
        which = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return which, self.at[self.order[np.repeat(lower, sizes) + inside]]


def shard_words(texts: list[bytes | None], ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all words with a 0 after each text; each text's first position and number of words."""
    get, out, sizes = ids.get, [], []
    for text in texts:
        own = split_words(text)
        sizes.append(len(own))
        out.append(np.array([get(w, 0) for w in own] + [0], np.int64))
    counts = np.array(sizes, np.int64)
    return np.concatenate(out), np.cumsum(counts + 1) - counts - 1, counts


def shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list]]:
    """Ids and texts of about ``limit`` words; a longer text is a shard of its own."""
    ids: list = []
    texts: list = []
    room = limit * 6
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            size = len(text or b"")
            if texts and size > room:
                yield ids, texts
                ids, texts, room = [], [], limit * 6
            ids.append(key)
            texts.append(text)
            room -= size
    if texts:
        yield ids, texts


def prepared(benchmark: DataFrame, window: int, part_bytes: int) -> list[str]:
    """URIs of the benchmark's parts, built and written by the executors; rows are dealt out by their hash."""
    folder = shared_folder(benchmark.sparkSession)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // part_bytes)

    def build(table: pa.Table) -> pa.Table:
        rows = table.select(["item_id", "text"]).sort_by([("item_id", "ascending"), ("text", "ascending")])
        bench = Benchmark(list(zip(rows.column(0).to_pylist(), rows.column(1).cast(pa.binary()).to_pylist())), window)
        system, path = filesystem(folder)
        name = f"{folder}/benchmark-{uuid.uuid4().hex}"  # of this attempt
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{name.rpartition('/')[2]}", compression=None) as out:
            out.write(pickle.dumps(bench, 5))
        return pa.table({"uri": [name]})

    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, parts))))
    return sorted(r.uri for r in dealt.groupBy("part").applyInArrow(build, "uri string").collect())


_loaded: dict[str, Benchmark] = {}


def loaded(uri: str) -> Benchmark:
    """A part; the last one stays in the process."""
    if uri not in _loaded:
        _loaded.clear()
        system, path = filesystem(uri)
        with system.open_input_file(path) as file:
            _loaded[uri] = pickle.loads(file.read())
    return _loaded[uri]


REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, longest_match long, contaminated boolean"


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, longest_match, contaminated.

    A word is hit inside any occurrence of a window (``window`` consecutive
    words of an item; all its words where it has fewer). ``longest_match`` is
    the longest verbatim run of words shared with an item, 0 without a window.
    Null and empty texts have no words. Items without words have no window; a
    null item_id counts as ''. Rows of one item_id are one item. Repeated rows
    and null doc_ids get a row each. Other columns are not read.
    """
    uris = prepared(benchmark, window, part_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for ids, texts in shards(batches, SHARD_WORDS):
            counts, hits, owners, longest = search(texts, uris)
            digests = [hashlib.sha256(",".join(own).encode()).hexdigest() for own in owners]
            columns = [pa.array(ids, pa.int64()), pa.array(counts), pa.array(hits), pa.array([len(x) for x in owners], pa.int64()), pa.array(digests), pa.array(longest), pa.array(hits > 0)]
            yield pa.RecordBatch.from_arrays(columns, REPORT.replace(",", "").split()[::2])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, REPORT)


def extend(words: np.ndarray, starts: np.ndarray, item: np.ndarray, offset: int, size: int) -> np.ndarray:
    """How far each occurrence of the item's window goes on word by word."""
    length = np.full(len(starts), size, np.int64)
    going = np.arange(len(starts))
    while len(going) and offset + size < len(item):
        going = going[words[starts[going] + size] == item[offset + size]]
        size += 1
        length[going] = size
    return length


def search(texts: list[bytes | None], uris: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[str]], np.ndarray]:
    """Per document: its words, words hit, names of the items found (sorted) and the longest match, over all parts."""
    counts = longest = step = first = None
    owners: list[set[str]] = [set() for _ in texts]
    for uri in uris or [None]:
        bench = loaded(uri) if uri else Benchmark([])
        words, first, counts = shard_words(texts, bench.ids)
        if step is None:
            step, longest = np.zeros(len(words) + 1, np.int64), np.zeros(len(texts), np.int64)
        shard = Shard(words, bench)
        if not len(shard.text):
            continue
        which, at = shard.occurrences()
        if not len(which):
            continue
        np.add.at(step, at, 1)
        np.add.at(step, at + bench.sizes[which], -1)
        doc = np.searchsorted(first, at, "right") - 1
        for d, w in np.unique(np.stack((doc, which), 1), axis=0).tolist():
            owners[d].update(bench.names[i] for i in bench.item[bench.item_first[w] : bench.item_first[w + 1]])
        for _, _, starts, length in maximal(words, which, at, bench):
            np.maximum.at(longest, np.searchsorted(first, starts, "right") - 1, length)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(step[:-1]) > 0)))
    hits = covered[np.concatenate((first[1:], [len(step) - 1]))] - covered[first]
    return counts, hits, [sorted(x) for x in owners], longest


def maximal(words: np.ndarray, which: np.ndarray, at: np.ndarray, bench: Benchmark) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Text of the benchmark, word in it, starts and lengths of the matches that can't be extended to either side."""
    cut = np.flatnonzero(np.diff(which)) + 1  # windows come in order
    for starts, key in zip(np.split(at, cut), which[np.concatenate(([0], cut))] if len(which) else ()):
        before = np.where(starts > 0, words[np.maximum(starts - 1, 0)], 0)
        for spot in range(bench.place_first[key], bench.place_first[key + 1]):
            text, place = int(bench.text[spot]), int(bench.place[spot])
            item, offset = bench.words[bench.first[text] : bench.last[text]], place - int(bench.first[text])
            new = starts[before != item[offset - 1]] if offset else starts
            if len(new):
                yield text, offset, new, extend(words, new, item, offset, int(bench.sizes[key]))


MATCHES = "doc_id long, item_id string, item_word long, doc_word long, n_words long"


def longest_matches(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Verbatim matches that can't be extended to either side: doc_id, item_id, item_word, doc_word, n_words (positions from 0).

    Nulls, empty texts and repeated rows are as in ``decontaminate``.
    """
    uris = prepared(benchmark, window, part_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for ids, texts in shards(batches, SHARD_WORDS):
            for uri in uris:
                bench = loaded(uri)
                words, first, _ = shard_words(texts, bench.ids)
                shard = Shard(words, bench)
                if not len(shard.text):
                    continue
                which, at = shard.occurrences()
                out: list[tuple] = []
                for text, offset, starts, lengths in maximal(words, which, at, bench):
                    for start, length in zip(starts, lengths):
                        doc = int(np.searchsorted(first, start, "right") - 1)
                        out.append((ids[doc], bench.names[bench.owner[text]], offset, int(start - first[doc]), int(length)))
                if out:
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], MATCHES.replace(",", "").split()[::2])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, MATCHES)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` without the rows whose text has any window of the benchmark; columns and other rows as they are.

    Null and empty texts stay, and so do repeated rows and rows with a null
    doc_id whose text is clean; an empty benchmark removes nothing.
    """
    uris = prepared(benchmark, window, part_bytes)
    position = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(position).cast(pa.binary()).to_pylist()
            if not texts:
                continue
            keep: list[bool] = []
            for _, part in shards(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], ["row", "text"])]), SHARD_WORDS):
                keep += (search(part, uris)[1] == 0).tolist()
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


#: DuckDB SQL of the query op1: windows as strings, joined with every document's windows of the same size.
REPORT_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_nr, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, w, least(len(w), 10) AS size FROM (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark)
  WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT item_id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM b)),
own AS (
  SELECT row_nr, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT row_nr, w, size, unnest(range(1, CAST(len(w) - size + 2 AS BIGINT))) AS i FROM d CROSS JOIN (SELECT DISTINCT size FROM windows))),
hits AS (SELECT own.row_nr, own.size, own.i, windows.item_id FROM own JOIN windows USING (size, win)),
words AS (SELECT row_nr, count(DISTINCT spot) AS n_hit FROM (SELECT row_nr, unnest(range(i, i + size)) AS spot FROM hits) GROUP BY row_nr),
items AS (SELECT row_nr, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row_nr, item_id FROM hits) GROUP BY row_nr)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row_nr) LEFT JOIN items USING (row_nr)
"""
