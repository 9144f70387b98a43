"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star edges.

Equal shingle sets are one class from the start, so copies cost nothing
further. A class is represented by its smallest doc_id. Each representative's
set is hashed once into ``BINS`` bins; an empty bin copies the one that a
fixed sequence of random draws hits first (optimal densification). ``ROWS``
bins make a band; a band's value is a bucket. With 32 bands of 4, a pair at
the threshold of 0.8 misses all buckets with probability 5e-8.

In every bucket each member is paired with one center only, the member that
comes first in one random order of all documents. These stars are confirmed
on full sets and joined to components. What a star can't see - two members
that are alike while neither is like the center - is left to buckets whose
members are still in different components: there the members' sets come
together, block against block, and pairs across components whose sizes and
signatures allow the threshold (six standard deviations of the estimate) are
confirmed in place, each in the first bucket that they share; only links leave
the task. So no link is lost for the sake of a bound on pairs.

Texts are never shuffled: sets are made where the texts lie, for documents that
a bit map of fixed largest size has marked as wanted.

Everything is keyed by documents or buckets in shuffles that combine before
they move; tables between steps are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import Memo, bit_map, shared_folder, small_batches, written

BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Shingles of a block of a bucket's members; a task holds two blocks.
BLOCK_SHINGLES = 4 << 20
#: Pairs of a block that a task looks at in one step, and those of them whose signatures lie beside each other.
STEP_PAIRS, STEP_SIGNED = 1 << 21, 1 << 15
MEMO_WORDS = 50_000  # twice as many hashes stay, about 10 MB a generation

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def draws() -> np.ndarray:
    """For each bin, the bins it asks in turn when it is empty; the same for all documents."""
    return np.random.default_rng(20_17).integers(0, BINS, (64 * BINS, BINS))


DRAWS = draws()

_hashes: dict[int, Memo] = {}


def word_hash() -> Memo:
    import xxhash

    return _hashes.setdefault(0, Memo(xxhash.xxh3_64_intdigest, MEMO_WORDS))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size`` words in a row; fewer words are one shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(size, n)
    out = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        out = mix(out * _M3 + words[i : n - width + 1 + i] + np.uint64(width))
    return np.unique(out)


def densified(hashes: np.ndarray) -> np.ndarray:
    """Minimum of each bin; empty bins take over the first non-empty one of their draws."""
    mixed = mix(hashes + _M3)
    place = (mixed >> np.uint64(57)).astype(np.int64)  # 128 bins
    out = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, place, mixed & np.uint64((1 << 57) - 1))
    full = np.zeros(BINS, bool)
    full[place] = True
    empty = np.flatnonzero(~full)
    if len(empty):
        source = out.copy()
        for start in range(0, len(DRAWS), 64):
            asked = DRAWS[start : start + 64, empty]
            hits = full[asked]
            first, found = hits.argmax(axis=0), hits.any(axis=0)
            out[empty[found]] = source[asked[first[found], np.flatnonzero(found)]]
            empty = empty[~found]
            if not len(empty):
                break
        else:
            out[empty] = source[full].min()
    return out


SIGNED = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, signature binary"


def sign(size: int, signatures: bool = True):
    """Per text: number of shingles, two hashes of the set, bands and a byte of each bin's minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        hash_of = word_hash().__getitem__
        weights = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _M3)
        for batch in batches:
            counts, first, second, bands, small = [], [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = np.array([hash_of(w) for w in (text or b"").lower().split()], np.uint64)
                hashes = shingle_hashes(words, size)
                counts.append(len(hashes))
                again = mix(hashes ^ _M2)
                first.append(int(mix(hashes).sum(dtype=np.uint64).view(np.int64)))
                second.append(int((again ^ (again >> np.uint64(7))).sum(dtype=np.uint64).view(np.int64)))
                if len(hashes):
                    minima = densified(hashes).reshape(BANDS, ROWS)
                    key = weights.copy()
                    for row in range(ROWS):
                        key = mix(key * _M3 + minima[:, row])
                    bands.append(key.view(np.int64))
                    small.append((minima.reshape(-1) & np.uint64(255)).astype(np.uint8).tobytes())
                else:
                    bands.append(np.zeros(0, np.int64))
                    small.append(b"")
            sizes = np.concatenate(([0], np.cumsum([len(x) for x in bands]))).astype(np.int32)
            array = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), array, pa.array(small, pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "bands", "signature"])
        _hashes.clear()  # the worker goes on to other operators

    return run


def shingle_sets(plain: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(doc, shingles) of at least the wanted documents: the bit map thins the texts where they are; its false hits do no harm. A set ascends as unsigned numbers."""
    shared, power = bit_map(wanted, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        hash_of = word_hash().__getitem__
        bits = shared.value
        for batch in batches:
            spot = batch.column(2).to_numpy()
            chosen = np.flatnonzero(bits[spot >> 6] >> (spot & 63) & 1)
            if not len(chosen):
                continue
            texts = batch.column(1).take(pa.array(chosen)).cast(pa.binary()).to_pylist()
            own = [shingle_hashes(np.array([hash_of(w) for w in (text or b"").lower().split()], np.uint64), size).view(np.int64) for text in texts]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(chosen)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own)))], ["doc", "shingles"])
        _hashes.clear()

    spots = plain.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << power)).alias("spot"))
    return spots.mapInArrow(run, "doc long, shingles array<long>")


def confirmed(pairs: DataFrame, plain: DataFrame, size: int, percent: int, folder: str) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    wanted = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    full = written(shingle_sets(plain, written(wanted, folder, "wanted"), size), folder, "sets")
    # merge joins whatever the size: a broadcast of the pairs would only fit while they are few
    left = pairs.hint("merge").join(full.select(F.col("doc").alias("b"), F.col("shingles").alias("s")), "b")
    both = left.hint("merge").join(full.select(F.col("doc").alias("a"), F.col("shingles").alias("t")), "a")
    common = F.size(F.array_intersect("s", "t"))
    union = F.size("s") + F.size("t") - common
    return both.where(100 * common.cast("long") >= percent * union.cast("long")).select("a", "b").distinct()


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(doc, component) of every end of an edge (a, b): the smallest id reachable, by large-star and small-star steps.

    Each step keeps one minimum per node and is written to the shared folder;
    steps end when a round changes nothing, told by a count and a checksum.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, last, turn = written(now, folder, f"{name}-0"), None, 0
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("u > m").select("u", F.col("m").alias("v"))).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v <> m").select("v", F.col("m")).toDF("u", "v").union(smallest.toDF("u", "v")).where("u <> v").distinct()
        turn += 1
        now = written(small, folder, f"{name}-{turn}")
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == last:
            return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "doc")
        last = state


def links_of_bucket(percent: int):
    """Confirmed links of one bucket's blocks across components, of pairs that share no earlier bucket."""

    def run(table: pa.Table) -> pa.Table:
        docs, comps, side, n = (table.column(c).to_numpy() for c in ("doc", "component", "block", "n_shingles"))
        matrix = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, BINS)
        keys = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        lists = table.column("shingles").combine_chunks()
        sets = np.split(lists.flatten().to_numpy().view(np.uint64), np.cumsum(pa.compute.list_value_length(lists).to_numpy())[:-1])
        band, low = table.column("band").to_numpy()[0], table.column("low").to_numpy()[0]
        left = np.flatnonzero(side == low)
        right = np.flatnonzero(side != low) if (side != low).any() else left
        p = percent / 100
        occupied = BINS * (1 - np.exp(-n / BINS))
        parent = {c: c for c in comps.tolist()}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        out: list[tuple[int, int]] = []
        rows = max(1, min(128, STEP_PAIRS // len(right)))
        for start in range(0, len(left), rows):
            some = left[start : start + rows]
            x, y = n[some][:, None], n[right][None, :]
            may = (comps[some][:, None] != comps[right][None, :]) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
            may &= (some[:, None] < right[None, :]) if right is left else True
            i, j = np.nonzero(may)
            for part in range(0, len(i), STEP_SIGNED):
                u, v = some[i[part : part + STEP_SIGNED]], right[j[part : part + STEP_SIGNED]]
                equal = matrix[u] == matrix[v]
                least = np.minimum(occupied[u], occupied[v])
                fine = equal.sum(axis=1) >= BINS * (p - 6 * np.sqrt(p * (1 - p) / least) - 1 / least)
                if band:
                    fine[fine] = ~(keys[u[fine], :band] == keys[v[fine], :band]).any(axis=1)
                for k, m in zip(u[fine].tolist(), v[fine].tolist()):
                    c, d = root(int(comps[k])), root(int(comps[m]))
                    if c == d:
                        continue
                    s, t = sets[k], sets[m]
                    at = np.searchsorted(s, t)
                    common = int((s[np.minimum(at, len(s) - 1)] == t).sum())
                    if 100 * common >= percent * (len(s) + len(t) - common):
                        parent[c] = d
                        out.append((int(docs[k]), int(docs[m])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return run


def clusters(docs: DataFrame, *, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are what lies between ASCII white space, A-Z lower-cased; a text's
    set is its distinct runs of ``shingle_words`` words, or all its words as
    one run where it has fewer. Two documents are linked from ``percent`` of
    the union in common. ``component_id`` is the smallest doc_id reachable,
    ``kept`` whether that is the row's own. Null, empty and blank texts have
    no set and are linked with nothing. Rows of one doc_id are one node; a row
    with a null doc_id is linked with nothing, has no component and is kept.
    Repeated rows get a row each; other columns are not read.
    """
    folder = shared_folder(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        signed = written(plain.mapInArrow(sign(shingle_words), SIGNED), folder, "signed")
        return labelled(signed, plain, folder, shingle_words, percent)


def labelled(signed: DataFrame, plain: DataFrame, folder: str, size: int, percent: int) -> DataFrame:
    known = signed.where("doc_id is not null and n_shingles > 0")
    classes = written(known.groupBy("f1", "f2").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("rows"), F.min("n_shingles").alias("n_shingles"), F.min(F.struct("doc_id", "bands", "signature")).alias("own")), folder, "classes")
    bands = classes.select("doc", "n_shingles", F.posexplode("own.bands").alias("band", "bucket"))
    order = F.min(F.struct(F.xxhash64("doc").alias("o"), "doc", "n_shingles"))
    buckets = written(bands.groupBy("bucket").agg(order.alias("c"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles_in")).where("n > 1").select("bucket", "n", "shingles_in", F.col("c.doc").alias("center"), F.col("c.n_shingles").alias("center_size")), folder, "buckets")
    members = written(bands.join(buckets, "bucket"), folder, "members")
    sized = F.expr(f"100 * least(n_shingles, center_size) >= {percent} * greatest(n_shingles, center_size)")
    stars = members.where((F.col("doc") != F.col("center")) & sized).select(F.least("doc", "center").alias("a"), F.greatest("doc", "center").alias("b")).distinct()
    links = written(confirmed(written(stars, folder, "stars"), plain, size, percent, folder), folder, "links")
    # rows of one doc_id but different sets are one node, and so are rows of one set
    same = known.join(classes.where("rows > 1").select("f1", "f2", "doc"), ["f1", "f2"]).where("doc_id <> doc").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    linked = components(links, folder, "star-components")
    left = members.where("n > 2").join(linked, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    open_ = left.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    inside = written(left.join(open_, "bucket").select("bucket", "band", "shingles_in", "doc", "component", "n_shingles"), folder, "open")
    wanted = written(inside.select("doc").distinct(), folder, "open-docs")
    blocks = F.ceil(F.col("shingles_in") / BLOCK_SHINGLES).cast("int")
    full = shingle_sets(plain, wanted, size).join(classes.select("doc", F.col("own.bands").alias("bands"), F.col("own.signature").alias("signature")), "doc")
    inside = inside.withColumn("block", F.pmod(F.xxhash64("doc"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    inside = inside.select("bucket", "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "doc", "component", "n_shingles").join(full, "doc")
    more = inside.groupBy("bucket", "low", "high").applyInArrow(links_of_bucket(percent), "a long, b long")
    final = components(links.union(written(more, folder, "more")).union(same), folder, "components")
    rows = signed.select("doc_id", "n_shingles").join(final, signed["doc_id"] == final["doc"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, *, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``clusters`` keeps, columns as they are."""
    gone = clusters(docs, shingle_words=shingle_words, percent=percent).where(~F.col("kept")).select(F.col("doc_id").alias("__folio_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__folio_gone"], "left_anti")
