import random
import tracemalloc

import numpy as np
import pyarrow as pa

from folio.llm import minhash as m


def brute(rows, size, percent):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([1, 2, 6, 30, 200]))]
        for _ in range(rng.choice([1, 1, 2, 8])):
            own = list(base)
            for _ in range(rng.randrange(0, max(1, len(own) // 7) + 1)):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    rng.shuffle(rows)
    return rows


def check(spark, docs, rows, size, percent=80):
    got = m.clusters(docs(rows), shingle_words=size, percent=percent).collect()
    expected = brute(rows, size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_against_brute_force(spark, docs):
    rows = corpus(1) + [(900, None), (901, ""), (902, " \n"), (903, "One  two\tTHREE"), (904, "one two three"), (905, "x" * 200_000), (906, "x" * 200_000)]
    check(spark, docs, rows, 2)


def test_members_unlike_their_center_are_linked(spark, docs, monkeypatch):
    """A ring of texts, each like its neighbours only, through buckets of several members and small blocks."""
    monkeypatch.setattr(m, "BLOCK_SHINGLES", 900)
    words = [f"w{i}" for i in range(300)]
    check(spark, docs, [(i, " ".join(words[9 * i : 9 * i + 120])) for i in range(20)], 1)


def test_members_like_the_base_only_are_linked(spark, docs):
    """Variants of one base, unlike each other: where a variant is the center, the stars see no link."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = [(500, " ".join(base))]
    for i in range(60):
        own = list(base)
        for k in rng.sample(range(120), 12):
            own[k] = f"v{i}x{k}"
        rows.append((i, " ".join(own)))
    check(spark, docs, rows, 1)


def bucket(sets, band=0, bands=None):
    """A bucket's table of one block, each member a component of its own."""
    n = len(sets)
    signature = [(m.densified(s) & np.uint64(255)).astype(np.uint8).tobytes() for s in sets]
    columns = {"doc": range(n), "component": range(n), "block": [0] * n, "low": [0] * n, "band": [band] * n, "n_shingles": map(len, sets)}
    table = {name: pa.array(list(x), pa.int64()) for name, x in columns.items()}
    bands = [[0] * m.BANDS] * n if bands is None else bands
    return pa.table(table | {"bands": pa.array(bands, pa.list_(pa.int64())), "signature": pa.array(signature, pa.binary()), "shingles": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})


def test_identical_sets_of_a_bucket_are_linked():
    rng = np.random.default_rng(4)
    for n in (20, 120, 2000):
        own = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        other = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert m.links_of_bucket(80)(bucket([own, other, own])).to_pylist() == [{"a": 0, "b": 2}]


def test_only_a_shared_earlier_bucket_leaves_a_pair_out():
    """Equal low bytes in an earlier band aren't a shared bucket."""
    own = np.unique(np.random.default_rng(6).integers(0, 2**64, 200, dtype=np.uint64))
    apart, shared = [list(range(m.BANDS)), [-1, *range(1, m.BANDS)]], [list(range(m.BANDS))] * 2
    assert m.links_of_bucket(80)(bucket([own, own], 1, apart)).to_pylist() == [{"a": 0, "b": 1}]
    assert m.links_of_bucket(80)(bucket([own, own], 2, shared)).num_rows == 0


def test_the_pairs_of_a_wide_bucket_take_bounded_memory():
    rng = np.random.default_rng(8)
    table = bucket([np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64)) for _ in range(2000)])
    tracemalloc.start()
    try:
        assert m.links_of_bucket(80)(table).num_rows == 0
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()


def test_long_texts_come_to_python_in_small_batches(spark, monkeypatch):
    sign, key = m.sign, "spark.sql.execution.arrow.maxBytesPerBatch"

    def checked(size):
        def run(batches):
            def each():
                for batch in batches:
                    assert batch.nbytes < 8 << 20
                    yield batch

            return sign(size)(each())

        return run

    monkeypatch.setattr(m, "sign", checked)
    before = spark.conf.get(key)
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 2000) AS text")
    assert m.clusters(docs, shingle_words=2).where("kept AND n_shingles = 1").count() == 3000
    assert spark.conf.get(key) == before


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    for n in (3, 40, 2000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[: int(n * 0.9)], rng.integers(0, 2**63, n - int(n * 0.9)).astype(np.uint64))))
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((m.densified(a) == m.densified(b)).mean() - exact) < 0.2


def test_edge_rows(spark, docs):
    text = "a b c d e f g h"
    table = docs([(5, text), (5, text), (None, text), (7, text), (7, "other words than these are"), (8, "x y z")])
    got = sorted(((str(r.doc_id), r.component_id, r.kept) for r in m.clusters(table).collect()), key=str)
    assert got == [("5", 5, True), ("5", 5, True), ("7", 5, False), ("7", 5, False), ("8", 8, True), ("None", None, True)]
    kept = m.keep_one(table)
    assert kept.columns == table.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["5", "5", "8", "None"]
    assert m.clusters(table.limit(0)).count() == 0
