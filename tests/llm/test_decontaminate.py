import hashlib
import pickle
import random

from folio.llm import decontaminate as d

ITEMS = "item_id long, text string"


def brute(texts, items, window=10):
    windows = {}
    for name, text in items:
        words = d.split_words(text.encode())
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(name)
    out = []
    for text in texts:
        words, hit, own = d.split_words((text or "").encode()), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if names := windows.get(tuple(words[i : i + size])):
                    hit.update(range(i, i + size))
                    own |= names
        out.append((len(words), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()))
    return out


def test_words():
    assert d.split_words("Ab-c1 É_é\tx".encode()) == [b"ab", b"c1", "É".encode(), "é".encode(), b"x"]
    assert d.split_words(None) == []


def test_against_brute_force(spark, docs):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 25, 70])))) for i in range(30)] + [(100, ""), (101, "only once"), (101, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")]
    texts = [" ".join(rng.choices(vocabulary + ["other"], k=rng.choice([0, 5, 60, 400]))) for _ in range(60)]
    texts += [f"x {items[4][1]} y", items[5][1].upper(), None, "", "w1", "w1" * 3, items[6][1] * 3]
    rows = list(enumerate(texts)) + [(None, items[3][1]), (5, texts[5])]
    got = d.decontaminate(docs(rows), spark.createDataFrame([*items, (None, "null item of several words")], ITEMS)).collect()
    names = [(str(i), t) for i, t in items] + [("", "null item of several words")]
    expected = sorted(zip([i for i, _ in rows], brute([t for _, t in rows], names)), key=str)
    assert sorted(((r.doc_id, (r.n_words, r.n_hit, r.n_items, r.items_sha256)) for r in got), key=str) == expected
    assert all(r.contaminated == (r.n_hit > 0) for r in got)


def test_longest_matches(spark, docs):
    item = " ".join(f"a{i}" for i in range(40))
    text = "a5 " + " ".join(f"a{i}" for i in range(5, 30)) + " stop " + " ".join(f"a{i}" for i in range(12))
    bench = spark.createDataFrame([(7, item)], ITEMS)
    got = sorted((r.item_word, r.doc_word, r.n_words) for r in d.longest_matches(docs([(1, text)]), bench).collect())
    assert got == [(0, 27, 12), (5, 1, 25)]
    assert d.decontaminate(docs([(1, text)]), bench).first().longest_match == 25


def test_removal_and_empty_tables(spark, docs):
    bench = spark.createDataFrame([(1, "one two three")], ITEMS)
    table = docs([(1, "zero one two three four"), (2, "one two"), (3, None)])
    kept = d.remove_contaminated(table, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3] and kept.columns == table.columns
    nothing = spark.createDataFrame([], ITEMS)
    assert d.decontaminate(table, nothing).where("contaminated").count() == 0
    assert d.decontaminate(table.limit(0), bench).count() == 0


def test_parts_of_a_benchmark_find_the_same(spark, docs):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(15)]
    items = [(i % 20, " ".join(rng.choices(vocabulary, k=rng.choice([2, 9, 12, 40])))) for i in range(50)]
    bench = spark.createDataFrame([*items, *items], ITEMS)
    rows = [(i, " ".join(rng.choices(vocabulary, k=300))) for i in range(40)] + [(99, items[3][1] + " x " + items[7][1])]
    size = sum(len(t) for _, t in set(items))
    assert len(d.prepared(bench, 10, size // 3 + 1)) == 3
    whole, parts = (sorted(map(tuple, d.decontaminate(docs(rows), bench, part_bytes=n).collect())) for n in (1 << 20, size // 3 + 1))
    assert whole == parts and [r[1:5] for r in whole] == brute([t for _, t in rows], [(str(i), t) for i, t in items])
    kept = d.remove_contaminated(docs([*rows, (100, "clean")]), bench, part_bytes=size // 3 + 1)
    assert [r.doc_id for r in kept.collect()] == [100]
    matches = [sorted(map(tuple, d.longest_matches(docs(rows), bench, part_bytes=n).collect())) for n in (1 << 20, size // 3 + 1)]
    assert matches[0] == matches[1]


def test_a_benchmark_takes_ten_times_its_text():
    rng = random.Random(1)
    items = [(str(i), " ".join(f"t{rng.randint(0, 20_000)}" for _ in range(200)).encode()) for i in range(1000)]
    assert len(pickle.dumps(d.Benchmark(items))) < 20 * sum(len(t) for _, t in items)


def test_long_text_is_split_into_shards(spark, docs, monkeypatch):
    item = " ".join(f"b{i}" for i in range(12))
    text = " ".join(f"w{i}" for i in range(200_000)) + " " + item
    row = d.decontaminate(docs([(1, text)]), spark.createDataFrame([(1, item)], ITEMS)).first()
    assert (row.n_words, row.n_hit) == (200_012, 12)
