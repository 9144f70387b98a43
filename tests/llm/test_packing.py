import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from folio.llm import packing as p
from folio.llm.shared import tokenizer_file

PATH = tokenizer_file("word_bpe_49k.json")
ODD = ["<|ENDOFTEXT|> A<|endoftext|>B", " <|endoftext|>x <|startoftext|> don't we'll 123abc ", "Ａ b c　d ̈x é Σας ΟΔΟΣ İstanbul", "a\x85b\x1cc\x0bd ​", "日本語 😀", "½²a ªº ŉ ǅ ſ ÀÉ'LL 'tis '' — «q» a\xadb ÿ\x7f \xa0z", "".join(map(chr, range(0x21, 0x250)))]


def test_ids_are_the_tokenizers():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() + ODD
    tokenizer, own = Tokenizer.from_file(PATH), p.WordPieces(PATH)
    assert own.known
    for text in texts:
        assert np.frombuffer(own.text(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_fullest_by_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        available = {rng.randrange(1, 20): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(1, 40)
        sums = {0}
        for length, n in available.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        used = p.fullest(available, room)
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)
        assert all(n <= available[k] for k, n in used.items())


def fewest(counts, capacity):
    """A lower bound of the bins (long pieces can't share; what they leave holds only so much)."""
    best = 0
    for k in range(capacity // 2 + 1):
        alone = sum(n for x, n in counts.items() if x > capacity - k)
        long = {x: n for x, n in counts.items() if capacity / 2 < x <= capacity - k}
        short = sum(x * n for x, n in counts.items() if k <= x <= capacity / 2)
        room = sum(n * (capacity - x) for x, n in long.items())
        best = max(best, alone + sum(long.values()) + max(0, -(-(short - room) // capacity)))
    return best


def test_plan_places_every_piece_once():
    rng = random.Random(6)
    counts = {x: rng.randrange(1, 300) for x in rng.sample(range(1, 101), 30)}
    plan = p.minimum_bin_slack(counts, 100)
    placed: dict[int, int] = {}
    for c in plan:
        assert sum(length * n for length, n in c.used) <= 100
        for length, n in c.used:
            placed[length] = placed.get(length, 0) + n * c.times
    assert placed == counts
    bins = sum(c.times for c in plan)
    assert bins <= 1.05 * fewest(counts, 100) + 1
    assert p.minimum_bin_slack({}, 100) == []


def test_round_trip(spark, docs):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["tion", "the", "é,", "Word!"], k=rng.choice([0, 1, 5, 30, 200]))) for _ in range(80)] + [None, ""]
    rows = list(enumerate(texts)) + [(7, texts[7]), (None, "x y")]
    got = p.pack(docs(rows), capacity=64).collect()
    tokenizer = Tokenizer.from_file(PATH)
    expected = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), 64)):
            own = ids[start : start + 64]
            expected.append((i, k, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(expected, key=str)
    sequences: dict[int, list] = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(sequences) == list(range(len(sequences)))
    assert len(sequences) <= 1.05 * fewest(Counter(r.length for r in got), 64) + 1
    assert p.pack(docs(rows).limit(0)).count() == 0
