import random
import time
import tracemalloc

import pyarrow.parquet as pq
from tokenizers import Tokenizer, models, pre_tokenizers

from folio.llm import token_counts as t
from folio.llm.shared import tokenizer_file

ODD = ["", " ", "  a  b ", "▁a ▁ b▁▁c", "日本語 テスト 😀😀 x", "\x00 a\x01b", "<s> <unk> <0x41>", "a\nb\r\nc\td", "é" * 50, "é́", "word" * 3000, "😀" * 500 + "a😀", "😀a" * 300, "\U0001f9ff\u0378" * 40]


def reference(vocabulary, byte_fallback):
    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return tokenizer


def test_exact_counts(spark, docs):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() + ODD
    tokenizer = reference(t.vocabulary(tokenizer_file("piece_bpe_32k.model")), True)
    got = {r.doc_id: r.n_tokens for r in t.count_tokens(docs(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == [len(tokenizer.encode(x, add_special_tokens=False).ids) for x in texts]


def test_ties_and_unknown_characters():
    vocabulary = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("bb", -2.0), ("bbb", -3.0), ("aé", -5.0)]
    tokenizer, counter = reference(vocabulary, False), t.Counter(vocabulary, False)
    for text in ["ab", "abb", "abbb", "bbbb", "aéb", "éé", "aééb c", "xaxb", "b é é", "abab aé"]:
        assert sum(counter.run(w)[0] for w in t.words(text)) == len(tokenizer.encode(text, add_special_tokens=False).ids), text


def test_random_texts():
    rng, alphabet = random.Random(4), "aab be▁é語😀."
    vocabulary = [("<unk>", 0.0), ("▁", -2.0), *{"".join(rng.choices("abe▁", k=rng.randint(1, 5))): -float(rng.randint(1, 9)) for _ in range(60)}.items()]
    vocabulary = list({p: (p, s) for p, s in vocabulary}.values())
    tokenizer, counter = reference(vocabulary, False), t.Counter(vocabulary, False)
    for _ in range(500):
        text = "".join(rng.choices(alphabet, k=rng.randint(1, 60)))
        assert sum(counter.run(w)[0] for w in t.words(text)) == len(tokenizer.encode(text, add_special_tokens=False).ids), text


def test_a_million_unknown_characters():
    counter = t.Counter(t.vocabulary(tokenizer_file("piece_bpe_32k.model")))
    took = []
    for n in (100_000, 1_000_000):
        start = time.process_time()
        assert counter.run("▁" + "\U0001f9ff" * n)[0] == 4 * n + 1
        took.append(time.process_time() - start)
    assert took[1] < 30 * took[0]  # ten times the characters
    tracemalloc.start()
    counter.run("▁" + "\U0001f9ff" * 50_000)
    assert tracemalloc.get_traced_memory()[1] < 2 << 20
    tracemalloc.stop()


def test_edge_rows(spark, docs):
    got = t.count_tokens(docs([(1, None), (2, ""), (None, "a"), (None, "a")]))
    assert sorted((str(r.doc_id), r.n_tokens) for r in got.collect())[:2] == [("1", 0), ("2", 0)] and got.count() == 4
    assert t.count_tokens(docs([(1, "a")]).limit(0)).count() == 0
