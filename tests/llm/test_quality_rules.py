import math
import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from folio.llm import quality_rules as q
from folio.llm.shared import written

LABELS = "doc_id long, quality int, toxic int"


def measures(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed


def test_measures(spark, docs):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "a b", "x " * 30, "é#|  b\x0bc\x0c\r\nb\n\nb\n b", "a b c d e f g h " * 3 + "z", " ".join(f"w{i}" for i in range(40)), " ".join(rng.choices("abc", k=300)), "word " * 50_000]
    texts += ["\n".join(" ".join(rng.choices(["aa", "bb", "😀", "ü"], k=9)) for _ in range(9)) for _ in range(8)]
    got = q.judge(docs(list(enumerate(texts))), spark.createDataFrame([], LABELS)).sort("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got] == [measures(t) for t in texts]
    assert all(r.kept != r.base_failed for r in got)  # nothing else without labels


def test_binomial_tail_is_exact(spark):
    rows = [(n, k) for n in (1, 7, 60, 900, 20_000) for k in (0, 1, 3, 40) if k <= n]
    table = spark.createDataFrame(rows, "n long, k long")
    for p in (0.5, 0.01):
        for r in table.select("n", "k", q.binomial_tail(F.col("n"), F.col("k"), F.lit(p)).alias("p")).collect():
            exact = 1.0 if r.k >= r.n else sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(p) + (r.n - i) * math.log(1 - p)) for i in range(r.k + 1))
            assert math.isclose(r.p, exact, rel_tol=1e-9, abs_tol=1e-300)


def corpus(spark, n, share=0.2):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        poor = rng.random() < share
        words = [f"w{rng.randrange(9999)}" for _ in range(40)]
        rows.append((i, " ".join(w + "!!" for w in words) if poor else " ".join(words), "en" if i % 2 else None))
        labels.append((i, int(not poor), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, LABELS), {i for i, quality, _ in labels if not quality}


def test_certified_cutoffs_reject_the_poor_and_keep_the_good(spark):
    table, labels, poor = corpus(spark, 5000)
    got = q.judge(table, labels)
    assert {r.doc_id for r in got.where("not kept").collect()} == poor


def test_too_few_labels_certify_nothing(spark):
    table, labels, _ = corpus(spark, 300)
    assert q.judge(table, labels).where("not kept").count() == 0


def test_keep_good_leaves_rows_as_they_are(spark, docs):
    good = " ".join(f"w{i}" for i in range(30))
    table = docs([(1, good), (None, good), (2, "short"), (3, None), (1, good)])
    kept = q.keep_good(table, spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 0)], LABELS))
    assert kept.columns == table.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "None"]
    assert q.keep_good(table.limit(0), spark.createDataFrame([], LABELS)).count() == 0


def varied(rng, stratum, poor):
    """A text whose fault, where poor, is one of the six features; small strata are too small for a cutoff."""
    words = [f"w{rng.randrange(99999)}" for _ in range(30)]
    fault = rng.choice(list(q.GRID)) if poor else None
    if fault == "bang":
        words = [w + "!" for w in words]
    elif fault == "symbols":
        words = [w + "#$" for w in words]
    elif fault == "upper":
        words = [w.upper() + "ABCD" for w in words]
    elif fault == "long_words":
        words = [w * 3 for w in words]
    elif fault == "repeats":
        words = words + words[:8] + [f"v{rng.randrange(9)}" for _ in range(24)]
    text = " ".join(words)
    return text + "\n" + "\n".join(["same line here", "another line"] * 6) if fault == "dup_lines" else text


def test_certified_cutoffs_equal_those_of_sql(spark, tmp_path):
    rng, rows, labels = random.Random(9), [], []
    for i in range(12_000):
        lang = rng.choices(["aa", "bb", None, "rare"], [10, 6, 4, 0.2])[0]
        poor = rng.random() < 0.25
        rows.append((i, varied(rng, lang, poor), lang))
        labels.append((i, int(not poor) if lang != "bb" or rng.random() < 0.97 else 1, 0))
    rows += [rows[0], (None, rows[1][1], "aa")]
    labels += [(None, 1, 0), (5, None, 0), labels[0]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    connection = duckdb.connect()
    for name in ("documents", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    head, tail = q.JUDGE_SQL.rsplit("SELECT doc_id, n_words", 1)
    cut = set(connection.execute(head.rstrip() + " SELECT stratum, feature, cutoff FROM cut").fetchall())
    tested = connection.execute(head.rstrip() + " SELECT count(*) FROM tested").fetchone()[0]
    assert 4 < len(cut) < tested and {s for s, _, _ in cut} >= {"aa", ""} and "rare" not in {s for s, _, _ in cut} and len({f for _, f, _ in cut}) >= 5
    docs_, labels_ = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    measured = written(q.with_measures(docs_).drop("text"), f"file://{tmp_path}", "measured").withColumn("stratum", q.stratum())
    assert {tuple(r) for r in q.certified_cutoffs(measured, labels_, f"file://{tmp_path}/work").collect()} == cut
    got = sorted(map(tuple, q.judge(docs_, labels_).collect()), key=str)
    assert got == sorted(connection.execute(q.JUDGE_SQL).fetchall(), key=str)
    assert sum(not r[-1] and not r[-2] for r in got) > 1000


def test_holm_goes_on_in_order_of_p(spark):
    """Ties are in order of stratum and feature; the first that fails ends it."""
    table, labels, _ = corpus(spark, 1200)
    assert q.judge(table, labels).where("not kept").count() > 0
