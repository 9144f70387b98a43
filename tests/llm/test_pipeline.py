import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
import test_decontaminate
import test_line_dedup
import test_minhash
import test_quality_rules
from tokenizers import Tokenizer

import corpus_pipeline as p
from folio.llm import shared
from folio.llm.shared import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, line int"
LABELS = "doc_id long, quality int, toxic int"


def made(rng):
    """Documents with copies, near copies, repeated runs of lines, benchmark passages, junk, nulls and repeated rows."""
    word = lambda: f"w{rng.randrange(4000)}"
    line = lambda n: " ".join(word() for _ in range(n))
    run = [line(20) for _ in range(4)]
    item = line(30)
    rows = []
    for i in range(170):
        kind = i % 10
        text = "\n".join(line(rng.randrange(8, 30)) for _ in range(rng.randrange(3, 9)))
        if kind == 1:
            text = text + "\n" + "\n".join(run) + "\n" + line(12)
        elif kind == 2:
            text += " " + " ".join(item.split()[5:20])
        elif kind == 3:
            text = "spam buy " * 40
        elif kind == 4 and rows:
            words = rows[rng.randrange(len(rows))][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        elif kind == 5 and rows:
            text = rows[rng.randrange(len(rows))][1]
        rows.append((i, text))
    rows += [(500, None), (501, ""), (502, "\n \n"), (503, "word " * 9), (None, line(60)), (None, "\n".join(run)), rows[7], rows[7], (900, " ".join(line(30) for _ in range(100)))]
    return rows, [("1", item), ("2", None), (None, "")]


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(6)
    rows, bench = made(rng)
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "c", 1) for i, t in rows], SCHEMA).coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 90, 2)] + [(None, 0, 0), (4, None, 1)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows, [(i or "", t or "") for i, t in bench]


def texts_of(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


def test_stages_by_brute_force(spark, folder):
    path, rows, bench = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    steps = dict(p.STAGES)
    assert list(steps) == ["quality_rules", "line_dedup", "minhash_near_dedup", "decontamination", "best_fit_packing"]

    kept = steps["quality_rules"](spark, docs, path)
    good = [r for r in rows if not test_quality_rules.measures(r[1])[-1]]
    assert kept.columns == docs.columns and texts_of(kept) == sorted(good, key=str) and len(good) < len(rows)

    cut = steps["line_dedup"](spark, kept, path)
    unique = sorted(set(good), key=lambda r: (r[0] is None, r[0] or 0))
    gone = dict(zip(unique, test_line_dedup.brute([(n, t) for n, (_, t) in enumerate(unique)], 50)))
    left = cut.collect()
    assert cut.columns == docs.columns and sum(gone.values()) > 20
    lines = lambda t: len([x for x in (t or "").split("\n") if re.search(r"\S", x)])
    expected = sorted((str(i), lines(t) - gone[i, t]) for i, t in good if lines(t) > gone[i, t])
    assert sorted((str(r.doc_id), lines(r.text)) for r in left) == expected
    assert all(r.n_chars == len(r.text) for r in left)

    one = steps["minhash_near_dedup"](spark, cut, path)
    known = {r.doc_id: r.text for r in left if r.doc_id is not None}
    classes = test_minhash.brute(sorted(known.items()), 5, 80)
    stay = [(r.doc_id, r.text) for r in left if r.doc_id is None or classes[r.doc_id][1] == r.doc_id]
    assert one.columns == docs.columns and texts_of(one) == sorted(stay, key=str) and len(stay) < len(left)

    clean = steps["decontamination"](spark, one, path)
    hits = test_decontaminate.brute([t for _, t in stay], bench)
    whole = [r for r, h in zip(stay, hits) if not h[1]]
    assert clean.columns == docs.columns and texts_of(clean) == sorted(whole, key=str) and len(whole) < len(stay)

    pieces = sorted(map(tuple, steps["best_fit_packing"](spark, clean, path).drop("sequence_id", "offset").collect()), key=str)
    tokenizer, out = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), []
    for i, t in whole:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        out += [(i, n, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for n, s in enumerate(range(0, len(ids), 2048))]
    assert pieces == sorted(out, key=str) and max(x[1] for x in out) > 0

    result = p.run(spark, path)
    assert sorted(map(tuple, result.drop("sequence_id", "offset").collect()), key=str) == pieces
    for own in result.toPandas().groupby("sequence_id"):
        spans = own[1].sort_values("offset")
        assert spans["offset"].tolist() == (spans["length"].cumsum() - spans["length"]).tolist() and spans["length"].sum() <= 2048


def test_empty_tables(spark, folder, tmp_path):
    path, _, _ = folder
    empty = tmp_path / "none"
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert p.run(spark, str(empty)).count() == 0


def test_working_folders_go(spark, folder):
    base = Path(shared.shared_folder(spark).removeprefix("file://")).parent
    before = set(base.glob("folio-*"))
    assert p.run(spark, folder[0]).count()
    assert {x.name for new in set(base.glob("folio-*")) - before for x in new.iterdir()} == {"decontamination", "pieces", "counts"}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "other"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_folder(Session())
