import random

import numpy as np

from folio.llm import line_dedup as d


def brute(rows, least):
    """Removed lines per row: every later occurrence's longest match with an earlier one, in order of documents."""
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    text, places = [], []
    for i in order:
        for j, line in enumerate(d.content_lines(rows[i][1].encode())[0]):
            text.append(line)
            places.append((i, j))
        text.append(None)
        places.append(None)
    gone = set()
    for b in range(len(text)):
        for a in range(b):
            n = words = 0
            while b + n < len(text) and text[a + n] is not None and text[a + n] == text[b + n]:
                words += len(text[b + n].split())
                n += 1
            if words > least:
                gone.update(range(b, b + n))
    out = [0] * len(rows)
    for k in gone:
        out[places[k][0]] += 1
    return out


def test_shortest_runs():
    ahead, behind = d.shortest_runs(np.array([3, 3, 5, 1]), 5)
    assert ahead.tolist() == [2, 2, 2, 0] and behind.tolist() == [0, 2, 2, 2]


def test_against_brute_force(spark, docs):
    rng = random.Random(2)
    lines = [" ".join(f"l{i}w{j}" for j in range(rng.choice([1, 2, 4, 9]))) for i in range(14)]
    rows = []
    for i in range(40):
        own = rng.choices(lines, k=rng.randrange(1, 25))
        if i % 3 == 0 and rows:
            start = rng.randrange(5)
            own += rows[rng.randrange(len(rows))][1].split("\n")[start : start + 9]
        rows.append((i, "\n".join(rng.choice(["", " "]) + x + rng.choice(["", " ", "\n"]) for x in own)))
    rows += [(50, "same line\n" * 30), (51, "")]
    for least in (3, 10):
        got = {r.doc_id: r for r in d.dedup_lines(docs(rows), min_words=least).collect()}
        assert [got[i].n_removed for i, _ in rows] == brute(rows, least)
        for i, t in rows:
            assert len(d.content_lines(got[i].text.encode())[0]) == got[i].n_lines - got[i].n_removed


def test_first_copy_stays_and_edge_cases(spark, docs):
    run = "\n".join(" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    table = docs([(2, f"own\n{run}\nend"), (1, run), (3, None), (4, ""), (None, run), (5, run), (5, run)])
    got = {(r.doc_id, r.text) for r in d.dedup_lines(table).collect()}
    assert got == {(1, run), (2, "own\nend"), (3, None), (4, ""), (None, ""), (5, "")}
    kept = d.remove_repeats(table)
    assert kept.columns == table.columns
    assert sorted(((r.doc_id, r.n_chars) for r in kept.collect()), key=str) == [(1, len(run)), (2, 7), (3, None), (4, 0)]
    assert d.dedup_lines(table.limit(0)).count() == 0


def test_short_repeats_stay(spark, docs):
    text = "Released under a license.\n" + " ".join(f"w{i}" for i in range(45))
    assert d.dedup_lines(docs([(1, text), (2, text)])).where("n_removed > 0").count() == 0
