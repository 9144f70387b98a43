"""Quality rules with risk-controlled cutoffs.

Fixed base rules come first. On top of them, each stratum (language) may get
one cutoff per feature, selected with labelled documents: one half of the
labels proposes, for each feature, the cutoff of a fixed grid that rejects the
most poor documents while rejecting next to no good ones; the other half, the
holdout, then tests the hypothesis "this cutoff rejects more than alpha of the
stratum's good documents" with its exact binomial tail. Holm's correction over
all proposals of all strata keeps the chance of any wrongly certified cutoff
within delta. A stratum's ``ALPHA`` is shared out among the features proposed
for it - the holdout has no part in that - so all cutoffs of a stratum together
reject at most ``ALPHA`` of its good documents. What can't be certified isn't
used.

DataFrame operations only; one pass over the texts. Word windows are compared
by their 64-bit hashes within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.llm.shared import shared_folder, written

ALPHA, DELTA = 0.05, 0.05
#: Features (higher is worse) and the grid of their cutoffs.
GRID = {
    "bang": (0.05, 0.1, 0.2, 0.35, 0.5, 0.8),
    "dup_lines": (0.1, 0.2, 0.3, 0.45, 0.6, 0.8),
    "long_words": (7.0, 8.0, 9.0, 10.0, 12.0, 15.0),
    "repeats": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3),
    "symbols": (0.02, 0.05, 0.1, 0.2, 0.35, 0.5),
    "upper": (0.1, 0.2, 0.3, 0.45, 0.6, 0.8),
}
TUNE_ALPHA = ALPHA / len(GRID) / 8
MAX_BROADCAST_STRATA = 10_000
SPACE = r"[\x20\x09-\x0D]"
OWN = "__folio_quality"


def with_measures(docs: DataFrame) -> DataFrame:
    """``docs`` with the struct ``OWN`` of counts and features of the text; null is as empty."""
    text = f"{OWN}_text"
    base = docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    split = base.withColumns({
        f"{OWN}_w": F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""),
        f"{OWN}_l": F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}")),
    })
    words, lines = F.col(f"{OWN}_w"), F.col(f"{OWN}_l")
    hashes = F.when(F.size(words) >= 8, F.transform(F.sequence(F.lit(1), F.size(words) - 7), lambda i: F.xxhash64(F.slice(words, i, 8))))
    hashed = split.withColumns({
        f"{OWN}_h": hashes,
        f"{OWN}_c": F.struct(
            F.size(words).cast("long").alias("n_words"),
            (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            F.regexp_count(text, F.lit("!")).cast("long").alias("n_bangs"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        ),
    }).drop(f"{OWN}_w", f"{OWN}_l", text)
    # where some window repeats: (hash, start) sorted, then the starts whose neighbour has the same hash
    h = F.col(f"{OWN}_h")
    ordered = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    sorted_ = hashed.withColumn(f"{OWN}_s", ordered).drop(f"{OWN}_h")
    s = F.col(f"{OWN}_s")

    def same(v: Column, j: Column) -> Column:
        return F.coalesce(F.get(s, j - 1)["h"] == v["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == v["h"], F.lit(False))

    starts = sorted_.withColumn(f"{OWN}_p", F.sort_array(F.transform(F.filter(s, same), lambda v: v["i"]))).drop(f"{OWN}_s")
    p = F.col(f"{OWN}_p")
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(8), F.coalesce(F.get(p, k + 1) - x, F.lit(8)))), F.lit(0), lambda a, x: a + x)
    counts = starts.withColumn(f"{OWN}_r", F.coalesce(covered, F.lit(0)).cast("long")).drop(f"{OWN}_p")
    c, r = F.col(f"{OWN}_c"), F.col(f"{OWN}_r")
    n = F.greatest(c["n_words"], F.lit(1))
    features = F.struct(
        (c["n_bangs"] / n).alias("bang"),
        (c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1))).alias("dup_lines"),
        (c["word_chars"] / n).alias("long_words"),
        (r / n).alias("repeats"),
        (c["n_symbols"] / n).alias("symbols"),
        (c["n_upper"] / F.greatest(c["word_chars"], F.lit(1))).alias("upper"),
    )
    failed = (c["n_words"] < 20) | (100 * r > 30 * c["n_words"])
    own = F.struct(*[c[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines")], r.alias("n_repeat_words"), failed.alias("base_failed"), features.alias("features"))
    return counts.withColumn(OWN, own).drop(f"{OWN}_c", f"{OWN}_r")


def binomial_tail(n: Column, k: Column, p: Column) -> Column:
    """P(at most k of n) at rate p, exactly: terms summed from their running logarithm."""
    ratio = F.log(p / (1 - p))
    start = F.struct((n * F.log(1 - p)).alias("term"), F.lit(0.0).alias("sum"))

    def add(a: Column, i: Column) -> Column:
        return F.struct((a["term"] + F.log((n - i) / (i + 1.0)) + ratio).alias("term"), (a["sum"] + F.exp(a["term"])).alias("sum"))

    return F.when(k >= n, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, add)["sum"])


def certified_cutoffs(measured: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """(stratum, feature, cutoff), certified on the holdout; ``measured``, a table that is written, has doc_id, stratum and ``OWN``.

    A document's label is the least quality of its label rows; nulls are no labels.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    half = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1) < "8"
    rows = measured.where(~F.col(OWN)["base_failed"] & F.col("doc_id").isNotNull()).join(known, "doc_id")
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(OWN)["features"][f].alias("value"), F.array(*map(F.lit, map(float, grid))).alias("grid")) for f, grid in GRID.items()]))
    tried = rows.select("stratum", "quality", half.alias("tune"), values.alias("v")).select("stratum", "quality", "tune", "v.feature", "v.value", F.explode("v.grid").alias("cutoff"))
    good, bad, out = F.col("quality") > 0, F.col("quality") <= 0, F.col("value") >= F.col("cutoff")
    counted = tried.groupBy("stratum", "feature", "cutoff").agg(*[F.count_if(c).alias(name) for name, c in {
        "tune_good": F.col("tune") & good, "tune_good_out": F.col("tune") & good & out, "tune_bad_out": F.col("tune") & bad & out,
        "good": ~F.col("tune") & good, "good_out": ~F.col("tune") & good & out}.items()])
    useful = counted.where((F.col("tune_bad_out") > 0) & (F.col("tune_good_out") <= TUNE_ALPHA * F.col("tune_good")) & (F.col("tune_bad_out") > 4 * F.col("tune_good_out")))
    best = F.max_by(F.struct("cutoff", "good", "good_out"), F.struct("tune_bad_out", -F.col("tune_good_out"), "cutoff"))
    proposed = useful.groupBy("stratum", "feature").agg(best.alias("b")).select("stratum", "feature", "b.*")
    share = ALPHA / F.count(F.lit(1)).over(Window.partitionBy("stratum"))
    tested = written(proposed.withColumn("p", binomial_tail(F.col("good"), F.col("good_out"), share)), folder, "tested")
    order = Window.partitionBy(F.lit(0)).orderBy("p", "stratum", "feature")  # of those that may be certified: each has a hundred labels or more
    holm = tested.where(F.col("p") <= DELTA).withColumn("ok", F.col("p") <= DELTA / (F.lit(tested.count()) - F.row_number().over(order) + 1))
    return holm.withColumn("ok", F.min("ok").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("ok").select("stratum", "feature", "cutoff")


def decided(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measured`` with ``kept``: no base rule and no cutoff of its stratum says no."""
    by_stratum = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("feature", "cutoff"))).alias(f"{OWN}_cut"))
    if cutoffs.select("stratum").distinct().count() <= MAX_BROADCAST_STRATA:
        by_stratum = F.broadcast(by_stratum)
    own, cut = F.col(OWN), F.col(f"{OWN}_cut")
    out = own["base_failed"]
    for f in GRID:
        out = out | F.coalesce(own["features"][f] >= F.try_element_at(cut, F.lit(f)), F.lit(False))
    return measured.join(by_stratum.withColumnRenamed("stratum", f"{OWN}_stratum"), F.col(f"{OWN}_stratum") == stratum(), "left").withColumn(f"{OWN}_kept", ~out).drop(f"{OWN}_stratum", f"{OWN}_cut")


def stratum() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts have no words and fail the base rules. A null
    language is the stratum ''. Repeated rows are judged each by itself; rows
    with a null doc_id have no label. Without labels, or with too few for the
    bound, only the base rules reject. Other columns are not read.
    """
    folder = shared_folder(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.col("lang"))
    measured = written(with_measures(plain).drop("text"), folder, "measured")
    cutoffs = written(certified_cutoffs(measured.withColumn("stratum", stratum()), labels, folder), folder, "cutoffs")
    own = F.col(OWN)
    counts = [own[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    return decided(measured, cutoffs).select("doc_id", *counts, F.col(f"{OWN}_kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, columns as they are; texts are measured once.

    Nulls, empty texts and repeated rows are as in ``judge``; an empty table stays empty.
    """
    folder = shared_folder(docs.sparkSession)
    measured = written(with_measures(docs), folder, "measured")
    cutoffs = written(certified_cutoffs(measured.select(F.col("doc_id").cast("long"), stratum().alias("stratum"), OWN), labels, folder), folder, "cutoffs")
    return decided(measured, cutoffs).where(f"{OWN}_kept").select(*[F.col(f"`{c}`") for c in docs.columns])


#: DuckDB SQL of ``judge``.
JUDGE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS row_nr, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
win AS (SELECT row_nr, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT row_nr, w, unnest(range(1, CAST(len(w) - 6 AS BIGINT))) AS i FROM s)),
twice AS (SELECT row_nr, i FROM (SELECT row_nr, i, count(*) OVER (PARTITION BY row_nr, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT row_nr, count(DISTINCT spot) AS n_repeat_words FROM (SELECT row_nr, unnest(range(i, i + 8)) AS spot FROM twice) GROUP BY row_nr),
c AS (
  SELECT s.row_nr, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper
  FROM s LEFT JOIN rep USING (row_nr)),
m AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_bangs / greatest(n_words, 1) AS bang, n_dup_lines / greatest(n_lines, 1) AS dup_lines,
    word_chars / greatest(n_words, 1) AS long_words, n_repeat_words / greatest(n_words, 1) AS repeats, n_symbols / greatest(n_words, 1) AS symbols, n_upper / greatest(word_chars, 1) AS upper_share
  FROM c),
grid(feature, cutoffs) AS (VALUES {grid}),
f AS (
  SELECT m.row_nr, stratum, base_failed, doc_id, grid.feature,
    CASE grid.feature WHEN 'bang' THEN bang WHEN 'dup_lines' THEN dup_lines WHEN 'long_words' THEN long_words WHEN 'repeats' THEN repeats WHEN 'symbols' THEN symbols ELSE upper_share END AS value, cutoffs
  FROM m CROSS JOIN grid),
known AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
tried AS (SELECT stratum, feature, value, unnest(cutoffs) AS cutoff, quality, left(md5(CAST(doc_id AS VARCHAR)), 1) < '8' AS tune FROM f JOIN known USING (doc_id) WHERE NOT base_failed),
counted AS (
  SELECT stratum, feature, cutoff, count_if(tune AND quality > 0) AS tune_good, count_if(tune AND quality > 0 AND value >= cutoff) AS tune_good_out,
    count_if(tune AND quality <= 0 AND value >= cutoff) AS tune_bad_out, count_if(NOT tune AND quality > 0) AS good, count_if(NOT tune AND quality > 0 AND value >= cutoff) AS good_out
  FROM tried GROUP BY ALL),
proposed AS (
  SELECT * FROM counted WHERE tune_bad_out > 0 AND tune_good_out <= {tune_alpha} * tune_good AND tune_bad_out > 4 * tune_good_out
  QUALIFY row_number() OVER (PARTITION BY stratum, feature ORDER BY tune_bad_out DESC, tune_good_out, cutoff DESC) = 1),
shared AS (SELECT *, {alpha} / count(*) OVER (PARTITION BY stratum) AS share FROM proposed),
tested AS (
  SELECT stratum, feature, cutoff, CASE WHEN good_out >= good THEN 1.0 ELSE list_sum(list_transform(range(0, CAST(good_out + 1 AS BIGINT)),
    lambda i: exp(lgamma(good + 1.0) - lgamma(i + 1.0) - lgamma(good - i + 1.0) + i * ln(share) + (good - i) * ln(1 - share)))) END AS p
  FROM shared),
holm AS (SELECT *, p <= {delta} / (count(*) OVER () - row_number() OVER (ORDER BY p, stratum, feature) + 1) AS ok FROM tested),
cut AS (SELECT stratum, feature, cutoff FROM (SELECT *, bool_and(ok) OVER (ORDER BY p, stratum, feature ROWS UNBOUNDED PRECEDING) AS fine FROM holm) WHERE fine),
out AS (SELECT f.row_nr, bool_or(value >= cutoff) AS rejected FROM f JOIN cut USING (stratum, feature) GROUP BY f.row_nr)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM m LEFT JOIN out USING (row_nr)
"""
JUDGE_SQL = (
    JUDGE_SQL.replace("{grid}", ", ".join(f"('{f}', [{', '.join(f'CAST({x} AS DOUBLE)' for x in grid)}])" for f, grid in GRID.items()))
    .replace("{tune_alpha}", repr(TUNE_ALPHA)).replace("{alpha}", repr(ALPHA)).replace("{delta}", repr(DELTA))
)
