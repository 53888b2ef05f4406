"""Quality rules: fixed counts, and a hashed n-gram log-likelihood ratio between trusted and raw text.

All n-grams of one and two words are hashed into ``BUCKETS`` bins. The raw multinomial counts every document;
the trusted one counts every document that labels call good. A document's score is the mean over its n-grams of
log(trusted / raw). The threshold is fixed from all labelled documents: the cut with the fewest errors, each label
weighing the same; every document is decided by it.

Everything runs as DataFrame expressions; the bins' weights are one array of fixed size.

Words are runs without ASCII white space. Cases: null and empty texts have no words and fail the base rule;
very long texts are counted whole; without labels of both kinds nothing but the base rule rejects; repeated
label rows count once; repeated rows, ties and extra columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.common import fresh

BUCKETS = 1 << 14
SLICES = 1 << 14
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SMOOTH = 2.0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _hash_pairs(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))


def _part(a: Column, start: int, size: Column) -> Column:
    return F.slice(a, start, F.greatest(size, F.lit(0)))


def pairs(h: Column) -> Column:
    """Hashes of neighbours, from the words' hashes."""
    n = F.size(h) - 1
    return _hash_pairs(_part(h, 1, n), _part(h, 2, n))


def grams(h: Column, two: Column) -> Column:
    """Bins of all words and all pairs of neighbours."""
    return F.transform(F.concat(h, two), lambda x: F.pmod(x, F.lit(BUCKETS)))


def repeated_words(h: Column, two: Column) -> Column:
    """Words inside five-word windows that occur twice or more in the text, the first time included."""
    n = F.size(h)
    four = lambda p: _hash_pairs(_part(p, 1, n - 3), _part(p, 3, n - 3))
    windows = _hash_pairs(_part(four(two), 1, n - 4), _part(h, 5, n - 4))

    def covered(keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, j: F.get(s, j)["k"] == x["k"]
            twice = F.filter(s, lambda x, j: F.coalesce(same(x, j + 1), F.lit(False)) | ((j > 0) & F.coalesce(same(x, F.greatest(j - 1, F.lit(0))), F.lit(False))))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def total(p: Column) -> Column:
            gap = lambda x, j: F.least(F.lit(5), F.coalesce(F.get(p, j + 1) - x, F.lit(5)))
            return F.aggregate(F.transform(p, gap), F.lit(0).cast("long"), lambda acc, g: acc + g)

        return let(let(placed, starts), total)

    of_keys = lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(covered(keys))
    return F.when(n < 6, F.lit(0).cast("long")).otherwise(let(windows, of_keys))


def with_counts(docs: DataFrame, weights: list[float] | None = None, *, text_col: str = "text") -> DataFrame:
    """Adds the fixed counts (words, characters in words, symbols, repeated lines and repeated words) and,
    with the bins' weights, the score; columns of these names are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))

    def counts(w: Column) -> Column:
        def of(h: Column, two: Column) -> Column:
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeated_words(h, two).alias("n_repeat_words"),
                (F.lit(None).cast("double") if weights is None else score(h, two, weights)).alias("score"),
            )

        return let(hashes(w), lambda h: let(pairs(h), lambda two: of(h, two)))

    [c] = fresh(docs.columns, "_counts")
    found = docs.withColumn(c, let(words_of(F.col(text_col)), counts))
    symbols = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")
    n, r = F.col(f"{c}.n_words"), F.col(f"{c}.n_repeat_words")
    return found.select(
        *[F.col(x) for x in docs.columns if x not in COUNTS], n.alias("n_words"), F.col(f"{c}.word_chars").alias("word_chars"), symbols.alias("n_symbols"), dup.alias("n_dup_lines"),
        r.alias("n_repeat_words"), ((n < 10) | (100 * r > 20 * n)).alias("base_failed"),
        F.col(f"{c}.score").alias("score"),
    )


def pack_labels(labels: DataFrame) -> DataFrame:
    """(block, known, bad): one row for each 64 neighbouring ids, one bit for each id; bad if one of its labels is 0."""
    doc_id = F.col("doc_id").cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(doc_id, F.lit(64)).cast("int"))
    bits = labels.where("doc_id is not null and quality is not null").select(F.shiftright(doc_id, 6).alias("block"), bit.alias("bit"), F.when(F.col("quality") == 0, bit).otherwise(0).alias("bad"))
    return bits.groupBy("block").agg(F.bit_or("bit").alias("known"), F.bit_or("bad").alias("bad"))


def with_labels(rows: DataFrame, packed: DataFrame, how: str) -> DataFrame:
    """``rows`` (with a long ``doc_id``) with ``good``: 1, 0, or null without a label."""
    place = F.pmod(F.col("doc_id"), F.lit(64)).cast("int")
    good = F.when(F.getbit("known", place) == 1, 1 - F.getbit("bad", place).cast("int"))
    return rows.withColumn("block", F.shiftright("doc_id", 6)).join(packed, "block", how).select(*rows.columns, good.alias("good"))


def fit_ratio(docs: DataFrame, labels: DataFrame) -> tuple[list[float], float]:
    """The bins' log-ratios and the score below which a document is rejected, from all documents and all labels."""
    packed = pack_labels(labels).persist()
    try:
        packed.count()  # now the planner knows its size, and broadcasts it or deals both sides by blocks of ids
        return _fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), packed)
    finally:
        packed.unpersist()


def _fit(texts: DataFrame, packed: DataFrame) -> tuple[list[float], float]:
    # the outer form: for the inner one the optimizer would add filters that compute the bins again
    counted = with_labels(texts, packed, "left").select(F.coalesce("good", F.lit(0)).alias("good"), F.explode_outer(let(hashes(words_of(F.col("text"))), lambda h: grams(h, pairs(h)))).alias("bin"))
    rows = counted.where("bin is not null").groupBy("bin").agg(F.count("*").alias("raw"), F.sum("good").alias("trusted")).collect()  # at most BUCKETS rows
    raw, trusted = [0] * BUCKETS, [0] * BUCKETS
    for r in rows:
        raw[r.bin], trusted[r.bin] = r.raw, r.trusted
    n_raw, n_trusted = sum(raw), sum(trusted)
    if not n_trusted:
        return [0.0] * BUCKETS, -math.inf
    share = n_trusted / n_raw  # smoothing in proportion: a bin without evidence weighs nothing
    table = [round(math.log((t + SMOOTH * share) / (n_trusted + SMOOTH * share * BUCKETS) * (n_raw + SMOOTH * BUCKETS) / (c + SMOOTH)), 6) for t, c in zip(trusted, raw)]
    # scored before the join: should the planner shuffle for it, only ids and scores are moved
    scores = texts.select("doc_id", let(hashes(words_of(F.col("text"))), lambda h: score(h, pairs(h), table)).alias("s"))
    return table, best_cut_of(with_labels(scores, packed, "inner").where("good is not null").select("s", "good"))


def best_cut_of(scored: DataFrame) -> float:
    """``best_cut`` of all rows (s, good) of a table of any size; rows without a score are left out.

    Equal scores are counted together. Each slice of the scores' range is put in order apart; a cut's error is that
    of the slices before it plus what its own slice adds, so the slices' totals and best places give the exact cut."""
    by_score = scored.groupBy("s").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).persist()
    try:
        found = by_score.where("s is not null")  # behind the cache: it would be pushed down and compute the scores twice
        good, bad, low, high = found.agg(F.sum("good"), F.sum("bad"), F.min("s"), F.max("s")).first()
        if not good or not bad or low == high:
            return -math.inf
        part = F.floor((F.col("s") - low) / (high - low) * SLICES)
        order = Window.partitionBy("slice").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = [F.sum(c).over(order).cast("decimal(19,0)").alias(c) for c in ("good", "bad")]
        placed = found.withColumn("slice", part).select("slice", "s", F.lead("s").over(Window.partitionBy("slice").orderBy("s")).alias("next"), *sums)
        error = (F.col("good") * F.lit(bad) - F.col("bad") * F.lit(good)).alias("error")
        totals = [F.max(c).cast("long").alias(c) for c in ("good", "bad")]
        slices = placed.groupBy("slice").agg(*totals, F.min("s").alias("first"), F.min(F.struct(error, "s", "next")).alias("place")).collect()  # at most SLICES + 1 rows
    finally:
        by_score.unpersist()
    slices.sort(key=lambda r: r.slice)
    lost = kept = 0
    best, cut = good * bad, -math.inf  # good below times all bad, plus bad above times all good
    for r, after in zip(slices, [*slices[1:], None]):
        error = lost * bad + (bad - kept) * good + int(r.place.error)
        nxt = r.place.next if r.place.next is not None else after and after.first
        if error < best and nxt is not None:
            best, cut = error, (r.place.s + nxt) / 2
        lost, kept = lost + r.good, kept + r.bad
    return cut


def best_cut(scored: list[tuple[float, int]]) -> float:
    """The middle of the gap at which rejecting lower scores errs least, both labels weighing the same."""
    good = sum(g for _, g in scored)
    bad = len(scored) - good
    if not good or not bad:
        return -math.inf
    scored = sorted(scored)
    lost = kept = 0
    best, cut = 1.0, -math.inf  # share of good below plus share of bad above
    for (s, g), nxt in zip(scored, [*scored[1:], (math.inf, 0)]):
        lost, kept = lost + g, kept + (1 - g)
        error = lost / good + (bad - kept) / bad
        if error < best - 1e-12 and nxt[0] > s and nxt[0] < math.inf:
            best, cut = error, (s + nxt[0]) / 2
    return cut


def score(h: Column, two: Column, table: list[float]) -> Column:
    """Mean log-ratio over a text's n-grams, from the hashes of its words and pairs; null without words."""
    weights = F.from_json(F.lit(json.dumps(table)), "array<double>")
    total = lambda g: F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda acc, b: acc + F.get(weights, b)) / F.size(g))
    return let(grams(h, two), total)


def op9_query(spark, sf_dir: str) -> DataFrame:
    from chronolith.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights, threshold = fit_ratio(docs, table(spark, sf_dir, "labels"))
    found = with_counts(docs, weights)
    kept = ~F.col("base_failed") & F.coalesce(F.col("score") >= F.lit(threshold), F.lit(False))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round("score", 9).alias("score"))
