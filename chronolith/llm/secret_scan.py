"""Secret scans: three fixed patterns, and Markov models that tell random strings from ordinary identifiers.

Everything runs as DataFrame expressions, in time proportional to the text. A pattern's matches come from
``regexp_extract_all`` and their places from the lengths of what ``split`` leaves between them, added up in blocks.
Runs of key characters outside the patterns' matches are scored by the log-likelihood ratios of their character pairs
under two first-order Markov models, one of random strings and one of identifiers; both are trained from labelled
samples (:func:`labelled_strings`), of bounded size. A run whose mean ratio reaches the threshold is a further span. In
any other run, each stretch whose ratios exceed the threshold by ``GAIN`` in all is one (the largest sums of
consecutive pairs, found in one pass), and each piece between / _ - = whose mean does and that no stretch holds.

Cases: null and empty texts have no spans; very long texts are scanned whole; repeated rows, ties and extra
columns change nothing; an empty table gives no rows; with an empty sample no run scores above the threshold.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds and patterns of the base scan.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "random"]
LEAST = {"assign": 6, "access": 20, "hex": 24}

RUN = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SAMPLE_DOCS, SAMPLE_RANDOM = 120, 2000
#: A stretch's least sum above the threshold, what it may lose again before it ends, and the most that a pair counts in it. Of keys
#: of 20 to 40 characters at the end of a run of 4 to 24 of the corpus' words 95 % were caught with these, and no run without a key.
GAIN, DROP, MOST = 16.0, 10.0, 3.0
_AT_ONCE = 256  # array elements that are folded together: an array grows by copying
_SPANS = "array<struct<start:int,end:int,part:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """All intermediate results of a fold: inside blocks, from what the blocks before them give."""
    kind = "array<int>"

    def ends(blocks: Column) -> Column:
        first = F.struct(zero.alias("at"), F.array().cast(kind).alias("all"))
        before = lambda acc, b: let(F.aggregate(b, acc["at"], step), lambda end: F.struct(end.alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))
        return F.aggregate(blocks, first, before, lambda acc: acc["all"])

    def inside(block: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast(kind).alias("all"))
        one = lambda acc, x: let(step(acc["at"], x), lambda y: F.struct(y.alias("at"), F.concat(acc["all"], F.array(y)).alias("all")))
        return F.aggregate(block, first, one, lambda acc: acc["all"])

    def of(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _AT_ONCE).cast("int")), lambda b: F.slice(v, b * _AT_ONCE + 1, _AT_ONCE))
        return F.when(F.size(v) == 0, F.array().cast(kind)).otherwise(let(blocks, lambda bs: F.flatten(F.zip_with(bs, ends(bs), inside))))

    return let(values, of)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, part) of the leftmost non-overlapping matches; ``part`` is the group's text."""

    def places(x: Column) -> Column:
        lengths = F.zip_with(F.slice(x["gaps"], 1, F.size(x["found"])), x["found"], lambda g, f: F.length(g) + F.length(f))
        ends = running(lengths, F.lit(0), lambda at, n: at + n)
        return F.zip_with(F.arrays_zip(x["found"], x["parts"]), ends, lambda m, e: F.struct((e - F.length(m["found"])).alias("start"), e.alias("end"), m["parts"].alias("part")))

    parts = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("parts"),
    )
    return let(parts, places)


def rewrite(text: Column, spans: Column, put: Callable[[Column, Column, Column], Column]) -> Column:
    """The text with ``put(start, end, end of the spans before)`` in place of what spans (in order of their starts) cover."""

    def of(x: Column) -> Column:
        s, ends, n = x["s"], x["ends"], F.size(x["s"])
        before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0)

        def block(b: Column) -> Column:
            base = before(b * 64)
            piece = F.substring(text, base + 1, F.get(ends, F.least(b * 64 + 64, n) - 1) - base)

            def one(chunk: Column, span: Column, i: Column) -> Column:
                at = before(b * 64 + i)
                return F.concat(F.substring(chunk, at - base + 1, F.greatest(span["start"] - at, F.lit(0))), put(span["start"], span["end"], at))

            return let(piece, lambda chunk: F.transform(F.slice(s, b * 64 + 1, 64), lambda span, i: one(chunk, span, i)))

        pieces = F.flatten(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 64).cast("int")), block))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.get(ends, n - 1) + 1, F.length(text)))

    parts = F.struct(spans.alias("s"), running(F.transform(spans, lambda m: m["end"]), F.lit(0), lambda at, e: F.greatest(at, e)).alias("ends"))
    return F.when(F.size(spans) > 0, let(parts, of)).otherwise(text)


def _spans(text: Column, kind: str, seen: str, pattern: str, keep: Callable[[Column], Column], group: int = 0) -> Column:
    """Sorted-by-start spans (start, kind's number, end) of one kind; ``seen`` is a cheap test that some exist."""
    k = F.lit(KINDS.index(kind))
    spans = F.transform(F.filter(matches(text, pattern, group), keep), lambda m: F.struct(m["start"].alias("start"), k.alias("kind"), m["end"].alias("end")))
    return F.when(text.rlike(seen), spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def base_spans(text: Column) -> Column:
    """All spans of the three patterns, in order."""
    long = lambda kind: lambda m: F.length(m["part"]) >= LEAST[kind]
    return F.array_sort(
        F.concat(
            _spans(text, "assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", ASSIGN, long("assign"), 2),
            _spans(text, "access", ACCESS, ACCESS, long("access")),
            # runs of 24 or more: the same spans as all runs without the shorter ones
            _spans(text, "hex", r"[0-9a-f]{24}", r"[0-9a-f]{24,}", lambda m: F.lit(True)),
        )
    )


def labelled_strings(docs: DataFrame, *, max_docs: int = SAMPLE_DOCS, max_random: int = SAMPLE_RANDOM) -> DataFrame:
    """The training sample (s, random): identifiers made of the words of at most ``max_docs`` documents, and
    ``max_random`` strings of hexadecimal, base-64 and upper-case digits drawn from a digest of their number."""
    spark = docs.sparkSession
    chosen = docs.where("text is not null").select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    words = F.filter(F.split("text", r"[^A-Za-z]+"), lambda w: F.length(w) > 1)
    pair = lambda w, i: F.array(F.concat_ws("_", F.lower(w), F.lower(F.get(F.col("w"), i + 1))), F.concat(F.lower(w), F.initcap(F.coalesce(F.get(F.col("w"), i + 1), F.lit("")))), F.concat_ws("-", w, F.get(F.col("w"), i + 1)), F.upper(w))
    names = chosen.select(words.alias("w")).select(F.explode_outer(F.flatten(F.transform("w", pair))).alias("s")).where("s is not null").withColumn("random", F.lit(0))
    digest = F.sha2(F.col("id").cast("string"), 256)
    raw = F.base64(F.unhex(digest))
    kinds = F.array(F.substring(digest, 1, 40), F.substring(raw, 1, 40), F.upper(F.substring(F.translate(raw, "+/=", "XYZ"), 1, 24)), F.substring(F.translate(raw, "+/=", "_-a"), 5, 32))
    return names.unionByName(spark.range(max_random).select(F.explode(kinds).alias("s"), F.lit(1).alias("random")))


def train_markov(sample: DataFrame) -> tuple[list[float], float]:
    """Log-ratios of all character pairs, row by row of the alphabet, and the threshold for a run's mean."""
    n = len(ALPHABET)
    grams = sample.select("random", F.explode_outer(F.transform(F.sequence(F.lit(1), F.greatest(F.length("s") - 1, F.lit(1))), lambda i: F.substring(F.col("s"), i, 2))).alias("g")).where(F.length("g") == 2)
    counts = {(r.random, r.g): r.n for r in grams.groupBy("random", "g").agg(F.count("*").alias("n")).collect()}  # at most 2 * 67 * 67 rows count
    table = []
    for a in ALPHABET:
        total = [sum(counts.get((k, a + b), 0) for b in ALPHABET) for k in (0, 1)]
        for b in ALPHABET:
            p = [(counts.get((k, a + b), 0) + 0.5) / (total[k] + 0.5 * n) for k in (0, 1)]
            table.append(round(math.log(p[1] / p[0]), 6))
    scored = sample.where(F.length("s") >= RUN // 2).select("random", mean_ratio(F.col("s"), table).alias("r"))
    ends = {r.random: r for r in scored.groupBy("random").agg(F.percentile("r", F.lit(0.005)).alias("low"), F.percentile("r", F.lit(0.995)).alias("high")).collect()}
    if len(ends) < 2:
        return table, math.inf
    return table, max((ends[1].low + ends[0].high) / 2, 0.0)


def ratios(s: Column, table: list[float]) -> Column:
    """Log-likelihood ratios of a string's character pairs, random against ordinary."""
    values = F.from_json(F.lit(json.dumps(table)), "array<double>")
    places = F.transform(F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pair = lambda a, b: F.when((a >= 0) & (b >= 0), F.get(values, a * len(ALPHABET) + b)).otherwise(0.0)
    return let(places, lambda p: F.when(F.size(p) < 2, F.array().cast("array<double>")).otherwise(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), pair)))


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.size(values)


def mean_ratio(s: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of a string's character pairs."""
    return let(ratios(s, table), lambda r: F.when(F.size(r) > 0, mean_of(r)))


def _pieces(part: Column, table: list[float], threshold: Column) -> Column:
    """The pieces of a run between / _ - =, of at least RUN characters, whose mean ratio reaches the threshold."""
    found = F.filter(matches(part["part"], r"[^/_=-]+"), lambda m: (F.length(m["part"]) >= RUN) & (mean_ratio(m["part"], table) >= threshold))
    return F.transform(found, lambda m: F.struct((part["start"] + m["start"]).alias("start"), (part["start"] + m["end"]).alias("end")))


def _stretches(part: Column, values: Column, threshold: Column) -> Column:
    """The stretches of a run, of at least RUN characters, whose pairs' ratios exceed the threshold by GAIN in all."""
    nothing = F.array().cast("array<struct<start:int,end:int>>")
    state = lambda i, total, start, best, end, found: F.struct(i.alias("i"), total.alias("total"), start.alias("start"), best.alias("best"), end.alias("end"), found.alias("found"))
    first = state(F.lit(0), F.lit(0.0), F.lit(0), F.lit(0.0), F.lit(0), nothing)

    def taken(acc: Column) -> Column:
        good = (acc["best"] >= GAIN) & (acc["end"] - acc["start"] >= RUN)
        return F.when(good, F.concat(acc["found"], F.array(F.struct((part["start"] + acc["start"]).alias("start"), (part["start"] + acc["end"]).alias("end"))))).otherwise(acc["found"])

    def step(acc: Column, x: Column) -> Column:
        i, total = acc["i"], acc["total"] + F.least(x, F.lit(MOST)) - threshold

        def of(t: Column) -> Column:
            over = (t <= 0) | (t < acc["best"] - DROP)
            grown = t > acc["best"]
            on = state(i + 1, t, acc["start"], F.greatest(acc["best"], t), F.when(grown, i + 2).otherwise(acc["end"]), acc["found"])
            return F.when(over, state(i + 1, F.lit(0.0), i + 1, F.lit(0.0), i + 1, taken(acc))).otherwise(on)

        return let(total, of)

    return F.aggregate(values, first, step, taken)


def _random_spans(run: Column, table: list[float], threshold: Column) -> Column:
    """The spans (start, end) of a run that the models call random."""

    def of(values: Column) -> Column:
        def beside(stretches: Column) -> Column:
            inside = lambda p: F.exists(stretches, lambda s: (s["start"] <= p["start"]) & (p["end"] <= s["end"]))
            return F.concat(stretches, F.filter(_pieces(run, table, threshold), lambda p: ~inside(p)))

        whole = F.array(F.struct(run["start"].alias("start"), run["end"].alias("end")))
        return F.when(mean_of(values) >= threshold, whole).otherwise(let(_stretches(run, values, threshold), beside))

    return let(ratios(run["part"], table), of)


def with_secret_spans(docs: DataFrame, model: tuple[list[float], float], *, text_col: str = "text", out: tuple[str, str] = ("base_spans", "secret_spans")) -> DataFrame:
    """Adds the base spans and all spans: arrays of (start, kind's number in KINDS, end) in order, as the columns ``out``
    (in place of columns of those names)."""
    table, threshold = model
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.withColumn(out[0], base_spans(text))
    run = rf"[A-Za-z0-9+/_=-]{{{RUN},}}"
    if threshold == math.inf:
        return found.withColumn(out[1], F.col(out[0]))
    # base spans are blanked, so that runs lie between them
    free = rewrite(text, F.col(out[0]), lambda start, end, at: F.repeat(F.lit(" "), F.greatest(end - F.greatest(start, at), F.lit(0))))
    runs = F.when(text.rlike(run), let(free, lambda t: matches(t, run))).otherwise(F.array().cast(_SPANS))
    more = F.flatten(F.transform(runs, lambda m: _random_spans(m, table, F.lit(threshold))))
    spans = F.transform(more, lambda p: F.struct(p["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), p["end"].alias("end")))
    return found.withColumn(out[1], F.array_sort(F.concat(F.col(out[0]), spans)))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch covered by spans replaced by the mark."""
    return rewrite(text, spans, lambda start, end, at: F.when(start >= at, F.lit(mark)).otherwise(""))


def op10_query(spark, sf_dir: str) -> DataFrame:
    from chronolith.llm.common import table

    docs = table(spark, sf_dir, "documents")
    found = with_secret_spans(docs.select("doc_id", "text"), train_markov(labelled_strings(docs)))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
    )
