"""Toxicity scores from Levenshtein automata intersected with a lexicon trie.

The lexicon is learned from labelled rows: words and word beginnings (stems) that mark toxic documents. A trie
holds its terms; a word is matched by the product of the trie with the Levenshtein automata of all terms,
determinised lazily, so that most words leave it after a few characters. Long terms allow more misspellings.
A misspelling that the sample has seen more in clean documents than in toxic ones does not count. A context window around each match
looks for quotation marks on both sides or a reporting word: quoted matches count for little. A small logistic
model over the matches' weights gives the score.

The labelled sample that the lexicon, the exceptions and the model are fitted on is bounded by ``max_labelled``
rows (chosen by a hash of the id), the lexicon by ``max_terms`` terms (those with the highest ratio), and as many
words beside stems; every document is scored over its whole text. Texts stay in Spark: the driver gets terms' counts,
misspellings' counts and four numbers for each labelled document.

Cases: null and empty texts score like a text without matches; without labels of both kinds every score is the
share of toxic labels (0 without labels); repeated label rows count once, toxic if any is; ties, repeated rows
and extra columns change nothing; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import materialize, using, worker_cache

MAX_LABELLED = 8_000
MAX_TERMS = 500
STEM_LENGTHS = range(3, 9)
END = "$"  # closes a term that is a whole word
LEAST_G2 = 20.0
WINDOW = 6
QUOTED_SHARE, MISS_SHARE = 0.2, 0.7
QUOTES = "\"“”„«»‘’'"
REPORTING = {"said", "says", "quote", "quoted", "called", "wrote", "dit", "sagte", "dijo"}
KNOWN_CLEAN = 150_000
STRIP = 256  # texts of a batch that are Python strings at a time
_letters = re.compile(r"[^\W\d_]+")


def allowed(term: str) -> int:
    """Misspellings that a term allows: none in stems, whose words vary as it is; :func:`choose_terms` keeps words beside them."""
    n = len(term.rstrip(END))
    return (n >= 5) + (n >= 11) if term.endswith(END) else 0


class LexiconAutomaton:
    """Lazily determinised intersection of a trie with its terms' Levenshtein automata."""

    def __init__(self, terms: Iterable[str]):
        self.child: list[dict[str, int]] = [{}]
        self.term: list[list[str]] = [[]]
        self.most = [0]  # errors that any term below a node allows
        for t in sorted(set(terms)):
            node = 0
            for c in t.rstrip(END):
                self.most[node] = max(self.most[node], allowed(t))
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.term.append([])
                    self.most.append(0)
                node = self.child[node][c]
            self.most[node] = max(self.most[node], allowed(t))
            self.term[node].append(t)
        self.sets: list[frozenset[tuple[int, int]]] = []
        self.ids: dict[frozenset, int] = {}
        self.word_hit: list[tuple[str, int] | None] = []
        self.stem_hit: list[tuple[str, int] | None] = []
        self.arcs: dict[tuple[int, str], int] = {}
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        todo = list(pairs)
        while todo:  # letters left out of the word
            node, e = todo.pop()
            if e < self.most[node]:
                for to in self.child[node].values():
                    if e + 1 <= self.most[to] and (to, e + 1) not in pairs:
                        pairs.add((to, e + 1))
                        todo.append((to, e + 1))
        least: dict[int, int] = {}
        for node, e in pairs:
            least[node] = min(e, least.get(node, e))
        key = frozenset(least.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            hits = [(e, t) for node, e in key for t in self.term[node] if e <= allowed(t)]
            best = lambda found: (min(found)[1], min(found)[0]) if found else None
            self.word_hit.append(best(hits))
            self.stem_hit.append(best([h for h in hits if not h[1].endswith(END)]))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        to = set()
        for node, e in self.sets[state]:
            for letter, n in self.child[node].items():
                if letter == c:
                    to.add((n, e))
                elif e < self.most[n]:
                    to.add((n, e + 1))  # another letter
            if e < self.most[node]:
                to.add((node, e + 1))  # a letter too many
        found = self.arcs[state, c] = self._state(to) if to else -1
        return found

    def match(self, word: str) -> tuple[str, int] | None:
        """The lexicon term that a word spells, and its misspellings."""
        state, stem = self.start, None
        for c in word:
            to = self.arcs.get((state, c))
            state = self._step(state, c) if to is None else to
            if state < 0:
                return stem
            found = self.stem_hit[state]
            if found and (stem is None or found[1] < stem[1]):
                stem = found
        whole = self.word_hit[state]
        return whole if whole and (stem is None or whole[1] <= stem[1]) else stem


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)  # by term
    exceptions: frozenset[str] = frozenset()  # misspellings seen more in clean documents
    coef: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    bias: float = 0.0
    prior: float = 0.0


def features(found: list, weights: dict[str, float]) -> tuple[float, float, float, float]:
    """What the logistic model sees of a document's matches."""
    total, terms, top, n = 0.0, {}, 0.0, 0
    for term, e, _, quoted, n in found:
        share = MISS_SHARE**e * (QUOTED_SHARE if quoted else 1.0)
        w = weights[term] * share
        total += w
        top = max(top, w)
        terms[term] = max(share, terms.get(term, 0.0))
    return math.log1p(total), min(sum(terms.values()), 6.0), top, math.log1p(100 * total / (n + 20))


class Matcher:
    """The automaton of some terms, with the words it has looked at."""

    def __init__(self, terms: Iterable[str]):
        self.automaton = LexiconAutomaton(terms)
        self.clean: set[str] = set()
        self.hits: dict[str, tuple[tuple[str, int, str], ...]] = {}

    def _look(self, chunk: str) -> None:
        found = []
        for word in _letters.findall(chunk):
            if hit := self.automaton.match(word):
                found.append((*hit, word))
        if found:
            self.hits[chunk] = tuple(found)
        else:
            if len(self.clean) >= KNOWN_CLEAN:
                self.clean.clear()
            self.clean.add(chunk)

    def matches(self, text: str | None) -> list[tuple[str, int, str, bool, int]]:
        """(term, misspellings, word, quoted, the text's words) of every match in the text."""
        chunks = text.lower().split() if text else []
        for chunk in set(chunks).difference(self.clean, self.hits):
            self._look(chunk)
        if self.hits.keys().isdisjoint(chunks):
            return []
        found = []
        for i, chunk in enumerate(chunks):
            for term, e, word in self.hits.get(chunk, ()):
                before, after = chunks[max(0, i - WINDOW) : i], chunks[i + 1 : i + 1 + WINDOW]
                opened = chunk[0] in QUOTES or any(x[0] in QUOTES for x in before)
                closed = chunk[-1] in QUOTES or any(x.rstrip(".,;:!?")[-1:] in QUOTES and x.rstrip(".,;:!?") for x in after)
                told = any(x.strip(",:;") in REPORTING for x in before)
                found.append((term, e, word, bool((opened and closed) or (told and opened)), len(chunks)))
        return found


_matchers: dict[tuple[str, ...], Matcher] = worker_cache("toxicity", {})


def _matcher(terms: Iterable[str]) -> Matcher:
    """One matcher for each worker process and lexicon, whatever model uses it."""
    using("toxicity")
    key = tuple(sorted(terms))
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(key)
    return _matchers[key]


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model, self.matcher = model, _matcher(model.weights)

    def matches(self, text: str | None) -> list[tuple[str, int, str, bool, int]]:
        """The text's matches without the misspellings that the model excepts."""
        if not self.model.weights:
            return []
        return [h for h in self.matcher.matches(text) if not (h[1] and h[2] in self.model.exceptions)]

    def features(self, found: list) -> tuple[float, float, float, float]:
        return features(found, self.model.weights)

    def score(self, found: list) -> float:
        m = self.model
        if not m.weights:
            return m.prior
        z = m.bias + sum(c * x for c, x in zip(m.coef, self.features(found)))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


_scorers: dict[int, Scorer] = worker_cache("toxicity", {})


def _scorer(model: ToxicityModel) -> Scorer:
    """One scorer for each worker process and model."""
    using("toxicity")
    if id(model) not in _scorers:
        _scorers.clear()
        _scorers[id(model)] = Scorer(model)
    return _scorers[id(model)]


def forms(text: Column) -> Column:
    """The distinct words, closed by ``$``, and stems of a text."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) > 0))
    of = lambda w: F.array(F.concat(w, F.lit(END)), *[F.when(F.length(w) >= n, F.substring(w, 1, n)) for n in STEM_LENGTHS])
    return F.array_distinct(F.filter(F.flatten(F.transform(words, of)), lambda f: f.isNotNull()))


def _g2(a: float, b: float, na: float, nb: float) -> float:
    """Log-likelihood ratio of a term in a of na and b of nb documents."""
    p = (a + b) / (na + nb)
    part = lambda k, n, q: (k * math.log(k / (n * q)) if k else 0) + ((n - k) * math.log((n - k) / (n * (1 - q))) if n > k and q < 1 else 0)
    return 2 * (part(a, na, p) + part(b, nb, p))


def choose_terms(counts: list[tuple[str, int, int]], toxic: int, clean: int, max_terms: int = MAX_TERMS) -> dict[str, float]:
    """Weights of the terms kept from (form, toxic documents, clean documents)."""
    rate = lambda a, b: math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
    by = {f: (a, b) for f, a, b in counts if rate(a, b) >= math.log(8) and _g2(a, b, toxic, clean) >= LEAST_G2}
    # a form that a longer one replaces: as many toxic documents and no more clean ones
    drop = {f[:n] for f, (a, b) in by.items() for n in range(1, len(f)) if f[:n] in by and by[f[:n]][0] <= a and by[f[:n]][1] >= b}
    kept: dict[str, float] = {}
    for f in sorted(by.keys() - drop, key=lambda f: (-_g2(*by[f], toxic, clean), f)):
        if not any(f[:n] in kept for n in range(1, len(f))) and not any(k.startswith(f) for k in kept) and len(kept) < max_terms:
            kept[f] = round(min(rate(*by[f]), 6.0), 6)
    # words beside their stems: the stem takes no misspellings, the word's automaton does
    beside = [f for f in by if allowed(f) and f not in kept and any(f[:n] in kept for n in range(1, len(f)))]
    for f in sorted(beside, key=lambda f: (-_g2(*by[f], toxic, clean), f))[:max_terms]:
        kept[f] = round(min(rate(*by[f]), 6.0), 6)
    return kept


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> tuple[tuple[float, ...], float]:
    """Ridge logistic regression by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w[:-1])), float(w[-1])


def misspellings(found: list) -> list[str]:
    """The distinct misspelled words of a document's matches; quoted ones do not count."""
    return sorted({word for _, e, word, quoted, _ in found if e and not quoted})


def clean_misspellings(counts: Iterable[tuple[str, int, int]], toxic: int, clean: int) -> frozenset[str]:
    """Of (misspelling, toxic documents, clean documents) those that are relatively more frequent in clean documents."""
    return frozenset(word for word, a, b in counts if b * toxic > a * clean)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, max_terms: int = MAX_TERMS) -> ToxicityModel:
    """Fits lexicon, exceptions and model on at most ``max_labelled`` of the labelled documents."""
    spark = docs.sparkSession
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).collect()  # bounded by max_labelled
    chosen = spark.createDataFrame([(r.doc_id, int(r.toxic)) for r in chosen], "doc_id long, y int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = materialize(texts.join(F.broadcast(chosen), "doc_id").where("text is not null").select("text", "y"), "labelled")
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    model = ToxicityModel(prior=toxic / max(toxic + clean, 1))
    if not toxic or not clean:
        return model
    counted = sample.select("y", F.explode_outer(forms(F.col("text"))).alias("form")).where("form is not null").groupBy("form").agg(
        F.sum("y").cast("long").alias("a"), F.sum(1 - F.col("y")).cast("long").alias("b")
    )
    least = max(3, math.ceil(0.002 * toxic))  # forms below it cannot reach the least ratio with fewer documents
    top = counted.where((F.col("a") >= least) & (F.col("a") * clean > 4 * F.col("b") * toxic)).orderBy(F.desc(F.col("a") - F.col("b") * toxic / clean), "form").limit(40 * max_terms)
    model.weights = choose_terms([(r.form, r.a, r.b) for r in top.collect()], toxic, clean, max_terms)
    if not model.weights:
        return model
    weights = model.weights
    matched = materialize(sample.select("y", _matches_of(weights)("text").alias("m")), "matches")
    words = F.array_distinct(F.transform(F.filter("m", lambda h: (h["e"] > 0) & ~h["quoted"]), lambda h: h["word"]))
    seen = matched.select("y", F.explode(words).alias("word")).groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where("b > 0")
    model.exceptions = clean_misspellings([(r.word, r.a, r.b) for r in seen.collect()], toxic, clean)  # within a few edits of the lexicon
    excepted = model.exceptions

    def numbers(batches: Iterable) -> Iterable:
        for batch in batches:
            kept = [[tuple(h.values()) for h in m if not (h["e"] and h["word"] in excepted)] for m in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(m, weights) for m in kept], pa.list_(pa.float64()))], ["y", "x"])

    rows = matched.mapInArrow(numbers, "y int, x array<double>").collect()  # bounded by max_labelled
    model.coef, model.bias = fit_logistic(np.array([r.x for r in rows]), np.array([r.y for r in rows], float))
    return model


_MATCH = pa.struct([("term", pa.string()), ("e", pa.int32()), ("word", pa.string()), ("quoted", pa.bool_()), ("n", pa.int32())])
_TOXICITY = pa.struct([("score", pa.float64()), ("n_matches", pa.int32()), ("n_quoted", pa.int32())])


def _strips(texts: pa.Array) -> Iterable[str | None]:
    """The texts of a batch; only a strip of them is held as Python strings."""
    for low in range(0, len(texts), STRIP):
        yield from texts.slice(low, STRIP).to_pylist()


def _matches_of(weights: dict[str, float]):
    def run(texts: pa.Array) -> pa.Array:
        of = _matcher(weights).matches
        return pa.array([[dict(zip(("term", "e", "word", "quoted", "n"), h)) for h in of(t)] for t in _strips(texts)], pa.list_(_MATCH))

    return F.arrow_udf(run, "array<struct<term:string,e:int,word:string,quoted:boolean,n:int>>")


def with_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """Adds ``out`` (in place of a column of that name): a struct of ``score`` (0 to 1), ``n_matches`` and ``n_quoted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 2 * max_terms terms and a sample's misspellings

    @F.arrow_udf("struct<score double, n_matches int, n_quoted int>")
    def toxicity(texts: pa.Array) -> pa.Array:
        scorer = _scorer(shared.value)
        found = map(scorer.matches, _strips(texts))
        return pa.array([(scorer.score(f), len(f), sum(h[3] for h in f)) for f in found], _TOXICITY)

    return docs.withColumn(out, toxicity(F.col(text_col)))


def held_out(doc_id: Column) -> Column:
    """Rows that nothing learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op3_query(spark, sf_dir: str) -> DataFrame:
    from chronolith.llm.common import table

    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    scored = with_toxicity(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        F.when(F.col("toxicity.score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.col("toxicity.n_matches").alias("n_matches"),
        F.col("toxicity.n_quoted").alias("n_quoted"),
    )
