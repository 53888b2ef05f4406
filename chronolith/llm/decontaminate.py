"""Benchmark decontamination: every training passage queries a BM25 index of the benchmark's items.

The inverted index holds, for each word, its blocks of items with each block's highest impact, and in them the
postings; all are sparse arrays in proportion to the items' text. Impacts are BM25 weights divided by the item's own
total, so a score is the share of an item that a passage covers and one threshold fits all items. An item whose
question carries less than ``QUESTION_SHARE`` of its weight has a second entry, for the question alone.

A passage is searched by block-max WAND, for all passages of a batch together. Its words are ordered by their highest
impact; up to the pivot, the words whose impacts add up to less than a share of the threshold, they cannot lift any item
over it alone. Only the lists of the words from the pivot on are read. Their block maxima and the impacts before the pivot
bound each block, then the block maxima of all the passage's words do, and postings are read only in blocks whose
bound reaches the threshold: everything above it is retrieved and nothing else is scored.

Retrieved pairs are verified by word trigrams: the item's question (up to its last sentence) and its answer (the
last sentence; the last third where there is just one) must both be found in the passage, or nearly all of the question.

Items are kept in layers by length, for items of up to 64, 128, 256 words and so on. Passages are as long as two items of the
layer and begin at every item length, so each item's copy lies in one of them, and a long item changes nothing for short ones.

An index is broadcast only up to ``max_items`` items and ``max_bytes`` of text (or one single item above it); a larger
benchmark is split by a hash of its rows. Word and item counts and the mean length come from the whole benchmark, so that
every part gives the scores of an index that is not split. The driver holds one part at a time; after each ``AT_ONCE`` parts the
documents found so far are written, so that a task holds no more of them either.

Cases: null and empty texts and items match nothing; repeated items are reported for each item id; words are
compared in lower case without punctuation; ties, repeated rows and extra columns change nothing; empty tables
give no matches.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import materialize

K1, B = 1.2, 0.75
BLOCK = 4
STEP = 64
THRESHOLD = 0.5
BOTH, QUESTION_ALONE = 0.5, 0.8
QUESTION_SHARE = 0.7  # THRESHOLD of the whole item may be out of reach for a passage with the question alone
SHORT = 8  # items of fewer words must be found whole
MAX_ITEMS, MAX_BYTES = 4096, 8 << 20
AT_ONCE = 4
PIVOT = 0.3  # share of the threshold that a passage's words before the pivot may reach: the lower, the tighter the first bound
KNOWN_WORDS = 150_000
PAIRS = 1 << 18  # of passages and words, or postings, looked at together
_SLACK = 1.00001  # bounds stay above rounded sums
_LEAK = "array<struct<item_id:long,score:double,question:double,answer:double,first_word:long>>"


def plain(word: str) -> str:
    """A word without punctuation, in lower case."""
    word = word.lower().strip(".,;:!?|\"'()")
    return word if word.isalnum() else "".join([c for c in word if c.isalnum()])


def split_item(text: str | None) -> tuple[list[str], int]:
    """An item's words, and the place where its answer begins."""
    words, cut, sentence = [], None, 0
    for raw in (text or "").split():
        w = plain(raw)
        if w:
            if sentence and sentence == len(words):
                cut = len(words)
            words.append(w)
        if re.search(r"[.!?]['\")]*$", raw):
            sentence = len(words)
    return words, cut if cut is not None and len(words) - cut >= 2 else max(len(words) - max(len(words) // 3, 1), 0)


@dataclass
class Item:
    item_id: int
    words: list[int]
    cut: int  # the answer begins here


@dataclass
class Layer:
    """The entries of the items of like length. Words have ranks, in the order of their highest impact."""

    step: int
    item: np.ndarray  # of each entry
    rank: np.ndarray  # of each word of the vocabulary, -1 without entries; the last one stands for unknown words
    highest: np.ndarray  # impact of each rank
    first: np.ndarray  # list of each rank: where its blocks begin
    block: np.ndarray  # of each list element
    best: np.ndarray  # its highest impact
    key: np.ndarray  # rank * blocks + block, ascending
    posting: np.ndarray  # where its postings begin
    entry: np.ndarray  # of each posting
    impact: np.ndarray
    blocks: int


@dataclass
class Index:
    vocabulary: dict[str, int] = field(default_factory=dict)
    items: list[Item] = field(default_factory=list)
    layers: list[Layer] = field(default_factory=list)


@dataclass
class Counts:
    """Of the whole benchmark: items, their mean length, and the items that have each word."""

    n: int
    mean: float
    df: dict[str, int]


def count_items(rows: list[tuple[int, list[str], int]]) -> Counts:
    return Counts(len(rows), sum(len(w) for _, w, _ in rows) / max(len(rows), 1), Counter(t for _, w, _ in rows for t in set(w)))


def _impacts(words: list[int], df: list[int], counts: Counts) -> tuple[dict[int, float], float]:
    norm = K1 * (1 - B + B * len(words) / counts.mean)
    w = {t: math.log(1 + (counts.n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in sorted(Counter(words).items())}
    total = sum(w.values())
    return {t: v / total for t, v in w.items()}, total


def build_index(rows: list[tuple[int, list[str], int]], counts: Counts | None = None) -> Index:
    """The index of (item id, words, cut); ``counts`` of a larger benchmark that these rows are a part of."""
    counts = counts or count_items(rows)
    index = Index()
    for item_id, words, cut in sorted((r for r in rows if r[1]), key=lambda r: (len(r[1]), r[0], r[1])):
        index.items.append(Item(item_id, [index.vocabulary.setdefault(w, len(index.vocabulary)) for w in words], cut))
    df = [counts.df[w] for w in index.vocabulary]
    steps: dict[int, list[int]] = {}
    for i, x in enumerate(index.items):
        step = STEP
        while step < len(x.words):
            step *= 2
        steps.setdefault(step, []).append(i)
    for step, members in steps.items():
        entries: list[tuple[int, dict[int, float]]] = []
        for i in members:
            x = index.items[i]
            whole, _ = _impacts(x.words, df, counts)
            entries.append((i, whole))
            if x.cut >= SHORT and sum(whole[t] for t in set(x.words[: x.cut])) < QUESTION_SHARE:
                entries.append((i, _impacts(x.words[: x.cut], df, counts)[0]))
        index.layers.append(_layer(step, entries, len(index.vocabulary)))
    return index


def _layer(step: int, entries: list[tuple[int, dict[int, float]]], n_words: int) -> Layer:
    sizes = [len(w) for _, w in entries]
    entry = np.repeat(np.arange(len(entries)), sizes)
    term = np.fromiter((t for _, w in entries for t in w), np.int64, sum(sizes))
    impact = np.fromiter((v for _, w in entries for v in w.values()), float, sum(sizes))
    top = np.zeros(n_words)
    np.maximum.at(top, term, impact)
    used = np.flatnonzero(top)
    used = used[np.argsort(top[used], kind="stable")]
    rank = np.full(n_words + 1, -1, np.int64)
    rank[used] = np.arange(len(used))
    blocks = -(-len(entries) // BLOCK)
    key = rank[term] * blocks + entry // BLOCK
    order = np.lexsort((entry, key))
    key, entry, impact = key[order], entry[order], impact[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    pairs = key[starts]
    first = np.searchsorted(pairs // blocks, np.arange(len(used) + 1))
    return Layer(step, np.array([i for i, _ in entries]), rank, top[used] * _SLACK, first, pairs % blocks, np.maximum.reduceat(impact, starts) * _SLACK, pairs, np.append(starts, len(key)), entry, impact, blocks)


def _grams(words: list[int], n: int) -> set[tuple[int, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def _share(part: list[int], passage: list[int], have: set) -> float:
    n = min(3, len(part))
    if not n:
        return 1.0
    want = _grams(part, n)
    got = have if n == 3 else _grams(passage, n)
    return len(want & got) / len(want)


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each of the spans of n numbers, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _sections(sizes: np.ndarray, most: int = PAIRS) -> Iterator[slice]:
    """Cuts a sequence so that the sizes in each slice sum up to about ``most``."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")), at + 1)
        yield slice(at, to)
        at = to


def retrieve(layer: Layer, passage: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(passage, entry, score) above the threshold, of distinct pairs of a passage and a word's rank in order."""
    if not len(passage):
        return
    begins = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    n_words = np.diff(np.append(begins, len(passage)))
    running = np.cumsum(layer.highest[word])
    before = np.repeat(running[begins] - layer.highest[word[begins]], n_words)
    running = running - before  # impacts of a passage's words up to this one
    reaches = np.repeat(running[begins + n_words - 1] >= THRESHOLD, n_words)
    needed = reaches & (running >= PIVOT * THRESHOLD)  # from the pivot on
    at = np.flatnonzero(needed)
    ordinal = np.repeat(np.arange(len(begins)), n_words)
    n_low = np.bincount(ordinal, ~needed, len(begins)).astype(np.int64)
    low_sum = np.bincount(ordinal, np.where(needed, 0.0, layer.highest[word]), len(begins))
    lists = layer.first[word[at] + 1] - layer.first[word[at]]
    for part in _passage_sections(ordinal[at], lists):
        mine = at[part]
        k = lists[part]
        element = _spans(layer.first[word[mine]], k)
        pair, where = np.unique(np.repeat(ordinal[mine], k) * layer.blocks + layer.block[element], return_inverse=True)
        bound = np.bincount(where, layer.best[element], len(pair))
        likely = bound + low_sum[pair // layer.blocks] >= THRESHOLD
        pair, bound = pair[likely], bound[likely]
        # the words before the pivot, by their block maxima
        n = n_low[pair // layer.blocks]
        mine, found = _elements(layer, pair, begins, n, word)
        pair = pair[bound + np.bincount(mine, layer.best[found], len(pair)) >= THRESHOLD]
        for some in _sections(n_words[pair // layer.blocks]):
            yield from _score(layer, pair[some], begins, n_words, passage, word)


def _elements(layer: Layer, pair: np.ndarray, begins: np.ndarray, n: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the pair, list element) for the first ``n`` words of each pair's passage that have its block."""
    mine = np.repeat(np.arange(len(pair)), n)
    key = word[_spans(begins[pair // layer.blocks], n)] * layer.blocks + (pair % layer.blocks)[mine]
    found = np.searchsorted(layer.key, key)
    found[found == len(layer.key)] = 0
    hit = layer.key[found] == key
    return mine[hit], found[hit]


def _passage_sections(of: np.ndarray, sizes: np.ndarray) -> Iterator[slice]:
    """Like :func:`_sections`, but without cutting inside a passage."""
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.empty(0, int)
    ends = np.append(starts[1:], len(of))
    for s in _sections(np.add.reduceat(sizes, starts) if len(starts) else np.empty(0, int)):
        yield slice(int(starts[s.start]), int(ends[s.stop - 1]))


def _score(layer: Layer, pair: np.ndarray, begins: np.ndarray, n_words: np.ndarray, passage: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """Scores the items of the pairs (passage's ordinal and block)."""
    of, block = pair // layer.blocks, pair % layer.blocks
    mine, found = _elements(layer, pair, begins, n_words[of], word)
    k = layer.posting[found + 1] - layer.posting[found]
    posting = _spans(layer.posting[found], k)
    slot = np.repeat(mine, k) * BLOCK + layer.entry[posting] % BLOCK
    score = np.round(np.bincount(slot, layer.impact[posting], len(pair) * BLOCK), 9)
    for s in np.flatnonzero(score >= THRESHOLD).tolist():
        p, e = divmod(s, BLOCK)
        yield int(passage[begins[of[p]]]), int(block[p]) * BLOCK + e, float(score[s])


class Searcher:
    def __init__(self, index: Index):
        self.index = index
        self.known: dict[str, int] = {}

    def _ids(self, text: str) -> list[int]:
        """Numbers of the text's words; the one after the last stands for unknown ones."""
        raw = text.split()
        got = list(map(self.known.get, raw))
        if None in got:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            none = len(self.index.vocabulary)
            for i, x in enumerate(got):
                if x is None:
                    w = plain(raw[i])
                    got[i] = self.known[raw[i]] = self.index.vocabulary.get(w, none) if w else -1
        return [x for x in got if x >= 0] if -1 in got else got

    def search(self, texts: list[str | None]) -> list[list[tuple[int, float, float, float, int]]]:
        """(item id, score, question, answer, first word) of the verified items of each text."""
        out: list[list] = [[] for _ in texts]
        index = self.index
        words = [self._ids(t) if t else [] for t in texts] if index.items else []
        sizes = np.array([len(w) for w in words], np.int64)
        if not sizes.sum():
            return out
        flat = np.concatenate([np.array(w, np.int64) for w in words])
        of, place = np.repeat(np.arange(len(words)), sizes), _spans(np.zeros(len(sizes), np.int64), sizes)
        for layer in index.layers:
            rank = layer.rank[flat]
            known = rank >= 0
            if not known.any():
                continue
            # chunks of a step; a passage is a chunk and the next one of its document, and the last chunk ends the one before
            chunks = np.maximum(-(-sizes // layer.step), 1)
            first = np.cumsum(chunks) - chunks
            chunk = first[of[known]] + place[known] // layer.step
            number, doc = place[known] // layer.step, of[known]
            own, earlier = number < np.maximum(chunks[doc] - 1, 1), number > 0
            pairs = np.unique(np.concatenate([chunk[own] * len(layer.highest) + rank[known][own], (chunk[earlier] - 1) * len(layer.highest) + rank[known][earlier]]))
            last, have = -1, set()
            for p, e, score in retrieve(layer, pairs // len(layer.highest), pairs % len(layer.highest)):
                if p != last:
                    last, d = p, int(np.searchsorted(first, p, "right")) - 1
                    low = int(p - first[d]) * layer.step
                    passage = words[d][low : low + 2 * layer.step]
                    have = _grams(passage, 3)
                item = index.items[layer.item[e]]
                q, a = _share(item.words[: item.cut], passage, have), _share(item.words[item.cut :], passage, have)
                if min(q, a) >= (BOTH if len(item.words) >= SHORT else 1.0) or (q >= QUESTION_ALONE and item.cut >= SHORT):
                    out[d].append((item.item_id, round(score, 6), round(q, 6), round(a, 6), low))
        return [self._best(x) for x in out]

    @staticmethod
    def _best(found: list) -> list:
        """One row for each item: the passage that covers most of it."""
        best: dict[int, tuple] = {}
        for x in found:
            if x[0] not in best or (x[2] + x[3], x[1], -x[4]) > (best[x[0]][2] + best[x[0]][3], best[x[0]][1], -best[x[0]][4]):
                best[x[0]] = x
        return sorted(best.values())


_searchers: dict[int, Searcher] = {}


def _item_words(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([split_item(t) for t in texts], columns=["words", "cut"])


def indexes(benchmark: DataFrame, *, max_items: int = MAX_ITEMS, max_bytes: int = MAX_BYTES) -> Iterator[Index]:
    """Indexes of bounded size that together hold all items, one after the other."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    split = F.pandas_udf(_item_words, "struct<words array<string>, cut int>")
    items = materialize(rows.select("item_id", F.octet_length("text").alias("size"), F.xxhash64("item_id", "text").alias("h"), split("text").alias("x")).where("size(x.words) > 0"), "items")
    n, mean, size = items.agg(F.count("*"), F.avg(F.size("x.words")), F.sum("size")).first()
    if not n:
        return
    df = materialize(items.select(F.explode(F.array_distinct("x.words")).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "item-words")
    parts = max(1, math.ceil(n / max_items), math.ceil(size / max_bytes))
    while True:
        part = F.pmod(F.col("h"), F.lit(parts))
        of = items.groupBy(part).agg(F.count("*").alias("n"), F.sum("size").alias("size"))
        if not of.where((F.col("n") > 1) & ((F.col("n") > max_items) | (F.col("size") > max_bytes))).take(1):
            break
        parts = math.ceil(parts * 1.5)
    for k in range(parts):
        mine = items.where(part == k)
        found = mine.select("item_id", "x.words", "x.cut").collect()  # within max_items and max_bytes
        if found:
            own = df.join(mine.select(F.explode("x.words").alias("word")).distinct(), "word", "left_semi").collect()  # the part's words
            yield build_index([(r.item_id, r.words, r.cut) for r in found], Counts(n, mean, {r.word: r.n for r in own}))


def _finder(shared):
    """A function of texts that runs the broadcast index."""

    def find(texts: pd.Series) -> pd.Series:
        index = shared.value
        if id(index) not in _searchers:
            if len(_searchers) >= 2 * AT_ONCE:
                _searchers.clear()
            _searchers[id(index)] = Searcher(index)
        search = _searchers[id(index)].search
        rows = texts.tolist()
        found = [x for low in range(0, len(rows), 128) for x in search(rows[low : low + 128])]
        names = ("item_id", "score", "question", "answer", "first_word")
        return pd.Series([[dict(zip(names, x)) for x in leaks] for leaks in found], dtype=object)

    return find


def with_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", out: str = "leaks", max_items: int = MAX_ITEMS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Adds ``out`` (in place of a column of that name): item id, score, shares of question and answer, and the passage's first word, for each item found."""
    column, n = F.array().cast(_LEAK), 0
    for index in indexes(benchmark, max_items=max_items, max_bytes=max_bytes):
        if n and n % AT_ONCE == 0:
            docs, column = materialize(docs.withColumn(out, column), "leaks"), F.col(out)
        shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by max_items and max_bytes
        column, n = F.concat(column, F.pandas_udf(_finder(shared), _LEAK)(F.col(text_col))), n + 1
    return docs.withColumn(out, F.array_sort(column))


def op1_query(spark, sf_dir: str) -> DataFrame:
    from chronolith.llm.common import table

    found = with_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")
