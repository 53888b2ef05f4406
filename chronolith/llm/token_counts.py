"""Token counts by a compiled finite-state transducer.

A SentencePiece BPE vocabulary is compiled, lazily, into a deterministic transducer over characters. A state is the
longest end of the read text that can still grow into a piece, and, for each place in it, the token that the encoding
of the text up to there ends in, with the count there relative to the count here. There are finitely many, and
equal ones are one state whatever text led to them. A transition reads a character and emits the change of the
count: the encoding of the longer text ends in the one token whose left neighbour does not merge with it.

No piece has a space mark after another character, so a mark that follows another character leads to a start state
from everywhere: whole segments are arcs from start to start, kept with what they emit. Pieces of marks alone score
below all others and alike, so a run of marks is cut from the left into the longest of them; all but its last mark
emit a number that follows from the run's length, and the start states differ in what the last mark costs if the run takes it.

A long text is read in chunks. A chunk's state map holds, for entry states, the state reached and the tokens
emitted. Maps are made independently, compose, and are combined by a prefix scan in a logarithmic number of rounds. A map
starts with the entry state that the characters before the chunk suggest, and takes up any other one when asked.

Cases: null and empty texts have no tokens; very long texts are read chunk by chunk, in time proportional to their
length; an empty table gives no rows; repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CHUNK = 1 << 16
CONTEXT = 256  # characters before a chunk that suggest its entry state
#: Kept arcs and states; beyond them a worker compiles anew. They bound memory and never change a count.
ARCS, STATES = 600_000, 400_000
_LOW, _BITS = 32, 6  # a transition is packed as target << _BITS | emitted + _LOW

#: The last token there, and the count there minus the count here. Where the segment starts, the cost of its mark as a
#: token alone stands for the token.
Place = tuple[str | int, int]


class Transducer:
    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.score: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                self.score[sp.id_to_piece(i)] = sp.get_score(i)
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece crosses a segment start")
        runs = {p: s for p, s in self.score.items() if len(p) > 1 and not p.strip(MARK)}
        if any(p.startswith(MARK * 2) for p in self.score.keys() - runs.keys()) or len(set(runs.values())) > 1 or max(runs.values(), default=-1e30) >= min(s for p, s in self.score.items() if len(p) > 1 and p not in runs):
            raise ValueError("the pieces of spaces alone have not one score below all others")
        # tokens of runs of marks by the defining procedure: they repeat with the longest piece
        self.period = max(map(len, runs), default=1)
        self.in_run = [len(self.merge(MARK * n)) if n else 0 for n in range(4 * self.period)]
        if any(self.in_run[n] != self._run(n) for n in range(4 * self.period)):
            raise ValueError("runs of spaces have no period")
        # pieces that merging reaches at all, with the two halves of their last merge; characters stand for themselves
        self.halves: dict[str, tuple[str, str]] = {}
        for p in self.score:
            if len(p) > 1 and not p.startswith(MARK * 2) and self.merge(p, last := []) == [p]:
                self.halves[p] = last[-1]
        self.begins = {p[:n] for p in self.halves for n in range(1, len(p))}
        self.rank = {p: i for i, p in enumerate(sorted(self.halves, key=lambda p: -self.score[p]))}
        self.arcs: dict[str, int] = {}
        self.reset()

    def _run(self, n: int) -> int:
        """Tokens of a run of n marks."""
        full, rest = divmod(n, self.period)
        return full * self.in_run[self.period] + self.in_run[rest]

    def reset(self) -> None:
        self.next: dict[int, int] = {}  # state << 21 | character: target << _BITS | emitted + _LOW
        self.states: list[tuple[str, tuple[Place, ...]]] = []
        self.number: dict[tuple[str, tuple[Place, ...]], int] = {}
        costs = {self._run(n + 1) - self._run(n) for n in range(2 * self.period)}
        self.start = {c: self._state("", ((c, 0),)) for c in sorted(costs, reverse=True)}

    def _state(self, end: str, places: tuple[Place, ...]) -> int:
        key = end, places
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def merge(self, text: str, done: list[tuple[str, str]] | None = None) -> list[str]:
        """The defining procedure: merge the best-scored adjacent pair, leftmost first."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            if done is not None:
                done.append((parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether two tokens stay apart side by side: undoes their merges, latest first, and looks for one
        across the border that would have come earlier (of equal ones, the leftmost comes first)."""
        rank, halves = self.rank.get, self.halves
        a, b, limit = rank(left, -1), rank(right, -1), 1 << 30
        while True:
            if rank(left + right, limit) < limit:
                return False
            if a > b:
                limit = a
                left = halves[left][1]
                a = rank(left, -1)
            elif b < 0:
                return True
            else:
                limit = b + 1
                right = halves[right][0]
                b = rank(right, -1)

    def cost(self, token: str) -> int:
        """Ids that a token stands for: unknown characters fall back to their bytes."""
        return 1 if token in self.score else len(token.encode())

    def _compile(self, state: int, c: str) -> int:
        """The packed transition of a state by a character."""
        end, places = self.states[state]
        text = end + c
        for n in range(len(text), 0, -1):
            token = text[-n:]
            if n > 1 and token not in self.rank:
                continue
            before, count = places[len(end) + 1 - n]
            if isinstance(before, int) or self.compatible(before, token):
                break
        emitted = count + (before if isinstance(before, int) and token == MARK else self.cost(token))
        keep = len(text)
        while keep and text[-keep:] not in self.begins:
            keep -= 1
        whole = [(t, k - emitted) for t, k in places] + [(token, 0)]
        to = self._state(text[len(text) - keep :], tuple(whole[len(whole) - keep - 1 :]))
        found = self.next[state << 21 | ord(c)] = to << _BITS | emitted + _LOW
        return found

    def run(self, state: int, text: str) -> tuple[int, int]:
        """(state reached, tokens emitted) for a text without a segment start."""
        get, total = self.next.get, 0
        low = (1 << _BITS) - 1
        for c in text:
            step = get(state << 21 | ord(c))
            if step is None:
                step = self._compile(state, c)
            total += step & low
            state = step >> _BITS
        return state, total - _LOW * len(text)

    def _entry(self, segment: str) -> tuple[int, int, str]:
        """(start state, tokens of the run before the last mark, segment with one mark)."""
        if not segment.startswith(MARK * 2):
            return self.start[1], 0, segment
        word = segment.lstrip(MARK)
        n = len(segment) - len(word)
        return self.start[self._run(n) - self._run(n - 1)], self._run(n - 1), MARK + word

    def arc(self, segment: str) -> int:
        """What a whole segment emits."""
        state, emitted, one = self._entry(segment)
        found = emitted + self.run(state, one)[1]
        if len(segment) <= 64:
            if len(self.arcs) >= ARCS:
                self.arcs.clear()
            self.arcs[segment] = found
        return found

    def closed(self, segments: list[str]) -> int:
        got = list(map(self.arcs.get, segments))
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    known = self.arcs.get(segments[i])
                    got[i] = self.arc(segments[i]) if known is None else known
        return sum(got)

    def map_of(self, chunk: str, entries: list[int]) -> ChunkMap:
        """The state map of a chunk, which has marks for spaces and does not begin or end beside one inside a run."""
        head, *rest = split_segments(chunk)
        fixed = None
        if rest:
            state, emitted, one = self._entry(rest[-1])
            state, more = self.run(state, one)
            fixed = state, self.closed(rest[:-1]) + emitted + more
        return ChunkMap(lambda q: self._through(q, head, fixed), entries)

    def _through(self, state: int, head: str, fixed: tuple[int, int] | None) -> tuple[int, int]:
        state, emitted = self.run(state, head)
        return (state, emitted) if fixed is None else (fixed[0], emitted + fixed[1])

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        if len(self.states) > STATES:
            self.reset()
        text = MARK + text.replace(" ", MARK)
        if len(text) <= CHUNK:
            return self.closed([x for x in split_segments(text) if x])
        cuts = [0]
        while len(text) - cuts[-1] > CHUNK:
            at = cuts[-1] + CHUNK
            if MARK in (text[at - 1], text[at]):  # not inside a run of marks: where it begins or, if that is too early, after it
                begin = len(text[cuts[-1] : at].rstrip(MARK)) + cuts[-1]
                at = begin if begin > cuts[-1] else len(text) - len(text[at:].lstrip(MARK))
            if at >= len(text):
                break
            cuts.append(at)
        maps = []
        for a, b in zip(cuts, [*cuts[1:], len(text)]):
            *_, context = split_segments(text[max(0, a - CONTEXT) : a])
            state, _, one = self._entry(context)
            maps.append(self.map_of(text[a:b], [self.run(state, one)[0] if a else self.start[1]]))
        return scan(maps)[-1](self.start[1])[1]


class ChunkMap:
    """Entry state: (state reached, tokens emitted); entries that were not foreseen are added when asked for."""

    def __init__(self, through, entries: list[int]):
        self.through = through
        self.held = {q: through(q) for q in entries}

    def __call__(self, state: int) -> tuple[int, int]:
        if state not in self.held:
            self.held[state] = self.through(state)
        return self.held[state]

    def __add__(self, other: ChunkMap) -> ChunkMap:
        """First this map, then the other."""

        def through(q: int) -> tuple[int, int]:
            middle, emitted = self(q)
            end, more = other(middle)
            return end, emitted + more

        return ChunkMap(through, list(self.held))


def scan(maps: list[ChunkMap]) -> list[ChunkMap]:
    """All prefixes' maps, in a logarithmic number of rounds of pairwise compositions."""
    if len(maps) < 2:
        return maps
    pairs = scan([maps[i] + maps[i + 1] for i in range(0, len(maps) - 1, 2)])
    return [maps[0] if i == 0 else pairs[i // 2] if i % 2 else pairs[i // 2 - 1] + maps[i] for i in range(len(maps))]


def split_segments(text: str) -> list[str]:
    """The text cut before every mark that follows another character; the first part may be empty."""
    if MARK + MARK not in text:
        first, *rest = text.split(MARK)
        return [first, *[MARK + x for x in rest]]
    parts = re.split(f"(?<!{MARK})(?={MARK})", text)
    return parts if parts[0] == "" or not text.startswith(MARK) else ["", *parts]


_made: dict[str, Transducer] = {}


def transducer(model_file: str) -> Transducer:
    if model_file not in _made:
        _made[model_file] = Transducer(model_file)
    return _made[model_file]


def count_tokens(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` and ``n_tokens`` of every text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches: Iterator) -> Iterator:
        tokens = transducer(model_file).tokens
        for batch in batches:
            texts = batch.column(1)
            counts = [tokens(t) if t else 0 for low in range(0, batch.num_rows, 512) for t in texts.slice(low, 512).to_pylist()]
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.withColumnRenamed("id", id_col)


def op5_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from chronolith.llm.common import table

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)
