"""Word-cached byte-pair tokenization with the ``tokenizers`` library's own model.

A word-level BPE file (lower case, white space dropped) never merges across white space, so a text's ids
are the concatenation of its words' ids. Each worker keeps two bounded caches, of white-space-separated
chunks and of the pre-tokens inside them, and asks the library's model only for pre-tokens it has not seen.
Texts for which that decomposition could differ from the library go to the library as a whole.
"""

from __future__ import annotations

import json
import struct
import unicodedata

import regex

from chronolith.llm.common import using, worker_cache

#: Entries that a cache holds before it is emptied: bounds a worker's memory, never changes a result.
CACHE_ENTRIES = 300_000


def byte_alphabet() -> list[str]:
    """The printable character that byte-level BPE uses for each byte."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        if b in kept:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str, width: int = 4, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        if kinds != ["NFC", "Replace", "Lowercase"] or not split.get("invert") or split.get("behavior") != "Removed":
            raise ValueError(f"{path} is not a lower-casing word tokenizer")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.model = self.library.model
        self.letter = byte_alphabet()
        self.code = {2: "H", 4: "I"}[width]
        self.width = width
        self.entries = entries
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= self.entries:
                self.words.clear()
            letter = self.letter
            found = self.pack([t.id for t in self.model.tokenize("".join([letter[b] for b in word.encode()]))])
            if len(word) <= 64:
                self.words[word] = found
        return found

    def chunk(self, chunk: str) -> bytes:
        found = b"".join(map(self.word, self.pattern.findall(chunk)))
        if len(chunk) <= 64:
            if len(self.chunks) >= self.entries:
                self.chunks.clear()
            self.chunks[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as the library gives them, without added special tokens."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f") or any(s in text for s in self.specials):
            # The library counts these four as symbols where Python splits on them; it also finds special strings.
            return self.pack(self.library.encode(text, add_special_tokens=False).ids)
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # the library lowers each character alone: no final sigma
                text = text.replace("Σ", "σ")
        parts = text.lower().split()
        got = list(map(self.chunks.get, parts))
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    got[i] = self.chunks.get(parts[i]) or self.chunk(parts[i])
        return b"".join(got)


_made: dict[tuple[str, int, int], WordTokenizer] = worker_cache("word tokenizer", {})


def word_tokenizer(path: str, width: int = 4, entries: int = CACHE_ENTRIES) -> WordTokenizer:
    """One tokenizer for each worker process and file."""
    using("word tokenizer")
    if (path, width, entries) not in _made:
        _made[path, width, entries] = WordTokenizer(path, width, entries)
    return _made[path, width, entries]
