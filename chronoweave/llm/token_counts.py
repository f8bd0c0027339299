"""Token counts of texts of any length by overlap resynchronisation.

A huge text is encoded in chunks that overlap. Byte-level BPE parts a text into words by a scanner that looks only
forward, so from a place where two scans both begin a word, they agree. A chunk's words are exact from its first
stable boundary to a margin before its end; where the next chunk begins one of the same words, the two are spliced.
If no boundary is shared, the overlap is doubled, up to the end of the text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import accumulate

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, whole

#: Characters of a chunk, and by how many the next begins before its end.
CHUNK, OVERLAP = 32_768, 512
#: The scanner of byte-level vocabularies: contractions, letters, digits, other signs, blanks.
SCANNER = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Beyond these characters, whose classes are the same everywhere, the library scans.
RARE = re.compile("[^\\x00-\\x1b\\x20-\\u02af\\u0391-\\u03a1\\u03a4-\\u03a9\\u03b1-\\u03c9\\u0410-\\u044f\\u2010-\\u2027\\u2030-\\u203a\\u20ac]")
REMEMBERED_CHARS, REMEMBERED_WORDS = 64, 500_000


class Counter:
    """Counts tokens as the `tokenizers` library does: scans words, encodes each distinct one once, adds up."""

    def __init__(self, source: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        from tokenizers import Tokenizer

        spec = json.loads(source)
        scanner = spec["pre_tokenizer"]
        if spec["normalizer"] or scanner["type"] != "ByteLevel" or scanner["add_prefix_space"] or not scanner["use_regex"]:
            raise ValueError("chunks can be spliced for byte-level scanning without normalisation only")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("chunks can be spliced for special tokens that do not depend on neighbours only")
        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = {t["content"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        # a special token's text that is cut off, an unfinished contraction and one character of lookahead lie within this
        self.margin = max([len(s) for s in self.specials] + [4]) + 4
        self.chunk, self.overlap = max(chunk, 2 * self.margin), max(overlap, 2 * self.margin)
        self.known: dict[str, int] = {}

    def words(self, text: str) -> list[str]:
        """The words of a text, which together are the text; a special token's string is one."""
        out: list[str] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.specials:
                out.append(part)
            elif part.isascii() or not RARE.search(part):
                out += SCANNER.findall(part)
            else:
                out += [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def tokens(self, words: list[str]) -> list[int]:
        """Tokens of each word. A word alone is scanned as itself, so it is encoded as in its text."""
        known = self.known
        new = list({w for w in words if w not in known})
        if new:
            if len(known) + len(new) > REMEMBERED_WORDS:
                known.clear()
                new = list(set(words))
            counts = [len(e) for e in self.library.encode_batch_fast(new, add_special_tokens=False)]
            fresh = dict(zip(new, counts, strict=True))
            known.update((w, n) for w, n in fresh.items() if len(w) <= REMEMBERED_CHARS)
            return [known.get(w) or fresh[w] for w in words]
        return [known[w] for w in words]

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        most = self.chunk + self.overlap
        return [sum(self.tokens(self.words(x))) if len(x) <= most else sum(n for _, _, n in self.spans(x)) for x in texts]

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """(offset where each word begins, tokens before it), both with an end."""
        words = self.words(text)
        return list(accumulate(map(len, words), initial=0)), list(accumulate(self.tokens(words), initial=0))

    def spans(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(begin, end, tokens) of consecutive exact parts that make up the text. Memory holds two chunks, or the longest
        stretch without a word's begin."""
        n, base, begin, before = len(text), 0, 0, 0
        end = min(n, self.chunk + self.overlap)
        offsets, sums = self.encode(text[:end])
        while end < n:
            cut, overlap = base + self.chunk, self.overlap
            ahead_end = min(n, cut + self.chunk + self.overlap)
            ahead = self.encode(text[cut:ahead_end])
            while end < n:
                # words of ours that begin at or after the cut, and of theirs up to the margin before our end
                ours = {at + base: i for i, at in enumerate(offsets) if cut <= at + base <= end - self.margin}
                shared = next(((at + cut, j) for j, at in enumerate(ahead[0]) if at + cut in ours), None)
                if shared:
                    break
                overlap *= 2
                end = min(n, cut + overlap)
                offsets, sums = self.encode(text[base:end])
                if ahead_end < min(n, end + self.overlap):
                    ahead_end = min(n, end + self.chunk)
                    ahead = self.encode(text[cut:ahead_end])
            else:
                break
            splice, place = shared
            yield begin, splice, sums[ours[splice]] - before
            base, begin, end = cut, splice, ahead_end
            offsets, sums = ahead
            before = sums[place]
        yield begin, n, sums[-1] - before


_KEPT: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", n_tokens: str = "n_tokens", keep_text: bool = True, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with the number of tokens of every whole text.

    vocabulary: path of a byte-level BPE file of the `tokenizers` library on the driver; its content (a few MB) goes
    along with the tasks. Special strings inside texts count as the library counts them. Null texts count as empty: 0.
    Extra columns stay; a column named like the result is replaced. Rows are independent, so ties, repeated rows and
    empty tables need no care, and there is no shuffle. Long texts are counted whole, two chunks at a time.
    """
    with open(vocabulary, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def start():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        key = f"{chunk} {overlap} {sent.value}"
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = Counter(sent.value, chunk, overlap)
        return lambda texts: [_KEPT[key].counts(texts)]

    return map_texts(docs, text, start, T.StructType([T.StructField(n_tokens, T.LongType())]), keep_text)


def n_bytes(text: Column | str) -> Column:
    """UTF-8 bytes of the text; 0 for null."""
    return F.octet_length(whole(text)).cast("long")
