"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one last token is possible in the BPE encoding of that prefix. An Aho-Corasick
automaton lists the tokens that end at each position; the one that is compatible with the last token of the prefix
before it is stored; the stored tokens, followed backwards, are the encoding.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

#: Ends the last symbol of a word inside the automaton; byte symbols never use this character.
END = "\0"
#: Words longer than this are encoded anew each time; words of a generation, and pairs of tokens, that are remembered.
REMEMBERED_CHARS, REMEMBERED_WORDS, REMEMBERED_PAIRS = 64, 120_000, 300_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if visible in Latin-1, else from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens with how each is merged. Symbols are characters; `suffix` marks the last symbol of a word."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str | None):
        self.suffix = suffix or ""
        inner = (lambda s: s.removesuffix(suffix) + END if s.endswith(suffix) else s) if suffix else (lambda s: s)
        self.text = {i: s for s, i in vocab.items()}
        self.ids = {inner(s): i for s, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for at, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = at
            self.parts.setdefault(both, (left, right))
            self.born.setdefault(both, at)
        self._fits: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.ids.items():
            if self._reachable(i):
                self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one rim of `token` while it is merged, smallest first, each with the rank of the merge that made it."""
        out = []
        while token in self.parts:
            out.append((token, self.born[token]))
            token = self.parts[token][side]
        return [(token, -1), *reversed(out)]

    def _meets(self, a: int, b: int) -> bool:
        """Whether merging a's symbols next to b's gives a, then b, with no merge across before both are whole.

        Merges happen by rank, the leftmost first on equal ranks. So the rims grow in order of rank, and a merge
        across comes first if its rank is below the next growth, or equal to it when that growth is on the right.
        """
        left, right = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        while True:
            grow_l = left[i + 1][1] if i + 1 < len(left) else None
            grow_r = right[j + 1][1] if j + 1 < len(right) else None
            if grow_l is None and grow_r is None:
                return True
            by_left = grow_r is None or (grow_l is not None and grow_l <= grow_r)
            across = self.rank.get((left[i][0], right[j][0]))
            if across is not None and (across < grow_l if by_left else across <= grow_r):
                return False
            i, j = (i + 1, j) if by_left else (i, j + 1)

    @lru_cache(maxsize=None)  # noqa: B019  one vocabulary lives as long as its worker
    def _reachable(self, token: int) -> bool:
        """Whether the token's own symbols are encoded as this token."""
        if token not in self.parts:
            return True
        a, b = self.parts[token]
        return self._reachable(a) and self._reachable(b) and self._meets(a, b)

    def fits(self, a: int, b: int) -> bool:
        """Whether token b can follow token a in an encoding."""
        key = a << 24 | b
        out = self._fits.get(key)
        if out is None:
            out = (a, b) not in self.rank and self._meets(a, b)
            if len(self._fits) >= REMEMBERED_PAIRS:
                self._fits.clear()
            self._fits[key] = out
        return out

    def encode_word(self, symbols: str) -> list[int]:
        """Ids of a word given as byte symbols."""
        if not symbols:
            return []
        if self.suffix:
            symbols += END
        n = len(symbols)
        last: list[int] = [-1] * (n + 1)
        width: list[int] = [0] * (n + 1)
        fits = self.fits
        for end, (length, token) in self.automaton.iter(symbols):
            end += 1
            start = end - length
            if last[end] < 0 and (not start or last[start] >= 0 and fits(last[start], token)):
                last[end], width[end] = token, length
        if last[n] < 0:
            raise ValueError("a symbol of the word is not in the vocabulary")
        out = []
        while n:
            out.append(last[n])
            n -= width[n]
        return out[::-1]


class WordBpe:
    """Encoder and decoder of a `tokenizers` file: NFC, lower case, words by its split pattern, byte symbols, BPE."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix"):
            raise ValueError("a BPE vocabulary without subword prefix is needed")
        self.source = source
        self.vocabulary = Vocabulary(model["vocab"], model["merges"], model.get("end_of_word_suffix"))
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = self.vocabulary.text | {i: s for s, i in self.specials.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.byte = byte_symbols()
        self.back = {s: b for b, s in enumerate(self.byte)}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def pieces(self, text: str) -> list[str]:
        """Words as the vocabulary's file parts them. Latin texts take a short way with equal results; others go through the library."""
        if text.isascii() or not COMMON.search(text):
            return self.words.findall(unicodedata.normalize("NFC", text).lower())
        return [bytes([self.back[c] for c in w]).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    @cached_property
    def library(self):
        """Loaded where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.source)

    def encode_piece(self, word: str) -> tuple[int, ...]:
        """Ids of a word, remembered in two generations: what is still in use when the younger is full lives on."""
        ids = self.known.get(word)
        if ids is None:
            ids = self.older.get(word)
            if ids is None:
                byte = self.byte
                ids = tuple(self.vocabulary.encode_word("".join([byte[b] for b in word.encode()])))
            if len(word) <= REMEMBERED_CHARS:
                if len(self.known) >= REMEMBERED_WORDS:
                    self.older, self.known = self.known, {}
                self.known[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.specials:
                out.append(self.specials[part])
            elif part:
                for word in self.pieces(part):
                    out += self.known.get(word) or self.encode_piece(word)
        return out

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: the tokens' strings, special ones too, joined by a space."""
        names = self.names
        return " ".join([names[i] for i in ids])


#: Anything but Latin, Greek and Cyrillic letters, common marks and punctuation: there, or for letters whose lower case depends on neighbours, the library's own tables decide.
COMMON = re.compile("[^\\x00-\\u02af\\u0391-\\u03a1\\u03a4-\\u03a9\\u03b1-\\u03c9\\u0410-\\u044f\\u2010-\\u2027\\u2030-\\u203a\\u20ac]|[\\x1c-\\x1f\\u0130]")


def encoder(source: str) -> WordBpe:
    """The encoder of a vocabulary file's content; a worker keeps the last one."""
    if (kept := _KEPT.get(source)) is None:
        _KEPT.clear()
        kept = _KEPT[source] = WordBpe(source)
    return kept


_KEPT: dict[str, WordBpe] = {}


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep_text: bool = True) -> DataFrame:
    """docs with the token ids of every whole text and the text decoded from them again.

    vocabulary: path of a `tokenizers` BPE file on the driver; its content (a few MB, whatever the corpus) goes along
    with the tasks. Null texts count as empty: no ids, decoded to "". Extra columns stay; columns named like the two
    results are replaced. Rows are independent: no shuffle, equal texts have equal ids, any number of repeated rows; long
    texts are encoded whole, word by word. Empty tables give empty ones.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())
    added = T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.StringType())])

    def start():
        bpe = encoder(sent.value)

        def make(texts: list[str]) -> list[list]:
            found = [bpe.encode(x) for x in texts]
            return [found, [bpe.decode(x) for x in found]]

        return make

    return map_texts(docs, text, start, added, keep_text)


def decode_documents(docs: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the text of their ids; null ids give null, unknown ids an error."""
    with open(vocabulary, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    frame = docs.drop(decoded)
    place = frame.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(sent.value)
        for batch in batches:
            texts = pa.array([None if x is None else bpe.decode(x) for x in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, decoded])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField(decoded, T.StringType())]))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (decimal, one space between) and of the decoded text."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
