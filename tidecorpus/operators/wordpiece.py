"""WordPiece encoding with added tokens.

The encoder of the corpus filter: a text is cleaned and lower-cased, the added
tokens are cut out first (leftmost, then longest, wherever they stand, also
inside a word), what is left is split at white space, marks and ideographs, and
each word is spelt by the longest vocabulary entry that starts it, then by the
longest continuation entries (``##``). A word that cannot be spelt whole, or is
longer than ``max_word`` characters, is one unknown token.

In Spark the vocabulary (at most ``vocab_size`` rows) is broadcast once; an Arrow
UDF walks two prefix tries, one of entries that start a word and one of
continuations. Pieces of a white-space chunk are remembered for the life of the
task, up to ``MEMO_CHARS`` characters in all and only for chunks of up to
``MEMO_WORD``, so a text without spaces costs no memory beside its own.
``token_counter`` stops at its cap: the length that truncation leaves needs no
more than the first ``cap`` pieces.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.slices import pieces_and_ids, sliced_udf

# --- fixed values: entry names of the published vocabulary files ---
PAD, UNK, CLS, SEP, MASK = "[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"
SPECIALS = [PAD, UNK, CLS, SEP, MASK]
CONTINUES = "##"
MAX_WORD = 100

MEMO_WORD = 64
MEMO_CHARS = 1_000_000
_SPACE = re.compile("[ \t\n\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_CJK = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m.group(1), 16)), K.CJK_RANGES))
_END = ""


def trie_of(entries: Iterable[str]) -> dict:
    """Nested dicts by character; the empty key marks an entry's end."""
    root: dict = {}
    for e in entries:
        node = root
        for c in e:
            node = node.setdefault(c, {})
        node[_END] = True
    return root


def longest(trie: dict, word: str, start: int) -> int:
    """End of the longest entry of the trie that stands at ``start`` (``start`` if none)."""
    node, end = trie, start
    for i in range(start, len(word)):
        node = node.get(word[i])
        if node is None:
            return end
        if _END in node:
            end = i + 1
    return end


def word_pieces(word: str, heads: dict, tails: dict, max_word: int = MAX_WORD) -> list[str]:
    """Longest match first; the whole word is unknown if any part of it is."""
    if len(word) > max_word:
        return [UNK]
    out, at = [], 0
    while at < len(word):
        end = longest(tails if at else heads, word, at)
        if end == at:
            return [UNK]
        out.append((CONTINUES if at else "") + word[at:end])
        at = end
    return out


def is_mark(c: str) -> bool:
    """ASCII marks (also those that Unicode calls symbols) and Unicode punctuation."""
    return ("!" <= c <= "~" and not c.isalnum()) or unicodedata.category(c)[0] == "P"


def clean_chunk(chunk: str, lowercase: bool, strip_accents: bool) -> str:
    """Without control, format, private and unassigned characters and U+FFFD; accents and case as asked."""
    if not chunk.isascii() or not chunk.isprintable():
        chunk = "".join(c for c in chunk if c != "\ufffd" and unicodedata.category(c) not in ("Cc", "Cf", "Cn", "Co"))
    if strip_accents:
        chunk = "".join(c for c in unicodedata.normalize("NFD", chunk) if unicodedata.category(c) != "Mn")
    return chunk.lower() if lowercase else chunk


def split_marks(text: str) -> list[str]:
    """Words, and every mark and ideograph alone."""
    if text.isalnum() and text.isascii():
        return [text]
    out, word = [], ""
    for c in text:
        if is_mark(c) or _CJK.match(c):
            if word:
                out.append(word)
            out.append(c)
            word = ""
        else:
            word += c
    return out + [word] if word else out


class WordPiece:
    """The encoder over plain strings; every worker builds one from the broadcast vocabulary."""

    def __init__(self, tokens: Iterable[str], added: Sequence[str] = (), lowercase: bool = True, strip_accents: bool = False, max_word: int = MAX_WORD):
        tokens = list(tokens)
        if any(_SPACE.search(a) or not a for a in added):
            raise ValueError("an added token holds no white space")
        self.heads = trie_of(t for t in tokens if not t.startswith(CONTINUES) and t not in SPECIALS)
        self.tails = trie_of(t[len(CONTINUES) :] for t in tokens if t.startswith(CONTINUES) and len(t) > len(CONTINUES))
        # alternatives are tried in order, so longer first makes the match leftmost, then longest
        ordered = sorted(set(added), key=lambda a: (-len(a), a))
        self.added = re.compile("(" + "|".join(map(re.escape, ordered)) + ")") if ordered else None
        self.lowercase, self.strip_accents, self.max_word = lowercase, strip_accents, max_word
        self.memo: dict[str, tuple[str, ...]] = {}
        self.memo_chars = 0

    def chunk(self, chunk: str) -> tuple[str, ...]:
        """Pieces of one run without white space."""
        got = self.memo.get(chunk)
        if got is not None:
            return got
        text, out = clean_chunk(chunk, self.lowercase, self.strip_accents), []
        for i, part in enumerate(self.added.split(text) if self.added else [text]):
            if i % 2:
                out.append(part)
            else:
                for word in split_marks(part):
                    out += word_pieces(word, self.heads, self.tails, self.max_word)
        got = tuple(map(sys.intern, out))  # a piece is held once, however many words have it
        if len(chunk) <= MEMO_WORD:
            if self.memo_chars > MEMO_CHARS:
                self.memo.clear()
                self.memo_chars = 0
            self.memo[chunk] = got
            self.memo_chars += len(chunk) + sum(map(len, got))
        return got

    def pieces(self, text: str) -> list[str]:
        out: list[str] = []
        for c in _SPACE.split(text):
            if c:
                out += self.chunk(c)
        return out

    def count(self, text: str, cap: int) -> int:
        """Number of pieces, at most ``cap``; reads no further than it must."""
        n, at = 0, 0
        while n < cap and at < len(text):
            m = _SPACE.search(text, at)
            end = m.start() if m else len(text)
            if end > at:
                n += len(self.chunk(text[at:end]))
            at = m.end() if m else len(text)
        return min(n, cap)


def _shared(vocab: DataFrame, added, lowercase, strip_accents, max_word) -> Callable[[], WordPiece]:
    tokens = [r["token"] for r in vocab.select("token").collect()]  # ≤ vocab_size rows
    bc = vocab.sparkSession.sparkContext.broadcast(tokens)
    return lambda: WordPiece(bc.value, added, lowercase, strip_accents, max_word)


def token_counter(vocab: DataFrame, added: Sequence[str] = K.SOCIAL_TOKENS, cap: int = K.MAX_LENGTH - 2, collapse: bool = True, lowercase: bool = True, strip_accents: bool = False, max_word: int = MAX_WORD):
    """E14 in the filter: a UDF ``text → int``, the pieces of the text after newline runs became ``". "`` and,
    with ``collapse``, emoji spans one token; truncated at ``cap``. Null text: 0."""
    make = _shared(vocab, added, lowercase, strip_accents, max_word)
    spans, lines = re.compile("emoji.*?emoji"), re.compile("\n+")

    def count():
        model = make()

        def length(t: str | None) -> int:
            t = lines.sub(". ", t) if t else ""
            return model.count(spans.sub(K.EMOJI_WRAPPER, t) if collapse and K.EMOJI_WRAPPER in t else t, cap)

        return lambda texts: pa.array([length(t) for t in texts.to_pylist()], pa.int32())

    return sliced_udf(T.IntegerType(), count)


def encoder(vocab: DataFrame, added: Sequence[str] = (), lowercase: bool = True, strip_accents: bool = False, max_word: int = MAX_WORD):
    """A UDF ``text → struct<pieces: array<string>, ids: array<int>>`` of the whole text. Added tokens
    that the vocabulary lacks get the next ids, in their order. Null text: empty arrays."""
    make = _shared(vocab, added, lowercase, strip_accents, max_word)
    ids = {r["token"]: r["id"] for r in vocab.select("token", "id").collect()}  # ≤ vocab_size rows
    for a in added:
        ids.setdefault(a, max(ids.values(), default=-1) + 1)
    unk = ids.get(UNK)
    if unk is None:
        raise ValueError(f"the vocabulary has no {UNK}")
    bc = vocab.sparkSession.sparkContext.broadcast(ids)

    def encode():
        model, table = make(), bc.value

        def coded(texts: pa.Array) -> pa.Array:
            pieces = [model.pieces(t) if t else [] for t in texts.to_pylist()]
            return pieces_and_ids(pieces, [[table.get(p, unk) for p in row] for row in pieces])

        return coded

    return sliced_udf("struct<pieces: array<string>, ids: array<int>>", encode)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a published vocabulary file: one entry a line, its id the line's number from 0. The
    file is one bounded object and is read as such; of repeated entries the last counts."""
    text = spark.read.text(path, wholetext=True).first()[0]
    lines = text.split("\n")
    ids = {t.rstrip("\r"): i for i, t in enumerate(lines[:-1] if lines and not lines[-1] else lines)}
    return spark.createDataFrame(sorted(ids.items(), key=lambda x: x[1]), "token string, id int")


def filter_corpus(df: DataFrame, vocab: DataFrame, text_col: str = "text", min_tokens: int = K.MIN_TOKENS, **options) -> DataFrame:
    """P10 by subword pieces: the rows whose length is at least ``min_tokens``; the text itself is kept."""
    return df.filter(token_counter(vocab, **options)(F.col(text_col)) >= min_tokens)
