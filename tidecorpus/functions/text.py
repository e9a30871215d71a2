"""Text normalisation as Spark ``Column`` functions.

Everything here is a native expression (regexp_replace / replace / lower /
transform) so it stays inside whole-stage codegen. Only Unicode normal forms
(NFKC, accent stripping) need Python; they live in ``functions.udfs``.

Regex classes are written with ``\\x{..}`` escapes so the same pattern text is
valid in Java regex (Spark) and RE2 (the DuckDB oracle).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

# Python's str.isspace() set, spelled for both regex engines.
PY_WS = (
    "[\\x09-\\x0D\\x1C-\\x1F\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)
NOT_WS = PY_WS.replace("[", "[^", 1)
WORD = K.WORD_CHAR
NON_WORD = K.NON_WORD_CHAR
# control / format / private characters except tab, newline, carriage return; U+FFFD
CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}\\p{Cf}\\p{Co}\\x{FFFD}]"
BERT_WS = "[\\t\\n\\r\\p{Zs}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- T2 – T5
def newlines_to_period(c) -> Column:
    """Every run of ``\\n`` becomes ``". "``."""
    return F.regexp_replace(_c(c), "\\n+", ". ")


def collapse_whitespace(c) -> Column:
    """Every run of Unicode whitespace becomes one space."""
    return F.regexp_replace(_c(c), PY_WS + "+", " ")


def strip_ws(c) -> Column:
    """T4 in general form: strip Python whitespace at both ends."""
    return F.regexp_replace(_c(c), "^" + PY_WS + "+|" + PY_WS + "+$", "")


def tidy(c) -> Column:
    """T2 → T3 → T4: the tail of the social normaliser."""
    # after T3 every whitespace run is a single ' ', so a plain trim is exact
    return F.trim(collapse_whitespace(newlines_to_period(c)))


def collapse_emoji_spans(c) -> Column:
    """T5: ``emoji.*?emoji`` → ``emoji`` left to right; ``.`` stops at ``\\n`` only."""
    return F.regexp_replace(_c(c), "(?d)emoji.*?emoji", K.EMOJI_WRAPPER)


# ---------------------------------------------------------------- T1 social normaliser
def literal(token: str) -> str:
    """A token as a regex replacement that stands for itself."""
    return token.replace("\\", "\\\\").replace("$", "\\$")


def replace_urls(c, token: str = K.URL_TOKEN) -> Column:
    """``http(s)://…`` or ``www.…`` up to the next whitespace → url token."""
    return F.regexp_replace(_c(c), "https?://" + NOT_WS + "+|www\\." + NOT_WS + "+", literal(token))


def replace_mentions(c, token: str = K.USER_TOKEN) -> Column:
    """``@handle`` → user token (run after T1b so ``@`` inside URLs survives)."""
    return F.regexp_replace(_c(c), "@" + WORD + "+", literal(token))


def split_hashtag_camel(c) -> Column:
    """Camel-case split inside ``#Tags`` only: ``#VivaPeron`` → ``#Viva Peron``.

    ``(?<=#)`` starts at the tag, ``\\G(?!^)`` continues right after the previous
    split of the same tag, so words outside tags are never split.
    """
    return F.regexp_replace(_c(c), "(?:(?<=#)|\\G(?!^))(\\p{L}*?\\p{Ll})(?=\\p{Lu})", "$1 ")


def replace_hashtags(c, token: str = K.HASHTAG_TOKEN) -> Column:
    """``#Tag`` → `` hashtag Tag ``."""
    return F.regexp_replace(_c(c), "#(" + WORD + "+)", f" {literal(token)} $1 ")


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
REGIONAL_LETTERS = "".join(chr(0x1F1E6 + i) for i in range(26))


def replace_emoji(c, wrapper: str = K.EMOJI_WRAPPER, names: dict | None = None) -> Column:
    """T1d: emoji → `` emoji <name> emoji``; emoji without a name → `` emoji  emoji ``.

    An emoji is read as it is written: flags (two letters), keycaps, and symbols with variation selector, skin
    tone, tag letters and joiners are one each, so no joiner or selector is left over. A sequence is named by
    the table, else by its form without skin tones plus the tone; a flag the table lacks is ``bandera`` and its
    letters, a keycap ``tecla`` and its sign. The lookup is an Arrow UDF: SQL functions name a match only by one
    pass over the text for each name, or by lambdas, which no other UDF accepts in its arguments.
    """
    from .udfs import emoji_namer

    return emoji_namer(wrapper, K.EMOJI_NAMES if names is None else names)(_c(c))


def cap_char_runs(c, n: int = 3) -> Column:
    """T1e: a character repeated more than ``n`` times is cut to ``n``."""
    return F.regexp_replace(_c(c), "(?d)(.)\\1{%d,}" % n, "$1" * n)


def normalize_laughter(c) -> Column:
    """T1e (option): ``jajaja…`` / ``jejeje…`` style laughs → ``jaja``."""
    return F.regexp_replace(_c(c), "(?i)(?<!" + WORD + ")(?:j+[aeiou]){2,}j*(?!" + WORD + ")", "jaja")


def social_normalise(
    c,
    user_token: str = K.USER_TOKEN,
    url_token: str = K.URL_TOKEN,
    hashtag_token: str = K.HASHTAG_TOKEN,
    emoji_wrapper: str = K.EMOJI_WRAPPER,
    shorten: int | None = 3,
    laughter: bool = False,
    camel_split: bool = True,
) -> Column:
    """T1 + T2–T4: the full tweet preprocessor, as one native expression chain."""
    out = replace_urls(c, url_token)
    out = replace_mentions(out, user_token)
    if shorten:
        out = cap_char_runs(out, shorten)
    if camel_split:
        out = split_hashtag_camel(out)
    out = replace_hashtags(out, hashtag_token)
    out = replace_emoji(out, emoji_wrapper)
    if laughter:
        out = normalize_laughter(out)
    return tidy(out)


# ---------------------------------------------------------------- tokenizer normaliser T6–T15
def clean_text(c) -> Column:
    """Drop control, format, private and unassigned characters, U+0000 and U+FFFD; whitespace → space."""
    return F.regexp_replace(F.regexp_replace(_c(c), CONTROL + "|\\p{Cn}", ""), BERT_WS, " ")


def space_cjk(c) -> Column:
    """Put a space on both sides of each CJK ideograph."""
    return F.regexp_replace(_c(c), "(" + K.CJK_RANGES + ")", " $1 ")


def rewrap_user(c) -> Column:
    """``(\\W)?@usuario(\\W)`` → `` @usuario `` (eats the neighbours)."""
    return F.regexp_replace(_c(c), "(" + NON_WORD + ")?@usuario(" + NON_WORD + ")", " @usuario ")


def rewrap_hashtag(c) -> Column:
    """Every literal ``hashtag`` → `` hashtag ``."""
    return F.replace(_c(c), F.lit("hashtag"), F.lit(" hashtag "))


def rewrap_url(c) -> Column:
    """``(\\W)url(\\W)`` → `` url ``."""
    return F.regexp_replace(_c(c), "(" + NON_WORD + ")url(" + NON_WORD + ")", " url ")


def fix_http_url(c) -> Column:
    """Literal ``http://url`` → `` url `` (after T13)."""
    return F.replace(_c(c), F.lit("http://url"), F.lit(" url "))


def tokenizer_normalise(c, lowercase: bool = False, strip_accents: bool = False) -> Column:
    """NFKC → clean text → CJK → accents → lower → T11–T14."""
    from .udfs import nfkc, strip_accents as _strip

    out = space_cjk(clean_text(nfkc(_c(c))))
    if strip_accents:
        out = _strip(out)
    if lowercase:
        out = F.lower(out)
    return fix_http_url(rewrap_url(rewrap_hashtag(rewrap_user(out))))


# ---------------------------------------------------------------- T16–T18
def detokenise(tokens) -> Column:
    """Join pieces by space, drop ``"@@ "`` continuation marks, strip."""
    return F.trim(F.replace(F.array_join(_c(tokens), " "), F.lit(K.CONTINUATION), F.lit("")))


def metaspace_to_text(pieces) -> Column:
    """T17 tail: concatenate pieces and turn the word mark into spaces."""
    return F.trim(F.replace(F.array_join(_c(pieces), ""), F.lit(K.WORD_MARK), F.lit(" ")))


def characters(c) -> Column:
    """Split a string into characters (astral code points stay whole)."""
    return F.split(_c(c), "", -1)


# ---------------------------------------------------------------- token counting
def whitespace_token_count(c) -> Column:
    """Number of space-separated tokens of a tidied string (0 for empty).

    A tidied string has single inner spaces and none at the ends, so the count
    is spaces + 1 – no token array is materialised."""
    s = _c(c)
    spaces = F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    return F.when(F.length(s) == 0, F.lit(0)).otherwise(spaces + 1)


def basic_token_count(c) -> Column:
    """Words plus single punctuation marks (a BERT-style pre-tokenisation count)."""
    return F.regexp_count(_c(c), F.lit("[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}" + PY_WS[1:-1] + "]"))


def token_len(c, max_length: int = K.MAX_LENGTH, basic: bool = False) -> Column:
    """E14 on a count: body length with truncation at ``max_length`` (two specials)."""
    n = basic_token_count(c) if basic else whitespace_token_count(c)
    return F.least(n, F.lit(max_length - 2))
