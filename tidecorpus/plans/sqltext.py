"""DuckDB (RE2) spellings of the native text functions, for the oracle SQL.

Each builder takes a SQL expression string and returns one; the regex text is
the same as in ``functions.text`` (``$1`` becomes ``\\1`` in RE2 replacements).
"""

from __future__ import annotations

from .. import constants as K
from ..functions import text as tx


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
REGIONAL_LETTERS = "".join(chr(0x1F1E6 + i) for i in range(26))


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rr(x: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(repl)}, 'g')"


def rep(x: str, a: str, b: str) -> str:
    return f"replace({x}, {q(a)}, {q(b)})"


SOCIAL = (
    "text || ' @u' || CAST(doc_id AS VARCHAR) || ' http://x.y/' || CAST(doc_id AS VARCHAR) || "
    "' #CamelTag' || CAST(doc_id AS VARCHAR) || ' www.site' || CAST(doc_id AS VARCHAR) || '.org/p'"
    " || ' \U0001F923 ok \U0001F63A'"
)


def newlines(x):
    return rr(x, "\\n+", ". ")


def collapse_ws(x):
    return rr(x, tx.PY_WS + "+", " ")


def tidy(x):
    return f"trim({collapse_ws(newlines(x))})"


def collapse_emoji(x):
    return rr(x, "emoji.*?emoji", K.EMOJI_WRAPPER)


def urls(x):
    return rr(x, "https?://" + tx.NOT_WS + "+|www\\." + tx.NOT_WS + "+", K.URL_TOKEN)


def mentions(x):
    return rr(x, "@" + tx.WORD + "+", K.USER_TOKEN)


def hashtags(x):
    return rr(x, "#(" + tx.WORD + "+)", f" {K.HASHTAG_TOKEN} \\1 ")


def emoji(x):
    """T1d as a split, a lookup and a join; ``x`` is written out three times."""
    table = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in K.EMOJI_NAMES.items()) + "}"
    tones = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in K.SKIN_TONES.items()) + "}"
    tone = "[" + "".join(K.SKIN_TONES) + "]"
    plain = "replace(s, chr(65039), '')"
    bare = f"regexp_replace({plain}, '{tone}', '', 'g')"
    flag = f"'bandera ' || translate({plain}, {q(REGIONAL_LETTERS)}, {q(LETTERS)})"
    rest = f"CASE WHEN contains({plain}, chr(8419)) THEN 'tecla ' || substr({plain}, 1, 1) WHEN regexp_full_match({plain}, '[\\x{{1F1E6}}-\\x{{1F1FF}}]{{2}}') THEN {flag} ELSE '' END"
    toned = f"CASE WHEN {table}[{bare}] IS NOT NULL THEN concat_ws(': ', {table}[{bare}], {tones}[regexp_extract({plain}, '{tone}')]) END"
    name = f"coalesce({table}[{plain}], {toned}, {rest})"
    seqs = f"list_transform(regexp_extract_all({x}, {q(K.EMOJI_SEQUENCE)}), lambda s: ' {K.EMOJI_WRAPPER} ' || {name} || ' {K.EMOJI_WRAPPER} ')"
    around = f"string_split_regex({x}, {q(K.EMOJI_SEQUENCE)})"
    return f"array_to_string(list_transform(list_zip({around}, {seqs}), lambda p: p[1] || coalesce(p[2], '')), '')"


def social_plain(x):
    """T1 without camel split and run cap (both need Java-only regex)."""
    return tidy(emoji(hashtags(mentions(urls(x)))))


def clean(x):
    return rr(rr(x, tx.CONTROL, ""), tx.BERT_WS, " ")


def cjk(x):
    return rr(x, "(" + K.CJK_RANGES + ")", " \\1 ")


def rewrap(x):
    out = rr(x, "(" + tx.NON_WORD + ")?@usuario(" + tx.NON_WORD + ")", " @usuario ")
    out = rep(out, "hashtag", " hashtag ")
    out = rr(out, "(" + tx.NON_WORD + ")url(" + tx.NON_WORD + ")", " url ")
    return rep(out, "http://url", " url ")


def tokenizer_normalise(x, lowercase=False, strip_accents=False):
    out = cjk(clean(x))
    if strip_accents:
        out = f"strip_accents({out})"
    if lowercase:
        out = f"lower({out})"
    return rewrap(out)


def ws_count(x):
    return f"(CASE WHEN length({x}) = 0 THEN 0 ELSE len(string_split({x}, ' ')) END)"
