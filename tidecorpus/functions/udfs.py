"""The few steps Spark has no native function for: Unicode normal forms and names of written emoji.

Arrow UDFs that go through their batches a slice at a time (``slices``); each is a
small helper over Python's ``unicodedata`` and ``re``.
"""

from __future__ import annotations

import re
import unicodedata

from .. import constants as K
from .slices import text_udf

#: Unicode NFKC.
nfkc = text_udf(lambda: lambda x: unicodedata.normalize("NFKC", x))


def _strip(x: str) -> str:
    return x if x.isascii() else "".join(ch for ch in unicodedata.normalize("NFD", x) if unicodedata.category(ch) != "Mn")


#: NFD, then drop non-spacing marks (``ñ`` → ``n``).
strip_accents = text_udf(lambda: _strip)


def _chars(pattern: str) -> str:
    """``\\x{...}`` spelt as the character, for Python's ``re``."""
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m.group(1), 16)), pattern)


def emoji_name(seq: str, names: dict[str, str]) -> str:
    """Name of one written emoji: by the table, by its form without skin tone plus the tone, else by its kind."""
    plain = seq.replace("\ufe0f", "")
    if plain in names:
        return names[plain]
    tones = [c for c in plain if c in K.SKIN_TONES]
    bare = "".join(c for c in plain if c not in K.SKIN_TONES)
    if bare in names:
        return f"{names[bare]}: {K.SKIN_TONES[tones[0]]}"
    if "\u20e3" in plain:
        return f"tecla {plain[0]}"
    if 0x1F1E6 <= ord(plain[0]) <= 0x1F1FF:
        return "bandera " + "".join(chr(ord(c) - 0x1F1E6 + ord("A")) for c in plain)
    return ""


def emoji_namer(wrapper: str, names: dict[str, str]):
    """T1d: a UDF that puts `` <wrapper> <name> <wrapper> `` in the place of every written emoji."""
    written = _chars(K.EMOJI_SEQUENCE)

    def named():
        find, memo = re.compile(written), {}

        def one(m):
            seq = m.group()
            if seq not in memo:
                if len(memo) > 100_000:
                    memo.clear()
                memo[seq] = f" {wrapper} {emoji_name(seq, names)} {wrapper} "
            return memo[seq]

        return lambda t: t if t.isascii() else find.sub(one, t)

    return text_udf(named)
