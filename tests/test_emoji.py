"""T1d goldens: one for each kind of written emoji; nothing of a sequence is left over."""

import pytest
from pyspark.sql import functions as F

from helpers import one
from tidecorpus.functions import text as tx

GOLDENS = [
    ("\U0001F1E6\U0001F1F7", "bandera: Argentina"),
    ("\U0001F1EB\U0001F1F7", "bandera FR"),
    ("3\ufe0f\u20e3", "tecla 3"),
    ("*\u20e3", "tecla *"),
    ("\U0001F44D\U0001F3FD", "pulgar hacia arriba: tono de piel medio"),
    ("\U0001F44D", "pulgar hacia arriba"),
    ("\u2764\ufe0f", "corazón rojo"),
    ("\u2764\ufe0f\u200d\U0001F525", "corazón en llamas"),
    ("\U0001F468\u200d\U0001F469\u200d\U0001F467", "familia: hombre, mujer, niña"),
    ("\U0001F469\U0001F3FF\u200d\U0001F4BB", "profesional de la tecnología mujer: tono de piel oscuro"),
    ("\U0001F937\U0001F3FB\u200d\u2640\ufe0f", ""),
    ("\U0001F3F4\U000E0067\U000E0062\U000E0065\U000E006E\U000E0067\U000E007F", ""),
    ("\U0001F63A", ""),
]


@pytest.mark.parametrize("seq, name", GOLDENS)
def test_each_kind(spark, seq, name):
    assert one(spark, tx.replace_emoji(F.col("x")), f"a{seq}b") == f"a emoji {name} emoji b"


def test_neighbours_and_others(spark):
    flags = "\U0001F1E6\U0001F1F7\U0001F1FA\U0001F1FE"
    assert one(spark, tx.social_normalise(F.col("x")), f"gol {flags}!") == "gol emoji bandera: Argentina emoji emoji bandera: Uruguay emoji !"
    for plain in ("", "no 3 * # emoji", "漢字 é \u200d \ufe0f"):
        assert one(spark, tx.replace_emoji(F.col("x")), plain) == plain
    assert one(spark, tx.replace_emoji(F.col("x")), None) is None
    assert one(spark, tx.replace_emoji(F.col("x"), "w", {"\u2600": "sol"}), "\u2600\ufe0f\U0001F44D") == " w sol w  w  w "
