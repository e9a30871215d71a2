"""Array goldens (FIXTURES §3) for E3, E5–E14, E18, E20, E22–E24."""

from pyspark.sql import functions as F

from tidecorpus import constants as K
from tidecorpus.operators import encode as en


def _row(spark, **cols):
    schema = ", ".join(f"{k} array<int>" for k in cols)
    return spark.createDataFrame([tuple(cols.values())], schema)


def test_build_inputs_and_masks(spark):
    df = _row(spark, a=[5, 6], b=[7])
    r = df.select(
        en.build_inputs("a").alias("single"),
        en.build_inputs("a", "b").alias("pair"),
        en.special_tokens_mask("a").alias("m1"),
        en.special_tokens_mask("a", "b").alias("m2"),
    ).collect()[0]
    assert r["single"] == [0, 5, 6, 2]
    assert r["pair"] == [0, 5, 6, 2, 2, 7, 2]
    assert r["m1"] == [1, 0, 0, 1]
    assert r["m2"] == [1, 0, 0, 1, 1, 0, 1]
    assembled = _row(spark, x=[0, 5, 2, 1]).select(en.special_tokens_mask("x", already_has_special_tokens=True).alias("m"))
    assert assembled.collect()[0]["m"] == [1, 0, 1, 0]


def test_pair_truncation_table(spark):
    pairs = [(10, 2), (2, 10), (10, 10), (5, 4), (4, 3), (1, 9), (9, 1), (8, 7)]
    want = {
        7: [(5, 2), (2, 5), (3, 4), (4, 3), (4, 3), (1, 6), (6, 1), (4, 3)],
        6: [(4, 2), (2, 4), (3, 3), (3, 3), (3, 3), (1, 5), (5, 1), (3, 3)],
    }
    df = spark.createDataFrame(pairs, "la int, lb int")
    for budget, expected in want.items():
        ka, kb = en.pair_lengths(F.col("la"), F.col("lb"), budget + 4)
        got = [(r["a"], r["b"]) for r in df.select(ka.alias("a"), kb.alias("b")).collect()]
        assert got == expected


def test_pad_truncate_lengths(spark):
    df = _row(spark, x=[0, 5, 2])
    r = df.select(
        en.pad("x", 6).alias("p"), en.pad("x", 2).alias("q"), en.truncate("x", 3).alias("t"),
        en.token_length(F.array(*[F.lit(v) for v in [1, 1, 1, 1, 0]])).alias("n"),
    ).collect()[0]
    assert r["p"] == [0, 5, 2, 1, 1, 1]
    assert r["q"] == [0, 5, 2]
    assert r["t"] == [0]
    assert r["n"] == 2
    r = df.select(en.attention_mask(en.pad("x", 5)).alias("m"), en.token_type_ids("x").alias("tt")).collect()[0]
    assert r["m"] == [1, 1, 1, 0, 0] and r["tt"] == [0, 0, 0]


def test_add_missing_tokens(spark):
    vocab = spark.createDataFrame([(f"t{i}", i) for i in range(31002)], "token string, id int")
    out = en.add_missing_tokens(vocab, K.SOCIAL_TOKENS).filter(F.col("id") >= 31002).orderBy("id").collect()
    assert [(r["token"], r["id"]) for r in out] == [("@usuario", 31002), ("url", 31003), ("hashtag", 31004), ("emoji", 31005)]


def test_lookups_unknown(spark):
    vocab = spark.createDataFrame([("<unk>", 3), ("a", 5), ("b", 6)], "token string, id int")
    df = spark.createDataFrame([(1, ["a", "zz", "b"]), (2, [])], "k long, toks array<string>")
    ids = en.lookup_ids(df, "k", "toks", vocab).orderBy("k").collect()
    assert ids[0]["ids"] == [5, 3, 6] and ids[1]["ids"] == []
    back = en.lookup_tokens(spark.createDataFrame([(1, [5, 99])], "k long, ids array<int>"), "k", "ids", vocab).collect()
    assert back[0]["tokens"] == ["a", "<unk>"]


def test_mlm_mask_invariants(spark):
    n = 300
    rows = [(i, list(range(10, 10 + 40))) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, body array<int>").select("id", en.build_inputs("body").alias("ids"), en.special_tokens_mask("body").alias("sm"))
    ids, labels = en.mlm_mask("ids", "sm", "id", seed=1, vocab_size=1000)
    out = df.select("ids", "sm", ids.alias("m"), labels.alias("l")).collect()
    chosen = total = 0
    for r in out:
        for x, s, m, lab in zip(r["ids"], r["sm"], r["m"], r["l"]):
            if s == 1:
                assert m == x and lab == K.IGNORE_INDEX  # specials never masked
            else:
                total += 1
                if lab != K.IGNORE_INDEX:
                    chosen += 1
                    assert lab == x
                else:
                    assert m == x
    assert 0.12 < chosen / total < 0.18


def test_equality_and_labels_vector(spark):
    a = spark.createDataFrame([(1, [1, 2]), (2, [3])], "k long, ids array<int>")
    b = spark.createDataFrame([(1, [1, 2]), (2, [4])], "k long, ids array<int>")
    assert en.encodings_equal(a, a, "k", ["ids"]).collect()[0][0] is True
    assert en.encodings_equal(a, b, "k", ["ids"]).collect()[0][0] is False
    df = spark.createDataFrame([(1, 0, 1)], "a int, b int, c int")
    assert df.select(en.labels_vector(["a", "b", "c"]).alias("v")).collect()[0]["v"] == [1, 0, 1]


def test_effective_max_length():
    assert en.effective_max_length(128, 512) == 128
    assert en.effective_max_length(256, 128) == 128
    assert en.effective_max_length(None, 4096) == 1024
    assert en.effective_max_length(None, None) == 1024
