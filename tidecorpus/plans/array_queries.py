"""Array / encoding / batching queries (E2, E3, E5–E24, T17) on ``documents``.

Encoding stand-in: whitespace tokens of the tidied, lower-cased text; a
word vocabulary of ``VOCAB`` entries (specials first, then the most frequent
words); unknown words → ``<unk>``. Arrays are reported joined by ``,``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import batching as bt
from ..operators import encode as en
from ..operators import scan_order as so
from ..operators.indexing import hash_bound, portable_hash_sql
from ..session import stored, table_path
from ..sources.tables import documents
from . import sqltext as S
from .registry import query

VOCAB = 2000
MAXLEN = 128
BATCH = 64


def _j(c):
    return F.array_join(c if not isinstance(c, str) else F.col(c), ",")


def tokens(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", en.word_tokens("text").alias("tokens"))


def word_vocab(spark, sf_dir) -> DataFrame:
    return en.build_word_vocab(tokens(spark, sf_dir), "tokens", VOCAB)


def small_vocab(spark, sf_dir) -> DataFrame:
    """The vocabulary as a local table (``VOCAB`` rows), so that it is trained once a query."""
    v = word_vocab(spark, sf_dir)
    return spark.createDataFrame(v.collect(), v.schema)


def encoded(spark, sf_dir, max_len: int | None = MAXLEN, vocab: DataFrame | None = None) -> DataFrame:
    """doc_id, body ids, input_ids (with specials). ``max_len`` truncates as the model input does;
    None encodes whole texts."""
    body = en.truncate("tokens", max_len) if max_len else F.col("tokens")
    t = tokens(spark, sf_dir).select("doc_id", body.alias("body_tokens"))
    ids = en.lookup_ids(t, "doc_id", "body_tokens", small_vocab(spark, sf_dir) if vocab is None else vocab, "body")
    return ids.select("doc_id", "body", en.build_inputs("body").alias("input_ids"))


# ---------------------------------------------------------------- SQL twins
_SPECIALS_SQL = "(VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(K.SEQUENCE_SPECIALS)) + ") s(token, id)"
_TIDY_LOWER = S.tidy("lower(text)")
_TOK_CTE = f"tok AS (SELECT doc_id, CASE WHEN length({_TIDY_LOWER}) = 0 THEN []::VARCHAR[] ELSE string_split({_TIDY_LOWER}, ' ') END AS tokens FROM documents)"
_VOC_CTE = f"""cnt AS (SELECT t AS token, count(*) AS n FROM (SELECT unnest(tokens) AS t FROM tok) GROUP BY t),
top AS (SELECT token, n FROM cnt WHERE token NOT IN (SELECT token FROM {_SPECIALS_SQL}) ORDER BY n DESC, token ASC LIMIT {VOCAB - 5}),
voc AS (SELECT token, id FROM {_SPECIALS_SQL} UNION ALL
        SELECT token, (row_number() OVER (ORDER BY n DESC, token ASC) - 1 + 5)::INTEGER AS id FROM top)"""


def _ids_cte(name: str, src: str, max_body: int | str = MAXLEN - 2) -> str:
    """``name``(doc_id, body) from ``src``(doc_id, tokens) through ``voc``; '' keeps whole texts."""
    return f"""{name}_ex AS (SELECT doc_id, unnest(generate_series(1, len(tokens[1:{max_body}]))) AS pos, unnest(tokens[1:{max_body}]) AS tok FROM {src}),
{name}_g AS (SELECT e.doc_id, list(coalesce(v.id, 3) ORDER BY e.pos) AS body FROM {name}_ex e LEFT JOIN voc v ON e.tok = v.token GROUP BY e.doc_id),
{name} AS (SELECT s.doc_id, coalesce(g.body, []::INTEGER[]) AS body FROM {src} s LEFT JOIN {name}_g g USING (doc_id))"""


_ENC = f"WITH {_TOK_CTE},\n{_VOC_CTE},\n{_ids_cte('enc', 'tok')},\ninp AS (SELECT doc_id, body, [0] || body || [2] AS input_ids FROM enc)\n"


_WHOLE = f"WITH {_TOK_CTE},\n{_VOC_CTE},\n{_ids_cte('enc', 'tok', '')},\ninp AS (SELECT doc_id, body, [0] || body || [2] AS input_ids FROM enc)\n"


def _s(x: str) -> str:
    return f"array_to_string({x}, ',')"


# ---------------------------------------------------------------- vocabulary
@query("e2_word_vocabulary", sql=f"WITH {_TOK_CTE},\n{_VOC_CTE}\nSELECT token, id FROM voc")
def e2_word_vocabulary(spark, sf_dir):
    return word_vocab(spark, sf_dir)


@query(
    "e3_add_missing_tokens",
    sql=f"""WITH {_TOK_CTE},\n{_VOC_CTE},
    req AS (SELECT * FROM (VALUES {", ".join(f"('{t}', {i})" for i, t in enumerate(K.SOCIAL_TOKENS + ['the']))}) r(token, ord)),
    miss AS (SELECT token, ord FROM req WHERE token NOT IN (SELECT token FROM voc))
    SELECT token, id FROM voc UNION ALL
    SELECT token, ((SELECT max(id) FROM voc) + row_number() OVER (ORDER BY ord))::INTEGER FROM miss""",
)
def e3_add_missing_tokens(spark, sf_dir):
    """Social tokens appended after the last id; ``the`` is already present."""
    return en.add_missing_tokens(word_vocab(spark, sf_dir), K.SOCIAL_TOKENS + ["the"])


@query(
    "j3_required_not_in_vocab",
    sql=f"""WITH {_TOK_CTE},\n{_VOC_CTE}
    SELECT token FROM (VALUES {", ".join(f"('{t}')" for t in K.SOCIAL_TOKENS + ['the'])}) r(token) WHERE token NOT IN (SELECT token FROM voc)""",
)
def j3_required_not_in_vocab(spark, sf_dir):
    req = spark.createDataFrame([(t,) for t in K.SOCIAL_TOKENS + ["the"]], "token string")
    return req.join(word_vocab(spark, sf_dir).select("token"), "token", "left_anti")


# ---------------------------------------------------------------- lookups
@query("e5_token_to_id", sql=_WHOLE + f"SELECT doc_id, {_s('body')} AS ids FROM enc")
def e5_token_to_id(spark, sf_dir):
    return encoded(spark, sf_dir, None).select("doc_id", _j("body").alias("ids"))


_DEC = (
    _WHOLE
    + """, dx AS (SELECT doc_id, unnest(generate_series(1, len(input_ids))) AS pos, unnest(input_ids) AS id FROM inp),
dg AS (SELECT x.doc_id, list(coalesce(v.token, '<unk>') ORDER BY x.pos) AS toks,
              list(v.token ORDER BY x.pos) FILTER (WHERE x.id > 4) AS plain FROM dx x LEFT JOIN voc v ON x.id = v.id GROUP BY x.doc_id)
"""
)


@query("e6_id_to_token", sql=_DEC + "SELECT doc_id, array_to_string(toks, ' ') AS tokens FROM dg")
def e6_id_to_token(spark, sf_dir):
    v = small_vocab(spark, sf_dir)
    dec = en.lookup_tokens(encoded(spark, sf_dir, None, v), "doc_id", "input_ids", v)
    return dec.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query("t17_decode_skip_special", sql=_DEC + "SELECT doc_id, coalesce(array_to_string(plain, ' '), '') AS text FROM dg")
def t17_decode_skip_special(spark, sf_dir):
    """Decode ids to text without the special tokens (ids 0–4)."""
    v = small_vocab(spark, sf_dir)
    e = encoded(spark, sf_dir, None, v).select("doc_id", F.filter("input_ids", lambda x: x > 4).alias("plain_ids"))
    dec = en.lookup_tokens(e, "doc_id", "plain_ids", v, "plain")
    return dec.select("doc_id", F.array_join("plain", " ").alias("text"))


# ---------------------------------------------------------------- assembly, masks, padding
@query("e7_build_inputs", sql=_ENC + f"SELECT doc_id, {_s('input_ids')} AS input_ids FROM inp")
def e7_build_inputs(spark, sf_dir):
    return encoded(spark, sf_dir).select("doc_id", _j("input_ids").alias("input_ids"))


def _pair_frame(spark, sf_dir) -> DataFrame:
    """A = tokens of the first line, B = tokens of the rest of the text."""
    d = documents(spark, sf_dir, "doc_id", "text")
    parts = F.split("text", "\n", 2)
    rest = F.when(F.size(parts) > 1, parts[1]).otherwise(F.lit(""))
    return d.select("doc_id", en.word_tokens(parts[0]).alias("ta"), en.word_tokens(rest).alias("tb"))


def _tok_sql(x: str) -> str:
    t = S.tidy(f"lower({x})")
    return f"CASE WHEN length({t}) = 0 THEN []::VARCHAR[] ELSE string_split({t}, ' ') END"


_PAIR_SQL = f"""WITH {_TOK_CTE},\n{_VOC_CTE},
pr AS (SELECT doc_id, {_tok_sql("string_split(text, chr(10))[1]")} AS ta,
              {_tok_sql("CASE WHEN position(chr(10) IN text) > 0 THEN substr(text, position(chr(10) IN text) + 1) ELSE '' END")} AS tb
       FROM documents),
kl AS (SELECT doc_id, ta, tb, len(ta) AS la, len(tb) AS lb FROM pr),
kk AS (SELECT *, least(CASE WHEN la <= lb THEN la ELSE lb END, {(MAXLEN - 4) // 2}) AS sh FROM kl),
k AS (SELECT doc_id, ta, tb,
             CASE WHEN la + lb <= {MAXLEN - 4} THEN la WHEN la <= lb THEN sh ELSE {MAXLEN - 4} - sh END AS ka,
             CASE WHEN la + lb <= {MAXLEN - 4} THEN lb WHEN la <= lb THEN {MAXLEN - 4} - sh ELSE sh END AS kb FROM kk),
a AS (SELECT doc_id, ta[1:ka] AS tokens FROM k),
b AS (SELECT doc_id, tb[1:kb] AS tokens FROM k),
{_ids_cte('ea', 'a', 100000)},
{_ids_cte('eb', 'b', 100000)}
"""


def _pair_encoded(spark, sf_dir):
    p = _pair_frame(spark, sf_dir)
    a, b = en.truncate_pair("ta", "tb", MAXLEN)
    p = p.select("doc_id", a.alias("ta"), b.alias("tb"))
    ids = en.array_lookup(small_vocab(spark, sf_dir), "token", "id", K.UNK_ID, "int")
    both = stored(p.select("doc_id", ids("ta").alias("a"), ids("tb").alias("b")))  # short arrays; texts are read once
    return both.select("doc_id", "a").join(both.select("doc_id", "b"), "doc_id")


@query(
    "e7_e11_pair_inputs",
    sql=_PAIR_SQL + f"SELECT doc_id, {_s('[0] || ea.body || [2, 2] || eb.body || [2]')} AS input_ids, CAST(len(ea.body) AS INTEGER) AS len_a, CAST(len(eb.body) AS INTEGER) AS len_b FROM ea JOIN eb USING (doc_id)",
)
def e7_e11_pair_inputs(spark, sf_dir):
    """Pair assembly after ``longest_first`` truncation to 128."""
    p = _pair_encoded(spark, sf_dir)
    return p.select(
        "doc_id", _j(en.build_inputs("a", "b")).alias("input_ids"), F.size("a").alias("len_a"), F.size("b").alias("len_b")
    )


@query(
    "e8_special_tokens_mask",
    sql=_PAIR_SQL
    + """SELECT doc_id, array_to_string([1] || list_transform(ea.body, lambda x: 0) || [1], ',') AS single_mask,
       array_to_string([1] || list_transform(ea.body, lambda x: 0) || [1, 1] || list_transform(eb.body, lambda x: 0) || [1], ',') AS pair_mask,
       array_to_string(list_transform([0] || ea.body || [2] || [1, 1], lambda x: CASE WHEN x IN (0, 2) THEN 1 ELSE 0 END), ',') AS assembled_mask
       FROM ea JOIN eb USING (doc_id)""",
)
def e8_special_tokens_mask(spark, sf_dir):
    p = _pair_encoded(spark, sf_dir)
    assembled = F.concat(en.build_inputs("a"), F.array(F.lit(1), F.lit(1)))  # two pads, not marked
    return p.select(
        "doc_id",
        _j(en.special_tokens_mask("a")).alias("single_mask"),
        _j(en.special_tokens_mask("a", "b")).alias("pair_mask"),
        _j(en.special_tokens_mask(assembled, already_has_special_tokens=True)).alias("assembled_mask"),
    )


_PADDED = f"list_concat(input_ids, list_transform(range(greatest({MAXLEN} - len(input_ids), 0)), lambda x: 1))"


@query(
    "e9_e12_padded_masks",
    sql=_ENC
    + f"""SELECT doc_id, {_s(_PADDED)} AS input_ids,
       {_s(f'list_transform({_PADDED}, lambda x: CASE WHEN x <> 1 THEN 1 ELSE 0 END)')} AS attention_mask,
       {_s(f'list_transform({_PADDED}, lambda x: 0)')} AS token_type_ids FROM inp""",
)
def e9_e12_padded_masks(spark, sf_dir):
    e = encoded(spark, sf_dir).select("doc_id", en.pad("input_ids", MAXLEN).alias("ids"))
    e = en.model_columns(
        e.select(
            "doc_id",
            F.col("ids").alias("input_ids"),
            en.attention_mask("ids").alias("attention_mask"),
            en.token_type_ids("ids").alias("token_type_ids"),
        ),
        ("doc_id", "input_ids", "attention_mask", "token_type_ids", "labels"),
    )
    return e.select("doc_id", *[_j(c).alias(c) for c in ("input_ids", "attention_mask", "token_type_ids")])


@query(
    "e10_e14_truncated_lengths",
    sql=_ENC
    + f"""SELECT doc_id, CAST(len(input_ids) AS INTEGER) AS n_ids,
       CAST(list_sum(list_transform({_PADDED}, lambda x: CASE WHEN x <> 1 THEN 1 ELSE 0 END)) - 2 AS INTEGER) AS token_len FROM inp""",
)
def e10_e14_truncated_lengths(spark, sf_dir):
    e = encoded(spark, sf_dir)
    mask = en.attention_mask(en.pad("input_ids", MAXLEN))
    return e.select("doc_id", F.size("input_ids").alias("n_ids"), en.token_length(mask).alias("token_len"))


@query(
    "e21_single_length_check",
    sql=_ENC + f"SELECT count(DISTINCT len({_PADDED})) AS n_lengths FROM (SELECT * FROM inp ORDER BY doc_id LIMIT 20000)",
)
def e21_single_length_check(spark, sf_dir):
    """After fixed padding the first 20,000 examples share one length (asserted)."""
    e = encoded(spark, sf_dir).select("doc_id", en.pad("input_ids", MAXLEN).alias("ids"))
    return en.assert_single_length(e, "ids", 20000, "doc_id")


# ---------------------------------------------------------------- batching
@query(
    "e15_batches_across_files",
    sql=f"""SELECT doc_id, (rn // {BATCH})::BIGINT AS batch_id, (rn % {BATCH})::INTEGER AS pos_in_batch
            FROM (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS rn FROM documents)""",
    bench=True,
)
def e15_batches_across_files(spark, sf_dir):
    """``source`` plays the file; lines in (file, position) order; batches cross files."""
    d = documents(spark, sf_dir, "doc_id", "source")
    return bt.batches_across_files(d, ["source", "doc_id"], BATCH).select("doc_id", "batch_id", "pos_in_batch")


@query(
    "e16_batches_within_files",
    sql=f"""SELECT doc_id, source, (rn // {BATCH})::BIGINT AS batch_in_file, (rn % {BATCH})::INTEGER AS pos_in_batch
            FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rn FROM documents)""",
)
def e16_batches_within_files(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "source")
    return bt.batches_within_files(d, "source", ["doc_id"], BATCH).select("doc_id", "source", "batch_in_file", "pos_in_batch")


_LEN_SQL = "len(input_ids)"


@query(
    "e13_dynamic_padding",
    sql=_ENC
    + f"""SELECT doc_id, batch_id, (ceil(max({_LEN_SQL}) OVER (PARTITION BY batch_id) / 8) * 8)::INTEGER AS padded_len
       FROM (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch_id FROM inp)""",
)
def e13_dynamic_padding(spark, sf_dir):
    """Batches of 32 in id order, padded to the longest in the batch, rounded up to 8."""
    e = encoded(spark, sf_dir)
    b = bt.batches_across_files(e, ["doc_id"], 32)
    p = bt.dynamic_pad(b, "input_ids", "batch_id", K.PAD_ID, 8, "padded")
    return p.select("doc_id", "batch_id", F.size("padded").alias("padded_len"))


@query(
    "e15_scan_order_batches",
    sql=f"""SELECT doc_id, (rn // {BATCH})::BIGINT AS batch_id, (rn % {BATCH})::INTEGER AS pos_in_batch
            FROM (SELECT doc_id, row_number() OVER () - 1 AS rn FROM documents)""",
)
def e15_scan_order_batches(spark, sf_dir):
    """Batches over the rows as the scan gives them, files in turn: nothing is sorted or moved."""
    rows = so.read_numbered(spark, table_path(sf_dir, "documents"), "doc_id")
    return so.with_batches(rows, BATCH).select("doc_id", "batch_id", "pos_in_batch")


@query(
    "e13_scan_order_padding",
    sql=_ENC
    + f"""SELECT doc_id, batch_id, n AS padded_len, md5(array_to_string(input_ids || list_transform(range(len(input_ids), n), lambda x: {K.PAD_ID}), ',')) AS padded
       FROM (SELECT *, (ceil(max(len(input_ids)) OVER (PARTITION BY batch_id) / 8) * 8)::INTEGER AS n
             FROM (SELECT inp.*, o.batch_id FROM inp JOIN (SELECT doc_id, (row_number() OVER () - 1) // 32 AS batch_id FROM documents) o USING (doc_id)))""",
    bench=True,
)
def e13_scan_order_padding(spark, sf_dir):
    """Batches of 32 in scan order, encoded, written once and padded in place: neither texts nor arrays are shuffled."""
    rows = so.with_batches(so.read_numbered(spark, table_path(sf_dir, "documents"), "doc_id", "text"), 32)
    body = en.truncate(en.word_tokens("text"), MAXLEN)
    ids = en.array_lookup(small_vocab(spark, sf_dir), "token", "id", K.UNK_ID, "int")(body)
    coded = rows.select("doc_id", "batch_id", en.build_inputs(ids).alias("input_ids"))
    p = so.pad_runs(coded, "input_ids", "batch_id", 32, K.PAD_ID, 8)
    return p.select("doc_id", "batch_id", F.size("padded").alias("padded_len"), F.md5(F.array_join("padded", ",")).alias("padded"))


@query(
    "e17_length_grouped_batches",
    sql=_ENC
    + f"""SELECT doc_id, (mega * 50 + k // 8)::BIGINT AS batch_id FROM (
         SELECT doc_id, mega, row_number() OVER (PARTITION BY mega ORDER BY {_LEN_SQL} DESC, r) - 1 AS k FROM (
           SELECT *, r // 400 AS mega FROM (
             SELECT *, row_number() OVER (ORDER BY {portable_hash_sql('doc_id', 3)}, doc_id) - 1 AS r FROM inp)))""",
)
def e17_length_grouped_batches(spark, sf_dir):
    """Seeded shuffle, megabatches of 50×8 rows, length-sorted inside, batches of 8."""
    e = encoded(spark, sf_dir).select("doc_id", F.size("input_ids").alias("n"))  # the sort carries lengths, not arrays
    return bt.length_grouped_batches(e, "doc_id", "n", 8, seed=3, mega=50).select("doc_id", "batch_id")


@query(
    "e19_epochs",
    sql=f"SELECT doc_id, CAST(e.epoch AS INTEGER) AS epoch, {portable_hash_sql('doc_id', 'e.epoch + 11')} AS shuffle_key FROM documents, range(3) e(epoch)",
)
def e19_epochs(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id")
    return bt.repeat_epochs(d, 3, "doc_id", seed=11).select("doc_id", "epoch", "shuffle_key")


@query(
    "e20_limit_after_flatten",
    sql=f"""SELECT doc_id, batch_id FROM (SELECT doc_id, rn // {BATCH} AS batch_id, rn
            FROM (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS rn FROM documents)) WHERE rn < 500""",
)
def e20_limit_after_flatten(spark, sf_dir):
    """The limit is the operator: the first 500 flattened examples."""
    d = documents(spark, sf_dir, "doc_id", "source")
    b = bt.batches_across_files(d, ["source", "doc_id"], BATCH)
    return bt.limit_rows(b, "row_index", 500).select("doc_id", "batch_id")


@query("e20_limit_zero_means_all", sql="SELECT count(*) AS n FROM documents")
def e20_limit_zero_means_all(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "source")
    b = bt.batches_across_files(d, ["source", "doc_id"], BATCH)
    return bt.limit_rows(b, "row_index", 0).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- masking, labels, equality
_MASK_SQL = _ENC + f"""
, sm AS (SELECT doc_id, input_ids, list_transform(input_ids, lambda x, i:
        struct_pack(x := x, s := CASE WHEN i = 1 OR i = len(input_ids) THEN 1 ELSE 0 END,
                    h := {portable_hash_sql('doc_id', 5, 'i - 1')})) AS z FROM inp),
fin AS (SELECT doc_id, list_transform(z, lambda e: struct_pack(x := e.x, c := e.s = 0 AND substr(e.h, 1, 8) < '{hash_bound(K.MLM_PROBABILITY)}',
        r := substr(e.h, 9, 8), n := ('0x' || substr(e.h, 17, 8))::BIGINT)) AS z FROM sm)
SELECT doc_id,
  {_s(f"list_transform(z, lambda e: CASE WHEN NOT e.c THEN e.x WHEN e.r < '{hash_bound(0.8)}' THEN {K.MASK_ID} WHEN e.r < '{hash_bound(0.9)}' THEN (e.n % {VOCAB})::INTEGER ELSE e.x END)")} AS input_ids,
  {_s(f'list_transform(z, lambda e: CASE WHEN e.c THEN e.x ELSE {K.IGNORE_INDEX} END)')} AS labels
FROM fin"""


@query("e18_mlm_masking", sql=_MASK_SQL)
def e18_mlm_masking(spark, sf_dir):
    """15 % of non-special positions chosen with the portable formula (seed 5)."""
    e = encoded(spark, sf_dir)
    smask = en.special_tokens_mask("body")
    ids, labels = en.mlm_mask("input_ids", smask, "doc_id", 5, VOCAB)
    return e.select("doc_id", _j(ids).alias("input_ids"), _j(labels).alias("labels"))


@query(
    "e22_labels_vector",
    sql="SELECT vec_id, array_to_string(["
    + ", ".join(f"CASE WHEN embedding[{i + 1}] > 0 THEN 1 ELSE 0 END" for i in range(9))
    + "], ',') AS labels FROM embeddings",
)
def e22_labels_vector(spark, sf_dir):
    from .task_queries import _category_frame

    c = _category_frame(spark, sf_dir)
    return c.select("vec_id", _j(en.labels_vector([f"c{i}" for i in range(9)])).alias("labels"))


@query(
    "e24_encoding_equality",
    sql=_WHOLE
    + """, dx AS (SELECT doc_id, unnest(generate_series(1, len(body))) AS pos, unnest(body) AS id FROM enc),
back AS (SELECT x.doc_id, list(coalesce(w.id, 3) ORDER BY x.pos) AS body FROM dx x LEFT JOIN voc v ON x.id = v.id LEFT JOIN voc w ON coalesce(v.token, '<unk>') = w.token GROUP BY x.doc_id),
eq AS (SELECT e.body = coalesce(b.body, []::INTEGER[]) AS body_equal, [0] || e.body || [2] = [0] || coalesce(b.body, []::INTEGER[]) || [2] AS input_ids_equal FROM enc e LEFT JOIN back b USING (doc_id))
SELECT bool_and(input_ids_equal) AS input_ids_equal, bool_and(body_equal) AS body_equal FROM eq""",
)
def e24_encoding_equality(spark, sf_dir):
    """Round trip ids → tokens → ids gives the same encoding, field by field, over whole texts."""
    v = small_vocab(spark, sf_dir)
    e = stored(encoded(spark, sf_dir, None, v).select("doc_id", "body"))  # texts are cut into tokens once
    e = e.select("doc_id", "body", en.build_inputs("body").alias("input_ids"))
    back = en.lookup_tokens(e.select("doc_id", "body"), "doc_id", "body", v, "toks")
    again = en.lookup_ids(back.select("doc_id", "toks"), "doc_id", "toks", v, "body")
    again = again.select("doc_id", "body", en.build_inputs("body").alias("input_ids"))
    return en.encodings_equal(e, again, "doc_id", ["input_ids", "body"])
