"""Tool-call linking: calls meet their results, in order, validated and canonical.

``link`` takes calls (conv_id, call_id, turn, name, arguments as JSON, after:
the call this one depends on, or null) and results (conv_id, call_id, turn,
content) and gives one row per call or unanswered-for result:

1. a hash join on conversation and identifier. Where an identifier occurs again
   in a conversation, its n-th call meets its n-th result, so repeated ids never
   multiply; the number comes from a range-split row index, not from a window
   over one id. ``status`` is linked, unanswered (no result) or orphan (no call);
2. a topological order: ``after`` names one call or several (a text, or an array),
   and all occurrences of an id share what is given for any of them. Depth is the
   longest way from a call without a known one before it. Chains of calls with one
   parent are folded by pointer doubling, in rounds that grow with the logarithm of
   their length; calls with several parents are settled in rounds, once all parents
   are. Names of no call are left out and marked; calls on a cycle, or behind one,
   come last and are marked. ``position`` numbers a conversation by depth, turn, id
   and occurrence (range-split: a conversation may hold a third of all rows);
3. arguments are checked against the tool's schema: JSON object, required
   fields, types, bounds, allowed values, no unknown fields;
4. canonical JSON: keys sorted at every level, no white space, one spelling of
   each number (1, 1.0 and 1e0 are 1; no digit is lost) and escape.

A null conversation is one of its own and stays null. A null call id is the value
'' ; a null turn sorts first; null arguments are no JSON object and null content
stays null. Repeated rows are repeated occurrences. Very long texts are kept whole.
Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.indexing import group_index
from .common import discard, null_safe_text, stored

PLAIN = 40  # numbers up to 40 places from the point are written without an exponent
WS = " \t\n\x0b\x0c\r"
#: Tools of the query: field -> (type, required, least, most); lengths for strings, values for numbers.
TOOLS = {
    "search": {"n_words": ("BIGINT", True, 1, 400), "text": ("STRING", True, 1, 4000)},
    "translate": {"n_words": ("BIGINT", True, 1, 60), "text": ("STRING", True, 1, 400)},
    "summarise": {"n_words": ("BIGINT", True, 20, 100_000), "text": ("STRING", True, 100, 100_000)},
}


def _number(text: str) -> str:
    """One spelling of each number: digits without needless zeros, with an exponent only far from 1."""
    sign, digits, exponent = Decimal(text).as_tuple()
    body = "".join(map(str, digits)).lstrip("0")
    kept = body.rstrip("0")
    exponent += len(body) - len(kept)
    if not kept:
        return "0"
    minus, point = "-" if sign else "", len(kept) + exponent  # digits before the point
    if exponent >= 0 and point <= PLAIN:
        return minus + kept + "0" * exponent
    if exponent < 0 and point > 0:
        return f"{minus}{kept[:point]}.{kept[point:]}"
    if exponent < 0 and point > -PLAIN:
        return f"{minus}0.{'0' * -point}{kept}"
    return f"{minus}{kept[0]}{'.' if len(kept) > 1 else ''}{kept[1:]}e{point - 1}"


class _Number(str):
    """A JSON number in its one spelling."""


def _no_constant(_: str):
    raise ValueError("no JSON")


def _write(v) -> str:
    if isinstance(v, _Number):
        return v
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_write(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_write, v)) + "]"
    return json.dumps(v, ensure_ascii=False)


def canonical_text(text: str | None) -> str | None:
    """JSON with sorted keys (of repeated ones the last), no white space and one spelling of each number and
    escape; None where it is no JSON."""
    if text is None:
        return None
    try:
        spelt = lambda t: _Number(_number(t))
        return _write(json.loads(text, parse_int=spelt, parse_float=spelt, parse_constant=_no_constant)).encode("utf-8", "replace").decode()
    except (ValueError, RecursionError, ArithmeticError):
        return None


@F.pandas_udf(T.StringType())
def canonical(texts: pd.Series) -> pd.Series:
    return pd.Series([canonical_text(t) for t in texts], dtype=object)


def errors(name: Column, arguments: Column, tools: dict) -> Column:
    """Sorted array of what is wrong with a call's arguments."""
    v = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    found = []
    for tool, fields in sorted(tools.items()):
        mine = is_object & (name == tool)
        for field, (kind, required, least, most) in sorted(fields.items()):
            value = F.try_variant_get(v, f"$.{field}", "variant")
            has = value.isNotNull()
            typed = has & (F.schema_of_variant(value) == kind)
            size = F.length(F.try_variant_get(v, f"$.{field}", "string")) if kind == "STRING" else F.try_variant_get(v, f"$.{field}", "double")
            if required:
                found.append(F.when(mine & ~has, F.lit(f"missing {field}")))
            found.append(F.when(mine & has & ~typed, F.lit(f"type of {field}")))
            found.append(F.when(mine & typed & ((size < least) | (size > most)), F.lit(f"bounds of {field}")))
        extra = F.array_size(F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(f) for f in fields]))) > 0
        found.append(F.when(mine & extra, F.lit("unknown field")))
    found.append(F.when(~F.coalesce(name.isin(sorted(tools)), F.lit(False)), F.lit("unknown tool")))
    found.append(F.when(~is_object, F.lit("no object")))
    return F.array_sort(F.array_compact(F.array(*found)))


def depths(calls: DataFrame) -> DataFrame:
    """(keys, call_id, depth, note) of each distinct call id; ``calls`` has conv_id, call_id, after and, if null
    conversations are told apart, no_conv. ``depth`` is the longest way from a root."""
    keys = [c for c in ("no_conv", "conv_id") if c in calls.columns]
    is_list = isinstance(calls.schema["after"].dataType, T.ArrayType)
    after = F.col("after").cast("array<string>") if is_list else F.array(F.col("after").cast("string"))
    ids = calls.select(*keys, "call_id").distinct()
    asked = calls.select(*keys, "call_id", F.explode(after).alias("parent")).where(F.col("parent").isNotNull()).distinct()
    names = ids.withColumnRenamed("call_id", "parent").withColumn("known", F.lit(True))
    edges = asked.join(names, [*keys, "parent"], "left")
    per = edges.groupBy(*keys, "call_id").agg(F.count("known").alias("n"), F.min(F.when(F.col("known"), F.col("parent"))).alias("parent"), F.count_if(F.col("known").isNull()).alias("lost"))
    own = stored(ids.join(per, [*keys, "call_id"], "left").select(*keys, "call_id", F.coalesce("n", F.lit(0)).alias("n"), "parent", (F.coalesce("lost", F.lit(0)) > 0).alias("lost")))
    # chains of calls with one parent each, by pointer doubling up to a head: a call with none or with several
    single = F.col("n") == 1
    now = stored(own.select(*keys, "call_id", F.when(single, F.col("parent")).otherwise(F.col("call_id")).alias("head"), F.when(single, 1).otherwise(0).cast("long").alias("dist"), (~single).alias("done")))
    n, open_ = now.agg(F.count(F.lit(1)), F.count_if(~F.col("done"))).first()
    steps = 0
    while open_ and 2**steps <= n:
        up = now.select(*keys, F.col("call_id").alias("head"), F.col("head").alias("head2"), F.col("dist").alias("more"), F.col("done").alias("done2"))
        after_ = stored(now.join(up, [*keys, "head"]).select(*keys, "call_id", F.col("head2").alias("head"), (F.col("dist") + F.col("more")).alias("dist"), "done2").withColumnRenamed("done2", "done"))
        discard(now)
        now, steps = after_, steps + 1
        open_ = now.where(~F.col("done")).count()
    chains = now.where("done").drop("done")  # the others lie on a cycle or behind one
    heads = own.where(F.col("n") == 0).select(*keys, F.col("call_id").alias("head"), F.lit(0).cast("long").alias("depth"))
    if own.where(F.col("n") > 1).limit(1).count():
        heads = _joined_heads(stored(heads), own, edges, chains, keys)
    found = chains.join(heads, [*keys, "head"]).select(*keys, "call_id", (F.col("depth") + F.col("dist")).alias("depth"))
    out = own.join(found, [*keys, "call_id"], "left")
    note = F.when(F.col("depth").isNull(), "cycle").when(F.col("lost"), "unknown after")
    return out.select(*keys, "call_id", F.coalesce("depth", F.lit(2**62)).alias("depth"), note.alias("note"))


def _joined_heads(heads: DataFrame, own: DataFrame, edges: DataFrame, chains: DataFrame, keys: list[str]) -> DataFrame:
    """Depths of calls with several parents too, in rounds: a call is ready when the heads of all its parents
    are. There are as many rounds as such calls lie behind one another."""
    many = own.where(F.col("n") > 1).select(*keys, "call_id", "n")
    of = edges.where("known").join(many, [*keys, "call_id"]).select(*keys, "call_id", "n", "parent")
    ways = of.join(chains.select(*keys, F.col("call_id").alias("parent"), "head", "dist"), [*keys, "parent"])
    ways = stored(ways.select(*keys, "call_id", "n", "head", (F.col("dist") + 1).alias("dist")))
    while True:
        ready = ways.join(heads, [*keys, "head"]).groupBy(*keys, "call_id", "n").agg(F.count(F.lit(1)).alias("got"), F.max(F.col("depth") + F.col("dist")).alias("depth"))
        ready = ready.where(F.col("got") == F.col("n")).select(*keys, F.col("call_id").alias("head"), "depth")
        new = stored(ready.join(heads, [*keys, "head"], "left_anti"))
        if not new.limit(1).count():
            return heads
        heads = stored(heads.unionByName(new))


def link(calls: DataFrame, results: DataFrame, tools: dict) -> DataFrame:
    """(conv_id, call_id, occurrence, status, position, depth, name, valid, errors, json)."""
    key = [F.col("conv_id").isNull().alias("no_conv"), F.coalesce("conv_id", F.lit(-1)).alias("conv_id"), F.coalesce(F.col("call_id").cast("string"), F.lit("")).alias("call_id")]
    c = calls.select(*key, "turn", F.coalesce("name", F.lit("")).alias("name"), F.col("arguments"), "after")
    r = results.select(*key, F.col("turn").alias("result_turn"), "content")
    c = group_index(c, ["turn", "name", F.xxhash64("arguments", "after")], ["no_conv", "conv_id", "call_id"], "occurrence")
    r = group_index(r, ["result_turn", F.xxhash64("content")], ["no_conv", "conv_id", "call_id"], "occurrence")
    c = c.withColumn("_c", F.lit(True))
    r = r.withColumn("_r", F.lit(True))
    both = c.join(r, ["no_conv", "conv_id", "call_id", "occurrence"], "full").join(depths(c), ["no_conv", "conv_id", "call_id"], "left")
    status = F.when(F.col("_c").isNull(), "orphan").when(F.col("_r").isNull(), "unanswered").otherwise("linked")
    wrong = F.when(F.col("_c"), F.array_compact(F.array_append(errors(F.col("name"), F.col("arguments"), tools), F.col("note")))).otherwise(F.array(F.lit("no call")))
    rows = both.select(
        "no_conv", "conv_id", "call_id", F.col("occurrence").cast("long").alias("occurrence"), status.alias("status"), F.coalesce("depth", F.lit(2**62)).alias("_depth"), F.coalesce("turn", "result_turn").alias("_turn"), "name", wrong.alias("errors"),
        F.to_json(F.struct(F.col("call_id").alias("id"), "name", "occurrence", F.col("content").alias("result"))).alias("_head"), canonical("arguments").alias("_args"))
    # "arguments" sorts before the other keys
    text = F.concat(F.lit('{"arguments":'), F.coalesce("_args", F.lit("null")), F.lit(","), F.substr("_head", F.lit(2)))
    rows = rows.select("no_conv", "conv_id", "call_id", "occurrence", "status", "_depth", "_turn", "name", (F.size("errors") == 0).alias("valid"), F.array_join("errors", ",").alias("errors"), text.alias("json"))
    out = group_index(rows, ["_depth", "_turn", "call_id", "occurrence"], ["no_conv", "conv_id"], "position")
    return out.select(F.when(~F.col("no_conv"), F.col("conv_id")).alias("conv_id"), "call_id", "occurrence", "status", F.col("position").cast("long").alias("position"), "name", "valid", "errors", "json")


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: a user's turn calls a tool chosen by its number of
    words, and the assistant's next turn is the result. Every fourth call starts anew; the others
    come after the call two turns before, if there was one. Turns of other roles (system) neither call
    nor answer and make no row."""
    t = turns.select("conv_id", "turn", "role", F.col("text"))
    ident = lambda turn: F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string")))
    trimmed = F.btrim(null_safe_text("text"), F.lit(WS))
    n = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")
    user = t.where(F.col("role") == "user").withColumn("n", n)
    name = F.element_at(F.array(F.lit("search"), F.lit("translate"), F.lit("summarise")), (F.col("n") % 3 + 1).cast("int"))
    calls = user.select("conv_id", ident(F.col("turn")).alias("call_id"), "turn", name.alias("name"), F.to_json(F.struct(F.col("text"), F.col("n").alias("n_words"))).alias("arguments"), F.when(F.floor(F.col("turn") / 2) % 4 != 0, ident(F.col("turn") - 2)).alias("after"))
    results = t.where(F.col("role") == "assistant").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def oracle_sql(tools: dict = TOOLS) -> str:
    """DuckDB SQL of ``link(*from_turns(conversations))`` (turns distinct in a conversation)."""
    checks = []
    for tool, fields in sorted(tools.items()):
        for field, (_, _, least, most) in sorted(fields.items()):
            value = "length(text)" if field == "text" else "n"
            checks.append(f"CASE WHEN name = '{tool}' AND ({value} < {least} OR {value} > {most}) THEN 'bounds of {field}' END")
    return f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, regexp_replace(coalesce(text, ''), '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS s FROM conversations),
u AS (SELECT conv_id, turn, text, md5(conv_id || ':' || turn) AS call_id, CASE WHEN s = '' THEN 0 ELSE len(string_split_regex(s, '[\\x20\\x09-\\x0D]+')) END AS n,
  CASE WHEN (turn // 2) % 4 <> 0 THEN md5(conv_id || ':' || (turn - 2)) END AS after FROM t WHERE role = 'user'),
c AS (SELECT *, ['search', 'translate', 'summarise'][n % 3 + 1] AS name, after IS NOT NULL AND after NOT IN (SELECT call_id FROM u) AS lost FROM u),
d AS (SELECT conv_id, call_id, 0::BIGINT AS depth FROM c WHERE after IS NULL OR lost UNION ALL SELECT c.conv_id, c.call_id, d.depth + 1 FROM c JOIN d ON c.conv_id = d.conv_id AND c.after = d.call_id),
r AS (SELECT conv_id, turn AS result_turn, text AS content, md5(conv_id || ':' || (turn - 1)) AS call_id FROM t WHERE role = 'assistant'),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.call_id IS NOT NULL AS is_call, r.call_id IS NOT NULL AS is_result, c.turn, r.result_turn, name, text, n, content, lost, depth
  FROM c JOIN d USING (conv_id, call_id) FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id),
e AS (SELECT *, CASE WHEN is_call THEN array_to_string(list_concat(list_sort(list_filter([{", ".join(checks)}], lambda x: x IS NOT NULL)), CASE WHEN lost THEN ['unknown after'] ELSE [] END), ',') ELSE 'no call' END AS errors FROM j)
SELECT conv_id, call_id, 0::BIGINT AS occurrence, CASE WHEN NOT is_call THEN 'orphan' WHEN NOT is_result THEN 'unanswered' ELSE 'linked' END AS status,
 row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(depth, 4611686018427387904), coalesce(turn, result_turn), call_id) - 1 AS position, name, errors = '' AS valid, errors,
 '{{"arguments":' || CASE WHEN is_call THEN '{{"n_words":' || n || ',"text":' || to_json(text)::VARCHAR || '}}' ELSE 'null' END || ',"id":"' || call_id || '"' || CASE WHEN is_call THEN ',"name":"' || name || '"' ELSE '' END || ',"occurrence":0' || CASE WHEN is_result THEN ',"result":' || to_json(content)::VARCHAR ELSE '' END || '}}' AS json
FROM e"""
