"""Chat formatting: tool calls linked with their results.

Calls and results meet by a hash join on (conversation, identifier). Calls are
ordered topologically along their ``after`` identifiers by rounds of joins: a
call's level is the length of the longest chain of calls it waits for. Arguments
are checked against the tool's schema, at any depth, and every linked call is
written as canonical JSON: keys sorted, no white space, absent values as null,
each number in one form (plain digits, no exponent, no zeros that say nothing), so
equal arguments are equal texts and no digit is lost. A number of more than 38
digits is written as a text and is a fault.

Defined results: of calls that repeat an identifier in a conversation the one
with the least (turn, name, arguments) is linked, the others get status
``duplicate``; of results likewise the one with the least (turn, content).
``after`` identifiers that name no call are ignored. Calls on or behind a cycle
have a null level and status ``cycle``. A result without a call becomes a row of
status ``orphan``. A call without an identifier or conversation gets status
``unnamed``, such a result is an orphan. Arguments that are null or no JSON
object are invalid. Further statuses, in this order: ``invalid`` (arguments), ``open``
(no result), ``linked``. Empty tables give an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

#: JSON types of a schema and how a variant's type reads in SQL.
TYPES = {"string": "STRING", "integer": r"BIGINT|DECIMAL\([0-9]+,0\)", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY",
         "number": "BIGINT|DOUBLE|DECIMAL|FLOAT"}
#: Digits of a number that is kept as a number.
DIGITS = 38


def _number(t: str) -> str:
    """SQL: a JSON number's one form: plain digits, no exponent, no zeros that say
    nothing; null for one that needs more than ``DIGITS`` digits."""
    whole, part = f"regexp_extract({t}, '^-?([0-9]+)', 1)", f"regexp_extract({t}, '[.]([0-9]+)', 1)"
    power = f"if({t} rlike '[eE]', try_cast(regexp_extract({t}, '[eE]([+-]?[0-9]+)$', 1) AS INT), 0)"
    # y.d: the digits without zeros around them, y.s: how many of them stand behind the point
    width = "greatest(length(y.d), int(y.s) + 1)"
    plain = (f"CASE WHEN y.d = '' THEN '0' WHEN y.s IS NULL OR abs(y.s) > {DIGITS} OR length(y.d) > {DIGITS} THEN NULL "
             f"WHEN y.s <= 0 AND length(y.d) - y.s <= {DIGITS} THEN concat(y.sign, y.d, repeat('0', int(-y.s))) "
             f"WHEN y.s > 0 THEN concat(y.sign, left(lpad(y.d, {width}, '0'), {width} - int(y.s)), '.', right(lpad(y.d, {width}, '0'), int(y.s))) END")
    # transform(array(x), y -> ...)[0] names x
    return (f"transform(array(named_struct('digits', trim(LEADING '0' FROM concat({whole}, {part})), 'behind', length({part}) - bigint({power}), "
            f"'sign', if({t} LIKE '-%', '-', ''))), z -> transform(array(named_struct('d', trim(TRAILING '0' FROM z.digits), "
            f"'s', z.behind - (length(z.digits) - length(trim(TRAILING '0' FROM z.digits))), 'sign', z.sign)), y -> {plain})[0])[0]")


def with_canonical_numbers(rows: DataFrame, column: str, lost: str) -> DataFrame:
    """``rows`` with every number of the JSON texts in ``column`` in its one form,
    and in ``lost`` (array of texts) the numbers that have none; in the JSON
    these become texts. Only texts with a number that could change are taken
    apart."""
    # a valid JSON text holds no control characters: they stand for what is escaped
    number = "x rlike '^-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][+-]?[0-9]+)?$'"
    runs = "regexp_extract_all(p, '[-+0-9.eE]+|[^-+0-9.eE]+', 0)"
    text = F.col(column).cast("string")
    odd = text.rlike("[0-9][.eE]|[0-9]{16}|-0")
    safe = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\x01\x01")), F.lit('\\"'), F.lit("\x01\x02"))
    out = rows.withColumn("__parts", F.when(odd, F.split(safe, '"', -1)))
    fixed = F.expr(f"""array_join(transform(__parts, (p, i) -> if(i % 2 = 1, p, array_join(transform({runs}, x -> if({number}, coalesce({_number('x')}, concat('"', x, '"')), x)), ''))), '"')""")
    gone = F.expr(f"filter(flatten(transform(__parts, (p, i) -> if(i % 2 = 1, array(), {runs}))), x -> {number} AND {_number('x')} IS NULL)")
    back = F.replace(F.replace(fixed, F.lit("\x01\x02"), F.lit('\\"')), F.lit("\x01\x01"), F.lit("\\\\"))
    return out.withColumns({lost: F.coalesce(gone, F.array().cast("array<string>")), column: F.coalesce(back, text)}).drop("__parts")


def _type(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def _check(value: Column, kind, path: Column) -> Column:
    """Faults of a JSON value (variant) under ``kind``: a type's name, {field:
    (kind, required)} for an object, [kind] for an array of such, a tuple of
    allowed values. Array of texts."""
    none, one = F.array().cast("array<string>"), lambda fault: F.array(F.concat(path, F.lit(f": {fault}")))
    if isinstance(kind, str):
        return F.when(_type(value).rlike(f"^({TYPES[kind]})"), none).otherwise(one(f"not {kind}"))
    if isinstance(kind, tuple):
        return F.when(F.to_json(value).isin([json.dumps(v, ensure_ascii=False) for v in kind]), none).otherwise(one("not allowed"))
    if isinstance(kind, list):
        items = F.try_variant_get(value, "$", "array<variant>")
        inside = F.flatten(F.transform(items, lambda x, i: _check(x, kind[0], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        return F.when(_type(value).startswith("ARRAY"), F.coalesce(inside, none)).otherwise(one("not array"))
    return F.when(_type(value).startswith("OBJECT"), _fields(value, kind, F.concat(path, F.lit(".")))).otherwise(one("not object"))


def _fields(value: Column, fields: dict, before: Column) -> Column:
    keys, found = F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>")), []
    for field, (kind, required) in sorted(fields.items()):
        quoted = field.replace("\\", "\\\\").replace("'", "\\'")
        path, own = F.concat(before, F.lit(field)), F.try_variant_get(value, f"$['{quoted}']", "variant")
        missing = F.array(F.concat(path, F.lit(": missing"))) if required else F.array().cast("array<string>")
        found.append(F.when(F.array_contains(keys, field), _check(own, kind, path)).otherwise(missing))
    known = F.array(*map(F.lit, sorted(fields))).cast("array<string>")
    extra = F.transform(F.array_except(keys, known), lambda k: F.concat(before, k, F.lit(": unknown field")))
    return F.concat(*found, extra)


def faults(name: Column, arguments: Column, schemas: dict) -> Column:
    """Faults of JSON ``arguments`` (variant) under ``schemas``: tool name ->
    {field: (kind, required)} (kinds as of ``_check``, nested to any depth).
    Sorted array of texts; empty: valid."""
    unknown, chain = F.array(F.lit("unknown tool")), None
    for tool, fields in sorted(schemas.items()):
        here = F.array_sort(_fields(arguments, fields, F.lit("")))
        chain = F.when(name == tool, here) if chain is None else chain.when(name == tool, here)
    found = unknown if chain is None else chain.otherwise(unknown)
    return F.when(_type(arguments).startswith("OBJECT"), found).otherwise(F.array(F.lit("no object")))


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of calls with unique (conv_id, call_id), none null.

    Calls that wait for just one other call form chains, which pointer doubling
    shortens to their first call in log2(length) joins. What is left, calls that
    wait for several, is ordered round by round over the shortened chains."""
    key = ["conv_id", "call_id"]
    named = calls.select(*key)
    edges = saved(calls.select(*key, F.explode(F.array_distinct("after")).alias("parent"))
                  .join(named.select("conv_id", F.col("call_id").alias("parent")), ["conv_id", "parent"]))
    parents = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("parent").alias("head"))
    nodes = saved(named.join(parents, key, "left").select(*key, F.coalesce("n", F.lit(0)).alias("n"), "head"))
    chain = nodes.filter("n = 1").select(*key, "head", F.lit(1).cast("bigint").alias("steps"))
    open_ = (nodes.count()).bit_length() + 1      # a chain without a cycle is done by then
    while open_:
        chain = saved(chain)
        on = chain.select("conv_id", F.col("call_id").alias("head"), F.col("head").alias("next"), F.col("steps").alias("more"))
        open_ = open_ - 1 if not chain.join(on, ["conv_id", "head"], "left_semi").isEmpty() else 0
        if open_:
            chain = chain.join(on, ["conv_id", "head"], "left").select(
                *key, F.coalesce("next", "head").alias("head"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
    first = nodes.filter("n = 0").select(*key, F.lit(0).cast("bigint").alias("level"))
    # calls that wait for several, each through the head of its parent's chain
    via = chain.select("conv_id", F.col("call_id").alias("parent"), "head", "steps")
    several = nodes.filter("n > 1").select(*key)
    links = saved(edges.join(several, key).join(via, ["conv_id", "parent"], "left").select(
        *key, F.coalesce("head", "parent").alias("head"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")))
    known, waiting = first, links.select(*key).distinct()
    while not waiting.isEmpty():
        found = links.join(known.select("conv_id", F.col("call_id").alias("head"), "level"), ["conv_id", "head"], "left")
        ready = found.join(waiting, key, "left_semi").groupBy(*key).agg(
            F.count_if(F.col("level").isNull()).alias("unknown"), F.max(F.col("level") + F.col("steps")).alias("level"))
        ready = saved(ready.filter("unknown = 0").select(*key, "level"))
        if ready.isEmpty():     # every call left waits for another one that does
            break
        known = saved(known.unionByName(ready))
        waiting = saved(waiting.join(ready, key, "left_anti"))
    heads = known.select("conv_id", F.col("call_id").alias("head"), "level")
    chained = chain.join(heads, ["conv_id", "head"]).select(*key, (F.col("level") + F.col("steps")).alias("level"))
    return named.join(known.unionByName(chained), key, "left")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """``calls``: conv_id, turn, call_id, name, arguments (JSON text), after
    (array of identifiers). ``results``: conv_id, turn, call_id, content. Returns
    conv_id, turn, call_id, name, level, status, faults, json."""
    key = ["conv_id", "call_id"]
    calls = calls.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("call_id").cast("string").alias("call_id"),
                         "name", "arguments", F.coalesce(F.col("after").cast("array<string>"), F.array().cast("array<string>")).alias("after"))
    results = results.select("conv_id", F.col("call_id").cast("string").alias("call_id"), F.struct(
        F.col("turn").cast("bigint").alias("turn"), F.col("content").cast("string").alias("content")).alias("result"))
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    nth = F.row_number().over(W.partitionBy(*key).orderBy("turn", "name", "arguments", F.to_json("after")))
    ranked = calls.filter(named).withColumn("nth", nth)
    first = ranked.filter("nth = 1").drop("nth")
    answer = results.filter(named).groupBy(*key).agg(F.min("result").alias("result"), F.lit(True).alias("answered"))
    linked = first.join(levels(first), key).join(answer, key, "left")
    odd = (ranked.filter("nth > 1").drop("nth").withColumn("status", F.lit("duplicate"))
           .unionByName(calls.filter(~named).withColumn("status", F.lit("unnamed"))))
    orphans = results.join(first.select(*key, F.lit(True).alias("known")), key, "left").filter("known IS NULL").select(
        "conv_id", F.col("result.turn").alias("turn"), "call_id", "result", F.lit("orphan").alias("status"))
    rows = linked.unionByName(odd, allowMissingColumns=True).unionByName(orphans, allowMissingColumns=True)
    rows = with_canonical_numbers(rows, "arguments", "lost").withColumn("parsed", F.try_parse_json("arguments"))
    wrong = F.concat(faults(F.col("name"), F.col("parsed"), schemas), F.transform("lost", lambda t: F.concat(F.lit("number out of range: "), t)))
    rows = rows.withColumn("faults", F.when(F.col("status") == "orphan", F.array().cast("array<string>")).otherwise(F.array_sort(wrong)))
    status = (F.when(F.col("status").isNotNull(), F.col("status")).when(F.col("level").isNull(), "cycle")
              .when(F.size("faults") > 0, "invalid").when(F.col("answered").isNull(), "open").otherwise("linked"))
    line = F.struct("after", F.col("parsed").alias("arguments"), "call_id", "conv_id", "level", "name",
                    F.col("result.content").alias("result"), "turn")
    return rows.withColumn("status", status).select(
        "conv_id", "turn", "call_id", "name", "level", "status", "faults",
        F.to_json(line, {"ignoreNullFields": "false"}).alias("json"))


SCHEMAS = {"configure": {"text": ("string", True)},
           "respond": {"prompt": ("string", True), "turn": ("integer", True)}}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as calls and results: a system turn configures, a user
    turn asks for a response and waits for the call one or two turns before; the
    assistant's turn is the result of the turn before it."""
    ident = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    text = F.col("text").cast("string")
    respond = F.to_json(F.struct(text.alias("prompt"), F.col("turn").alias("turn")))
    calls = turns.filter(F.col("role").isin("system", "user")).select(
        "conv_id", "turn", ident(0).alias("call_id"),
        F.when(F.col("role") == "system", "configure").otherwise("respond").alias("name"),
        F.when(F.col("role") == "system", F.to_json(F.struct(text.alias("text")))).otherwise(respond).alias("arguments"),
        F.when(F.col("role") == "user", F.array(ident(2), ident(1))).alias("after"))
    results = turns.filter(F.col("role") == "assistant").select(
        "conv_id", "turn", ident(1).alias("call_id"), text.alias("content"))
    return calls, results
