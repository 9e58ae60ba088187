"""Tool calls and their results: linked, ordered, validated, and written as canonical JSON.

Everything is column expressions and joins: calls and results meet in a hash join on conversation, identifier and occurrence;
levels of the order come from joins along references, chains first by doubling; arguments are parsed into a variant, whose fields are
kept in the order of their names, so writing it gives canonical JSON.  Numbers pass through the variant as marked strings, so
that none loses a digit, and are written in one form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelspark.functions.plan import settle
from labelspark.llm.order import numbered
from labelspark.llm.storage import write_table

# Tool -> parameter -> (type, required).  Types are those of JSON.
Schemas = dict[str, dict[str, tuple[str, bool]]]

# What a variant calls the types of JSON that have one name there.
TYPES = {"boolean": "BOOLEAN", "object": "OBJECT<.*>", "array": "ARRAY<.*>"}
# Fixed value: strings, numbers, and what stands between them in a JSON text.
TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|[^"0-9-]+|-'
# Numbers go through the variant as strings that begin with this mark; given strings that begin so get one more control character.
MARK = r"\u0001"
PLAIN_DIGITS = 40  # numbers of up to so many places before or after the point are written out


def number_form(text: Column) -> Column:
    """The one form of a JSON number, by its exact value: no leading or trailing zeros, no sign of zero, written out up to
    ``PLAIN_DIGITS`` places, beyond that as d.ddde[-]x.  An exponent that is no 64-bit number stays as it is."""
    unsigned = F.regexp_replace(text, "^-", "")
    part = lambda i: F.regexp_extract(unsigned, r"^([0-9]+)(?:\.([0-9]+))?(?:[eE]\+?(-?[0-9]+))?$", i)
    every = F.concat(part(1), part(2))
    lead = F.length(every) - F.length(F.regexp_replace(every, "^0+", ""))
    digits = F.regexp_replace(F.regexp_replace(every, "^0+", ""), "0+$", "")
    exponent = F.when(part(3) == "", F.lit("0")).otherwise(part(3)).try_cast("bigint")
    point = exponent + F.length(part(1)) - lead  # places before the point
    n, within = F.length(digits), point.between(-PLAIN_DIGITS, PLAIN_DIGITS)
    places = F.when(within, point.cast("int")).otherwise(0)
    written = (
        F.when(~within, F.concat(F.left(digits, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""),
                                 F.lit("e"), (point - 1).cast("string")))
        .when(places <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -places), digits))
        .when(n <= places, F.concat(digits, F.repeat(F.lit("0"), places - n)))
        .otherwise(F.concat(F.left(digits, places), F.lit("."), F.substr(digits, places + 1))))
    return F.when(exponent.isNull(), text).when(digits == "", "0").otherwise(F.concat(F.when(text.startswith("-"), "-").otherwise(""), written))


def marked(text: Column) -> Column:
    """A JSON text whose numbers are marked strings in their one form; null where a number stands for a key."""
    simple = lambda t: t.rlike("^(?:0|-?[1-9][0-9]{0,39})$")
    number = lambda t: F.concat(F.lit(f'"{MARK}#'), F.when(simple(t), t).otherwise(number_form(t)), F.lit('"'))
    out = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: (
        F.when(t.startswith(f'"{MARK}'), F.concat(F.lit(f'"{MARK}'), F.substr(t, F.lit(2))))
        .when(t.rlike("^-?(?:0|[1-9][0-9]*)(?:[.eE]|$)"), number(t)).otherwise(t))), "")
    has_number = text.rlike("[0-9]")
    key = out.rlike(rf'(?<!\\)"\{MARK}#[^"]*"\s*:')
    return F.when(~has_number, text).when(~key, out)


def canonical(text: Column) -> Column:
    """The JSON text with sorted keys, without white space, numbers in one form; null if it is no JSON or repeats a key."""
    return _written(F.try_parse_json(marked(text)))


def _written(parsed: Column) -> Column:
    """A variant of marked numbers as text."""
    numbers = F.regexp_replace(F.to_json(parsed), rf'(?<!\\)"\{MARK}#([^"]*)"', "$1")
    return F.regexp_replace(numbers, rf'(?<!\\)"\{MARK}\{MARK}', rf'"\{MARK}')


def references(text: Column) -> Column:
    """The identifiers in ``{"$ref": "id"}`` of a canonical JSON text, decoded."""
    found = F.regexp_extract_all(text, F.lit(r'\{"\$ref":("[^"\\]*+(?:\\.[^"\\]*+)*+")\}'), F.lit(1))
    return F.from_json(F.concat(F.lit("["), F.array_join(found, ","), F.lit("]")), "array<string>")


def argument_errors(name: Column, parsed: Column, keys: Column, schemas: Schemas) -> Column:
    """What is wrong with a call, as an array of messages in the order of tools and parameters.

    ``parsed``: the variant of its marked arguments; ``keys``: their names.  An integer is a number without a fractional part, however
    it is written and however many digits it has.
    """
    found = [F.when(parsed.isNull() | keys.isNull(), F.lit("arguments are no object")),
             F.when(name.isNull() | ~name.isin(list(schemas)), F.lit("unknown tool"))]
    readable = parsed.isNotNull() & keys.isNotNull()
    for tool, parameters in schemas.items():
        here = readable & (name == tool)
        for parameter, (kind, required) in parameters.items():
            value = F.try_variant_get(parsed, f"$.{parameter}", "variant")
            sort, text = F.schema_of_variant(value), F.try_variant_get(parsed, f"$.{parameter}", "string")
            number = (sort == "STRING") & text.startswith("\x01#")
            form = F.substr(text, F.lit(3))
            places = F.regexp_extract(form, r"^-?[0-9](?:\.([0-9]+))?e[0-9]+$", 1)
            whole = form.rlike("^-?[0-9]+$") | (form.rlike("^-?[0-9](?:[.][0-9]+)?e[0-9]+$") & (
                F.length(places) <= F.regexp_extract(form, "e([0-9]+)$", 1).try_cast("bigint")))
            fits = {"string": (sort == "STRING") & ~number, "number": number, "integer": number & whole}.get(kind)
            if fits is None:
                fits = sort.rlike(f"^({TYPES[kind]})$")
            if required:
                found.append(F.when(here & ~F.array_contains(keys, parameter), F.lit(f"{parameter} is missing")))
            found.append(F.when(here & F.array_contains(keys, parameter) & ~F.coalesce(fits, F.lit(False)),
                                F.lit(f"{parameter} is no {kind}")))
        known = F.array(*[F.lit(p) for p in parameters]).cast("array<string>")
        found.append(F.when(here & (F.size(F.array_except(keys, known)) > 0), F.lit("unknown parameter")))
    return F.array_compact(F.array(*found))


def _jumps(links: DataFrame) -> DataFrame:
    """(row, anchor, steps): where the chain of single references that starts at each row ends; no row for those that run into
    a circle.  Each round doubles the steps."""
    jumps, before = write_table(links.select("row", F.col("target").alias("anchor"), F.lit(1).cast("long").alias("steps")), "jumps"), None
    while True:
        on = jumps.select(F.col("row").alias("anchor"), F.col("anchor").alias("_to"), F.col("steps").alias("_more"))
        moved = jumps.join(on, "anchor", "left").select(
            "row", F.coalesce("_to", "anchor").alias("anchor"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps"),
            F.col("_to").isNotNull().alias("moved"))
        moved = write_table(moved, "jumps")
        still = moved.where("moved").count()
        if still in (0, before):  # a round that brings no chain to its end leaves only circles
            return moved.where("not moved").select("row", "anchor", "steps")
        jumps, before = moved.drop("moved"), still


def _levels(calls: DataFrame) -> DataFrame:
    """(row, level): 0 without references, else one more than the deepest call referred to; no row for calls that refer to
    a missing call, or in a circle.  Chains of single references are contracted first, in as many rounds as their length has
    binary digits; then one round of joins for each level of calls with several references."""
    needs = write_table(calls.select("row", "conv_id", F.explode(F.array_distinct("refs")).alias("call_id")), "needs")
    first = calls.groupBy("conv_id", "call_id").agg(F.min("row").alias("target"))
    matched = needs.join(first, (needs["conv_id"].eqNullSafe(first["conv_id"])) & (needs["call_id"] == first["call_id"]), "left")
    edges = write_table(matched.select("row", "target"), "needs_rows")
    counts = edges.groupBy("row").agg(F.count("*").alias("all"), F.min("target").alias("target"))
    jumps = _jumps(counts.where("all = 1 and target is not null"))
    ends = jumps.select(F.col("row").alias("target"), "anchor", "steps")
    edges = edges.join(counts.where("all > 1").select("row"), "row", "left_semi").join(ends, "target", "left")
    edges = write_table(edges.select("row", F.coalesce("anchor", "target").alias("target"),
                                     F.coalesce("steps", F.lit(0)).alias("steps")), "branches")
    known = write_table(calls.where(F.size("refs") == 0).select("row", F.lit(0).cast("long").alias("level")), "levels")
    latest = known
    while True:
        # calls whose references all have a level, the deepest of them in the latest round
        touched = edges.join(latest.select(F.col("row").alias("target")), "target", "left_semi").select("row").distinct()
        open_edges = edges.join(touched, "row", "left_semi").join(
            known.select(F.col("row").alias("target"), "level"), "target", "left")
        ready = open_edges.groupBy("row").agg(F.count("*").alias("all"), F.count("level").alias("done"),
                                              F.max(F.col("level") + F.col("steps")).alias("deep"))
        ready = ready.where("all = done").select("row", (F.col("deep") + 1).alias("level"))
        latest = write_table(ready.join(known, "row", "left_anti"), "levels")
        if latest.isEmpty():
            break
        known = known.unionByName(latest)
    chained = jumps.join(known.withColumnRenamed("row", "anchor"), "anchor").select("row", (F.col("level") + F.col("steps")).alias("level"))
    return known.unionByName(chained).select("row", F.col("level").cast("int").alias("level"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call and per result without a call.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text).  ``results``: conv_id, turn, call_id, content.  Returned:
    conv_id, call_id, occurrence, name, call_turn, result_turn, status (linked, unanswered, orphan), level, position, errors,
    record.

    The n-th call of an identifier in a conversation belongs to its n-th result.  A string argument ``{"$ref": "id"}`` refers
    to an earlier result; ``position`` numbers a conversation's rows from 0 by level (what a call refers to comes first; calls
    whose references are missing or circular, with an error, and orphans, come last), then turn, then identifier.  ``record``
    is canonical JSON with numbers in one form (see ``number_form``); arguments that are no JSON are null there.  Null identifiers
    link with nothing; null conversations count as one.  Repeated rows are further occurrences, in any order; long texts are read
    whole.  Other columns are ignored; empty tables give no rows.  Levels of calls with several references take a round of joins each.
    """
    c = calls.select("conv_id", "turn", "call_id", "name", "arguments")
    r = results.select("conv_id", "turn", "call_id", "content")
    c = numbered(c, ["conv_id", "call_id"], ["turn"], "occurrence")
    # each step once, however often its result is asked for
    c = settle(c, {"marked": marked(F.col("arguments")), "keys": F.json_object_keys("arguments")})
    c = settle(c, {"parsed": F.try_parse_json("marked")})
    c = settle(c, {"args": _written(F.col("parsed")), "wrong": argument_errors(F.col("name"), F.col("parsed"), F.col("keys"), schemas)})
    c = c.withColumn("refs", F.coalesce(references(F.col("args")), F.array().cast("array<string>")))
    c = c.drop("arguments", "marked", "keys", "parsed")
    c = write_table(c.withColumn("row", F.monotonically_increasing_id()), "calls")
    r = numbered(r, ["conv_id", "call_id"], ["turn"], "occurrence").select(
        F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id"), F.col("occurrence").alias("r_occurrence"),
        F.col("turn").alias("result_turn"), "content")
    leveled = c.join(_levels(c), "row", "left")
    match = (F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("call_id") == F.col("r_id")) & (F.col("occurrence") == F.col("r_occurrence")))
    linked = leveled.join(r, match, "full_outer")
    is_call, has_result = F.col("row").isNotNull(), F.col("r_occurrence").isNotNull()
    errors = F.when(is_call, F.concat("wrong", F.array_compact(F.array(F.when(F.col("level").isNull(), F.lit("reference is missing or circular"))))))
    rest = F.to_json(F.struct(F.col("call_id").alias("id"), "name", F.col("content").alias("result")), {"ignoreNullFields": "false"})
    record = F.concat(F.lit('{"arguments":'), F.coalesce("args", F.lit("null")), F.lit(","), F.substr(rest, F.lit(2)))
    out = linked.select(
        F.when(is_call, F.col("conv_id")).otherwise(F.col("r_conv")).alias("conv_id"), F.coalesce("call_id", "r_id").alias("call_id"),
        F.coalesce("occurrence", "r_occurrence").alias("occurrence"), "name", F.col("turn").alias("call_turn"), "result_turn",
        F.when(is_call & has_result, "linked").when(is_call, "unanswered").otherwise("orphan").alias("status"),
        "level", errors.alias("errors"), F.when(is_call, record).alias("record"))
    out = out.withColumn("depth", F.coalesce("level", F.lit((1 << 31) - 1))).withColumn("at", F.coalesce("call_turn", "result_turn"))
    out = numbered(out, ["conv_id"], ["depth", "at", "call_id", "occurrence", "status"], "position")
    return out.select("conv_id", "call_id", "occurrence", "name", "call_turn", "result_turn", "status", "level", "position", "errors", "record")
