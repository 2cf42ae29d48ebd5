"""Linking of tool calls with their results, in DataFrame operations only.

Calls and results are joined by identifier; results are pre-aggregated to one row an identifier, so
the join never multiplies. Calls follow each other by identifier too (``after``); their
topological order is the distance to the first call of their chain, found by pointer doubling, so a chain of n
calls takes log2(n) joins. Arguments are validated against the schema of their tool, and every call is
serialised as canonical JSON: sorted keys, no white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._stage import Stage

#: JSON types that a schema may ask for, as the engine names the types of parsed values.
_TYPES = {
    "string": "STRING",
    "integer": "BIGINT",
    "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*",
    "boolean": "BOOLEAN",
    "array": "ARRAY.*",
    "object": "OBJECT.*",
}


def argument_errors(name: Column, parsed: Column, schemas: dict[str, dict[str, dict]]) -> Column:
    """Sorted array of what is wrong: ``json``, ``tool``, or field:missing, field:type, field:range, field:unknown.

    schemas: tool -> field -> {type, required, min, max}; min and max bound numbers and the lengths of strings.
    """
    by_tool = F.array(F.lit("tool"))
    for tool, fields in schemas.items():
        found = []
        for field, rule in fields.items():
            value = F.variant_get(parsed, f"$.{field}", "variant")
            kind = F.schema_of_variant(value)
            missing = value.isNull() | F.is_variant_null(value)
            if rule.get("required"):
                found.append(F.when(missing, f"{field}:missing"))
            right = kind.rlike(f"^({_TYPES[rule['type']]})$")
            found.append(F.when(~missing & ~right, f"{field}:type"))
            if "min" in rule or "max" in rule:
                if rule["type"] == "string":
                    size = F.length(F.try_variant_get(parsed, f"$.{field}", "string")).cast("double")
                else:
                    size = F.try_variant_get(parsed, f"$.{field}", "double")
                out = F.lit(False)
                if "min" in rule:
                    out = out | (size < rule["min"])
                if "max" in rule:
                    out = out | (size > rule["max"])
                found.append(F.when(~missing & right & out, f"{field}:range"))
        known = F.array(*[F.lit(f) for f in fields])
        keys = F.coalesce(F.json_object_keys(F.to_json(parsed)), F.array().cast("array<string>"))
        unknown = F.transform(F.array_except(keys, known), lambda k: F.concat(k, F.lit(":unknown")))
        by_tool = F.when(name == tool, F.concat(F.array_compact(F.array(*found)), unknown)).otherwise(by_tool)
    broken = parsed.isNull() | ~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return F.when(broken, F.array(F.lit("json"))).otherwise(F.array_sort(by_tool))


def chain_order(calls: DataFrame, stage: Stage) -> DataFrame:
    """calls: ``call_id``, ``after``. Returns ``call_id``, ``depth`` (0 for the first of a chain; null on a cycle and for
    what only follows one), one row an identifier. Of calls with one identifier the smallest ``after`` counts; an
    ``after`` that is no call starts a chain."""
    ids = calls.where("call_id is not null").groupBy("call_id").agg(F.min("after").alias("after"))
    ids = stage.save(ids, "ids")
    known = ids.select(F.col("call_id").alias("after"))
    state = ids.join(known.withColumn("there", F.lit(True)).hint("shuffle_hash"), "after", "left")
    state = state.select("call_id", F.when(F.col("there"), F.col("after")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth"))
    state = stage.save(state, "order-0")
    left, n = state.where("up is not null").count(), ids.count()
    stage.expect(n * 100)
    turn, most = 0, max(1, n).bit_length() + 1
    while left and turn < most:
        above = state.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        state = state.join(above.hint("shuffle_hash"), "up", "left").select("call_id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        turn += 1
        state = stage.save(state, f"order-{turn}")
        if turn > 1:
            stage.drop(f"order-{turn - 1}")
        left = state.where("up is not null").count()
    return state.select("call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, dict]]) -> DataFrame:
    """calls: ``call_id``, ``after``, ``name``, ``arguments`` (JSON text); results: ``call_id``, ``content``. Further columns
    of calls stay, but for names that the result uses.

    Returns one row a call: ``call_id``, ``name``, ``depth`` (see chain_order), ``n_calls`` (calls of this identifier),
    ``n_results``, ``errors`` (comma-joined, empty if valid), ``message`` (canonical JSON of arguments, call_id, depth, name and
    result; fields that are null are left out, arguments that are no JSON too). Of several results the smallest content counts.
    A call without identifier is linked with nothing: depth, n_calls null, n_results 0. Empty tables are fine on either side.
    """
    stage = Stage(calls.sparkSession, "tool-calls")
    calls = calls.drop("depth", "n_calls", "n_results", "errors", "message", "result", "parsed")
    answered = results.where("call_id is not null").groupBy("call_id").agg(F.count(F.lit(1)).alias("n_results"), F.min("content").alias("result"))
    same = calls.where("call_id is not null").groupBy("call_id").agg(F.count(F.lit(1)).alias("n_calls"))
    # one row an identifier on the built side, so the hash tables hold identifiers, however often one occurs
    per_id = same.join(chain_order(calls, stage).hint("shuffle_hash"), "call_id", "left").join(answered.hint("shuffle_hash"), "call_id", "left")
    rows = calls.join(per_id.hint("shuffle_hash"), "call_id", "left").withColumn("parsed", F.try_parse_json("arguments"))
    message = F.struct(
        F.col("parsed").alias("arguments"), F.col("call_id").alias("call_id"), F.col("depth").alias("depth"), F.col("name").alias("name"), F.col("result").alias("result")
    )
    rows = rows.withColumn("errors", F.array_join(argument_errors(F.col("name"), F.col("parsed"), schemas), ",")).withColumn("message", F.to_json(message))
    return rows.withColumn("n_results", F.coalesce("n_results", F.lit(0))).drop("parsed", "result")
