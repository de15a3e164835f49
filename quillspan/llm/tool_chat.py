"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

A message's text is a call message if it is a JSON object with an array "tool_calls" of {"id", "name", "arguments"}, and a result if
it is a JSON object with a string "tool_call_id" ("content" holds what came back). Any other text is plain content.

- Linking: results are hash-joined to calls by conversation and identifier. Of calls with one identifier the first holds; of results
  with one identifier the first answers the call and the others are duplicates.
- Order: a result depends on its call, and nothing depends on a result, so the topological order is had without a search: a
  message's place is its turn, a result's the larger of its turn and its call's, after the call. No conversation is gathered.
- Validation: arguments must be an object with every required parameter, each of its type; parameters that the schema does not name
  and tools without a schema are errors.
- JSON: keys sorted, no white space, one line per message.

Null texts count as empty content. Messages without a conversation link to nothing. Repeated messages stay, each with its own line.
Other columns of the input are left out, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: name: {parameter: (type, required)}; types: string, integer, number, boolean, array, object.
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculator": {"expression": ("string", True)},
    "get_weather": {"city": ("string", True), "days": ("integer", False), "metric": ("boolean", False)},
}
_KINDS = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*"}
_CALLS = "array<struct<id:string,name:string,arguments:variant>>"


def _json(text: Column) -> Column:
    """The text as a variant if it looks like an object and parses, else null."""
    return F.when(F.btrim(text, F.lit(" \t\n\r")).startswith("{"), F.try_parse_json(text))


def schema_errors(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]] = SCHEMAS) -> Column:
    """What is wrong with a call, as sorted strings; empty if nothing is."""
    kind = lambda p: F.schema_of_variant(F.try_variant_get(arguments, f"$['{p}']", "variant"))
    given = F.when(F.schema_of_variant(arguments).startswith("OBJECT<"), F.json_object_keys(F.to_json(arguments)))
    result = F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("null"))))
    for tool, parameters in sorted(schemas.items()):
        checks = []
        for p, (type_, required) in sorted(parameters.items()):
            there = F.array_contains(given, p)
            wrong = F.when(there & ~F.coalesce(kind(p).rlike(f"^{_KINDS[type_]}$"), F.lit(False)), F.lit(f"{p}: not {type_}"))
            checks.append(F.when(~there, F.lit(f"{p}: missing")).otherwise(wrong) if required else wrong)
        extra = F.transform(F.array_except(given, F.lit(list(parameters)).cast("array<string>")), lambda k: F.concat(k, F.lit(": unexpected")))
        all_ = F.array_sort(F.concat(F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"), extra))
        result = F.when(name == tool, F.when(given.isNull(), F.array(F.lit("arguments: not object"))).otherwise(all_)).otherwise(result)
    return result


def format_chat(df: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] = SCHEMAS) -> DataFrame:
    """One row per message of (conv_id, turn, role, text): place_turn and place_step (sort by both for the order), kind, n_calls, n_answered, link, errors, valid, json."""
    v = _json(F.col("text"))
    calls = F.try_variant_get("v", "$.tool_calls", _CALLS)
    base = df.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"), v.alias("v")).withColumns({"calls": calls, "answers": F.try_variant_get("v", "$.tool_call_id", "string")})
    kind = F.when(F.size("calls") > 0, "call").when(F.col("answers").isNotNull(), "result").otherwise("plain")
    base = base.withColumn("kind", kind)
    call = base.filter("kind = 'call'").select("conv_id", "turn", F.posexplode("calls").alias("i", "c")).filter("c.id IS NOT NULL AND conv_id IS NOT NULL")
    first_call = call.groupBy("conv_id", F.col("c.id").alias("call_id")).agg(F.min(F.struct("turn", "i")).alias("at"))
    first_result = base.filter("kind = 'result' AND conv_id IS NOT NULL").groupBy("conv_id", F.col("answers").alias("call_id")).agg(F.min("turn").alias("answered_at"))
    links = first_call.join(first_result, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.col("at.turn").alias("call_turn"), F.col("at.i").alias("call_step"), "answered_at")

    plain = base.filter("kind = 'plain'").select(
        "conv_id", "turn", "role", "kind", F.col("turn").alias("place_turn"), F.lit(0).cast("long").alias("place_step"), F.lit(0).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_answered"), F.lit(None).cast("string").alias("link"),
        F.lit("").alias("errors"), F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("role")), {"ignoreNullFields": "false"}).alias("json"),
    )

    results = base.filter("kind = 'result'").alias("r").join(links.alias("l"), (F.col("r.conv_id") == F.col("l.conv_id")) & (F.col("r.answers") == F.col("l.call_id")), "left")
    problem = F.when(F.col("call_turn").isNull(), "no call").when(F.col("turn") > F.col("answered_at"), "duplicate result").otherwise("")
    content = F.try_variant_get("v", "$.content", "variant")
    results = results.select(
        F.col("r.conv_id").alias("conv_id"), "turn", "role", "kind", F.greatest("turn", "call_turn").alias("place_turn"), F.coalesce(F.col("call_step") + 1, F.lit(0)).cast("long").alias("place_step"), F.lit(0).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_answered"),
        F.col("answers").alias("link"), problem.alias("errors"),
        F.concat(F.lit('{"content":'), F.coalesce(F.to_json(content), F.lit("null")), F.lit(',"role":'), F.coalesce(_quoted("role"), F.lit("null")), F.lit(',"tool_call_id":'), _quoted("answers"), F.lit("}")).alias("json"),
    )

    # A message's own calls: linked, validated, then brought together again (by message, whose size is its own text's).
    one = base.filter("kind = 'call'").withColumn("m", F.struct("conv_id", "turn", "role", "text")).select("m", F.col("v"), F.posexplode("calls").alias("i", "c"))
    one = one.alias("o").join(links.alias("l"), (F.col("o.m.conv_id") == F.col("l.conv_id")) & (F.col("o.c.id") == F.col("l.call_id")), "left")
    owns = (F.col("call_turn") == F.col("m.turn")) & (F.col("call_step") == F.col("i"))
    errors = F.concat(schema_errors(F.col("c.name"), F.col("c.arguments"), schemas), F.when(F.coalesce(owns, F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit("identifier missing or taken"))))
    said = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("c.arguments"), F.lit("null")), F.lit(',"id":'), F.coalesce(_quoted("c.id"), F.lit("null")), F.lit(',"name":'), F.coalesce(_quoted("c.name"), F.lit("null")), F.lit("}")
    )
    one = one.select("m", "i", F.coalesce(F.to_json(F.try_variant_get("v", "$.content", "variant")), F.lit("null")).alias("content"), said.alias("said"), F.transform(errors, lambda e: F.concat(F.coalesce(F.col("c.id"), F.lit("null")), F.lit(" "), e)).alias("errors"), (owns & F.col("answered_at").isNotNull()).cast("long").alias("answered"))
    own = one.groupBy("m", "content", "i", "said", "errors", "answered").agg(F.count("*").alias("copies")).groupBy("m", "content").agg(F.array_sort(F.collect_list(F.struct("i", "said", "errors"))).alias("all"), F.sum(F.coalesce("answered", F.lit(0))).alias("n_answered"), F.max("copies").alias("copies"))
    called = own.select(
        F.col("m.conv_id").alias("conv_id"), F.col("m.turn").alias("turn"), F.col("m.role").alias("role"), F.lit("call").alias("kind"), F.col("m.turn").alias("place_turn"), F.lit(0).cast("long").alias("place_step"), F.size("all").cast("long").alias("n_calls"), "n_answered", F.lit(None).cast("string").alias("link"),
        F.array_join(F.flatten(F.transform("all", lambda x: x.errors)), "; ").alias("errors"),
        F.concat(F.lit('{"content":'), F.col("content"), F.lit(',"role":'), F.coalesce(_quoted("m.role"), F.lit("null")), F.lit(',"tool_calls":['), F.array_join(F.transform("all", lambda x: x.said), ","), F.lit("]}")).alias("json"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
    return plain.unionByName(results).unionByName(called).withColumn("valid", F.col("errors") == "")


def _quoted(column: str) -> Column:
    """A string as JSON."""
    whole = F.to_json(F.array(F.col(column)))
    return F.when(F.col(column).isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2))


def op8_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
