"""Chat formatting with linked tool calls (DataFrame operations only).

Wire form: a turn's text may hold ``<tool_call>{"id","name","arguments"}</tool_call>``
blocks; a turn of role ``tool`` answers with ``{"tool_call_id","content"}``.  An
argument ``{"$result": "id"}`` uses the result of another call.

Calls and results are hash-joined by (conversation, identifier).  Calls are
ordered topologically by levels: a call whose arguments use no other result has
level 0, any other is one above the highest it uses; calls in or behind a cycle
have no level; every round looks only at uses that are still open.  Arguments are checked against per-tool schemas.  Messages are
canonical JSON: keys sorted, no blanks, absent fields left out.

Distribution: formatting is row by row; only calls, results and uses are
shuffled, by (conversation, identifier), and never gathered per conversation.

Defined results: null text or role is the empty string; text that is no JSON
inside a block counts as an invalid call; for repeated identifiers the earliest
turn counts, and of equal turns the least place; rows of one turn with unlike texts are
separate messages, each with its own calls, and repeated rows are separate messages with the
same ones; a null conversation is one of its own; very long texts are kept
whole; an empty table gives an empty result; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squall.llm.common import shared_dir, table, written

#: tool -> parameter -> (type as in schema_of_variant, required)
SCHEMAS = {
    "search": {"query": ("STRING", True), "limit": ("BIGINT", False)},
    "calculate": {"expression": ("STRING", True)},
    "get_weather": {"city": ("STRING", True), "days": ("BIGINT", False)},
    "read_file": {"path": ("STRING", True)},
}

_BLOCK = r"(?s)<tool_call>(.*?)</tool_call>"
_USES = r'\{"\$result":"([^"]+)"\}'


def _errors(name, arguments, schemas):
    """Messages on a call's arguments; arguments: a variant, or null."""
    known = F.lit(False)
    found = [F.when(arguments.isNull(), F.lit("arguments: not an object"))]
    for tool, parameters in schemas.items():
        of_tool = name == tool
        known = known | of_tool
        for parameter, (kind, required) in parameters.items():
            value = F.try_variant_get(arguments, f"$.{parameter}", "variant")
            is_kind = F.schema_of_variant(value)
            if required:
                found.append(F.when(of_tool & value.isNull(), F.lit(f"{parameter}: missing")))
            uses = F.try_variant_get(value, "$['$result']", "string").isNotNull()
            found.append(F.when(of_tool & value.isNotNull() & (is_kind != kind) & ~uses, F.lit(f"{parameter}: not {kind}")))
        allowed = F.array(*[F.lit(p) for p in parameters]) if parameters else F.array().cast("array<string>")
        extra = F.array_except(F.coalesce(F.json_object_keys(F.to_json(arguments)), F.array().cast("array<string>")), allowed)
        found.append(F.when(of_tool & (F.size(extra) > 0), F.concat(F.array_join(F.array_sort(extra), ","), F.lit(": not known"))))
    found.append(F.when(~F.coalesce(known, F.lit(False)), F.concat(F.coalesce(name, F.lit("null")), F.lit(": no such tool"))))
    return F.array_compact(F.array(*found))


def _text_key(text):
    """Tells rows of one turn apart; null for texts without a call."""
    return F.when(text.contains("<tool_call>"), F.sha2(text, 256))


def parse_calls(turns: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """One row per call: conv_id, turn, text_key (of the row's text), at (place in it), id, name, arguments (canonical JSON), uses, errors."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blocks = turns.where(text.contains("<tool_call>")).select("conv_id", "turn", _text_key(text).alias("text_key"), F.posexplode(F.regexp_extract_all(text, F.lit(_BLOCK), 1)).alias("at", "raw"))
    calls = blocks.withColumn("call", F.try_parse_json("raw"))
    calls = calls.withColumn("id", F.try_variant_get("call", "$.id", "string")).withColumn("name", F.try_variant_get("call", "$.name", "string"))
    calls = calls.withColumn("given", F.try_variant_get("call", "$.arguments", "variant"))
    calls = calls.withColumn("given", F.when(F.schema_of_variant("given").startswith("OBJECT"), F.col("given")))
    calls = calls.withColumn("arguments", F.to_json("given"))
    return calls.select(
        "conv_id", "turn", "text_key", "at", "id", "name", "arguments",
        F.array_distinct(F.regexp_extract_all(F.coalesce("arguments", F.lit("")), F.lit(_USES), 1)).alias("uses"),
        _errors(F.col("name"), F.col("given"), schemas).alias("errors"),
    )


def parse_results(turns: DataFrame) -> DataFrame:
    """One row per answered identifier: conv_id, id, result_turn (the earliest), content (canonical JSON)."""
    parsed = turns.where(F.col("role") == "tool").select("conv_id", "turn", F.try_parse_json("text").alias("result"))
    parsed = parsed.select("conv_id", "turn", F.try_variant_get("result", "$.tool_call_id", "string").alias("id"), F.to_json(F.try_variant_get("result", "$.content", "variant")).alias("content"))
    return parsed.where(F.col("id").isNotNull()).groupBy("conv_id", "id").agg(F.min(F.struct("turn", "content")).alias("first")).select("conv_id", "id", F.col("first.turn").alias("result_turn"), F.col("first.content").alias("content"))


def levels(spark: SparkSession, calls: DataFrame) -> DataFrame:
    """(conv_id, id, level) of each identified call; one more round for each level there is."""
    ids = calls.where(F.col("id").isNotNull()).groupBy("conv_id", "id").agg(F.min(F.struct("turn", "at", "uses")).alias("first"))
    ids = ids.select("conv_id", "id", F.col("first.uses").alias("uses"))
    uses = ids.select("conv_id", "id", F.explode("uses").alias("used"))
    known = ids.select(F.col("conv_id").alias("kc"), F.col("id").alias("ki"))
    uses = uses.join(known, F.col("conv_id").eqNullSafe(F.col("kc")) & (F.col("used") == F.col("ki")), "left_semi")  # results from elsewhere order nothing
    if uses.isEmpty():
        return ids.select("conv_id", "id", F.lit(0).alias("level"))
    shared_dir(spark)
    left = uses.checkpoint()

    def without(some: DataFrame, gone: DataFrame, by: str = "id") -> DataFrame:
        gone = gone.select(F.col("conv_id").alias("rc"), F.col("id").alias("ri")).distinct()
        return some.join(gone, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col(by) == F.col("ri")), "left_anti")

    new, _ = written(without(ids, left).select("conv_id", "id", F.lit(0).alias("level")))
    done = new
    level = 0
    while True:
        level += 1
        still, _ = written(without(left, new, "used"))  # uses of calls that have no level yet
        ready = without(left.select("conv_id", "id").distinct(), still)
        new, seen = written(ready.select("conv_id", "id", F.lit(level).alias("level")))
        left = still
        if not seen["n"]:
            break
        done = done.unionByName(new)
    return done.unionByName(left.select("conv_id", "id", F.lit(None).cast("int").alias("level")).distinct())


def link(spark: SparkSession, turns: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """parse_calls with result_turn and level: calls in topological order are those by (level, turn, at)."""
    calls, results = parse_calls(turns, schemas), parse_results(turns)
    order = levels(spark, calls)
    out = calls.join(results.withColumnsRenamed({"conv_id": "rc", "id": "ri"}), F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("id") == F.col("ri")), "left").drop("rc", "ri")
    return out.join(order.withColumnsRenamed({"conv_id": "oc", "id": "oi"}), F.col("conv_id").eqNullSafe(F.col("oc")) & (F.col("id") == F.col("oi")), "left").drop("oc", "oi")


def format_chat(spark: SparkSession, turns: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """One row per turn: conv_id, turn, role, n_calls, n_linked, n_invalid, top_level, message (canonical JSON)."""
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    linked = link(spark, turns, schemas)
    shown = F.struct("arguments", F.array_join("errors", "; ").alias("errors"), "id", "level", "name", "result_turn")
    per = linked.groupBy("conv_id", "turn", "text_key", "at").agg(F.min(F.struct(F.when(F.size("errors") > 0, 1).otherwise(0).alias("bad"), F.col("result_turn").alias("answered"), "level", shown.alias("shown"))).alias("c"))
    per = per.groupBy(F.col("conv_id").alias("pc"), F.col("turn").alias("pt"), "text_key").agg(
        F.count(F.lit(1)).alias("n_calls"), F.count("c.answered").alias("n_linked"), F.sum("c.bad").alias("n_invalid"), F.max("c.level").cast("long").alias("top_level"),
        F.transform(F.sort_array(F.collect_list(F.struct("c.level", "at", "c.shown"))), lambda x: x["shown"]).alias("calls"),
    )
    own = _text_key(F.col("text")) == F.col("text_key")
    out = turns.join(per, F.col("conv_id").eqNullSafe(F.col("pc")) & F.col("turn").eqNullSafe(F.col("pt")) & own, "left")
    content = F.regexp_replace("text", _BLOCK, "")
    message = F.to_json(F.struct(content.alias("content"), "conv_id", "role", F.col("calls").alias("tool_calls"), "turn"))
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id", "turn", "role", F.coalesce("n_calls", zero).alias("n_calls"), F.coalesce("n_linked", zero).alias("n_linked"),
        F.coalesce("n_invalid", zero).alias("n_invalid"), "top_level", message.alias("message"),
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(spark, table(spark, sf_dir, "conversations"))
