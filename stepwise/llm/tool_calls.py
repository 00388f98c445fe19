"""Linking of tool calls and results in chats (native).

Calls and results meet by a hash join on (conversation, identifier).  Calls
are ordered so that every call follows the calls it depends on, arguments
are validated against per-tool schemas, and each linked pair is serialised
as canonical JSON (keys sorted at every level, no white space).

Topological order: a call's sort key is ``(topo_turn, topo_depth, call_id)``.
``topo_turn`` is the latest turn among the call and everything it depends
on, ``topo_depth`` the number of steps from the call that sets it.  Where
every dependency points to an earlier turn this is the turn itself; only
calls behind a backward-pointing dependency are relaxed further, in rounds
that shuffle the changed calls alone.  Calls in or behind a cycle have the
status ``cycle`` and null keys.

Defined results: a null conversation or identifier links with nothing
(status ``no_id``, one row per input row); an identifier used by several
calls or results is represented by the earliest (turn, then name, arguments;
turn, then content) and counted in ``n_calls`` / ``n_results``; a result
without a call is an ``orphan_result``; arguments that are not a JSON object
(malformed, duplicate keys, null) give the error ``arguments``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.session import ensure_checkpoint_dir

KEY = ["conv_id", "call_id"]
LAST_TURN = (1 << 63) - 1


def _kind(value: Column) -> Column:
    """JSON type of a variant: string, integer, number, boolean, array, object or null."""
    t = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return (F.when(t == "BIGINT", "integer").when(t.isin("DECIMAL", "DOUBLE", "FLOAT"), "number")
             .when(t == "VOID", "null").otherwise(F.lower(t)))


def argument_errors(args: Column, params: Column) -> Column:
    """Errors of variant ``args`` against ``array<struct<param,type,required>>``; null params: unknown tool."""
    fields = F.try_variant_get(args, "$", "map<string,variant>")
    fits = lambda p: (_kind(fields[p["param"]]) == p["type"]) | (
        (p["type"] == "number") & (_kind(fields[p["param"]]) == "integer"))
    has = lambda p: F.map_contains_key(fields, p["param"])
    missing = F.transform(F.filter(params, lambda p: p["required"] & ~has(p)), lambda p: F.concat(F.lit("missing:"), p["param"]))
    wrong = F.transform(F.filter(params, lambda p: F.when(has(p), ~fits(p)).otherwise(F.lit(False))),
                        lambda p: F.concat(F.lit("type:"), p["param"]))
    unknown = F.transform(F.array_sort(F.filter(F.map_keys(fields), lambda k: ~F.exists(params, lambda p: p["param"] == k))),
                          lambda k: F.concat(F.lit("unknown:"), k))
    return (F.when(params.isNull(), F.array(F.lit("unknown_tool")))
             .when(fields.isNull(), F.array(F.lit("arguments")))
             .otherwise(F.concat(missing, wrong, unknown)))


def _edges(calls: DataFrame) -> DataFrame:
    return (calls.select(*KEY, F.explode(F.array_distinct("depends_on")).alias("dep")).where("dep is not null"))


def topological_keys(calls: DataFrame) -> DataFrame:
    """``(conv_id, call_id, topo_turn, topo_depth)`` of calls with unique keys."""
    spark = calls.sparkSession
    ensure_checkpoint_dir(spark)
    label = calls.select(*KEY, F.col("turn").alias("topo_turn"),
                         F.when(F.col("turn").isNotNull(), F.lit(0)).cast("bigint").alias("topo_depth"))
    edges = _edges(calls)
    pos = label.select("conv_id", F.col("call_id").alias("dep"), F.col("topo_turn").alias("k"), F.col("topo_depth").alias("d"))
    late = (edges.join(pos, ["conv_id", "dep"])
            .join(label.select(*KEY, "topo_turn"), KEY).where("k >= topo_turn").select("conv_id").distinct())
    late = late.checkpoint(eager=True)
    if late.isEmpty():
        return label
    # only conversations with a dependency that does not point to an earlier turn go round
    size = calls.join(late, "conv_id", "left_semi").groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
    work = label.join(size, "conv_id").withColumn("changed", F.lit(True)).checkpoint(eager=True)
    inner = edges.join(late, "conv_id", "left_semi").join(
        label.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_semi").checkpoint(eager=True)
    while True:
        moved = work.where("changed").select("conv_id", F.col("call_id").alias("dep"), "topo_turn", "topo_depth")
        best = (inner.join(moved, ["conv_id", "dep"]).groupBy(*KEY)
                .agg(F.max(F.struct("topo_turn", (F.col("topo_depth") + 1).alias("d"))).alias("b")))
        joined = work.join(best, KEY, "left")
        # a depth of the number of calls is only reached round a cycle; the latest turn of all then marks
        # the call and what depends on it
        capped = F.struct(F.col("b.topo_turn"), F.least(F.col("b.d"), F.col("size")).alias("d"))
        newer = F.coalesce(capped > F.struct("topo_turn", F.col("topo_depth").alias("d")), F.lit(False))
        work = (joined.withColumn("changed", newer)
                .withColumn("topo_turn", F.when(newer & (F.col("b.d") >= F.col("size")), F.lit(LAST_TURN))
                            .when(newer, F.col("b.topo_turn")).otherwise(F.col("topo_turn")))
                .withColumn("topo_depth", F.when(newer, F.least(F.col("b.d"), F.col("size"))).otherwise(F.col("topo_depth")))
                .drop("b").checkpoint(eager=True))
        if work.where("changed").isEmpty():
            break
    done = work.withColumn("looped", F.col("topo_depth") >= F.col("size"))
    done = done.select(*KEY, *(F.when(~F.col("looped"), F.col(c)).alias(c) for c in ("topo_turn", "topo_depth")))
    return label.join(late, "conv_id", "left_anti").unionByName(done)


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per identifier (and per row without one).

    ``calls(conv_id, turn, call_id, name, arguments, depends_on)`` with
    arguments as JSON text, ``results(conv_id, turn, call_id, content)``,
    ``schemas(name, param, type, required)``.  Extra columns are ignored.
    """
    calls = calls.select(*KEY, "turn", "name", "arguments", "depends_on")
    results = results.select(*KEY, "turn", "content")
    has_id = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    calls = calls.withColumn("turn", F.col("turn").cast("bigint"))
    one = (calls.where(has_id).groupBy(*KEY)
           .agg(F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("c"), F.count(F.lit(1)).alias("n_calls"))
           .select(*KEY, "c.*", "n_calls"))
    got = (results.where(has_id).groupBy(*KEY)
           .agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
           .select(*KEY, F.col("r.content").alias("content"), "n_results"))
    keys = topological_keys(one)
    known = one.select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("known"))
    unmet = (_edges(one).join(known, ["conv_id", "dep"], "left_anti").groupBy(*KEY)
             .agg(F.array_sort(F.collect_set(F.concat(F.lit("dependency:"), F.col("dep")))).alias("unmet")))
    linked = (one.join(keys, KEY, "left").join(unmet, KEY, "left").join(got, KEY, "full")
              .withColumn("has_id", F.lit(True)))
    alone = (calls.where(~has_id).withColumn("n_calls", F.lit(1).cast("bigint")).withColumn("has_id", F.lit(False))
             .unionByName(results.where(~has_id).withColumn("n_results", F.lit(1).cast("bigint"))
                          .withColumn("has_id", F.lit(False)), allowMissingColumns=True))
    rows = linked.unionByName(alone, allowMissingColumns=True)
    tools = (schemas.groupBy("name").agg(F.sort_array(F.collect_set(F.struct("param", "type", "required"))).alias("params")))
    rows = rows.join(tools, "name", "left").withColumn("args", F.try_parse_json("arguments"))
    n_calls, n_results = (F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_calls", "n_results"))
    no_errors = F.array().cast("array<string>")
    errors = F.when(n_calls == 0, no_errors).otherwise(
        F.concat(argument_errors(F.col("args"), F.col("params")), F.coalesce(F.col("unmet"), no_errors)))
    cycle = F.col("turn").isNotNull() & F.col("topo_turn").isNull()
    status = (F.when(~F.col("has_id"), "no_id").when(n_calls == 0, "orphan_result").when(cycle, "cycle")
               .when(F.size("errors") > 0, "invalid").when(n_results == 0, "no_result").otherwise("ok"))
    body = F.to_json(F.struct(F.col("args").alias("arguments"), F.col("call_id").alias("id"), F.col("name"),
                              F.col("content").alias("result")), {"ignoreNullFields": "false"})
    return (rows.withColumn("errors", errors).withColumn("status", status)
            .select("conv_id", "call_id", "turn", "name", "topo_turn", "topo_depth", n_calls.alias("n_calls"),
                    n_results.alias("n_results"), "errors", "status", "content", body.alias("json")))
