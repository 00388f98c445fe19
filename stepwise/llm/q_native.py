"""Queries of the native operators (tool-call linking, fingerprints, URL filters)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.llm import merkle, tool_calls, url_filters
from stepwise.llm.common import table

# Fixed values of the URL query.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]
LISTED_NAMES = ["casino-win", "ads-track", "free-bets", "spam-farm", "cheap-pills", "adult-x"]


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, then the cascade over all hosts; listed are the hosts with a listed name as a label."""
    pages = table(spark, sf_dir, "pages")
    host, _ = url_filters.split_url(F.col("url"))
    listed = (pages.select(host.alias("key"))
              .where(F.arrays_overlap(F.split("key", "[.]"), F.array(*map(F.lit, LISTED_NAMES)))))
    return url_filters.filter_urls(pages, listed, URL_RULES)


OP9_SQL = f"""
with p as (
  select page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
r(verdict, rhost, rpath) as (values {", ".join(str(r) for r in URL_RULES)}),
best as (
  select p.page_id, p.host, p.path, arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) as rule,
         arg_max(r.verdict, length(r.rhost || r.rpath)) as v
  from p left join r on (p.host = r.rhost or ends_with(p.host, '.' || r.rhost)) and starts_with(p.path, r.rpath)
  group by p.page_id, p.host, p.path)
select page_id, host, path, rule,
       coalesce(v, case when list_has_any(string_split(host, '.'), {LISTED_NAMES}) then 'block' else 'allow' end) as verdict
from best
"""


def conversation_calls(conv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tool calls and results seen in a conversation table.

    A user turn calls a tool (named by its text) and depends on the call two
    turns before; the assistant turn after it is that call's result.
    """
    cid = F.concat(F.lit("call-"), F.col("conv_id"), F.lit("-"), F.col("turn"))
    names = F.array(F.lit("search"), F.lit("summarise"), F.lit("translate"))
    args = F.to_json(F.struct(F.col("text").alias("query"), F.length("text").alias("limit")))
    calls = conv.where("role = 'user'").select(
        "conv_id", "turn", cid.alias("call_id"),
        F.element_at(names, (F.pmod(F.length("text"), F.lit(3)) + 1).cast("int")).alias("name"),
        args.alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(F.concat(F.lit("call-"), F.col("conv_id"), F.lit("-"), F.col("turn") - 2)))
        .otherwise(F.array().cast("array<string>")).alias("depends_on"))
    results = conv.where("role = 'assistant'").select(
        "conv_id", "turn", F.concat(F.lit("call-"), F.col("conv_id"), F.lit("-"), F.col("turn") - 1).alias("call_id"),
        F.col("text").alias("content"))
    return calls, results


TOOL_SCHEMAS = [("search", "query", "string", True), ("search", "limit", "integer", False),
                ("summarise", "query", "string", True), ("summarise", "limit", "string", False),
                ("translate", "query", "string", True), ("translate", "lang", "string", True)]


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = conversation_calls(table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(TOOL_SCHEMAS, "name string, param string, type string, required boolean")
    out = tool_calls.link_tool_calls(calls, results, schemas)
    return out.select("conv_id", "call_id", "turn", "name", "topo_turn", "topo_depth", "n_calls", "n_results",
                      F.concat_ws(",", "errors").alias("errors"), "status", "json")


OP3_SQL = """
with c as (
  select conv_id, turn, 'call-' || conv_id || '-' || turn as call_id, length(text) as n, text,
         ['search', 'summarise', 'translate'][length(text) % 3 + 1] as name,
         case when turn >= 2 then 'call-' || conv_id || '-' || (turn - 2) end as dep
  from conversations where role = 'user'),
c1 as (select conv_id, call_id, count(*) as n_calls, min({'turn': turn, 'name': name, 'text': text, 'n': n, 'dep': dep}) as c
       from c group by all),
r as (select conv_id, 'call-' || conv_id || '-' || (turn - 1) as call_id, count(*) as n_results,
             min({'turn': turn, 'content': text}) as r
      from conversations where role = 'assistant' group by all),
j as (
  select coalesce(c1.conv_id, r.conv_id) as conv_id, coalesce(c1.call_id, r.call_id) as call_id,
         c1.c.turn as turn, c1.c.name as name, c1.c.turn as topo_turn, case when c1.c.turn is not null then 0::bigint end as topo_depth,
         coalesce(n_calls, 0) as n_calls, coalesce(n_results, 0) as n_results, c1.c.text as text, c1.c.n as n,
         c1.c.dep as dep, r.r.content as content
  from c1 full join r on c1.conv_id = r.conv_id and c1.call_id = r.call_id),
e as (
  select j.*, concat_ws(',',
    case when name = 'translate' then 'missing:lang' end, case when name = 'summarise' then 'type:limit' end,
    case when name = 'translate' then 'unknown:limit' end,
    case when dep is not null and c1.call_id is null then 'dependency:' || dep end) as errors
  from j left join c1 on c1.conv_id = j.conv_id and c1.call_id = j.dep)
select conv_id, call_id, turn, name, topo_turn, topo_depth, n_calls, n_results, errors,
       case when n_calls = 0 then 'orphan_result' when errors <> '' then 'invalid'
            when n_results = 0 then 'no_result' else 'ok' end as status,
       case when n_calls = 0 then '{"arguments":null,"id":' || to_json(call_id) || ',"name":null,"result":' || to_json(content) || '}'
            else '{"arguments":{"limit":' || n || ',"query":' || to_json(text) || '},"id":' || to_json(call_id)
                 || ',"name":' || to_json(name) || ',"result":' || coalesce(to_json(content)::varchar, 'null') || '}' end as json
from e
"""


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.edited_fingerprints(docs).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


QUERIES = {"op3_tool_calls": op3_tool_calls, "op5_fingerprints": op5_fingerprints, "op9_url_filters": op9_url_filters}
ORACLES = {"op3_tool_calls": OP3_SQL, "op9_url_filters": OP9_SQL}
