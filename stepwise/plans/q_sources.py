"""Queries: record sources and sinks, field resolution of raw records.

Each source query writes a fixture to a fresh folder under the session's
shared checkpoint location and reads it back through the source under test.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stepwise.operators import chains as C
from stepwise.operators import search as S
from stepwise.operators.answers import keep_last
from stepwise.plans.fixtures import fixture, with_fixtures
from stepwise.plans.registry import register, rounded
from stepwise.session import scratch_path
from stepwise.sources import records as RS


@register("scan_chain_json", with_fixtures("select id, step_index, question, step from f_chain", "f_chain"))
def q_scan_chain_json(spark, sf):
    src = fixture(spark, sf, "f_chain")
    path = RS.write_records(src, scratch_path(spark, "chains"))
    return RS.read_json_records(spark, path, schema=src.schema).select("id", "step_index", "question", "step")


@register("scan_buffer_lenient", with_fixtures("""
select cast(json_extract_string(raw, '$.id') as bigint) as id, json_extract_string(raw, '$.problem') as problem,
       coalesce(list_contains(json_keys(raw), 'answer'), false) as has_answer, json_extract_string(raw, '$.answer') as answer
from f_buffer where side = 'g'
""", "f_buffer"))
def q_scan_buffer_lenient(spark, sf):
    src = fixture(spark, sf, "f_buffer").where("side = 'g'").select(F.col("raw").alias("value"))
    path = scratch_path(spark, "buffer")
    src.write.mode("overwrite").text(path)
    buf = S.parse_buffer(RS.read_buffer(spark, path))
    return buf.select(F.get_json_object("raw", "$.id").cast("bigint").alias("id"), "problem", "has_answer", "answer")


@register("scan_answers", with_fixtures("select side, id, answer from f_answer", "f_answer"))
def q_scan_answers(spark, sf):
    src = fixture(spark, sf, "f_answer")
    path = RS.write_records(src, scratch_path(spark, "answers"))
    ans = RS.read_answer_records(spark, path)
    return ans.select(F.get_json_object("raw", "$.side").alias("side"), F.col("id_text").cast("bigint").alias("id"),
                      "answer")


@register("scan_class_dir", with_fixtures("""
select original_id, step_id, is_error, classification, round(reward, 6) as reward from f_prm
""", "f_prm"))
def q_scan_class_dir(spark, sf):
    src = fixture(spark, sf, "f_prm")
    path = RS.write_records(src, scratch_path(spark, "classes"), partition_by=("classification",))
    d = RS.read_record_dir(spark, path, class_pattern=r"classification=([^/]+)/")
    return rounded(d.select(F.col("original_id").cast("bigint"), F.col("step_id").cast("int"), "is_error",
                            F.col("source_class").alias("classification"), F.col("reward").cast("double")))


def _write_arrays(df, path, file_col, order, pretty):
    """One JSON array per value of ``file_col``, its rows in ``order``."""
    one_file = Window.partitionBy(file_col).orderBy(*order)
    record = F.to_json(F.struct(*[c for c in df.columns if c != file_col]), {"pretty": "true"} if pretty else {})
    opener = F.when(F.row_number().over(one_file) == 1, "[").otherwise(",")
    closer = F.when(F.lead(F.lit(1)).over(one_file).isNull(), "]").otherwise("")
    text = df.select(file_col, F.concat(opener, record, closer).alias("value"))
    text.write.option("lineSep", "\n" if pretty else " ").partitionBy(file_col).text(path)


@register("scan_json_arrays", with_fixtures("""
select original_id, step_id, is_error, classification, round(reward, 6) as reward from f_prm
""", "f_prm"))
def q_scan_json_arrays(spark, sf):
    """A folder that mixes pretty arrays, compact arrays and JSON lines, each file split over tasks."""
    src = fixture(spark, sf, "f_prm")
    path = scratch_path(spark, "arrays")
    chunk = src.withColumn("chunk", F.floor(F.col("original_id") / 4000))
    for layout, pretty in ((0, True), (1, False)):
        _write_arrays(chunk.where(F.col("original_id") % 3 == layout), f"{path}/layout={layout}", "chunk",
                      ("original_id", "step_id"), pretty)
    chunk.where("original_id % 3 = 2").write.partitionBy("chunk").json(f"{path}/layout=2")
    schema = "original_id bigint, step_id int, is_error boolean, classification string, reward double"
    return rounded(RS.read_json_records(spark, path, schema=StructType.fromDDL(schema)))


@register("answers_last_in_file", with_fixtures("""
select cast(id % 997 as varchar) as id, answer from f_answer where side = 'p'
qualify row_number() over (partition by id % 997 order by id desc) = 1
""", "f_answer"))
def q_answers_last_in_file(spark, sf):
    """Ids repeat in the files; the last row of an id counts, although the rows are shuffled in between."""
    src = fixture(spark, sf, "f_answer").where("side = 'p'").withColumn("ord", F.col("id")).withColumn("id", F.col("id") % 997)
    path = RS.write_records(src.select("id", "answer", "ord"), scratch_path(spark, "answers"), order_by=("ord",))
    read = RS.read_answer_records(spark, path).repartition("answer").select(F.col("id_text").alias("id"), "answer", "position")
    return keep_last(read, "id").select("id", "answer")


@register("sft_scan_head", with_fixtures("""
select conv_id, turn, instruction, output from f_sft order by conv_id, turn limit 100
""", "f_sft"))
def q_sft_scan_head(spark, sf):
    src = fixture(spark, sf, "f_sft")
    path = RS.write_records(src, scratch_path(spark, "sft"), fmt="parquet")
    return RS.read_parquet_folder(spark, path, required=("instruction", "output"), max_samples=100,
                                  order_by=("conv_id", "turn")).select("conv_id", "turn", "instruction", "output")


@register("pref_scan_prune", with_fixtures("select prompt, chosen, rejected from f_pref", "f_pref"))
def q_pref_scan_prune(spark, sf):
    src = fixture(spark, sf, "f_pref").withColumn("extra", F.length("chosen"))
    path = RS.write_records(src, scratch_path(spark, "pref"), fmt="parquet")
    cols = ("prompt", "chosen", "rejected")
    return RS.read_parquet_folder(spark, path, required=cols, keep=cols)


@register("sink_roundtrip", with_fixtures("""
select cast(id as varchar) || '-step' || cast(step_index as varchar) as id, id as orig_id, step_index,
       'Step ' || cast(step_index + 1 as varchar) || ': ' || step as now_step from f_chain where step_index is not null
""", "f_chain"))
def q_sink_roundtrip(spark, sf):
    ex = C.expand_steps(C.chains_from_rows(fixture(spark, sf, "f_chain"))).select("id", "orig_id", "step_index", "now_step")
    path = RS.write_records(ex, scratch_path(spark, "steps"), order_by=("orig_id", "step_index"))
    return RS.read_json_records(spark, path, schema=ex.schema)


def _jstr(c):
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def _obj(*pieces):
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in pieces]), F.lit("}"))


def _chains(spark, sf):
    return C.chains_from_rows(fixture(spark, sf, "f_chain"))


def _via_file(spark, raw, name):
    """Records land in a JSON-lines file first, as they would from any producer."""
    path = scratch_path(spark, name)
    raw.select(F.col("raw").alias("value")).write.mode("overwrite").text(path)
    return RS.raw_json_records(spark, path)


_CHAINS_SQL = """
, ch as (select id, first(question) as question, coalesce(list(step order by step_index) filter (where step_index is not null), []) as steps
          from f_chain group by id)
"""


def _type(k):
    return f"json_type(raw, '$.{k}')"


def _text(k):
    return f"json_extract_string(raw, '$.{k}')"


def _truthy_sql(k):
    return (f"(case when {_type(k)} is null or {_type(k)} = 'NULL' then false when {_type(k)} = 'VARCHAR' then {_text(k)} <> '' "
            f"when {_type(k)} = 'ARRAY' then json_array_length(raw, '$.{k}') > 0 when {_type(k)} = 'OBJECT' then {_text(k)} <> '{{}}' "
            f"when {_type(k)} = 'BOOLEAN' then {_text(k)} = 'true' else coalesce(cast({_text(k)} as double) <> 0, true) end)")


def _first_truthy_sql(keys, value):
    return "(case " + " ".join(f"when {_truthy_sql(k)} then {value(k)}" for k in keys) + " end)"


@register("chain_resolve_truthy", with_fixtures(_CHAINS_SQL + f"""
, r as (select (case id % 4
          when 0 then json_object('id', id, 'question', question, 'steps', steps, 'answer', 'A' || cast(id as varchar))
          when 1 then json_object('idx', id, 'id', 0, 'problem', question, 'question', '', 'reasoning', steps, 'final_answer', '', 'label', 7)
          when 2 then json_object('id', id, 'text', question, 'steps', []::varchar[], 'explanation', steps[1])
          else json_object('id', id, 'prompt', question, 'steps', 5) end)::varchar as raw from ch),
s as (select raw, {_first_truthy_sql(['steps', 'reasoning', 'explanation'], lambda k: "'" + k + "'")} as sk from r),
t as (select raw, sk, case sk when 'steps' then {_type('steps')} when 'reasoning' then {_type('reasoning')}
                               when 'explanation' then {_type('explanation')} end as skt from s)
select coalesce({_first_truthy_sql(['id', 'idx'], _text)}, '') as id,
       coalesce({_first_truthy_sql(['question', 'problem', 'text', 'prompt'], _text)}, '') as question,
       cast(len(coalesce(case when skt = 'VARCHAR' then [json_extract_string(raw, '$.' || sk)]
                              when skt = 'ARRAY' then cast(json_extract(raw, '$.' || sk) as varchar[]) end, [])) as int) as n_steps,
       array_to_string(coalesce(case when skt = 'VARCHAR' then [json_extract_string(raw, '$.' || sk)]
                              when skt = 'ARRAY' then cast(json_extract(raw, '$.' || sk) as varchar[]) end, []), chr(10)) as steps_text,
       coalesce({_first_truthy_sql(['final_answer', 'answer', 'label'], _text)}, '') as answer,
       coalesce(case when {_truthy_sql('explanation')} then {_text('explanation')} end, '') as explanation
from t where sk is null or skt in ('VARCHAR', 'ARRAY')
""", "f_chain"))
def q_chain_resolve_truthy(spark, sf):
    ch = _chains(spark, sf)
    i = F.col("id")
    q, st = _jstr(F.col("question")), F.to_json(F.col("steps"))
    raw = (F.when(i % 4 == 0, _obj(("id", i.cast("string")), ("question", q), ("steps", st),
                                   ("answer", _jstr(F.concat(F.lit("A"), i.cast("string"))))))
           .when(i % 4 == 1, _obj(("idx", i.cast("string")), ("id", F.lit("0")), ("problem", q), ("question", F.lit('""')),
                                  ("reasoning", st), ("final_answer", F.lit('""')), ("label", F.lit("7"))))
           .when(i % 4 == 2, _obj(("id", i.cast("string")), ("text", q), ("steps", F.lit("[]")),
                                  ("explanation", _jstr(F.get(F.col("steps"), 0)))))
           .otherwise(_obj(("id", i.cast("string")), ("prompt", q), ("steps", F.lit("5")))))
    res = C.resolve_truthy(_via_file(spark, ch.select(raw.alias("raw")), "truthy"))
    return res.select("id", "question", F.size("steps").alias("n_steps"), F.array_join("steps", "\n").alias("steps_text"),
                      "answer", "explanation")


def _has_sql(k):
    return f"coalesce(list_contains(json_keys(raw), '{k}'), false)"


def _pick_sql(keys, value, default):
    return "(case " + " ".join(f"when {_has_sql(k)} then {value(k)}" for k in keys) + f" else {default} end)"


@register("chain_resolve_presence", with_fixtures(_CHAINS_SQL + f"""
, r as (select (case id % 4
          when 0 then json_object('id', id, 'modified_question', question, 'modified_process', steps,
                                  'error_steps', [1, len(steps)], 'classification', 'calc')
          when 1 then json_object('idx', id, 'problem', question, 'steps', steps, 'label', 'logic')
          when 2 then json_object('id', null, 'question', question, 'modified_process', steps, 'classification', null)
          else json_object('id', id, 'question', question, 'modified_process', []::varchar[]) end)::varchar as raw from ch)
select {_pick_sql(['id', 'idx'], _text, "'unknown'")} as original_id,
       {_pick_sql(['modified_question', 'problem', 'question'], _text, "''")} as question,
       cast(len(coalesce({_pick_sql(['modified_process', 'steps'], lambda k: f"cast(json_extract(raw, '$.{k}') as varchar[])", '[]::varchar[]')}, [])) as int) as n_steps,
       array_to_string({_pick_sql(['error_steps'], lambda k: f"cast(json_extract(raw, '$.{k}') as int[])", '[]::int[]')}, ',') as error_steps_text,
       {_pick_sql(['classification', 'label'], _text, "'unclassified'")} as classification
from r
""", "f_chain"))
def q_chain_resolve_presence(spark, sf):
    ch = _chains(spark, sf)
    i = F.col("id")
    q, st = _jstr(F.col("question")), F.to_json(F.col("steps"))
    errs = F.to_json(F.array(F.lit(1), F.size("steps")))
    raw = (F.when(i % 4 == 0, _obj(("id", i.cast("string")), ("modified_question", q), ("modified_process", st),
                                   ("error_steps", errs), ("classification", F.lit('"calc"'))))
           .when(i % 4 == 1, _obj(("idx", i.cast("string")), ("problem", q), ("steps", st), ("label", F.lit('"logic"'))))
           .when(i % 4 == 2, _obj(("id", F.lit("null")), ("question", q), ("modified_process", st),
                                  ("classification", F.lit("null"))))
           .otherwise(_obj(("id", i.cast("string")), ("question", q), ("modified_process", F.lit("[]")))))
    res = C.resolve_presence(_via_file(spark, ch.select(raw.alias("raw")), "presence"))
    return res.select("original_id", "question", F.coalesce(F.size("steps"), F.lit(0)).alias("n_steps"),
                      F.array_join(F.transform("error_steps", lambda x: x.cast("string")), ",").alias("error_steps_text"),
                      "classification")
