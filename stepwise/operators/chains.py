"""Reasoning chains: build, expand to per-step rows, render verifier prompts.

Chains travel as one row with an ``array<string>`` of steps; expansion is a
narrow ``posexplode``.  Building arrays from long step rows is one hash
aggregation whose lists are bounded by the length of a chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.functions import templates as T
from stepwise.functions.text import py_strip


def chains_from_rows(rows: DataFrame, id_col: str = "id", index_col: str = "step_index",
                     text_col: str = "step", carry: tuple[str, ...] = ("question",)) -> DataFrame:
    """Long step rows -> ``(id, carried..., steps array<string>)`` in index order.

    A row without an index carries no step, so an id with such rows alone has an empty chain.
    """
    aggs = [F.first(c, ignorenulls=True).alias(c) for c in carry]
    item = F.when(F.col(index_col).isNotNull(), F.struct(F.col(index_col).alias("i"), F.col(text_col).alias("t")))
    aggs.append(F.sort_array(F.collect_list(item)).alias("_s"))
    return (rows.groupBy(id_col).agg(*aggs)
            .withColumn("steps", F.transform("_s", lambda x: x["t"])).drop("_s"))


def numbered(steps: Column, first: int = 1) -> Column:
    """["a", "b"] -> ["Step 1: a", "Step 2: b"]."""
    return F.transform(steps, lambda s, i: F.concat(F.lit("Step "), (i + first).cast("string"),
                                                    F.lit(": "), s.cast("string")))


def prefix_text(numbered_steps: Column, n: Column, sep: str = "\n") -> Column:
    """The first ``n`` numbered steps joined by ``sep`` ('' when n = 0)."""
    return F.array_join(F.slice(numbered_steps, F.lit(1), n), sep)


def expand_steps(chains: DataFrame, id_col: str = "id", question_col: str = "question",
                 steps_col: str = "steps", answer_col: str | None = None,
                 explanation_col: str | None = None) -> DataFrame:
    """One example per step (0-based ``step_index``) with the running prefix.

    ``previous_steps`` is the newline-joined "Step j: ..." list of the
    earlier steps and the empty string for the first step; ``now_step`` is
    "Step i+1: ..."; the example id is "{id}-step{i}".
    """
    base = chains.select(
        F.col(id_col).alias("orig_id"),
        F.coalesce(F.col(question_col).cast("string"), F.lit("")).alias("question"),
        numbered(F.col(steps_col)).alias("_num"),
        (F.coalesce(F.col(answer_col).cast("string"), F.lit("")) if answer_col else F.lit("")).alias("answer"),
        (F.coalesce(F.col(explanation_col).cast("string"), F.lit("")) if explanation_col else F.lit("")).alias("explanation"),
    )
    ex = base.select("*", F.posexplode("_num").alias("step_index", "now_step"))
    return ex.select(
        F.concat(F.col("orig_id").cast("string"), F.lit("-step"), F.col("step_index").cast("string")).alias("id"),
        "orig_id", F.col("step_index").cast("int").alias("step_index"), "question",
        prefix_text(F.col("_num"), F.col("step_index")).alias("previous_steps"),
        "now_step", "answer", "explanation")


def split_steps(chains: DataFrame, id_col: str = "id", question_col: str = "question",
                steps_col: str = "steps", error_steps_col: str = "error_steps",
                class_col: str = "classification", default_class: str = "unclassified",
                carry: tuple[str, ...] = ()) -> DataFrame:
    """One sample per step with 1-based ``step_id`` and the earlier steps as an array.

    Chains without steps are skipped; ``is_error`` is membership of the
    step id in ``error_steps``.  ``carry`` names columns (a record's metadata)
    that every step of the record keeps.
    """
    c = chains.where(F.size(F.col(steps_col)) > 0)
    ex = c.select(F.col(id_col).alias("original_id"),
                  F.col(question_col).alias("question"),
                  F.col(steps_col).alias("_steps"),
                  F.coalesce(F.col(error_steps_col), F.array().cast("array<int>")).alias("error_steps"),
                  F.coalesce(F.col(class_col), F.lit(default_class)).alias("classification"),
                  *carry,
                  F.posexplode(F.col(steps_col)).alias("_p", "current_step"))
    return ex.select(
        "original_id", (F.col("_p") + 1).cast("int").alias("step_id"), "question",
        F.slice("_steps", F.lit(1), F.col("_p")).alias("previous_steps"),
        "current_step", "error_steps", "classification",
        F.array_contains("error_steps", (F.col("_p") + 1).cast("int")).alias("is_error"), *carry)


def running_history(rows: DataFrame, id_col: str, order_col: str, text_col: str,
                    sep: str = "\n") -> DataFrame:
    """Every earlier text of the same chain, in order, for each row.

    The variant for steps that are already rows: a window frame ending one
    row before the current one.  Window groups are single chains.
    """
    w = (Window.partitionBy(id_col).orderBy(order_col)
         .rowsBetween(Window.unboundedPreceding, -1))
    prev = F.collect_list(F.col(text_col)).over(w)
    return (rows.withColumn("n_previous", F.size(prev))
                .withColumn("history", F.array_join(prev, sep)))


# --------------------------------------------------------------------------
# Prompt rendering
# --------------------------------------------------------------------------

def render_first_error_prompt(examples: DataFrame) -> DataFrame:
    """Verifier prompt of the first-error suite from expanded examples."""
    lines = [F.lit(T.FIRST_ERROR_VERIFIER_TEXT), F.lit(""),
             F.concat(F.lit("Question: "), F.coalesce(F.col("question"), F.lit(""))), F.lit(""),
             F.concat(F.lit("Previous Steps: "), F.coalesce(F.col("previous_steps"), F.lit(""))), F.lit(""),
             F.concat(F.lit("Now Step: "), F.coalesce(F.col("now_step"), F.lit(""))), F.lit(""),
             F.lit(T.FIRST_ERROR_REPLY_LINE), F.lit(""), F.lit(T.FIRST_ERROR_RESPONSE_TAIL)]
    return examples.withColumn("prompt", F.concat_ws("\n", *lines))


def _previous_or_none(steps: Column) -> Column:
    return F.when(F.size(steps) > 0, F.array_join(numbered(steps), "\n")).otherwise(F.lit(T.NO_PREVIOUS_STEPS))


def render_classified_prompt(samples: DataFrame, template: str = T.CLASSIFIED_VERIFIER_TEMPLATE) -> DataFrame:
    """Instruction-framed prompt for split step samples (``previous_steps`` array)."""
    instruction = T.render(template,
                           question=F.col("question"),
                           previous_steps=_previous_or_none(F.col("previous_steps")),
                           now_step=F.concat(F.lit("Step "), F.col("step_id").cast("string"), F.lit(": "),
                                             F.coalesce(F.col("current_step").cast("string"), F.lit(""))))
    return samples.withColumn("prompt", F.concat(F.lit(T.INSTRUCTION_HEAD), instruction, F.lit(T.RESPONSE_HEAD)))


def render_candidate_prompt(df: DataFrame, problem_col: str = "problem", steps_col: str = "steps",
                            candidate_col: str = "candidate",
                            template: str = T.CANDIDATE_VERIFIER_TEMPLATE) -> DataFrame:
    """Chat-wrapped verifier prompt for one candidate next step."""
    steps = F.coalesce(F.col(steps_col), F.array().cast("array<string>"))
    instruction = T.render(template,
                           question=F.col(problem_col),
                           previous_steps=_previous_or_none(steps),
                           now_step=F.concat(F.lit("Step "), (F.size(steps) + 1).cast("string"), F.lit(": "),
                                             F.coalesce(F.col(candidate_col), F.lit(""))))
    return df.withColumn("prompt", F.concat(F.lit(T.CHAT_USER_HEAD), instruction, F.lit(T.CHAT_ASSISTANT_TAIL)))


def render_policy_prompt(df: DataFrame, problem_col: str = "problem", steps_col: str = "steps") -> DataFrame:
    """Generator prompt: steps joined by a blank line, trailing blank line if any."""
    steps = F.coalesce(F.col(steps_col), F.array().cast("array<string>"))
    body = T.render(T.POLICY_TEMPLATE, question=F.col(problem_col), previous_steps=F.array_join(steps, "\n\n"))
    return df.withColumn("prompt", F.concat(body, F.when(F.size(steps) > 0, F.lit("\n\n")).otherwise(F.lit(""))))


def render_sft_text(df: DataFrame, instruction_col: str = "instruction", output_col: str = "output",
                    eos_token: str = "</s>") -> DataFrame:
    """Supervised prompt and full training text ``prompt + output + eos``."""
    prompt = F.concat(F.lit(T.INSTRUCTION_HEAD), F.col(instruction_col), F.lit(T.RESPONSE_HEAD))
    return (df.withColumn("prompt", prompt)
              .withColumn("text", F.concat(F.col("prompt"), F.col(output_col), F.lit(eos_token))))


# --------------------------------------------------------------------------
# Candidates
# --------------------------------------------------------------------------

def clean_candidates(df: DataFrame, col: str = "candidates") -> DataFrame:
    """Strip every candidate and drop empty ones (indices shift down)."""
    return df.withColumn(col, F.filter(F.transform(F.col(col), py_strip), lambda x: x != ""))


def candidate_preview(df: DataFrame, col: str = "candidates", k: int = 3, width: int = 80) -> DataFrame:
    """Count plus the first ``width`` characters of the first ``k`` candidates."""
    return (df.withColumn("candidate_count", F.size(col))
              .withColumn("preview", F.transform(F.slice(F.col(col), 1, k), lambda x: F.substring(x, 1, width))))


def expand_candidates(df: DataFrame, id_col: str = "id", col: str = "candidates") -> DataFrame:
    """One row per (sample, candidate_idx)."""
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, F.posexplode(col).alias("candidate_idx", "candidate"))


# --------------------------------------------------------------------------
# Field resolution over raw JSON records (names vary between data sets)
# --------------------------------------------------------------------------

def _json_text(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "string")


def _truthy(f: Column) -> Column:
    """Python truthiness of a field from its JSON type and text (absent / null are false)."""
    t, s = f["t"], f["s"]
    return (F.when(t.isNull() | (t == "VOID"), F.lit(False))
            .when(t == "STRING", s != "")
            .when(t.startswith("ARRAY"), s != "[]")
            .when(t.startswith("OBJECT"), s != "{}")
            .when(t == "BOOLEAN", s == "true")
            .otherwise(F.coalesce(s.cast("double") != 0, F.lit(True))))


def _chain_of(f: Column) -> Column:
    """``ok`` and ``steps`` of a field: a list's items, a text as the only step; anything else is not ok."""
    is_list, is_text = f["t"].startswith("ARRAY"), f["t"] == "STRING"
    items = F.when(is_text, F.array(f["s"])).when(is_list, F.try_variant_get(f["v"], "$", "array<string>"))
    return F.struct((is_list | is_text).alias("ok"), items.alias("steps"))


# Fields of a record by the names they go under; the first truthy one counts.
TRUTHY_NAMES = {"id": ["id", "idx"], "question": ["question", "problem", "text", "prompt"],
                "steps": ["steps", "reasoning", "explanation"], "answer": ["final_answer", "answer", "label"],
                "explanation": ["explanation"]}


def resolve_truthy(raw: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Chains from records whose field names vary: first *truthy* name wins.

    ``TRUTHY_NAMES`` has the names; a missing field is '' (no steps: an empty
    list).  Steps that are a string become a one-step list, and any other
    non-list value drops the record.  A record is parsed once, to a struct of
    its fields; a field's type and text are taken once for each column that
    may come from it, so the plan grows with the number of names.
    """
    keys = sorted({k for names in TRUTHY_NAMES.values() for k in names})
    schema = ", ".join(f"`{k}` variant" for k in keys)
    fields = raw.select(F.from_json(F.col(raw_col), schema, {"mode": "FAILFAST"}).alias("f"))

    def field(k: str) -> Column:
        v = F.col(f"f.`{k}`")
        return F.struct(F.schema_of_variant(v).alias("t"), F.try_variant_get(v, "$", "string").alias("s"), v.alias("v"))

    def first(name: str, value) -> Column:
        found = F.filter(F.array(*map(field, TRUTHY_NAMES[name])), _truthy)
        return F.get(F.transform(F.slice(found, 1, 1), value), 0)

    texts = {c: F.coalesce(first(c, lambda f: f["s"]), F.lit("")).alias(c) for c in ("id", "question", "answer", "explanation")}
    rows = fields.select(texts["id"], texts["question"], first("steps", _chain_of).alias("chain"), texts["answer"], texts["explanation"])
    return (rows.where("chain is null or chain.ok")
            .select("id", "question", F.coalesce("chain.steps", F.array().cast("array<string>")).alias("steps"), "answer", "explanation"))


def resolve_presence(raw: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Chains from records by key *presence*: a present null wins over later names.

    original_id: id | idx | 'unknown'; question: modified_question | problem |
    question | ''; steps: modified_process | steps | []; error_steps | [];
    classification: classification | label | 'unclassified'.
    """
    keys = F.json_object_keys(F.col(raw_col))
    v = F.col("_v")
    df = raw.withColumn("_v", F.parse_json(F.col(raw_col))).withColumn("_keys", keys)
    has = lambda k: F.array_contains(F.col("_keys"), k)

    def pick(names, value, default):
        expr = default
        for k in reversed(names):
            expr = F.when(has(k), value(k)).otherwise(expr)
        return expr

    text = lambda k: _json_text(v, k)
    arr = lambda k: F.try_variant_get(v, f"$.{k}", "array<string>")
    ints = lambda k: F.try_variant_get(v, f"$.{k}", "array<int>")
    return df.select(
        pick(["id", "idx"], text, F.lit("unknown")).alias("original_id"),
        pick(["modified_question", "problem", "question"], text, F.lit("")).alias("question"),
        pick(["modified_process", "steps"], arr, F.array().cast("array<string>")).alias("steps"),
        pick(["error_steps"], ints, F.array().cast("array<int>")).alias("error_steps"),
        pick(["classification", "label"], text, F.lit("unclassified")).alias("classification"))
