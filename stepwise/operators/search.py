"""Best-of-N step search over tables.

State lives in two buffers (generator and discriminator), each a DataFrame
keyed by sample id.  Whether ``answer`` is *present* decides whether a
sample is finished, so buffers keep their raw JSON text and derive
``has_<key>`` from ``json_object_keys`` (a typed struct cannot tell an
explicit null from an absent key).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.functions.answers import light_normalise, single_boxed
from stepwise.operators import chains as C
from stepwise.operators import votes as V
from stepwise.session import ensure_checkpoint_dir, path_exists, scratch_path, written

EVALUATIONS = "array<struct<candidate_idx: int, reward: double, analysis_labels: array<string>, analysis_outputs: array<string>>>"
#: Fields of a buffer that jobs read, and their types.
BUFFER_FIELDS = {"problem": "string", "steps": "array<string>", "answer": "string", "candidates": "array<string>",
                 "candidate_evaluations": EVALUATIONS}


def parse_buffer(raw: DataFrame, raw_col: str = "raw", id_type: str = "bigint") -> DataFrame:
    """Raw JSON sample -> typed columns plus ``has_<key>`` presence flags.

    ``id`` is taken from the record, as ``id_type``, unless the table already has that column.
    """
    keys = F.json_object_keys(F.col(raw_col))
    out = raw
    if "id" not in raw.columns:
        out = out.withColumn("id", F.get_json_object(raw_col, "$.id").cast(id_type))
    out = out.withColumns({f"has_{k}": F.coalesce(F.array_contains(keys, k), F.lit(False)) for k in ("id", *BUFFER_FIELDS)})
    value = lambda k: F.get_json_object(raw_col, f"$.{k}")
    return out.withColumns({k: value(k) if t == "string" else F.from_json(value(k), t) for k, t in BUFFER_FIELDS.items()})


def _side(buffer: DataFrame, side: str, placed: bool) -> DataFrame:
    """A buffer's rows with their order, what is present and the fields, in one shape for both sides."""
    have = set(buffer.columns)
    order = F.monotonically_increasing_id()
    if placed:
        order = F.col("position") if "position" in have else F.struct(
            F.lit("").alias("file"), F.lit(0).cast("bigint").alias("block"), order.alias("row"), F.lit(0).alias("item"))
    fields = [(F.col(k) if k in have else F.lit(None)).cast(t).alias(k) for k, t in BUFFER_FIELDS.items()]
    present = F.lit(0)
    for k, bit in _BITS.items():
        if f"has_{k}" in have:
            present = present.bitwiseOR(F.when(F.col(f"has_{k}"), F.lit(bit)).otherwise(F.lit(0)))
    return buffer.select("id", F.lit(side).alias("side"), order.alias("at"), present.alias("present"), F.struct(*fields).alias("row"))


_BITS = {k: 1 << i for i, k in enumerate(BUFFER_FIELDS)}


def merge_buffers(gen: DataFrame, disc: DataFrame) -> DataFrame:
    """Merge of parsed buffers: the last row of an id on either side, then per-field precedence.

    ``problem`` and ``steps`` come from the generator when it has the key,
    else from the discriminator; ``answer`` from whichever has the key,
    generator first; candidates and their evaluations from the discriminator.
    One aggregate with map-side combine takes the last row of both sides;
    a row's order is its ``position`` in the files, if it has one.  What is
    present is one number beside the fields: a job that asks only for that
    neither parses nor moves the fields.
    """
    placed = "position" in gen.columns or "position" in disc.columns
    both = _side(gen, "g", placed).unionByName(_side(disc, "d", placed))
    last = lambda side, c: F.max_by(F.when(F.col("side") == side, F.col(c)), F.when(F.col("side") == side, F.col("at")))
    one = both.groupBy("id").agg(*[last(side, c).alias(f"{side}_{c}") for side in "gd" for c in ("present", "row")])
    has = lambda side, k: F.coalesce(F.col(f"{side}_present"), F.lit(0)).bitwiseAND(F.lit(_BITS[k])) != 0
    first = lambda k: F.when(has("g", k), F.col(f"g_row.{k}")).when(has("d", k), F.col(f"d_row.{k}"))
    own = lambda k: F.when(has("d", k), F.col(f"d_row.{k}")).alias(k)
    return one.select(
        "id", first("problem").alias("problem"),
        F.when(has("g", "steps") | has("d", "steps"), first("steps")).otherwise(F.array().cast("array<string>")).alias("steps"),
        (has("g", "answer") | has("d", "answer")).alias("has_answer"), first("answer").alias("answer"),
        own("candidates"), has("d", "candidates").alias("has_candidates"),
        own("candidate_evaluations"), has("d", "candidate_evaluations").alias("has_candidate_evaluations"))


def pending(merged: DataFrame) -> DataFrame:
    """Samples still without an answer key (the rest pass through untouched)."""
    return merged.where(~F.col("has_answer"))


def answered_ids(gen: DataFrame, disc: DataFrame) -> DataFrame:
    """Distinct ids that carry an answer key in either buffer."""
    return (gen.where("has_answer").select("id")
            .union(disc.where("has_answer").select("id")).distinct())


def to_score(gen: DataFrame, disc: DataFrame) -> DataFrame:
    """Discriminator samples with candidates whose id is answered nowhere."""
    todo = disc.where(F.coalesce(F.size("candidates"), F.lit(0)) > 0)
    return todo.join(answered_ids(gen, disc), "id", "left_anti")


def progress(buffer: DataFrame, side_col: str | None = None) -> DataFrame:
    """answered / total and the loop state: done, not_done or empty."""
    keys = [side_col] if side_col else []
    agg = buffer.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"),
                                    F.count_if(F.col("has_answer")).alias("answered"))
    state = (F.when(F.col("total") == 0, "empty")
             .when(F.col("answered") == F.col("total"), "done").otherwise("not_done"))
    return agg.withColumn("state", state)


def init_buffer(problems: DataFrame, id_col: str = "id", problem_col: str = "problem") -> DataFrame:
    """Fresh search state: id, problem, empty steps, no answer."""
    return problems.select(F.col(id_col).alias("id"), F.col(problem_col).alias("problem"),
                           F.array().cast("array<string>").alias("steps"),
                           F.lit(False).alias("has_answer"), F.lit(None).cast("string").alias("answer"))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df``, or an error if it has no row."""
    if df.isEmpty():
        raise ValueError(f"{what}: no rows")
    return df


def init_or_resume(spark: SparkSession, buffer_path: str, problems: DataFrame, id_col: str = "id",
                   problem_col: str = "problem") -> DataFrame:
    """Resume from a non-empty buffer file, else start every problem afresh; one schema either way.

    Ids of the file are read as the type they have in ``problems``; the last
    row of an id counts.  Without a buffer, ``problems`` must have rows.
    """
    from stepwise.sources.records import read_buffer
    fresh = init_buffer(problems, id_col, problem_col)
    existing = read_buffer(spark, buffer_path)
    if existing.isEmpty():
        return require_rows(fresh, "problems to search")
    held = parse_buffer(existing, id_type=_id_type(fresh, "id"))
    return merge_buffers(held, held.where("false")).select(*fresh.columns)


# Exit codes of the progress check: stop, continue, unreadable buffer.
CHECK_DONE, CHECK_CONTINUE, CHECK_INVALID = 0, 1, 2


def check_progress(spark: SparkSession, buffer_path: str) -> tuple[int, int, int]:
    """(code, answered, total) for a buffer file: 0 when every sample has an
    answer key, 1 when some do not or the buffer is empty, 2 when the file is
    missing or not a list/dict of objects.  One small aggregate."""
    from stepwise.sources.records import read_buffer
    try:
        buf = parse_buffer(read_buffer(spark, buffer_path, strict=True), id_type="string")
    except (FileNotFoundError, ValueError):
        return CHECK_INVALID, 0, 0
    row = progress(buf).collect()
    if not row or row[0]["total"] == 0:
        return CHECK_CONTINUE, 0, 0
    r = row[0]
    return (CHECK_DONE if r["state"] == "done" else CHECK_CONTINUE), r["answered"], r["total"]


def evaluations_by_sample(results: DataFrame, sample_col: str = "sample_id") -> DataFrame:
    """Per sample, its candidate evaluations sorted by ``candidate_idx``."""
    item = F.struct(*[F.col(c) for c in results.columns if c != sample_col])
    return results.groupBy(sample_col).agg(F.sort_array(F.collect_list(item)).alias("candidate_evaluations"))


def best_candidates(results: DataFrame, candidates: DataFrame, sample_col: str = "sample_id",
                    idx_col: str = "candidate_idx", reward_col: str = "reward") -> DataFrame:
    """Arg-max candidate per sample (ties -> lowest index) and its answer.

    ``candidates`` holds ``(id, candidates array<string>)``.  An index out
    of range is skipped.  ``answer`` is set when the chosen text has exactly
    one non-empty boxed answer.
    """
    best = (results.groupBy(sample_col)
            .agg(F.max_by(F.struct(F.col(idx_col).alias("best_idx"), F.col(reward_col).alias("best_reward")),
                          F.struct(F.col(reward_col), -F.col(idx_col))).alias("_b")))
    best = best.select(F.col(sample_col).alias("id"), "_b.best_idx", "_b.best_reward")
    j = best.join(candidates.select("id", "candidates"), "id")
    j = j.withColumn("best_candidate", F.get(F.col("candidates"), F.col("best_idx")))
    j = j.where(F.col("best_candidate").isNotNull())
    ans = single_boxed(F.col("best_candidate"))
    return (j.withColumn("answer", F.when(F.length(ans) > 0, ans))
             .withColumn("has_answer", F.col("answer").isNotNull())
             .drop("candidates"))


def apply_selection(buffer: DataFrame, best: DataFrame) -> DataFrame:
    """Append the chosen step and set the answer where one was found."""
    b = best.select("id", F.col("best_candidate").alias("_step"), F.col("answer").alias("_ans"))
    j = buffer.join(b, "id", "left")
    return (j.withColumn("steps", F.when(F.col("_step").isNotNull(),
                                         F.concat(F.coalesce("steps", F.array().cast("array<string>")),
                                                  F.array(F.col("_step")))).otherwise(F.col("steps")))
             .withColumn("answer", F.when(F.col("_ans").isNotNull(), F.col("_ans")).otherwise(F.col("answer")))
             .withColumn("has_answer", F.col("has_answer") | F.col("_ans").isNotNull())
             .drop("_step", "_ans"))


def candidate_answer_check(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """Extracted boxed answer of each candidate vs the gold answer (light normalisation)."""
    c = candidates.withColumn("extracted", single_boxed(F.col("candidate"))).where(F.col("extracted").isNotNull())
    j = c.join(gold.select("id", F.col("answer").alias("gold")), "id")
    return j.withColumn("match", light_normalise(F.col("extracted")) == light_normalise(F.col("gold")))


# --------------------------------------------------------------------------
# Caller-supplied generation and scoring (Arrow batches)
# --------------------------------------------------------------------------

GeneratorFn = Callable[[pd.DataFrame], pd.Series]   # prompts frame -> list of candidate texts per row
ScorerFn = Callable[[pd.Series], pd.Series]         # prompt series -> list of generation texts per row


def generate_candidates(pending_samples: DataFrame, generator: GeneratorFn, carry: Sequence[str] = ()) -> DataFrame:
    """Run a generator over pending samples; candidates are stripped, empties dropped.

    The id, problem, steps and rendered prompt cross into Python, and the
    columns ``carry`` among them come back beside the candidates.  A generator
    may be random, so write the result once before using it twice.
    """
    prompts = C.render_policy_prompt(pending_samples).select("id", "problem", "steps", "prompt")
    names = ["id", *carry]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[names].assign(candidates=generator(pdf))

    types = ", ".join(f"{c} {_id_type(prompts, c)}" for c in names)
    out = prompts.mapInPandas(run, f"{types}, candidates array<string>")
    return C.clean_candidates(out)


def _id_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def score_candidates(samples: DataFrame, scorer: ScorerFn, wide: bool = False) -> DataFrame:
    """Verifier generations for every candidate.

    Long form ``(sample_id, candidate_idx, gen_idx, output)`` by default; with
    ``wide`` one row per candidate with the ``outputs`` array (voting on it
    then needs no shuffle).
    """
    ex = C.expand_candidates(samples.select("id", "problem", "steps", "candidates"))
    prompts = C.render_candidate_prompt(ex).select(F.col("id").alias("sample_id"), "candidate_idx", "prompt")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            outs = scorer(pdf["prompt"])
            yield pd.DataFrame({"sample_id": pdf["sample_id"], "candidate_idx": pdf["candidate_idx"],
                                "outputs": outs})

    scored = prompts.mapInPandas(run, f"sample_id {_id_type(samples, 'id')}, candidate_idx int, outputs array<string>")
    if wide:
        return scored
    return scored.select("sample_id", "candidate_idx", F.posexplode("outputs").alias("gen_idx", "output"))


def resume_state(problems: DataFrame, gen: DataFrame | None = None, disc: DataFrame | None = None) -> DataFrame:
    """Search state from parsed buffers; problems that neither buffer holds start afresh."""
    state = init_buffer(problems)
    if gen is None and disc is None:
        return state
    held = merge_buffers(*(b if b is not None else other.where("false") for b, other in ((gen, disc), (disc, gen))))
    return state.join(held.select("id"), "id", "left_anti").unionByName(held.select(*state.columns))


def state_of(start: DataFrame, log: DataFrame | None) -> DataFrame:
    """Search state as a view: the start, and what the step log says since.

    ``log`` has ``id, round, step, answer``: chosen steps in the order of
    their rounds; the answer of the last round that found one counts.
    """
    if log is None:
        return start
    since = log.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("round", "step"))), lambda s: s["step"]).alias("_steps"),  # at most one a round
        F.max_by("answer", F.when(F.col("answer").isNotNull(), F.col("round"))).alias("_answer"))
    none = F.array().cast("array<string>")
    return (start.join(since, "id", "left")
            .withColumn("steps", F.concat(F.coalesce("steps", none), F.coalesce("_steps", none)))
            .withColumn("answer", F.coalesce("_answer", "answer"))
            .withColumn("has_answer", F.col("has_answer") | F.col("_answer").isNotNull())
            .drop("_steps", "_answer"))


def search_loop(spark: SparkSession, problems: DataFrame, generator: GeneratorFn, scorer: ScorerFn,
                max_rounds: int = 30, gen: DataFrame | None = None, disc: DataFrame | None = None,
                log_path: str | None = None) -> DataFrame:
    """Greedy best-of-N: generate -> score -> select -> check, until all answered.

    Starts afresh or from parsed buffers (``gen``, ``disc``).  The state is an
    append-only step log: a round writes the chosen step (and answer) of the
    samples pending in it under ``log_path/round=k`` and touches no other
    row, so a run costs as much as its steps, however many samples are done;
    the state itself is a view over the start and the log.  A round that is
    on the log is not run again, so a broken run goes on with its last round
    when it is started again with the same ``log_path``.  Candidates and their
    rewards are written once a round, so that what is selected has been scored
    even if the generator is random.  Samples left at the round limit have
    ``has_answer`` false; no sample at all is an error.
    """
    ensure_checkpoint_dir(spark)
    start = require_rows(written(resume_state(problems, gen, disc), "search-start"), "samples to search")
    log_path = log_path or scratch_path(spark, "search-log")
    schema = f"id {_id_type(start, 'id')}, step string, answer string, round int"
    log = None
    for k in range(max_rounds):
        part = f"{log_path}/round={k}"
        if not path_exists(spark, f"{part}/_SUCCESS"):
            work = generate_candidates(pending(state_of(start, log)), generator, ("problem", "steps")).checkpoint()
            if work.isEmpty():
                break
            # generations stay an array per candidate: voting is a narrow projection
            results = V.vote_counted_wide(score_candidates(work, scorer, wide=True)).checkpoint()
            best = best_candidates(results, work.select("id", "candidates"))
            best.select("id", F.col("best_candidate").alias("step"), "answer").write.mode("overwrite").parquet(part)
        log = spark.read.schema(schema).parquet(log_path)
    return state_of(start, log)


def stub_generator(pdf: pd.DataFrame) -> pd.Series:
    """Deterministic stand-in generator: proposes a boxed answer from round 3 on."""
    out = []
    for sid, steps in zip(pdf["id"], pdf["steps"]):
        k = len(steps) + 1
        cands = [f"step {k} option {j} for sample {sid}" for j in range(4)]
        if k >= 3:
            cands.append(f"so the answer is \\boxed{{{sid % 97}}}")
        cands.append("   ")
        out.append(cands)
    return pd.Series(out)


def stub_scorer(prompts: pd.Series) -> pd.Series:
    """Deterministic stand-in verifier: favours boxed candidates."""
    def votes(p: str) -> list[str]:
        yes = "\\boxed{" in p.rsplit("Now Step:", 1)[-1]
        h = sum(map(ord, p[-40:]))
        return [f"Verification: Is the step correct (Yes/No)? {'Yes' if yes or (h + g) % 3 == 0 else 'No'}"
                for g in range(4)]
    return prompts.map(votes)
