"""End to end: chains -> per-step prompts -> caller's verifier -> votes -> first-error report.

    python examples/first_error_eval.py [sf_dir]

The verifier is a stand-in callable (replace ``verifier`` with a model
client); everything else runs as Spark jobs.
"""

from __future__ import annotations

import os
import sys

import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from stepwise import get_session  # noqa: E402
from stepwise.operators import chains as C  # noqa: E402
from stepwise.operators import evaluate as EV  # noqa: E402
from stepwise.operators import votes as V  # noqa: E402
from stepwise.plans.fixtures import fixture  # noqa: E402


def verifier(prompts: pd.Series) -> pd.Series:
    """Stand-in: eight generations per prompt."""
    return prompts.map(lambda p: [f"Verification: Is the step correct (Yes/No)? {'No' if (len(p) + g) % 5 == 0 else 'Yes'}"
                                  for g in range(8)])


def main(sf_dir: str) -> None:
    spark = get_session()
    chains = C.chains_from_rows(fixture(spark, sf_dir, "f_chain"))
    examples = C.render_first_error_prompt(C.expand_steps(chains))

    def score(batches):
        for pdf in batches:
            yield pd.DataFrame({"orig_id": pdf["orig_id"], "step_index": pdf["step_index"],
                                "outputs": verifier(pdf["prompt"])})

    scored = examples.select("orig_id", "step_index", "prompt").mapInPandas(
        score, "orig_id long, step_index int, outputs array<string>")
    votes = scored.select("orig_id", "step_index", F.posexplode("outputs").alias("gen_idx", "output"))
    steps = V.vote_excluding_unparsed(votes, ["orig_id", "step_index"])
    gold = steps.select(F.col("orig_id").alias("id")).distinct().withColumn("label", (F.col("id") % 3 - 1).cast("int"))
    report = EV.first_error_summary(steps, gold)
    EV.report_text(report, percent=("first_error_accuracy", "no_error_accuracy")).show(truncate=False)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001")
