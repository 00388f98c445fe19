"""End to end: preference pairs -> tokens -> padded batches; logged log-probs -> losses -> metrics.

    python examples/preference_prep.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from stepwise import get_session  # noqa: E402
from stepwise.operators import preference as P  # noqa: E402
from stepwise.operators import tokens as TK  # noqa: E402
from stepwise.operators.ordering import assign_batches  # noqa: E402
from stepwise.plans.fixtures import fixture  # noqa: E402


def main(sf_dir: str) -> None:
    spark = get_session()
    pairs = fixture(spark, sf_dir, "f_pref")
    tok = TK.preference_tokenize(pairs, max_prompt_length=800)
    batches = TK.preference_collate(assign_batches(tok, ["pair_id"], 4))
    batches.select("pair_id", "batch_id", F.size("chosen_input_ids").alias("chosen_width")).show(5)

    logps = fixture(spark, sf_dir, "f_pairlogp")
    losses = P.weighted_losses(logps, ["sigmoid", "cmcl"], [1.0, 0.5], beta=0.1,
                               cmcl={"alpha": 1.0, "beta": 30.0, "gamma": 60.0, "tau": 1.0})
    metrics = P.batch_metrics(losses)
    P.log_windows(metrics, logging_steps=8).orderBy("window_id").show(5)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001")
