"""Verdict parsing: the verifier's final "Is the step correct (Yes/No)? X".

Fixed values: the two patterns differ on purpose.  The last-match form allows
any whitespace between words and has no word boundary after the verdict
("Yesterday" counts as Yes); the first-match form needs single spaces, allows
no space before "(", and ends at a word boundary.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------
LAST_VERDICT_PATTERN = r"(?i)Verification:\s*Is\s+the\s+step\s+correct\s+\(Yes/No\)\?\s*(Yes|No)"
FIRST_VERDICT_PATTERN = r"(?i)Verification:\s*Is the step correct\s*\(Yes/No\)\?\s*(Yes|No)\b"
REWARD_YES, REWARD_NO, REWARD_UNPARSED = 1.0, 0.0, 0.5


def last_verdict(text: Column) -> Column:
    """'Yes' / 'No' from the last match, null when there is none."""
    m = F.try_element_at(F.regexp_extract_all(text, F.lit(LAST_VERDICT_PATTERN), F.lit(1)), F.lit(-1))
    return F.when(m.isNull(), F.lit(None).cast("string")).when(F.lower(m) == "yes", F.lit("Yes")).otherwise(F.lit("No"))


def first_verdict_score(text: Column) -> Column:
    """1.0 / 0.0 from the first match, null when unparsable."""
    m = F.regexp_extract(text, FIRST_VERDICT_PATTERN, 1)
    return (F.when(text.isNull() | (m == ""), F.lit(None).cast("double"))
            .when(F.lower(m) == "yes", F.lit(1.0)).otherwise(F.lit(0.0)))


def verdict_reward(label: Column) -> Column:
    """Yes -> 1.0, No -> 0.0, anything else -> 0.5."""
    return (F.when(label == "Yes", F.lit(REWARD_YES)).when(label == "No", F.lit(REWARD_NO))
            .otherwise(F.lit(REWARD_UNPARSED)))


def reward_label(reward: Column) -> Column:
    """The label that ``verdict_reward`` gave this reward: Yes, No or null."""
    return F.when(reward == REWARD_YES, F.lit("Yes")).when(reward == REWARD_NO, F.lit("No"))


# The same expressions as DuckDB SQL, for oracles.
def last_verdict_sql(expr: str) -> str:
    m = f"regexp_extract_all({expr}, '{LAST_VERDICT_PATTERN}', 1)[-1]"
    return f"(case when {m} is null then null when lower({m}) = 'yes' then 'Yes' else 'No' end)"


def first_verdict_score_sql(expr: str) -> str:
    m = f"regexp_extract({expr}, '{FIRST_VERDICT_PATTERN}', 1)"
    return f"(case when {expr} is null or {m} = '' then null when lower({m}) = 'yes' then 1.0e0 else 0.0e0 end)"


def verdict_reward_sql(label: str) -> str:
    return f"(case when {label} = 'Yes' then 1.0e0 when {label} = 'No' then 0.0e0 else 0.5e0 end)"
