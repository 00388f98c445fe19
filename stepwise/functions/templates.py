"""Prompt texts and a renderer that turns a template into a Catalyst concat.

Fixed values: the verifier and policy prompt texts below must equal the
evaluated prompts character for character, so they are stated verbatim.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------

# Verifier body shared by the first-error suite (as used after stripping).
FIRST_ERROR_VERIFIER_TEXT = """### Instruction:
You are an excellent math teacher. Please verify the correctness of the Now Step.

You first need to analyze the Now Step and the Previous Steps and then summarize based on your analysis.
Analysis:
You need to analyze the following aspects.
**Previous Steps Analysis**: You need to analyze the Previous Steps step by step. For each step, you need to first explain what the current step is doing, then you try to find any error in the current step.
**Now Step Analysis**: You first need to explain what the Now Step is doing, and then point out which part of the Question it is trying to solve or which part of the information it states.
**Data Source Analysis**: First you need to find out what data are used in the Now Step, and then you need to determine whether the source of the data is reasonable and correct. When you judge whether the source of a data is reasonable and correct, you need to specify the specific source of this data: such as which part of the question, or which content of the previous step; and then determine the source and current use is consistent, the Now Step is used correctly.
**Consistency Analysis**: You need to check that the Now Step is consistent with the contents of the Previous Steps, and then you need to check that all the information inside the Now Step is consistent.
**Calculation Analysis**: If the Now Step involves any calculations, such as addition, subtraction, multiplication, division, equations, modulo operations, etc., you will first need to perform a check on the calculation, such as a reverse operation, to see if the calculation was done correctly, and then analyze the results of your check to see if there was an error in the calculation.
Conclusion: 
Please verify the correctness of the Now Step based on your analysis, if there is any error in the Now Step then the Now Step is wrong and vice versa the Now Step is correct. At the end of the Conclusion, when you give your final answer, write it in the form "Verification: Is the step correct (Yes/No)? X", where X is either Yes or No."""

# Classified-step suite instruction (str.format fields: question, previous_steps, now_step).
CLASSIFIED_VERIFIER_TEMPLATE = """You are an excellent math teacher. Please verify the correctness of the Now Step.

You first need to analyze the Now Step and the Previous Steps and then summarize based on your analysis.
Analysis:
You need to analyze the following aspects.
**Previous Steps Analysis**: You need to analyze the Previous Steps step by step. For each step, you need to first explain what the current step is doing, then you try to find any error in the current step.
**Now Step Analysis**: You first need to explain what the Now Step is doing, and then point out which part of the Question it is trying to solve or which part of the information it states.
**Data Source Analysis**: First you need to find out what data are used in the Now Step, and then you need to determine whether the source of the data is reasonable and correct. When you judge whether the source of a data is reasonable and correct, you need to specify the specific source of this data: such as which part of the question, or which content of the previous step; and then determine the source and current use is consistent, the Now Step is used correctly.
**Consistency Analysis**: You need to check that the Now Step is consistent with the contents of the Previous Steps, and then you need to check that all the information inside the Now Step is consistent.
**Calculation Analysis**: If the Now Step involves any calculations, such as addition, subtraction, multiplication, division, equations, modulo operations, etc., you will first need to perform a check on the calculation, such as a reverse operation, to see if the calculation was done correctly, and then analyze the results of your check to see if there was an error in the calculation.
Conclusion:
Please verify the correctness of the Now Step based on your analysis, if there is any error in the Now Step then the Now Step is wrong and vice versa the Now Step is correct. At the end of the Conclusion, when you give your final answer, write it in the form "Verification: Is the step correct (Yes/No)? X", where X is either Yes or No.

Question: {question}
Previous Steps: {previous_steps}
Now Step: {now_step}
Please carefully analyze the correctness of the Now Step.
Reply:"""

# Best-of-N candidate scoring instruction (same fields).
CANDIDATE_VERIFIER_TEMPLATE = """###Instruction: 
You are an excellent math teacher. Please verify the correctness of the Now Step.

You first need to analyze the Now Step and the Previous Steps and then summarize based on your analysis.
Analysis:
You need to analyze the following aspects.
**Previous Steps Analysis**: You need to analyze the Previous Steps step by step. For each step, you need to first explain what the current step is doing, then you try to find any error in the current step.
**Now Step Analysis**: You first need to explain what the Now Step is doing, and then point out which part of the Question it is trying to solve or which part of the information it states.
**Data Source Analysis**: First you need to find out what data are used in the Now Step, and then you need to determine whether the source of the data is reasonable and correct. When you judge whether the source of a data is reasonable and correct, you need to specify the specific source of this data: such as which part of the question, or which content of the previous step; and then determine the source and current use is consistent, the Now Step is used correctly.
**Consistency Analysis**: You need to check that the Now Step is consistent with the contents of the Previous Steps, and then you need to check that all the information inside the Now Step is consistent.
**Calculation Analysis**: If the Now Step involves any calculations, such as addition, subtraction, multiplication, division, equations, modulo operations, etc., you will first need to perform a check on the calculation, such as a reverse operation, to see if the calculation was done correctly, and then analyze the results of your check to see if there was an error in the calculation.
Conclusion:
Please verify the correctness of the Now Step based on your analysis, if there is any error in the Now Step then the Now Step is wrong and vice versa the Now Step is correct. At the end of the Conclusion, when you give your final answer, write it in the form "Verification: Is the step correct (Yes/No)? X", where X is either Yes or No.

Question: {question}
Previous Steps: {previous_steps}
Now Step: {now_step}
Please carefully analyze the correctness of the Now Step.
Reply: 
###Response: 
"""

# Policy (step generator) chat prompt (fields: question, previous_steps).
POLICY_TEMPLATE = """<|im_start|>system
You are Qwen, created by Alibaba Cloud. You are a helpful math problem solving assistant. Please reason step by step, and put your final answer within \\boxed{{}}.<|im_end|>
<|im_start|>user
{question}<|im_end|>
<|im_start|>assistant
{previous_steps}"""

# Framing around instructions.
FIRST_ERROR_REPLY_LINE = "Please carefully analyze the correctness of the Now Step.\nReply: "
FIRST_ERROR_RESPONSE_TAIL = "\n### Response:\n"
INSTRUCTION_HEAD = "### Instruction:\n"
RESPONSE_HEAD = "\n\n### Response:\n"
CHAT_USER_HEAD = "<|user|>\n"
CHAT_ASSISTANT_TAIL = "\n<|assistant|>"
NO_PREVIOUS_STEPS = "None"

# ---- rendering --------------------------------------------------------------


def template_parts(template: str) -> list[tuple[str, str | None]]:
    """(literal, field) pairs of a ``str.format`` template, braces unescaped."""
    return [(lit, field) for lit, field, _, _ in string.Formatter().parse(template)]


def render(template: str, **fields: Column) -> Column:
    """``template.format(**fields)`` as one ``concat`` over columns."""
    pieces: list[Column] = []
    for lit, field in template_parts(template):
        if lit:
            pieces.append(F.lit(lit))
        if field is not None:
            pieces.append(F.coalesce(fields[field].cast("string"), F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")


def sql_literal(text: str) -> str:
    """A SQL string literal for the oracle text (single quotes doubled)."""
    return "'" + text.replace("'", "''") + "'"


def render_sql(template: str, **fields: str) -> str:
    """The same rendering as SQL text: ``concat(lit, coalesce(expr, ''), ...)``."""
    pieces: list[str] = []
    for lit, field in template_parts(template):
        if lit:
            pieces.append(sql_literal(lit))
        if field is not None:
            pieces.append(f"coalesce(cast({fields[field]} as varchar), '')")
    return "concat(" + ", ".join(pieces) + ")"
