"""Prompt construction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redline.functions import patterns as pt

TASKS = {
    "grammar": (pt.GRAMMAR_PROMPT_PREFIX, pt.GRAMMAR_MARKER,
                pt.GRAMMAR_SYSTEM_PROMPT, pt.GRAMMAR_USER_TEMPLATE),
    "readability": (pt.READABILITY_PROMPT_PREFIX, pt.READABILITY_MARKER,
                    pt.READABILITY_SYSTEM_PROMPT, pt.READABILITY_USER_TEMPLATE),
}


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def marker(task: str) -> str:
    return TASKS[task][1]


def prompt(task: str, source="input_text") -> Column:
    """P-04: local-model inference prompt `<prefix><input>\\n<marker>`."""
    prefix, mark, _, _ = TASKS[task]
    return F.concat(F.lit(prefix), _c(source), F.lit("\n" + mark))


def training_text(task: str, source="input_text", target="target_text") -> Column:
    """P-03: prompt + ' ' + target + end-of-text marker."""
    return F.concat(prompt(task, source), F.lit(" "), _c(target), F.lit(pt.END_OF_TEXT))


def chat_messages(task: str, source="input_text", system: str | None = None,
                  user_template: str | None = None) -> Column:
    """P-05: [{role: system, content}, {role: user, content}]. The template is
    filled by literal replacement, so braces inside the text are harmless."""
    _, _, sys_default, user_default = TASKS[task]
    system = sys_default if system is None else system
    user_template = user_default if user_template is None else user_template
    user = F.replace(F.lit(user_template), F.lit("{input_text}"), _c(source))
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )
