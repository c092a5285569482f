"""Rendering message arrays to model text.

A message array is ``ARRAY<STRUCT<role STRING, content STRING>>``. The
format literals are parameters; the defaults are the ChatML markers the
training prompts end with and the Llama-3 template shipped with the project.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollout_tables.fixed_values import (
    CHATML_CLOSE, CHATML_GENERATION, CHATML_OPEN, LLAMA3_EOT, LLAMA3_HEADER_CLOSE, LLAMA3_HEADER_OPEN,
)
from rollout_tables.functions.text import py_strip


def render_chatml(messages: Column, add_generation_prompt: bool = True,
                  open_: str = CHATML_OPEN, close: str = CHATML_CLOSE,
                  generation: str = CHATML_GENERATION) -> Column:
    """``<|im_start|>role\\ncontent<|im_end|>\\n`` per message, then the
    assistant header."""
    body = F.array_join(F.transform(messages, lambda m: F.concat(
        F.lit(open_), F.coalesce(m["role"], F.lit("")), F.lit("\n"),
        F.coalesce(m["content"], F.lit("")), F.lit(close))), "")
    body = F.coalesce(body, F.lit(""))
    return F.concat(body, F.lit(generation)) if add_generation_prompt else body


def render_llama3(messages: Column, add_generation_prompt: bool = True) -> Column:
    """A leading system message keeps its content as is, every other
    message is stripped; each rendered message is followed by a newline (the
    template's line break after the expression), and the optional assistant
    header closes the text."""
    def one(m, i):
        keep = (i == 0) & (m["role"] == "system")
        content = F.when(keep, F.coalesce(m["content"], F.lit(""))).otherwise(
            py_strip(F.coalesce(m["content"], F.lit(""))))
        return F.concat(F.lit(LLAMA3_HEADER_OPEN), F.coalesce(m["role"], F.lit("")),
                        F.lit(LLAMA3_HEADER_CLOSE), content, F.lit(LLAMA3_EOT + "\n"))
    body = F.coalesce(F.array_join(F.transform(messages, one), ""), F.lit(""))
    if add_generation_prompt:
        return F.concat(body, F.lit(LLAMA3_HEADER_OPEN + "assistant" + LLAMA3_HEADER_CLOSE))
    return body


def flatten_messages(messages: Column) -> Column:
    """Messages as one string (role TAB content, records joined by 0x1E), the
    flat form the SQL checks compare."""
    return F.array_join(F.transform(messages, lambda m: F.concat_ws("\t", m["role"], m["content"])), "\x1e")
