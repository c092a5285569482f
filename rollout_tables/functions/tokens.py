"""Token-array columns for the SFT table.

``ids`` is ``ARRAY<INT>`` as a tokenizer returns it. Truncation and padding
come first, then the answer start is searched on the padded ids, as the
training code does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollout_tables.fixed_values import ASSISTANT_TOKEN_ID, HEADER_SCAN_WIDTH, IGNORE_INDEX, NEWLINE_TOKEN_ID


def truncate(ids: Column, max_len: int) -> Column:
    """C1."""
    return F.slice(ids, 1, max_len)


def pad(ids: Column, max_len: int, pad_id: int) -> Column:
    """Right padding to ``max_len``."""
    return F.concat(ids, F.array_repeat(F.lit(pad_id), F.greatest(F.lit(max_len) - F.size(ids), F.lit(0))))


def attention_mask(padded: Column, n_real: Column) -> Column:
    return F.transform(padded, lambda x, i: F.when(i < n_real, F.lit(1)).otherwise(F.lit(0)))


def answer_start(ids: Column, rule: str = "answer", n_real: Column | None = None,
                 header_id: int = ASSISTANT_TOKEN_ID, newline_id: int = NEWLINE_TOKEN_ID) -> Column:
    """Index of the first answer token, null when none is found.

    The last ``header_id`` that has ``newline_id`` within the next 9 tokens
    marks the answer; the answer starts after that newline. ``rule='last_header'``
    is the rule as written; ``rule='answer'`` (default) also requires a real
    token after the newline, so an empty trailing assistant header (added for
    generation) does not mask the whole answer.
    """
    def window(i):
        return F.slice(ids, i + 2, HEADER_SCAN_WIDTH)

    def nl_index(i):
        return i + F.array_position(window(i), F.lit(newline_id)).cast("int")

    def candidate(x, i):
        ok = (x == header_id) & F.exists(window(i), lambda t: t == newline_id)
        if rule == "answer":
            limit = n_real if n_real is not None else F.size(ids)
            ok = ok & (nl_index(i) + 1 < limit)
        return F.when(ok, i)

    last = F.array_max(F.transform(ids, candidate))
    return F.when(last.isNotNull(), nl_index(last) + 1)


def mask_labels(ids: Column, start: Column, ignore_index: int = IGNORE_INDEX) -> Column:
    """C4: every position before ``start`` becomes -100; no start, no mask."""
    return F.transform(ids, lambda x, i: F.when(start.isNotNull() & (i < start), F.lit(ignore_index)).otherwise(x))
