"""Stored PARSE output: what a completion answers, written once as a shredded
variant column and read by field.

``stored_answers`` scans and parses the completions (E1-E9) and keeps, in place
of the text, a VARIANT ``answer`` with one field a rule (``move``,
``advantage``, ``score``, ``missing``, ``fens``; a key that is absent has no
field, a JSON null is a null), a VARIANT ``other`` with the entries that no rule
reads, and what the whole text says where a rule may fall back on it. Spark's
Parquet writer shreds both by the types it meets. ``read_labels`` then reads
only the fields of the wanted categories, which are pushed into the scan:
reports and scores over stored answers parse nothing again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollout_tables.functions import completions as C
from rollout_tables.functions.text import py_strip, variant_type
from rollout_tables.operators.parse import PARSED_COLUMNS, completion_of

FIELD_KEYS = {"move": list(C.EXACT_KEYS), "advantage": ["adv"], "score": ["score"], "missing": ["missing"], "fens": ["fens"]}
CATEGORY_FIELD = {
    "FIND_NEXT_BEST_MOVE": "move", "FIND_LAST_MOVE": "move", "FIND_ADVANTAGED_PLAYER": "advantage",
    "FIND_FINAL_SCORE": "score", "MLM_ON_MOVES": "missing", "SORT_FENS": "fens",
}
STORED_COLUMNS = ["json_state", "answer", "other", "text_move", "text_advantage", "text_score", "think_tokens"]


def _variant_of(entries: Column) -> Column:
    """A map of variants as one variant object."""
    return F.to_variant_object(entries)


def _key_at(place: Column) -> Column:
    return F.get(F.col("_keys"), (place - 1).cast("int"))


def stored_answers(rollouts: DataFrame, completion_col: str = "completion", strip_think: bool = False) -> DataFrame:
    """The rollouts with ``STORED_COLUMNS`` in place of the completion, to be
    written as Parquet. ``strip_think`` reads the answer outside the reasoning
    block only (Q9). A null completion is an empty text."""
    whole, text = completion_of(rollouts, completion_col), F.col("_c")
    df = rollouts.withColumns({"_whole": whole, "_c": C.without_think(whole) if strip_think else whole})
    no_object = F.col("_obj").isNull()
    fields = [F.struct(F.lit(name).alias("key"), F.col(f"_v_{name}").alias("value")) for name in FIELD_KEYS]
    # a repeated key holds its last value, as in the rules
    last = F.transform(F.array_distinct("_keys"), lambda k: F.struct(k.alias("key"), F.try_element_at(
        F.filter(F.map_entries("_obj"), lambda e: e["key"] == k), F.lit(-1))["value"].alias("value")))
    entries = F.when(F.col("_dups"), last).otherwise(F.map_entries("_obj"))
    rest = F.filter(entries, lambda e: ~F.array_contains(F.col("_read"), e["key"]))
    stages = [
        {"_found": C.found_object(text)}, {"_no_braces": F.col("_found") == ""},
        *C.object_stages(F.col("_found"), C.is_non_object(text, F.col("_no_braces"))),
        {f"_p_{name}": F.coalesce(*[C.key_place(k) for k in keys]) for name, keys in FIELD_KEYS.items()},
        {**{f"_v_{name}": C.value_at(F.col(f"_p_{name}")) for name in FIELD_KEYS},
         "_read": F.array_compact(F.array(*[_key_at(F.col(f"_p_{name}")) for name in FIELD_KEYS]))},
        {"answer": F.when(~no_object, _variant_of(F.map_from_entries(F.filter(F.array(*fields), lambda e: e["value"].isNotNull())))),
         "other": F.when(~no_object, _variant_of(F.map_from_entries(rest))),
         "text_move": F.when(no_object | F.col("_v_move").isNull(), C.text_move(text)),
         "text_advantage": F.when(no_object, C.text_advantage(text)),
         "text_score": F.when(no_object, py_strip(F.lower(C.text_score(text)))),
         "think_tokens": C.think_tokens(F.col("_whole"))},
    ]
    for stage in stages:
        df = df.withColumns(stage)
    keep = [c for c in rollouts.columns if c != completion_col and c not in STORED_COLUMNS]
    return df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in keep], *STORED_COLUMNS)


def is_stored(rollouts: DataFrame) -> bool:
    return set(STORED_COLUMNS) <= set(rollouts.columns)


def read_labels(stored: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """The columns of ``parse_completions`` from stored answers, those that
    ``categories`` do not read as nulls (and their fields not read)."""
    wanted = {f for c, f in CATEGORY_FIELD.items() if categories is None or c in categories}
    df = stored.withColumns({f"_v_{f}": F.variant_get("answer", f"$.{f}", "variant") if f in wanted else F.lit(None).cast("variant")
                             for f in FIELD_KEYS})
    df = df.withColumns({f"_s_{f}": C.as_text(F.col(f"_v_{f}")) for f in FIELD_KEYS}
                        | {f"_t_{f}": variant_type(F.col(f"_v_{f}")) for f in ("missing", "fens")})
    is_object = F.col("json_state") == "object"

    def stripped(f):
        return F.coalesce(py_strip(F.col(f"_s_{f}")), F.lit(""))

    def items(rule, f):
        return rule(is_object, F.col(f"_s_{f}"), F.col(f"_t_{f}"), F.col(f"_v_{f}"))

    labels = {
        "move": F.coalesce(py_strip(F.col("_s_move")), F.col("text_move")),
        "advantage": F.lower(F.when(is_object, stripped("advantage")).otherwise(F.col("text_advantage"))),
        "score": F.when(is_object, py_strip(F.lower(stripped("score")))).otherwise(F.col("text_score")),
        "missing": items(C.missing_items, "missing"), "fens": items(C.fen_items, "fens"),
    }
    df = df.withColumns({f"pred_{f}": c if f in wanted else F.lit(None).cast("array<string>" if f in ("missing", "fens") else "string")
                         for f, c in labels.items()})
    keep = [c for c in stored.columns if c not in STORED_COLUMNS and c not in PARSED_COLUMNS]
    return df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in keep], *PARSED_COLUMNS)
