"""Parsing of model completions (PARSE job columns, E1-E9).

A completion is free text that may hold a JSON object, possibly inside a
reasoning block. JSON handling follows Python's ``json.loads`` on the text
the original code feeds it (the first innermost ``{...}``, with single quotes
turned into double quotes). ``from_json`` into ``MAP<STRING,VARIANT>`` keeps
every key in order, duplicates included, and keeps each value's JSON type; a
Python dict keeps the first position of a key and its last value, which
the key-lookup stage reproduces.

The columns come in stages (``stage_columns``), each projection reading only
columns of the previous one, so that the parse and every key lookup is
computed once per row: the optimizer does not inline an expensive column into
several consumers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollout_tables.fixed_values import (
    CHARS_PER_TOKEN, JSON_OBJECT_PATTERN, MOVE_KEYS, SCORE_LABELS, THINK_CLOSE, THINK_OPEN, UCI_MOVE_PATTERN,
)
from rollout_tables.functions.text import py_strip, strip_chars, variant_as_py_str, variant_type

# a whole text that Python's json.loads reads as an array or a scalar
NON_OBJECT_JSON = (r"(?s)^[ \t\n\r]*(\[.*\]|\"([^\"\\]|\\.)*\"|-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?"
                   r"|true|false|null|NaN|-?Infinity)[ \t\n\r]*$")


NON_NUMBER = r"^[ \t\n\r]*(NaN|-?Infinity)[ \t\n\r]*$"
SEP = "\u0001"  # joins the lower-cased keys of one object into one string
_ITEM = f"[^{SEP}]*"


def _exactly(word: str) -> str:
    return f"(?:^|{SEP})({word})(?:{SEP}|$)"


def _contains(*words: str) -> str:
    if len(words) == 1:
        return f"(?:^|{SEP})({_ITEM}{words[0]}{_ITEM})"
    a, b = words
    return f"(?:^|{SEP})({_ITEM}(?:{a}{_ITEM}{b}|{b}{_ITEM}{a}){_ITEM})"


# first key (in object order) matching each rule: exact keys by position,
# the others by a regex over the joined keys
EXACT_KEYS = {f"move{i}": k for i, k in enumerate(MOVE_KEYS)}
CONTAINS_WORDS = {"adv": ("advantage", "most"), "score": ("score",), "missing": ("missing", "move"),
                  "fens": ("sorted", "fen")}
KEY_RULES = {name: _exactly(k) for name, k in EXACT_KEYS.items()}
KEY_RULES.update({name: _contains(*words) for name, words in CONTAINS_WORDS.items()})


def repaired(text: Column) -> Column:
    """Single quotes become double quotes before parsing."""
    return F.replace(text, F.lit("'"), F.lit('"'))


def think_tokens(completion: Column) -> Column:
    """Approximate token count of the reasoning block (characters / 4):
    the text between the first ``<|im_start|>assistant\n<think>\n`` and the
    next ``\n</think>`` (what a lazy pattern would capture),
    found with ``locate`` instead of a regex scan."""
    start = F.locate(THINK_OPEN, completion)
    body = start + F.lit(len(THINK_OPEN))
    end = F.call_function("locate", F.lit(THINK_CLOSE), completion, body)
    chars = F.when((start > 0) & (end > 0), end - body).otherwise(F.lit(0))
    return chars / F.lit(CHARS_PER_TOKEN)


def completion_text(c: Column, data_type=None) -> Column:
    """A completion given as chat messages becomes its text."""
    from pyspark.sql.types import ArrayType
    if isinstance(data_type, ArrayType):
        return F.array_join(F.transform(c, lambda m: F.coalesce(m["content"], F.lit(""))), "")
    return F.coalesce(c.cast("string"), F.lit(""))


def without_think(c: Column) -> Column:
    """Q9 option: the text without its (first, closed) reasoning block, so
    that braces in it do not hide the answer."""
    start = F.locate(THINK_OPEN, c)
    end = F.call_function("locate", F.lit(THINK_CLOSE), c, start + F.lit(len(THINK_OPEN)))
    return F.when((start > 0) & (end > 0), F.concat(F.substring(c, F.lit(1), start - 1),
                                                    F.substring(c, end + F.lit(len(THINK_CLOSE)), F.length(c)))).otherwise(c)


def found_object(c: Column) -> Column:
    """The first innermost ``{...}``, '' if there is none."""
    # no '{' at all: no object to find (skip the regex scan)
    return F.when(c.contains("{"), F.regexp_extract(c, JSON_OBJECT_PATTERN, 0)).otherwise(F.lit(""))


def is_non_object(c: Column, no_braces: Column) -> Column:
    """Whether the whole text is a JSON array or scalar."""
    whole = repaired(c)
    # as the only item of an array a value can have nothing after it
    alone = F.size(F.from_json(F.concat(F.lit("["), whole, F.lit("]")), "ARRAY<VARIANT>")) == 1
    return no_braces & whole.rlike(NON_OBJECT_JSON) & (whole.rlike(NON_NUMBER) | F.coalesce(alone, F.lit(False)))


def object_stages(found: Column, non_object: Column) -> list[dict[str, Column]]:
    """E2, the parse state and the keys of the object, as projections."""
    return [
        # without a {...} pair the text cannot decode to an object: parse only the found object
        {"_obj": F.when(found != "", F.from_json(repaired(found), "MAP<STRING,VARIANT>"))},
        {"json_state": F.when(F.col("_obj").isNotNull(), F.lit("object"))
         .when(non_object, F.lit("non_object")).otherwise(F.lit("text")),
         "_keys": F.map_keys("_obj"),
         "_dups": F.when(F.size("_obj") > 1, F.size(F.array_distinct(F.map_keys("_obj"))) < F.size("_obj"))
         .otherwise(F.lit(False))},
        {"_lkeys": F.split(F.lower(F.array_join("_keys", SEP)), SEP, -1)},
    ]


def key_place(name: str) -> Column:
    """Place (from 1) of the first key that matches a rule, else null. One key
    search per rule, without higher-order functions: a regex over the joined
    lower-cased keys finds the first key matching the rule, array_position
    gives its place and so the original key."""
    if name in EXACT_KEYS:  # exact key: its first position directly
        return F.nullif(F.array_position("_lkeys", EXACT_KEYS[name]), F.lit(0))
    joined = F.array_join("_lkeys", SEP)
    guard = None  # cheap substring guard, then the regex
    for w in CONTAINS_WORDS[name]:
        g = joined.contains(w)
        guard = g if guard is None else guard & g
    hit = F.when(guard, F.regexp_extract(joined, KEY_RULES[name], 1)).otherwise(F.lit(""))
    return F.when(hit != "", F.array_position("_lkeys", hit))


def value_at(place: Column) -> Column:
    """The value of the key at a place. It is a variant: SQL null when the key
    is absent, a variant null for a JSON null. A repeated key reads its last
    value, as a Python dict does."""
    key = F.get(F.col("_keys"), (place - 1).cast("int"))
    last_of_key = F.try_element_at(F.filter(F.map_entries("_obj"), lambda e: e["key"] == key), F.lit(-1))["value"]
    return F.when(F.col("_dups"), last_of_key).otherwise(F.try_element_at(F.col("_obj"), key))


def as_text(v: Column) -> Column:
    return F.when(v.isNotNull(), F.coalesce(variant_as_py_str(v), F.lit("None")))


def _parse_stage_columns(c: str) -> list[dict[str, Column]]:
    """E1 + E2, the parse state, the key lookups and the value conversions,
    as successive projections (each only reads columns of the previous one)."""
    s1 = {"_found": found_object(F.col(c))}
    s1b = {"_no_braces": F.col("_found") == ""}
    objects = object_stages(F.col("_found"), is_non_object(F.col(c), F.col("_no_braces")))
    s5 = {f"_v_{name}": value_at(key_place(name)) for name in KEY_RULES}
    s6 = {f"_s_{name}": as_text(F.col(f"_v_{name}")) for name in KEY_RULES}
    for name in ("missing", "fens"):
        s6[f"_t_{name}"] = variant_type(F.col(f"_v_{name}"))
    s7 = {
        "pred_move": move_column(F.col(c)),
        "pred_advantage": advantage_column(F.col(c)),
        "pred_score": score_column(F.col(c)),
        "pred_missing": missing_column(),
        "pred_fens": fens_column(),
        "think_tokens": think_tokens(F.col(c)),
    }
    return [s1, s1b, *objects, s5, s6, s7]


# which key a category's rule reads, the first present one of several
CATEGORY_KEYS = {
    "FIND_NEXT_BEST_MOVE": list(EXACT_KEYS), "FIND_LAST_MOVE": list(EXACT_KEYS), "FIND_ADVANTAGED_PLAYER": ["adv"],
    "FIND_FINAL_SCORE": ["score"], "MLM_ON_MOVES": ["missing"], "SORT_FENS": ["fens"],
}
SCAN_COLUMNS = ["pred_object", "json_state", "pred_text_move", "pred_text_advantage", "pred_text_score", "think_tokens"]


def _scan_stage_columns(c: str) -> list[dict[str, Column]]:
    """What the scan keeps of a completion, before its category is known: the
    found object as a map and, only where a rule may fall back on it, what the
    whole text says; all short. A score label matters only if it is a known
    one."""
    text, no_object = F.col(c), F.col("_obj").isNull()
    stripped = py_strip(F.lower(text_score(text)))
    maybe, move_key = None, None
    for name in SCORE_LABELS:
        maybe = text.contains(name) if maybe is None else maybe | text.contains(name)
    for name in MOVE_KEYS:
        has = F.array_contains("_lkeys", name)
        move_key = has if move_key is None else move_key | has
    return [{"_found": found_object(text)}, {"_no_braces": F.col("_found") == ""},
            *object_stages(F.col("_found"), is_non_object(text, F.col("_no_braces"))),
            {"pred_object": F.col("_obj"),
             "pred_text_move": F.when(no_object | ~move_key, text_move(text)),
             "pred_text_advantage": F.when(no_object, text_advantage(text)),
             "pred_text_score": F.when(no_object & maybe, F.when(stripped.isin(*SCORE_LABELS), stripped)),
             "think_tokens": think_tokens(text)}]


def _label_stage_columns(categories: list[str]) -> list[dict[str, Column]]:
    """The labels that the rule of the row's ``category`` reads, from the kept
    columns of the scan: one key search and one value a row. Labels of other
    rules are null."""
    category = F.col("category")

    def of(*names):
        return category.isin([c for c in names if c in categories])

    place = None
    for name, keys in CATEGORY_KEYS.items():
        if name in categories:
            at = F.coalesce(*[key_place(k) for k in keys])
            place = F.when(category == name, at) if place is None else place.when(category == name, at)
    stages = [{"_obj": F.col("pred_object")}, *object_stages(F.lit(""), F.lit(False))[1:],
              {"_place": F.lit(None).cast("long") if place is None else place}, {"_v": value_at(F.col("_place"))},
              {"_s": as_text(F.col("_v")), "_t": variant_type(F.col("_v"))}]
    del stages[1]["json_state"]
    is_object, s, t, v = F.col("_obj").isNotNull(), F.col("_s"), F.col("_t"), F.col("_v")
    by_key = F.coalesce(py_strip(s), F.lit(""))
    score = py_strip(F.lower(F.when(is_object, by_key).otherwise(F.coalesce(F.col("pred_text_score"), F.lit("")))))
    labels = {
        "pred_move": F.when(of("FIND_NEXT_BEST_MOVE", "FIND_LAST_MOVE"),
                            F.coalesce(F.when(is_object, py_strip(s)), F.col("pred_text_move"))),
        "pred_advantage": F.when(of("FIND_ADVANTAGED_PLAYER"), F.lower(F.when(is_object, by_key).otherwise(F.col("pred_text_advantage")))),
        "pred_score": F.when(of("FIND_FINAL_SCORE"), score),
        "pred_missing": F.when(of("MLM_ON_MOVES"), missing_items(is_object, s, t, v)),
        "pred_fens": F.when(of("SORT_FENS"), fen_items(is_object, s, t, v)),
    }
    return [*stages, labels]


_STAGE_CACHE: dict[tuple, list[dict[str, Column]]] = {}


def _kept(build, *args):
    """Columns built once per Spark context and arguments (a Column is an
    unresolved expression and can be reused by any frame; building it costs
    thousands of calls into the JVM)."""
    from pyspark import SparkContext
    sc = SparkContext._active_spark_context
    key = (id(sc), sc.applicationId if sc else None, build.__name__, repr(args))
    if key not in _STAGE_CACHE:
        _STAGE_CACHE[key] = build(*args)
    return _STAGE_CACHE[key]


def stage_columns(c: str) -> list[dict[str, Column]]:
    """The parse columns."""
    return _kept(_parse_stage_columns, c)


def text_move(c: Column) -> Column:
    """The first UCI-shaped move anywhere in a text, else ''."""
    return F.regexp_extract(c, UCI_MOVE_PATTERN, 0)


def text_advantage(c: Column) -> Column:
    lc = F.lower(c)
    w, b = lc.contains("white"), lc.contains("black")
    return (F.when(w & ~b, F.lit("white")).when(b & ~w, F.lit("black"))
            .when(lc.contains("draw"), F.lit("draw"))
            .otherwise(F.regexp_extract(lc, "white|black|draw", 0)))


def text_score(c: Column) -> Column:
    return py_strip(strip_chars(strip_chars(py_strip(c), '"'), "'"))


def move_column(c: Column) -> Column:
    """Move by key (priority order, case-insensitive exact key), else the
    first UCI-shaped move anywhere in the text, else ''."""
    by_key = F.coalesce(*[F.col(f"_s_move{i}") for i in range(len(MOVE_KEYS))])
    return F.coalesce(F.when(F.col("_obj").isNotNull(), py_strip(by_key)), text_move(c))


def advantage_column(c: Column) -> Column:
    """Lower-cased advantage label; from the text when it is no JSON."""
    by_key = F.coalesce(py_strip(F.col("_s_adv")), F.lit(""))
    return F.lower(F.when(F.col("_obj").isNotNull(), by_key).otherwise(text_advantage(c)))


def score_column(c: Column) -> Column:
    """E5: lower-cased, stripped score label; the stripped text when it is no JSON."""
    by_key = F.coalesce(py_strip(F.col("_s_score")), F.lit(""))
    return py_strip(F.lower(F.when(F.col("_obj").isNotNull(), by_key).otherwise(text_score(c))))


def missing_items(is_object: Column, s: Column, t: Column, v: Column) -> Column:
    """Predicted missing moves from a value, its text and its type; null
    when it cannot be read (the rule then scores -1.0). A JSON list keeps '?',
    a string drops it."""
    items = F.try_variant_get(v, "$", "array<string>")
    as_list = F.when(~F.exists(items, lambda m: m.isNull()),  # a null item cannot be read
                     F.transform(F.filter(items, lambda m: py_strip(m) != ""), lambda m: strip_chars(py_strip(m), "[]\"'")))
    text = F.coalesce(s, F.lit(""))
    parts = F.split(F.replace(F.replace(text, F.lit("["), F.lit("")), F.lit("]"), F.lit("")), ",", -1)
    from_text = F.filter(F.transform(parts, lambda p: strip_chars(py_strip(p), "\"'")),
                         lambda p: (p != "") & (p != "?"))
    return (F.when(~is_object, F.lit(None))
            .when(v.isNull(), F.array().cast("array<string>"))
            .when(t == "STRING", from_text)
            .when(t == "ARRAY<STRING>", as_list))


def missing_column() -> Column:
    return missing_items(F.col("_obj").isNotNull(), F.col("_s_missing"), F.col("_t_missing"), F.col("_v_missing"))


def fen_items(is_object: Column, s: Column, t: Column, v: Column) -> Column:
    """Predicted FEN order; null when the value is neither text nor a list."""
    text = F.coalesce(s, F.lit(""))
    from_text = F.transform(F.filter(F.split(strip_chars(text, "[]"), ",", -1), lambda f: py_strip(f) != ""),
                            lambda f: strip_chars(py_strip(f), "\"'"))
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"),
                        lambda e: F.coalesce(variant_as_py_str(e), F.lit("None")))
    as_list = F.transform(F.filter(items, lambda f: py_strip(f) != ""), lambda f: strip_chars(f, "\"'"))
    return (F.when(~is_object, F.lit(None))
            .when(v.isNull(), F.array().cast("array<string>"))
            .when(t == "STRING", from_text)
            .when(t.startswith("ARRAY"), as_list))


def fens_column() -> Column:
    return fen_items(F.col("_obj").isNotNull(), F.col("_s_fens"), F.col("_t_fens"), F.col("_v_fens"))


def parse(df: DataFrame, c: str) -> DataFrame:
    """All PARSE columns for the text column ``c``; helper columns are dropped."""
    out = df
    for stage in stage_columns(c):
        out = out.withColumns(stage)
    helpers = [x for x in out.columns if x.startswith(("_v_", "_s_", "_t_"))] + [
        "_obj", "_found", "_no_braces", "_keys", "_dups", "_lkeys"]
    return out.drop(*helpers)


def scan(df: DataFrame, c: str) -> DataFrame:
    """``SCAN_COLUMNS`` for the text column ``c``."""
    for stage in _kept(_scan_stage_columns, c):
        df = df.withColumns(stage)
    return df.drop("_found", "_no_braces", "_obj", "_keys", "_dups", "_lkeys")


def label(df: DataFrame, categories: list[str]) -> DataFrame:
    """The labels of each row's own category from the ``SCAN_COLUMNS``, of
    which ``json_state`` and ``think_tokens`` stay."""
    for stage in _kept(_label_stage_columns, categories):
        df = df.withColumns(stage)
    return df.drop(*[x for x in SCAN_COLUMNS if x.startswith("pred_")], "_obj", "_keys", "_dups", "_lkeys", "_place", "_v", "_s", "_t")
