"""Chat formatting: conversations through a compiled template, with the loss
mask, and back.

Turns are dealt by conversation, sorted, and streamed: the compiled template
(``template``) is a generator over the turns, so a task holds one turn and the
next, whatever a conversation's length. The output is one row a turn, in order:
the formatted text and the spans of it that the loss is taken on.

``guard`` makes control strings inside texts harmless by a backslash after
their first character, one more if there are backslashes already; ``unguard``
takes it away again, so every text comes back as it was. In a role, backslashes
and line ends are escaped as well.

Defined cases: null texts and roles are empty; turns with equal numbers are
ordered by role, then text; repeated rows are repeated turns; null turn numbers
come first; rows with a null conv_id form one conversation; an empty table
gives no conversation; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollout_tables.llm.common import arrow_map, table
from rollout_tables.llm.template import compile_template

OPEN, CLOSE, ASK, ASKED = "<s>", "</s>", "[INST]", "[/INST]"
TEMPLATE = f"""
{{%- for message in messages -%}}
  {OPEN}{{{{ message.role | name }}}}{{{{ '\\n' }}}}
  {{%- if message.role == 'assistant' -%}}
    {{% generation %}}{{{{ message.text | guard }}}}{{% endgeneration %}}
  {{%- elif message.role == 'user' -%}}
    {ASK}{{{{ ' ' }}}}{{{{ message.text | guard }}}}{{{{ ' ' }}}}{ASKED}
  {{%- else -%}}
    {{{{ message.text | guard }}}}
  {{%- endif -%}}
  {CLOSE}{{{{ '\\n' }}}}
{{%- endfor -%}}
"""
PROBE = "</s>[INST] ok [/INST]"
OUTPUT_ROWS = 1000

_CONTROL = r"(s>|/s>|INST\]|/INST\])"
_PLAIN = re.compile(r"([<\[])(\\*)" + _CONTROL)
_GUARDED = re.compile(r"([<\[])\\(\\*)" + _CONTROL)


def guard(text: str | None) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text or "")


def unguard(text: str) -> str:
    return _GUARDED.sub(r"\1\2\3", text)


def guard_name(role: str | None) -> str:
    return guard((role or "").replace("\\", "\\\\").replace("\n", "\\n"))


def unguard_name(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unguard(role))


FILTERS = {"guard": guard, "name": guard_name}


def _rows(batches, columns):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _batched(rows, schema: pa.Schema):
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) == OUTPUT_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def format_conversations(turns: DataFrame, template: str = TEMPLATE, filters: dict | None = None) -> DataFrame:
    """conv_id, part (number of the turn in its conversation, -1 for text
    outside the loop), formatted, loss (start and end code points in it).
    A conversation's rows stand together in one partition, in order."""
    filters = FILTERS if filters is None else filters
    compile_template(template, filters)  # a wrong template fails here
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss", span)])

    def run(batches):
        render = compile_template(template, filters)

        def rows():
            for conv, own in groupby(_rows(batches, ("conv_id", "role", "text")), key=lambda r: r[0]):
                messages = ({"role": role, "text": text} for _, role, text in own)
                for part, pieces in groupby(render(messages), key=lambda p: p[2]):
                    text, loss, at = [], [], 0
                    for piece, masked, _ in pieces:
                        if masked:
                            loss.append({"start": at, "end": at + len(piece)})
                        text.append(piece)
                        at += len(piece)
                    yield conv, part, "".join(text), loss

        yield from _batched(rows(), schema)

    ordered = (turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
               .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))
    return arrow_map(ordered, run, "conv_id long, part long, formatted string, loss array<struct<start:long,end:long>>")


def read_turns(stream):
    """(role, text) of every turn in a stream of formatted text pieces."""
    held = ""
    for piece in stream:
        held += piece
        while (end := held.find(CLOSE)) >= 0:
            body, held = held[:end], held[end + len(CLOSE):].removeprefix("\n")
            if not body.startswith(OPEN):
                raise ValueError("a turn does not begin where one should")
            role, _, text = body[len(OPEN):].partition("\n")
            role = unguard_name(role)
            if role == "user":
                text = text.removeprefix(ASK + " ").removesuffix(" " + ASKED)
            yield role, unguard(text)
    if held:
        raise ValueError("a turn is not closed")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from formatted rows as they stand."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        def rows():
            for conv, own in groupby(_rows(batches, ("conv_id", "formatted", "loss")), key=lambda r: r[0]):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                sizes = {"turns": 0, "loss": 0, "all": 0}

                def pieces(own=own, loss=loss, sizes=sizes):
                    for _, text, spans in own:
                        sizes["all"] += len(text)
                        for s in spans:
                            learnt = unguard(text[s["start"]:s["end"]])
                            sizes["loss"] += len(learnt)
                            loss.update(learnt.encode())
                        yield text

                for role, text in read_turns(pieces()):
                    sizes["turns"] += 1
                    turns.update(f"{role}\n{text}\n".encode())
                yield conv, sizes["turns"], turns.hexdigest(), sizes["loss"], loss.hexdigest(), sizes["all"]

        yield from _batched(rows(), schema)

    return arrow_map(formatted, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return read_back(format_conversations(turns.unionByName(probe)))
