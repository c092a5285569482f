"""Fill-in-middle transformation: documents cut into prefix, middle and suffix
at unit borders and written in the order a model trains on.

A unit is a run of blanks with the word after it, or the blanks that end the
text. Per Arrow batch everything is a pyarrow.compute pipeline: a byte that no
UTF-8 text holds is set between a word and the blank behind it and split on,
the unit lists are flattened with their parent rows, each unit gets its ordinal
in its row, and the units of one role (before, between or after the two cuts)
are filtered out, made into lists again and joined. The cuts and the form of a
row come from a digest of its id, so they do not depend on the file layout or
on the number of tasks. Nothing is shuffled.

Defined cases: a null text is an empty text, form ``plain``, no units. A text
with one of the three markers in it stays ``plain``, so that every output can
be taken apart again (``restored``). A null id is digested as empty text.
Repeated rows give repeated, equal rows. Input columns stay, but for the text
and for those named as one of the new columns, which are replaced. A very
long text is worked on alone, whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rollout_tables.llm.common import arrow_map, chunks, named, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
FIM_PERCENT = 50
SPM_PERCENT = 80

BLANK = rb"\x20\x09-\x0D"
BORDER = rb"([^" + BLANK + rb"])([" + BLANK + rb"])"
#: no UTF-8 text holds this byte
CUT = b"\xff"

ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]
ADDED_SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


def _modulo(values: pa.Array, by) -> pa.Array:
    return pc.subtract(values, pc.multiply(pc.divide(values, by), by))


def _pieces(units: pa.Array, low: pa.Array, high: pa.Array) -> list[pa.Array]:
    """The units before ``low``, up to ``high`` and from ``high`` on, joined."""
    sizes = pc.list_value_length(units).cast(pa.int64())
    flat, parents = pc.list_flatten(units), pc.list_parent_indices(units)
    begins = pc.subtract(pc.cumulative_sum(sizes), sizes)
    ordinals = pc.subtract(pa.array(np.arange(len(flat))), pc.take(begins, parents))
    before = pc.less(ordinals, pc.take(low, parents))
    behind = pc.greater_equal(ordinals, pc.take(high, parents))
    roles = [(before, low), (pc.invert(pc.or_(before, behind)), pc.subtract(high, low)), (behind, pc.subtract(sizes, high))]
    out = []
    for mask, counts in roles:
        offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(counts)]).cast(pa.int32())
        out.append(pc.binary_join(pa.ListArray.from_arrays(offsets, pc.filter(flat, mask)), pa.scalar(b"", flat.type)))
    return out


def fim_arrays(text: pa.Array, h: list[pa.Array], fim_percent: int, spm_percent: int) -> list[pa.Array]:
    """The added columns for one array of texts and its four digest numbers."""
    text = text.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    units = pc.split_pattern(pc.replace_substring_regex(text, BORDER, b"\\1" + CUT + b"\\2"), CUT)
    empty = pc.equal(pc.binary_length(text), 0)
    n = pc.if_else(empty, 0, pc.list_value_length(units)).cast(pa.int64())
    cuts = [_modulo(x, pc.add(n, 1)) for x in h[:2]]
    prefix, middle, suffix = _pieces(units, pc.min_element_wise(*cuts), pc.max_element_wise(*cuts))

    def joined(*parts):
        parts = [pa.scalar(p.encode(), text.type) if isinstance(p, str) else p for p in parts]
        return pc.binary_join_element_wise(*parts, pa.scalar(b"", text.type))

    plain = pc.or_(pc.or_(empty, pc.match_substring_regex(text, "<[PSM]>")), pc.greater_equal(_modulo(h[2], 100), fim_percent))
    spm = pc.less(_modulo(h[3], 100), spm_percent)
    choice = pc.make_struct(plain, spm, field_names=["plain", "spm"])
    output = pc.case_when(choice, text, joined(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle),
                          joined(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    form = pc.case_when(choice, "plain", "spm", "psm")

    def chars(piece):
        return pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(piece.view(pa.large_string())).cast(pa.int64()))

    return [n, form, chars(prefix), chars(middle), output.view(pa.large_string())]


def fill_in_middle(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = SEED,
                   fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """The documents with ``n`` (units), ``form`` (``plain``, ``spm`` or
    ``psm``), the code points of prefix and middle (null where plain) and
    ``output``, the text to train on, in place of the text."""
    kept = [c for c in docs.columns if c != text_column and c not in ADDED]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary"), 256)
    numbers = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    row = F.struct(*[named(c) for c in kept] or [F.lit(0)]).alias("row")
    source = docs.select(row, F.col(text_column).cast("string").alias("text"), *numbers)
    schema = StructType([source.schema["row"], *StructType.fromDDL(ADDED_SCHEMA).fields])

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                h = [part.column(f"h{i}") for i in range(1, 5)]
                arrays = fim_arrays(part.column("text"), h, fim_percent, spm_percent)
                arrays = [a.cast(pa.string()) if pa.types.is_large_string(a.type) else a for a in arrays]
                yield pa.RecordBatch.from_arrays([part.column("row"), *arrays], names=["row", *ADDED])

    out = arrow_map(source, run, schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], *ADDED)


def restored(output: Column, form: Column) -> Column:
    """The exact text, rebuilt from an output and its form: no marker occurs
    in a piece, so each is found by splitting at the markers."""
    def between(left, right):
        rest = F.split_part(output, F.lit(left), F.lit(2))
        return F.split_part(rest, F.lit(right), F.lit(1)) if right else rest

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = [F.sha2(c.cast("binary"), 256).alias(name) for c, name in
           ((F.col("output"), "output_sha256"), (restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *sha)
