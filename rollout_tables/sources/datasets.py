"""Reading and writing record tables, and split resolution.

A dataset with named splits is one table with a ``split`` column, written
partitioned by it, so selecting a split is partition pruning.
"""

from __future__ import annotations

import logging
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def read_dataset(spark: SparkSession, path: str, fmt: str = "parquet", train_only: bool = True) -> DataFrame:
    """A1/A2: read a saved table (any Spark source format); when it has a
    ``train`` split, take that part, else the whole."""
    df = spark.read.format(fmt).load(path)
    if train_only and _present(df, ["train"], "split", split_names(df)):
        return df.filter(F.col("split") == "train")
    return df


def split_names(df: DataFrame, split_col: str = "split") -> set[str] | None:
    """The split names of a table as it was read, from the folders of its
    files (``split=<name>``): no Spark job. None if its files do not lie in
    such folders. Not for a frame that was filtered since: its files are still
    those of the whole table."""
    folder = f"{split_col}="
    names = set()
    for path in df.inputFiles():
        found = [x for x in path.split("/")[:-1] if x.startswith(folder)]
        if not found:
            return None
        names.add(unquote(unquote(found[-1][len(folder):])))  # a file's URI over the folder's escapes
    return names - {"__HIVE_DEFAULT_PARTITION__"} or None


def _present(df: DataFrame, names, split_col: str, known: set[str] | None = None) -> set[str]:
    """Which of ``names`` are splits of ``df``: as many rows as names at most
    come back, whatever the number of splits; none if the names are known."""
    names = [n for n in names if n is not None]
    if known is not None:
        return known.intersection(names)
    if split_col not in df.columns or not names:
        return set()
    return {r[0] for r in df.filter(F.col(split_col).isin(*names)).select(split_col).distinct().collect()}


def _has_splits(df: DataFrame, split_col: str, known: set[str] | None = None) -> bool:
    return bool(known) if known is not None else split_col in df.columns and not df.filter(F.col(split_col).isNotNull()).limit(1).isEmpty()


def _pick(df: DataFrame, name: str, split_col: str) -> DataFrame:
    return df.filter(F.col(split_col) == name)


def sft_train_split(df: DataFrame, requested: str, split_col: str = "split", known: set[str] | None = None) -> DataFrame:
    """A3: the requested split, else the whole dataset when it has no
    splits. A requested name that is missing while several splits exist is
    an error here (the original silently trained on all splits). ``known`` are
    the split names, where ``split_names`` has found them."""
    if _present(df, [requested], split_col, known):
        return _pick(df, requested, split_col)
    if not _has_splits(df, split_col, known):
        return df
    raise ValueError(f"split {requested!r} not found")


def rl_train_split(df: DataFrame, requested: str, split_col: str = "split",
                   known: set[str] | None = None) -> tuple[DataFrame, bool]:
    """A4: requested -> ``train`` -> the whole dataset (then there is no
    evaluation split). Returns the frame and whether an evaluation split may
    be looked up."""
    names = _present(df, [requested, "train"], split_col, known)
    for name in (requested, "train"):
        if name in names:
            return _pick(df, name, split_col), True
    if not _has_splits(df, split_col, known):
        return df, False
    raise ValueError(f"split {requested!r} not found")


def val_split(df: DataFrame, requested: str | None, fallbacks: tuple[str, ...] = (),
              split_col: str = "split", known: set[str] | None = None) -> DataFrame | None:
    """A5: the requested validation split, else the first fallback present
    (RL: ``validation``), else None with a warning."""
    names = _present(df, [requested, *fallbacks], split_col, known)
    for name in ((requested,) if requested else ()) + tuple(fallbacks):
        if name in names:
            return _pick(df, name, split_col)
    if requested:
        log.warning("validation split %r not found", requested)
    return None


def write_splits(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> None:
    """One directory per split (``split=<name>``), written in one job."""
    df.write.mode(mode).partitionBy(split_col).parquet(path)
