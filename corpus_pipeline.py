"""A corpus pipeline over `documents`: toxic rows go, one of each group of near copies stays, contaminated rows go,
sources are mixed to their weights, and what is left is written as token ids.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame: all
but the last with the columns of `docs`. A stage's result is written before the next one begins; so each stage first
drops what earlier stages left in shared storage, unless its own `docs` still reads it.

Nulls in any column, empty and very long texts, repeated rows and ids, and further columns pass through every stage
as the operators' docstrings say; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import decontaminate, mixing, nearcopies, tokens, toxicity
from gristmill.llm.common import drop, named, shared_dir, stored, table

#: What the stages of the pipelines over a folder have named in shared storage and not dropped.
_left: dict[str, list[tuple[Callable, str]]] = {}


def tidy(stage: Callable) -> Callable:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _left.setdefault(sf_dir, [])
        read = docs.inputFiles() if left else []
        done = [folder for owner, folder in left if owner is not stage and not any(f"{folder.rpartition('/')[2]}/" in file for file in read)]
        drop(spark, *done)
        before = named()
        out = stage(spark, docs, sf_dir)
        _left[sf_dir] = [x for x in left if x[1] not in done] + [(stage, folder) for folder in named() if folder not in before]
        return out

    return run


@tidy
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, trained on the labelled rows of `docs`, scores below one half."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


@tidy
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id; rows without words, and rows whose group has no id,
    all stay. Of rows that repeat that id in the group, the one whose text has the least digest stays."""
    return nearcopies.representatives(docs)


@tidy
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any benchmark window."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@tidy
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often (0 to 3 times) as the mix's passes over their source begin with them."""
    return mixing.mixed_rows(docs)


@tidy
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the shards and reads them back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    return tokens.report(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_ids", write_tokens),
]

#: The classifier and the hash orders of the mix are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        docs = stored(stage(spark, docs, sf_dir), name, path)
        drop(spark, *before)  # the stage's result is written: its input is no longer read
        before = [path]
    out = STAGES[-1][1](spark, docs, sf_dir)
    drop(spark, *before)  # the shards are written, and `out` reads them
    return out
