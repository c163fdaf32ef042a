"""The corpus pipeline: quality rules, line dedup, near dedup, benchmark decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from draftlake.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules
from draftlake.llm.store import Scratch, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go, and those without a word; see ``quality_rules.keep_good`` for odd rows."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line stays in the first document that has it; a document that loses all its lines goes; see ``line_dedup.first_lines``."""
    return line_dedup.first_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays; see ``near_dedup.one_row_of_each``."""
    return near_dedup.one_row_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go; see ``decontaminate.uncontaminated``."""
    return decontaminate.uncontaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The windows of training, as pieces of documents; see ``packing.packed``."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; what each but the last returns is written, and read as the next one's input.

    Rows: (window_id, window_offset, doc_id, doc_offset, n_tokens), the pieces of what the four filters keep. Defined cases, by
    the stage that decides: null and empty texts and those without a word go with the quality rules; of rows equal in doc_id and
    text one stays (line dedup); rows with a null doc_id are compared like others, after all of them, and are packed with a
    null doc_id; of near copies the row of the least doc_id stays; documents of any length are compared, scanned and packed
    whole; other columns pass through to packing, whatever their names; an empty table gives no rows.
    """
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            before, docs = docs, scratch.write(out)
            if k:
                scratch.drop(before)
    return out


#: SQL can't express the third and the last stage; tests hold them against brute-force versions.
ORACLE_SQL = None
