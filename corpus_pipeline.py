"""From raw documents to training shards: five stages, each an operator of quire.llm.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents; the last adds shard and slot. Between
stages run() writes Parquet to the session's shared folder and reads it again, so a lost executor costs no more
than its part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, langid, mixing, sharding, simhash
from quire.llm.common import materialize, small_batches, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null, empty and letterless texts, and those that no learned language explains.

    Repeated rows are judged one by one. Empty table: no rows. Columns of any name are kept as they are.
    """
    small_batches(spark)
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the least doc_id; of repeated rows one.

    Null and wordless texts are copies of each other. A row with a null doc_id stays only where no id is in its group.
    Empty table: no rows. Columns of any name are kept as they are.
    """
    return simhash.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item, or two items that are shorter.

    Null and wordless texts stay. Repeated rows are judged one by one. Empty tables: nothing is dropped. Columns of
    any name are kept as they are.
    """
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples whole documents up to each source's budget of words.

    Null and wordless texts are never taken. A null source is one of its own. Equal rows are taken alike. Empty table:
    no rows. Columns of any name are kept as they are.
    """
    return mixing.take_mixture(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the mixture into 16 shards that all match it; equal texts share one where counts allow it.

    Null texts are empty ones. Equal rows: any order among them. Empty table: no rows. A shard or slot of the input is
    replaced; other columns are kept as they are.
    """
    return sharding.shard_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs


#: Language ID isn't expressible in SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None
