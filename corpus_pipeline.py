"""A corpus pipeline of five stages over ``documents``, each by one corpus operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's documents. All but the last keep
the columns of ``documents``:

1. quality: documents that the quality classifier rejects go,
2. near_duplicates: SimHash fingerprints within 2 bits, and MinHash bands for
   texts whose fingerprints lie further apart, each pair confirmed on the texts' own
   shingles: of each group of near copies (five-word shingles, Jaccard similarity 0.8
   or more) one document stays,
3. decontamination: documents that share a window with the benchmark go,
4. mixing: documents stay as often as the mix to target weights takes them,
5. tokens: the ids of what is left, written in binary form and read back.

Null texts count as empty ones: they have a quality score, are near copies of
one another, share no window, and are never taken by the mix. Texts of any
length are read whole. Ties between near copies go to the smallest doc_id.
Repeated rows are copies, of which one stays. A stage over an empty table gives
an empty table; columns of any name stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candlewick.llm import decontamination, mixing, quality, simhash, tokens
from candlewick.llm.common import pin, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.learn(pin(quality.statistics(docs), "statistics"), table(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_copy(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.write_and_check(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]

#: Classifiers, fingerprint components and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
