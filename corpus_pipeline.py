"""The corpus pipeline: documents are filtered, deduplicated, decontaminated and encoded.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of documents. A stage writes what
it decides, a narrow table, and gives its input's rows without the rejected ones; so each stage's texts are written once, by
who calls it. Written to the shared folder and read again, a lost executor costs at most one stage's work. What a stage wrote on its
way is deleted at its end, but for what its result reads.

Defined cases: stages drop rows and not ids: rows are told apart by id, or by a number where ids are null, negative or repeat. So an id's other texts stay if it
repeats, one of rows that repeat id and text stays, and rows without an id are deduplicated like others (of copies one with an id
stays, if there is one). Null texts and texts without a letter go in the first stage. Further columns of documents are carried
through, whatever their names. An empty table passes through empty.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.bpe_codec import encode_documents
from tidewater.llm.decontaminate import drop_contaminated
from tidewater.llm.exact_dedup import exact_dedup
from tidewater.llm.language_id import fit, identify
from tidewater.llm.ngram_join import similar_components
from tidewater.llm.queries import code_digests, table, vocabulary
from tidewater.llm.shared import delete_tables, drop_rows, free_name, materialise, noting, row_ids, sized

def stage(function):
    """A stage deletes what it wrote on its way and its result doesn't read."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own: list[str] = []
        with noting(own):
            out = function(spark, docs, sf_dir)
        delete_tables(own, out)
        return out

    return run_stage


@stage
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected are documents in no language: null texts and texts without a letter."""
    name = free_name(docs, "row")
    rows = row_ids(docs, "doc_id", name)
    found = identify(rows, fit(docs), id_col=name)
    return drop_rows(rows, materialise(found.where("lang_pred = 'und'").select(F.col("doc_id").alias(name)), "dropped"), name)


@stage
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    name = free_name(docs, "row")
    rows = row_ids(docs, "doc_id", name)
    found = exact_dedup(rows.select(F.struct(F.col("doc_id").alias("id"), F.col(name).alias("row")).alias("doc_id"), "text"))
    return drop_rows(rows, materialise(found.where("NOT kept").select(F.col("doc_id.row").alias(name)), "dropped"), name)


@stage
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the row with the smallest id stays."""
    name = free_name(docs, "row")
    rows = row_ids(docs, "doc_id", name)
    found = materialise(similar_components(rows, id_col=name).select(F.col("doc_id").alias("row"), F.col("component_id").alias("c")), "components")
    several = materialise(found.where("c <> row").select("c").distinct(), "several")
    members = found.join(sized(several), "c", "left_semi").join(rows.select(F.col(name).alias("row"), F.col("doc_id").alias("id")), "row")
    members = materialise(members, "members")
    best = members.groupBy("c").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("best"))
    dropped = members.join(best, "c").where("row <> best").select(F.col("row").alias(name))
    return drop_rows(rows, materialise(dropped, "dropped"), name)


@stage
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@stage
def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, decoded again: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return code_digests(encode_documents(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), decode=True))


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level BPE", encode_stage),
]

#: SQL can't express the stages that learn, tile or encode; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written; a stage's rows are deleted when the next one's are written."""
    docs, written = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        with noting(written):
            docs = materialise(stage(spark, docs, sf_dir), f"stage{k}")
        delete_tables(written, docs)
    return docs
