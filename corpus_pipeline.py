"""A training corpus made ready in five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylab.llm.common import bounded, read, stage
from quarrylab.llm.importance import importance_resampling
from quarrylab.llm.near_duplicates import near_duplicates
from quarrylab.llm.packing import pack
from quarrylab.llm.personal_data import redacted
from quarrylab.llm.positional_index import decontamination


def _rows(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of docs whose doc_id and text are (left_semi) or aren't (left_anti) among keys (doc_id, text_hash), with all their columns, whatever their names."""
    key_id, key_hash = _free("key_id", docs), _free("key_hash", docs)
    keys = stage(keys.select(F.col("doc_id").alias(key_id), F.col("text_hash").alias(key_hash)).distinct(), "keys")
    return docs.join(bounded(keys), F.col("doc_id").eqNullSafe(F.col(key_id)) & (F.xxhash64("text") == F.col(key_hash)), how)


def _free(name: str, docs: DataFrame) -> str:
    """A column's name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps.

    Decided by doc_id and text together, so that rows of one doc_id may go different ways; repeated rows go or stay together, and so do equal
    texts of all doc_ids. A null or empty text is judged as one without a feature. Texts are read whole; an empty table stays empty.
    """
    return _rows(docs, importance_resampling(docs, read(spark, sf_dir, "labels")), "left_semi")


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id, once if it is there several times.

    Null, empty and wordless texts are in no group and stay, also where they repeat. A null doc_id is the smallest only of a group without others. Of
    several texts of one group on its smallest doc_id, that of the smallest hash stays. Texts are compared whole; an empty table stays empty.
    """
    kept = stage(near_duplicates(docs).where("kept"), "kept")
    # Rows that share doc_id and component: one text of them stays. Wordless rows are in no group and all stay.
    one = kept.where("component is not null").groupBy("doc_id", "component").agg(F.min("text_hash").alias("text_hash")).select("doc_id", "text_hash")
    left = _rows(docs, one.union(kept.where("component is null").select("doc_id", "text_hash")), "left_semi")
    repeated = stage(kept.where("component is not null").groupBy("doc_id", "text_hash").count().where("count > 1"), "repeated")
    if repeated.isEmpty():
        return left
    return _rows(left, repeated, "left_anti").unionByName(_rows(left, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts have none and stay; so do repeated rows, or go together; rows of one doc_id are told apart by their texts. Texts and
    items are read whole, null items are none; an empty table stays empty.
    """
    return _rows(docs, decontamination(docs, read(spark, sf_dir, "benchmark")).where("contaminated"), "left_anti")


def personal_data_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars counted anew.

    Null texts stay null, texts of any length are read whole, repeated rows stay, and so does every other column.
    """
    return redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, in `op7_packing`'s columns.

    A null or empty text is its end token alone; repeated rows are documents of their own; a long text is cut into as many pieces as it needs;
    other columns are left out; an empty table gives no pieces.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("personal_data", personal_data_redacted),
    ("packing", packed),
]

#: The stages are no SQL; the tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
