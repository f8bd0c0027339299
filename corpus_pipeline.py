"""From raw documents to token ids: stages, each written as Parquet and read again by the next.

Run it where the repository is importable on driver and executors (PYTHONPATH or --py-files). All stages but the last
return the columns of documents, extra ones too, whatever their names; each works on all rows that its predecessor kept.
An empty table gives an empty one. Texts are read whole, however long they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import bpe, mixing, near_copies, pii, simhash, toxicity
from chronoweave.llm.common import plain, small_batches, stored, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that are rather toxic than not go (a score of 0.5 goes). Learns from labelled rows that are not
    held out. Null and empty texts are scored like texts without any sign; repeated rows share their fate."""
    small_batches(spark)
    names = docs.columns
    model = toxicity.learned(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    score = plain("_score", names)
    return toxicity.scored(docs, model, score=score).where(F.col(score) < 0.5).select(*names)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group of near-duplicates (five-word shingles, similarity 0.8 at least) stays, that
    of the least doc_id; of rows that share it the least text hash, of equal rows one. Null, empty and blank texts are one
    group; rows without doc_id come after others."""
    small_batches(spark)
    return simhash.deduplicated(docs, find=near_copies.similar)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: personal data give way to their kind's mark; n_chars follows. Null texts stay null, empty ones empty, and
    repeated rows stay, changed alike. Of overlapping spans the first one's mark stands."""
    small_batches(spark)
    names = docs.columns
    mark, base, spans = (plain(x, names) for x in ("_redacted", "_base", "_spans"))
    found = pii.personal_data(docs, base=base, spans=spans, redacted=mark)
    found = found.withColumn("text", F.when(F.col("text").isNotNull(), F.col(mark)))
    return found.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*names)


def in_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: each document as often as the mix takes it, twice at most. Null sources are one source; texts without words
    come as often as whole passes over their source; of equal rows any may be taken once more."""
    small_batches(spark)
    return mixing.mixed(docs)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: every document, repeated ones too, with its token ids and the text decoded from them; none and "" for null
    and empty texts. Columns named ids or decoded are replaced."""
    small_batches(spark)
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("near-duplicates", without_near_copies),
    ("personal data", without_personal_data),
    ("mix", in_target_weights),
    ("tokens", as_tokens),
]
#: Compression lengths, message passing and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
