"""A corpus pipeline out of the corpus operators.

Five stages run one after the other, each on all rows that its predecessor kept and
written as Parquet before the next one reads them: language identification,
near-duplicate removal, benchmark decontamination, mixing of sources and token
output. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from caseloom.llm import decontamination, jaccard_join, language_id, mixing, token_output
from caseloom.llm.shared import materialize, table

#: Documents whose language scores lower are rejected, as are those without a letter.
LEAST_LANGUAGE_SCORE = 0.2
#: Words of a shingle and the similarity (hundredths) of near duplicates.
NEAR_WORDS, NEAR_SIMILARITY = 5, 80


def identify_language(spark, docs, sf_dir):
    """Rows that are in a known language: null, letterless and unclear texts go."""
    return language_id.accepted(docs, language_id.learn(docs), LEAST_LANGUAGE_SCORE)


def drop_near_duplicates(spark, docs, sf_dir):
    """One row of each group of documents that similarity links: its least doc_id's.

    Texts without a word link with nothing and stay; of several rows with the kept
    doc_id one stays; rows with a null doc_id stay.
    """
    return jaccard_join.keep_one(docs, NEAR_WORDS, NEAR_SIMILARITY, 100)


def remove_leaks(spark, docs, sf_dir):
    """Rows in which no benchmark item was found."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_to_targets(spark, docs, sf_dir):
    """Rows as the mix takes them: whole copies, then the part up to a source's budget."""
    return mixing.mix_documents(docs)


def write_token_ids(spark, docs, sf_dir):
    """doc_id, start, n_tokens and ids_crc32 as read back from the encoded files."""
    return token_output.encoded(docs, token_output.tokenizer_path())


STAGES: list = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", remove_leaks),
    ("mixing", mix_to_targets),
    ("token_output", write_token_ids),
]
#: The classifier's and the fingerprints' rows are beyond SQL. Tests hold the operators of stages two to five against brute force and
#: language identification against held-out labels, and run the stages in place.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
