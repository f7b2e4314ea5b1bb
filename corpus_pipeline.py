"""From raw documents to token files: five stages, each of which works on what the last one kept.

Between stages documents are written as Parquet and read again. The mixing stage stores them in
mixed order, and the token stage writes them in the order in which they are stored.
"""

from __future__ import annotations

from lagweave.llm.common import Scratch, documents
from lagweave.llm.decontamination import decontaminate
from lagweave.llm.language import keep_identified
from lagweave.llm.mixing import in_mixed_order
from lagweave.llm.resemblance import deduplicate
from lagweave.llm.tokens import default_path, in_file_order, output_of


def language(spark, docs, sf_dir):
    """Documents whose language is identified; the others go."""
    return keep_identified(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document, that with the smallest id, of each group that shares 80% of five-word shingles."""
    return deduplicate(docs)


def decontamination(spark, docs, sf_dir):
    """Documents without a word in a benchmark window."""
    return decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def mixing(spark, docs, sf_dir):
    """All documents, stored in the order that mixes sources to their target weights."""
    return in_mixed_order(docs)


def tokens(spark, docs, sf_dir):
    """doc_id, start, n_tokens and ids_crc32 of every document, from token files in stored order."""
    return output_of(in_file_order(docs), default_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]
#: Neither compression sizes nor fingerprints and tokenizers can be had in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    scratch = Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
