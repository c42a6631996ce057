"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes all rows that its predecessor kept, with all their columns, whatever their names, and returns the
same columns but for the last. Null texts count as empty; quality rules reject them with other texts of too few words.
Rows of a repeated id are judged one by one, rows without an id like others (they sort first in line dedup, last in
near-dedup). Equal rows stay or go together. Empty tables give empty results of the same columns.
"""

from __future__ import annotations

from pointloom.llm.common import stage, table
from pointloom.llm.decontaminate import remove_documents
from pointloom.llm.line_dedup import remove_lines
from pointloom.llm.pieces import encoded
from pointloom.llm.quality import keep_good
from pointloom.llm.simhash import keep_one


def quality_rules(spark, docs, sf_dir):
    """Documents that any rule rejects go; the text alone decides. See :func:`pointloom.llm.quality.keep_good`."""
    return keep_good(docs)


def line_dedup(spark, docs, sf_dir):
    """Lines equal or similar to an earlier one go; every document stays, if with an empty text. Null texts stay null.
    See :func:`pointloom.llm.line_dedup.remove_lines`."""
    return remove_lines(docs)


def simhash_near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies stays, the first by id: the operator's fingerprints within two bits link,
    and near copies beyond that by their shingles. Wordless and null texts are copies of each other. See :func:`pointloom.llm.simhash.keep_one`."""
    return keep_one(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents that hold benchmark passages go; those without words stay, as do all if the benchmark is empty. See
    :func:`pointloom.llm.decontaminate.remove_documents`."""
    return remove_documents(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark, docs, sf_dir):
    """Token ids of every row that is left; empty and null texts have none. See :func:`pointloom.llm.pieces.encoded`."""
    return encoded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]
#: Near-duplicates and segmentation have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over the whole ``documents``: see above for nulls, repeats and empty tables."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
