"""From raw documents to packed sequences, in stages that are each written as Parquet and read again.

All stages but the last return the columns of documents, whatever their names; empty tables give empty ones; nulls, ties and
repeated rows are named at each stage.
"""

from __future__ import annotations

import public_tokenizers

from obsmat.llm import line_quality, mixing, packing, simhash, suffix_buckets
from obsmat.llm.common import read, table


def quality_rules(spark, docs, sf_dir):
    """Without the lines that many documents of a host share; documents that fail the base rules or are depleted go, null and
    empty texts with them. Null sources are one host; repeated rows count once and are kept or rejected alike."""
    return line_quality.clean(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies (five-word shingles, Jaccard of 0.8 or more): of the smallest doc_id, null last,
    then of the smallest text hash. Of repeated rows one stays. Candidates are the neighbours that op8's search finds and texts that share a key."""
    return simhash.first_of_each(docs)


def repeats(spark, docs, sf_dir):
    """Without the bytes of 200-byte strings that stand elsewhere too, each occurrence included: near copies are gone by now, so
    such a passage is quoted or planted text that belongs to none of its documents. Rows without a word left go."""
    return suffix_buckets.without_repeats(docs, drop_emptied=True)


def mix(spark, docs, sf_dir):
    """Each document as often as the mix of sources takes it; documents that it doesn't take go. Null sources are one source, the
    last. Rows with one doc_id, text and source share their copies."""
    return mixing.mixed(docs)


def pack(spark, docs, sf_dir):
    """The pieces of documents in sequences. Null texts are an end alone; repeated rows are documents of their own."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("repeats", repeats), ("mix", mix), ("pack", pack)]

#: Hash functions, seeded choice and the tokenizer have no SQL form; tests hold each stage against brute force on small tables.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the table documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
