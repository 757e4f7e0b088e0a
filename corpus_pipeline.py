"""From raw documents to token ids: language ID, exact dedup, near dedup, source mixing, BPE round trip.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; each result is written as Parquet in
the shared checkpoint folder and reread as the next one's docs. All but the last return the columns of ``documents``.

Defined cases: rows are known by their place in their file, so null and repeated ids and repeated rows are rows of their own in
every stage; null, empty and blank texts go in the first stage; a null lang is not learned from, and a null source is a source of its own;
texts of any length are read whole; other columns of any name are carried along, but for the last stage, which returns what
it counts; an empty table goes through all stages and gives an empty result.
"""

from __future__ import annotations

from segmentry.llm.bpe import round_trips
from segmentry.llm.common import read, stored
from segmentry.llm.exact_dedup import drop_exact_copies
from segmentry.llm.langid import with_language
from segmentry.llm.mixing import mixed_rows
from segmentry.llm.similar_dedup import drop_similar


def language_id(spark, docs, sf_dir):
    """Documents without a letter, or without a language of posterior 0.5 or more, go."""
    return with_language(docs)


def exact_dedup(spark, docs, sf_dir):
    """One row of each group of equal texts stays (the largest doc_id)."""
    return drop_exact_copies(docs, scan_only=True)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies (five-word Jaccard of 0.8 or more) stays (the smallest doc_id); pairs come from
    SimHash fingerprints within two bits, those beyond from MinHash bands, and each is verified."""
    return drop_similar(docs, scan_only=True)


def mix_sources(spark, docs, sf_dir):
    """Each row as often as the mix takes it: not at all, once or twice."""
    return mixed_rows(docs, scan_only=True)


def bpe(spark, docs, sf_dir):
    """Each document's number of tokens and the digests of its ids and of the text decoded from them."""
    return round_trips(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe", bpe),
]

#: Language ID, near dedup and BPE are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
