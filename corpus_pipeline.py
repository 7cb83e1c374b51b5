"""The corpus pipeline: language ID, near-duplicate removal, benchmark decontamination,
personal-data masking, then piece encoding, over ``documents``.

Each stage works on all that the one before kept and is written as Parquet in the shared
folder before the next reads it. Documents are rejected for their language if they have
no letter, or if they resemble their language far less than texts of their size in it do.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm.common import discard, fold_of, stage, table
from tessera.llm.decontaminate import decontaminate
from tessera.llm.language_id import UNKNOWN, train_prototypes, usual_strengths, with_language
from tessera.llm.near_dedup import deduplicate
from tessera.llm.personal_data import redact
from tessera.llm.piece_codec import encode_documents
from tessera.llm.queries import tokenizer_path

#: How many deviations a document may lie below the usual strength of its language. The deviation is that of
#: texts of its size, so short texts, which show little, are hardly ever rejected.
MOST_BELOW = 6.0


def in_language(found, usual):
    """Whether what :func:`with_language` found is a language."""
    value = lambda k: F.create_map(*(F.lit(x) for lang, row in usual.items() for x in (lang, float(row[k]))))[found["lang_pred"]]
    least = value(0) - MOST_BELOW * F.sqrt(value(1) + value(2) / found["n_grams"])
    return (found["lang_pred"] != UNKNOWN) & F.coalesce(found["strength"] >= least, F.lit(True))


def language(spark, docs, sf_dir):
    """Drop what is in no language; a missing lang becomes the predicted one."""
    languages, prototypes = train_prototypes(docs.where(fold_of("doc_id", 4) != 2))
    if not languages:  # nothing to compare with: only texts without a letter are known to have no language
        return docs.where(F.col("text").rlike(r"\p{L}"))
    usual = usual_strengths(docs.where(fold_of("doc_id", 4) != 2), languages, prototypes)
    found = with_language(docs.select(F.struct(*docs.columns).alias("row")).withColumn("text", F.col("row.text")), languages, prototypes, "found")
    kept = found.where(in_language(F.col("found"), usual))
    lang = F.coalesce("row.lang", "found.lang_pred").alias("lang")
    return kept.select(*(lang if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def near_duplicate(spark, docs, sf_dir):
    """Keep one document of each near-duplicate class."""
    return deduplicate(docs)


def decontamination(spark, docs, sf_dir):
    """Drop documents that quote a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark, docs, sf_dir):
    """Mask personal data in the texts."""
    return redact(docs)


def pieces(spark, docs, sf_dir):
    """Encode every text and check that it decodes to itself."""
    coded = encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))
    return coded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "lossless")


STAGES = [
    ("language", language),
    ("near_duplicate", near_duplicate),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("pieces", pieces),
]

#: Stages learn from the corpus and hash by key; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, function in STAGES:
        paths: list[str] = []
        docs = stage(function(spark, docs, sf_dir), name, paths, compact=False)
        discard(spark, before)
        before = paths
    return docs
