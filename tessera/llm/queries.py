"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import os

from .collocations import COLLOCATIONS_SQL, collocations
from .common import table
from .decontaminate import contaminated
from .fingerprints import edited_fingerprints
from .language_id import language_id
from .main_text import extract
from .near_dedup import near_duplicates
from .personal_data import find_personal_data
from .piece_codec import encode_documents
from .quality import quality_scores
from .sharding import SHARDS, place, placement_sql
from .token_files import token_file_digests
from .toxicity import toxicity
from .vector_codes import codes_sql, vector_codes


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the installed public tokenizers; TESSERA_TOKENIZERS names another folder."""
    if folder := os.environ.get("TESSERA_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark, sf_dir, *columns):
    return table(spark, sf_dir, "documents").select("doc_id", "text", *columns)


def op1_document_fingerprints(spark, sf_dir):
    """Fingerprints of every document and its edited text."""
    return edited_fingerprints(documents(spark, sf_dir))


def op2_main_text(spark, sf_dir):
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op3_quality(spark, sf_dir):
    """Quality score of every document."""
    return quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_sentencepiece_codec(spark, sf_dir):
    """Ids of every document under seeded merge-dropout, and whether they decode to its text."""
    coded = encode_documents(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", "ids", "lossless")


def op5_minhash_near_dedup(spark, sf_dir):
    """Near-duplicate classes of ``documents``."""
    return near_duplicates(documents(spark, sf_dir))


def op6_token_files(spark, sf_dir):
    """Place, number and checksum of every document's ids, read back from the token files."""
    return token_file_digests(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op7_personal_data(spark, sf_dir):
    """Spans of personal data in every document."""
    return find_personal_data(documents(spark, sf_dir))


def op8_decontamination(spark, sf_dir):
    """The benchmark items that documents quote."""
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op9_sharding(spark, sf_dir):
    """Slot and shard of every document."""
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", list(SHARDS))


def op10_language_id(spark, sf_dir):
    """Predicted language of every document."""
    return language_id(documents(spark, sf_dir, "lang"))


def op11_vector_codes(spark, sf_dir):
    """Code and error of every usable vector."""
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark, sf_dir):
    """The first phrases of each language."""
    return collocations(documents(spark, sf_dir, "lang"))


def op13_toxicity(spark, sf_dir):
    """Toxicity score of every document."""
    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def pipeline(spark, sf_dir):
    """The corpus pipeline over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_document_fingerprints,
        op2_main_text,
        op3_quality,
        op4_sentencepiece_codec,
        op5_minhash_near_dedup,
        op6_token_files,
        op7_personal_data,
        op8_decontamination,
        op9_sharding,
        op10_language_id,
        op11_vector_codes,
        op12_collocations,
        op13_toxicity,
        pipeline,
    )
}
#: Exact links and components; SQL joins all documents that share a shingle.
NEAR_DEDUP_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM split),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y),
roots AS (SELECT x, min(y) AS root FROM reach GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(root, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(root, doc_id)) AS kept
FROM sets LEFT JOIN roots ON roots.x = sets.doc_id"""
ORACLES = {"op5_minhash_near_dedup": NEAR_DEDUP_SQL, "op9_sharding": placement_sql(list(SHARDS)), "op11_vector_codes": codes_sql(), "op12_collocations": COLLOCATIONS_SQL}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
