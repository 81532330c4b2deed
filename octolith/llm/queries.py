"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from octolith.llm import ann, cotrain, decontam, htmlcrf, katz, packing, pii, secretscan, simhash, toxicity
from octolith.llm.spark import table


def op1_main_text(spark, sf_dir):
    """The main text of every page. Nulls, repeats and empty tables: as the operator has it."""
    return htmlcrf.extract(table(spark, sf_dir, "pages"))


def op2_toxicity(spark, sf_dir):
    """Every document's toxicity score, from a model of the labelled rows that are not held out. Nulls, repeats and empty tables: as the operator has it."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.digest(toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))))


def op3_benchmark_decontamination(spark, sf_dir):
    """What of the benchmark occurs in each document. Nulls, repeats and empty tables: as the operator has it."""
    return decontam.digest(decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and near-duplicate group of each document. Nulls, repeats and empty tables: as the operator has it."""
    return simhash.digest(simhash.groups(table(spark, sf_dir, "documents")))


def op5_nearest_neighbours(spark, sf_dir):
    """The ten nearest of all vectors to each hundredth one. Nulls, repeats and empty tables: as the operator has it."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


def op6_quality(spark, sf_dir):
    """Every document's quality score by two co-trained views. Nulls, repeats and empty tables: as the operator has it."""
    docs = table(spark, sf_dir, "documents")
    return cotrain.digest(cotrain.score(docs, cotrain.train(docs, table(spark, sf_dir, "labels"))))


def op7_personal_data(spark, sf_dir):
    """Counts and spans of personal data in each document. Nulls, repeats and empty tables: as the operator has it."""
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op8_secret_scan(spark, sf_dir):
    """Every candidate for a secret with its score. Nulls, repeats and empty tables: as the operator has it."""
    return secretscan.find(table(spark, sf_dir, "documents"), secretscan.train(secretscan.labelled_findings(spark)))


def op9_katz_scoring(spark, sf_dir):
    """Every document's log10 probability under a Katz backoff model of those that are not held out. Nulls, repeats and empty tables: as the operator has it."""
    return katz.score(table(spark, sf_dir, "documents"))


def op10_sequence_packing(spark, sf_dir):
    """All documents' pieces in sequences of at most 4096 tokens. Nulls, repeats and empty tables: as the operator has it."""
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_main_text, op2_toxicity, op3_benchmark_decontamination, op4_simhash_near_dedup, op5_nearest_neighbours, op6_quality, op7_personal_data, op8_secret_scan, op9_katz_scoring, op10_sequence_packing)}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "op3_benchmark_decontamination": f"""WITH
iw AS (SELECT item_id, {_WORDS} w, least(10, len(w)) k FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item_id, k, w[i:i + k - 1] key FROM (SELECT *, unnest(range(1, len(w) - k + 2)) i FROM iw WHERE k > 0)),
d AS (SELECT doc_id, coalesce({_WORDS}, []) w FROM documents),
dw AS (SELECT doc_id, k, i, w[i:i + k - 1] key FROM (SELECT d.*, k, unnest(range(1, len(w) - k + 2)) i FROM d, (SELECT DISTINCT k FROM win))),
hit AS (SELECT doc_id, item_id, i, k FROM dw JOIN win USING (k, key)),
pos AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
}
