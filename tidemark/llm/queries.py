"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, chat, embedding_dedup, exact_dedup, importance, ngram_join, packing, periodic_runs, quality, secrets, sharding, toxicity, warc

QUERIES = {
    "op1_quality": quality.op1,
    "op2_ngram_join": ngram_join.op2,
    "op3_exact_dedup": exact_dedup.op3,
    "op4_harmonic_packing": packing.op4,
    "op5_chat_format": chat.op5,
    "op6_bpe": bpe.op6,
    "op7_embedding_dedup": embedding_dedup.op7,
    "op8_secrets": secrets.op8,
    "op9_toxicity": toxicity.op9,
    "op10_sharding": sharding.op10,
    "op11_periodic_runs": periodic_runs.op11,
    "op12_importance_resampling": importance.op12,
    "op13_warc": warc.op13,
    "pipeline": corpus_pipeline.run,
}

OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 80 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM c LEFT JOIN n ON c.doc_id = n.doc_id
"""

ORACLE_SQL = {
    "op2_ngram_join": OP2_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op5_chat_format": chat.OP5_SQL,
    "op7_embedding_dedup": embedding_dedup.OP7_SQL,
    "op12_importance_resampling": importance.OP12_SQL,
    "op13_warc": warc.OP13_SQL,
}
