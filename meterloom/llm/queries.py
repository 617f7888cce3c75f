"""Registered queries of the text operators, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from meterloom.llm.common import remainder, table


def secret_model(docs):
    """Forest fitted on the findings of ``docs`` that format or place label, ids with crc32 modulo 5 equal to 0 left out."""
    from meterloom.llm.secrets import Context, dictionary, find, fit, labelled, pair_counts

    context = Context(pair_counts(docs), dictionary(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    learned = docs.where(F.coalesce(remainder("doc_id", 5) != 0, F.lit(True)))
    return fit(labelled(find(learned)), context)


def toxicity_model(docs, labels):
    """Network fitted on the labelled rows of ``docs``, ids with crc32 modulo 5 equal to 0 left out."""
    from meterloom.llm.toxicity import fit

    return fit(docs.where(F.coalesce(remainder("doc_id", 5) != 0, F.lit(True))), labels)


def op1_secrets(spark, folder):
    from meterloom.llm.secrets import scan

    docs = table(spark, folder, "documents")
    return scan(docs, secret_model(docs))


def op2_lattice_lm(spark, folder):
    from meterloom.llm.lattice_lm import lm_scores

    docs = table(spark, folder, "documents").withColumn("__held", remainder("doc_id", 10) == 0)
    return lm_scores(docs, public_tokenizers.path("piece_bpe_32k.model"), held_col="__held")


def op3_byte_bpe(spark, folder):
    from meterloom.llm.byte_bpe import encode_digest

    return encode_digest(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_exact_dedup(spark, folder):
    from meterloom.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, folder, "documents"))


def op5_simhash(spark, folder):
    from meterloom.llm.simhash import simhash_components

    return simhash_components(table(spark, folder, "documents"))


def op6_cover_tree(spark, folder):
    from meterloom.llm.cover_tree import top_k

    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_substring_dedup(spark, folder):
    from meterloom.llm.substring_dedup import repeated_passages

    return repeated_passages(table(spark, folder, "documents"))


def op8_toxicity(spark, folder):
    from meterloom.llm.toxicity import with_score

    docs = table(spark, folder, "documents")
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    model = toxicity_model(docs, table(spark, folder, "labels"))
    scored = with_score(docs, model, "text", "score", ["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_html(spark, folder):
    from meterloom.llm.html_text import extract

    return extract(table(spark, folder, "pages"))


def op10_packing(spark, folder):
    from meterloom.llm.packing import pack

    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_lexical(spark, folder):
    from meterloom.llm.lexical import ranked_search

    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_whitening(spark, folder):
    from meterloom.llm.whitening import whiten

    return whiten(table(spark, folder, "embeddings"))


def op13_line_dedup(spark, folder):
    from meterloom.llm.line_dedup import line_dedup

    done = line_dedup(table(spark, folder, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_lattice_lm, op3_byte_bpe, op4_exact_dedup, op5_simhash, op6_cover_tree, op7_substring_dedup, op8_toxicity, op9_html, op10_packing, op11_lexical, op12_whitening, op13_line_dedup)}

SQL = {
    "op4_exact_dedup": r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
    FROM documents
), r AS (
    SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size
    FROM d WINDOW w AS (PARTITION BY sha ORDER BY points DESC, doc_id ASC NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha AS text_sha256 FROM r
""",
    "op6_cover_tree": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
    FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
""",
    "op11_lexical": r"""
WITH words AS (
    SELECT row_number() OVER () AS doc, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), asked AS (
    SELECT item, item_id, unnest(list_distinct(terms)) AS term FROM (
        SELECT row_number() OVER () AS item, item_id,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM benchmark)
), totals AS (
    SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS all_terms FROM words WHERE len(terms) > 0
), tf AS (
    SELECT doc, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
    FROM (SELECT doc, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM words) GROUP BY doc, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, totals GROUP BY term
), scores AS (
    SELECT item, any_value(item_id) AS item_id, doc, any_value(doc_id) AS doc_id,
        CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // all_terms)))) AS BIGINT) AS score
    FROM asked JOIN tf USING (term) JOIN weights USING (term), totals GROUP BY item, doc
)
SELECT item_id, CAST(row_number() OVER p AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW p AS (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER p <= 10
""",
    "op13_line_dedup": r"""
WITH lines AS (
    SELECT doc, doc_id, place, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place
        FROM (SELECT row_number() OVER () AS doc, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), often AS (
    SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(often.key) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE often.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN often USING (key) GROUP BY doc
""",
}
