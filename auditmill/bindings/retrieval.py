"""Nearest neighbours, contexts and prompts over the given tables."""

import sys

import pyspark.cloudpickle
from pyspark.sql import functions as F

from auditmill.bindings.registry import query, spread_table, sql_lines, table
from auditmill.functions import vectors
from auditmill.operators import hooks, knn, prompts

RANKED = """
WITH pairs AS (
  SELECT q.vec_id AS chunk_id, k.vec_id AS id, q.label AS q_label, k.label AS k_label,
         round(list_cosine_similarity(q.embedding::DOUBLE[], k.embedding::DOUBLE[]), 9) AS sim
  FROM embeddings q, embeddings k {where}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY sim DESC, id)::INTEGER AS rank FROM pairs)
"""


def _sides(spark, sf):
    vecs = table(spark, sf, "embeddings")
    label = F.col("label").cast("string")
    asking = spread_table(spark, sf, "embeddings", "vec_id", "embedding", "label").select(
        F.col("vec_id").alias("chunk_id"), "embedding", label.alias("language"))
    known = vecs.select(F.col("vec_id").alias("id"), "embedding", F.array(label).alias("languages"))
    return asking, known


@query(RANKED.format(where="") + "SELECT chunk_id, id, sim, rank FROM ranked WHERE rank <= 5")
def knn_top5(spark, sf):
    return knn.knn_join(*_sides(spark, sf), knn.KnnParams(k=5))


@query(RANKED.format(where="") + "SELECT chunk_id, id, sim, rank FROM ranked WHERE rank <= 5")
def knn_top5_cells(spark, sf):
    """With blocks and shares so small that many are streamed and merged."""
    params = knn.KnnParams(k=5, block_bytes=1 << 14, share_bytes=1 << 16)
    return knn.knn_join(*_sides(spark, sf), params)


@query(RANKED.format(where="") + "SELECT chunk_id, id, sim, rank FROM ranked WHERE rank <= 5 AND q_label = k_label")
def knn_label_post(spark, sf):
    return knn.knn_join(*_sides(spark, sf), knn.KnnParams(k=5, mode="post"))


@query(RANKED.format(where="WHERE q.label = k.label") + "SELECT chunk_id, id, sim, rank FROM ranked WHERE rank <= 5")
def knn_label_pre(spark, sf):
    return knn.knn_join(*_sides(spark, sf), knn.KnnParams(k=5, mode="pre"))


@query("""
WITH first_of AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label),
anchor AS (SELECT e.label, e.embedding FROM embeddings e JOIN first_of USING (label, vec_id))
SELECT e.vec_id,
       CASE WHEN e.vec_id % 7 = 0 THEN NULL ELSE
         CAST(round(list_cosine_similarity(e.embedding::DOUBLE[], a.embedding::DOUBLE[]) * 1000000) AS BIGINT) END AS ppm
FROM embeddings e JOIN anchor a USING (label)
""")
def cosine_to_anchor(spark, sf):
    """Similarity to the first vector of the label; vectors that are missing count as zero."""
    vecs = table(spark, sf, "embeddings")
    anchors = vecs.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor"))
    given = F.when(F.col("vec_id") % 7 != 0, F.col("embedding"))
    sim = vectors.cosine_similarity(vectors.vector_or_zero(given, 64), F.col("anchor"))
    return vecs.join(anchors, "label").select("vec_id", F.round(sim * 1000000).cast("bigint").alias("ppm"))


@query(RANKED.format(where="") + """,
entry AS (
  SELECT doc_id AS id,
         '[' || CASE WHEN lang = 'en' THEN upper(source) ELSE 'CWE-' || doc_id END || '] ' || lang || ' text' || chr(10)
         || text[1:800]
         || CASE WHEN lang = 'fr' THEN chr(10) || 'Examples:' || chr(10) || '  - ' || source || chr(10) || '  - ' || lang
            ELSE '' END AS entry
  FROM documents)
SELECT r.chunk_id, md5(string_agg(entry, chr(10) || chr(10) ORDER BY rank)) AS context
FROM ranked r JOIN entry USING (id) WHERE rank <= 3 GROUP BY r.chunk_id
""")
def knowledge_context(spark, sf):
    asking, known = _sides(spark, sf)
    lang = F.col("lang")
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        "source",
        F.when(lang == "en", "").otherwise(F.concat(F.lit("CWE-"), F.col("doc_id").cast("string"))).alias("cwe_id"),
        F.concat("lang", F.lit(" text")).alias("title"),
        F.col("text").alias("document"),
        F.when(lang == "fr", F.array("source", "lang", F.lit("third"))).otherwise(F.array().cast("array<string>"))
        .alias("examples"),
    )
    hits = knn.knn_join(asking, known, knn.KnnParams(k=3))
    return prompts.knowledge_context(hits, rows).select("chunk_id", F.md5("context").alias("context"))


NUMBERED = f"""
numbered AS (
  SELECT doc_id, lang, source, lines, first,
         list_transform(range(1, len(lines) + 1), lambda i:
           lpad((first + i - 1)::VARCHAR, length((first + len(lines))::VARCHAR)::INTEGER, ' ') || ' | ' || lines[i]) AS shown
  FROM (SELECT *, 1 + doc_id % 120 AS first, {sql_lines('text')} AS lines FROM documents))
"""


@query(f"""WITH {NUMBERED}
SELECT doc_id, len(lines)::INTEGER AS n, md5(array_to_string(shown, chr(10))) AS code FROM numbered""")
def line_numbers(spark, sf):
    from auditmill.functions import text

    docs = spread_table(spark, sf, "documents", "doc_id", "text")
    shown = text.number_lines(F.col("text"), F.lit(1) + F.col("doc_id") % 120)
    return docs.select("doc_id", text.line_count(F.col("text")).alias("n"), F.md5(shown).alias("code"))


@query(f"""WITH {NUMBERED}
SELECT n.doc_id AS chunk_id, 'system' AS first_role, 'user' AS second_role, md5('Be brief.') AS first_text,
       md5('Notes: ' || coalesce('quality ' || quality || ', toxic ' || toxic, '') || chr(10) || 'File a/' || source
           || ' (' || lang || '), scope d' || n.doc_id || chr(10) || array_to_string(shown, chr(10))) AS second_text
FROM numbered n LEFT JOIN labels l ON l.doc_id = n.doc_id""")
def prompt_messages(spark, sf):
    doc_id = F.col("doc_id")
    chunks = spread_table(spark, sf, "documents", "doc_id", "lang", "source", "text").select(
        doc_id.alias("chunk_id"), F.col("lang").alias("language"), F.concat(F.lit("a/"), "source").alias("file_path"),
        F.concat(F.lit("d"), doc_id.cast("string")).alias("name"), F.col("text").alias("code"),
        (1 + doc_id % 120).alias("line_start"),
    )
    notes = table(spark, sf, "labels").select(
        doc_id.alias("chunk_id"),
        F.format_string("quality %d, toxic %d", "quality", "toxic").alias("context"))
    made = prompts.build_prompts(
        chunks.join(notes, "chunk_id", "left"), "Be brief.", "Notes: {knowledge}\nFile {file_path} ({language}), scope {name}\n{code}")
    message = F.col("messages")
    return made.select(
        "chunk_id",
        message[0]["role"].alias("first_role"), message[1]["role"].alias("second_role"),
        F.md5(message[0]["content"]).alias("first_text"), F.md5(message[1]["content"]).alias("second_text"),
    )


def _toy_embedder(texts):
    """Stands in for a model: three counts per text, and no answer to texts with secrets."""
    if any("token = " in t for t in texts):
        raise ValueError("refused")
    return [[len(t), t.count("e"), t.count("\n")] for t in texts]


@query("""
SELECT doc_id, CASE WHEN ok THEN length(text) ELSE 0 END::BIGINT AS n_chars,
       CASE WHEN ok THEN length(text) - length(replace(text, 'e', '')) ELSE 0 END::BIGINT AS n_e,
       CASE WHEN ok THEN length(text) - length(replace(text, chr(10), '')) ELSE 0 END::BIGINT AS n_lines
FROM (SELECT *, NOT contains(text, 'token = ') AS ok FROM documents)
""")
def embed_hook(spark, sf):
    embedded = hooks.embed(spread_table(spark, sf, "documents", "doc_id", "text").select("doc_id", "text"), "text", _toy_embedder, 3)
    vector = F.col("embedding")
    return embedded.select("doc_id", *[
        vector[i].cast("bigint").alias(name) for i, name in enumerate(["n_chars", "n_e", "n_lines"])])


def _toy_detector(messages):
    """Stands in for a model: the number of at signs, and an error for license lines."""
    text = messages[-1]["content"]
    if "License" in text:
        raise ValueError("refused")
    return '{"findings": [{"cwe_id": "CWE-%d"}]}' % text.count("@")


@query("""
SELECT doc_id AS chunk_id, 1 AS attempt,
       CASE WHEN contains(text, 'License') THEN '{"findings": []}' ELSE
       '{"findings": [{"cwe_id": "CWE-' || (length(text) - length(replace(text, '@', ''))) || '"}]}' END AS raw
FROM documents
""")
def detect_hook(spark, sf):
    docs = spread_table(spark, sf, "documents", "doc_id", "text").select(
        F.col("doc_id").alias("chunk_id"), prompts.messages("s", F.col("text")).alias("messages"))
    return hooks.detect(docs, _toy_detector).drop("messages")


pyspark.cloudpickle.register_pickle_by_value(sys.modules[__name__])
