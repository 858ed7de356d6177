"""The registered queries of the subpackage: each operator over its whole table, and SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill.llm import codes, jaccard_join, language, mixing, pages, parsing, personal, pieces, quality, repair, shards, spans, warc
from auditmill.llm.draws import unit_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_block_tree_text(spark, sf):
    return pages.extract(table(spark, sf, "pages"))


@query()
def op2_robust_outliers(spark, sf):
    return quality.judge(table(spark, sf, "documents"))


TREE = shards.Tree(40)


@query()
def op3_hash_tree_shards(spark, sf):
    return shards.assign(table(spark, sf, "documents"), TREE)


@query()
def op4_consistent_parsing(spark, sf):
    return parsing.compare_neighbours(table(spark, sf, "documents"))


@query()
def op5_piece_prefix_table(spark, sf):
    import public_tokenizers
    return pieces.token_digests(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query(r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM tokens),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * n_both >= 80 * (p.n + q.n - n_both)),
reach AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.a)
SELECT d.doc_id, coalesce(max(s.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id""")
def op6_ngram_jaccard_join(spark, sf):
    return jaccard_join.near_groups(table(spark, sf, "documents"))


@query()
def op7_sentence_spans(spark, sf):
    return spans.remove_repeats(table(spark, sf, "documents"), local_cuts=True, grow=True)


@query()
def op8_personal_data(spark, sf):
    return personal.find(table(spark, sf, "documents"))


@query()
def op9_language_mixture(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held = language.held_out(F.col("doc_id"))
    model = language.learn(docs, ~held)
    return language.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "languages")


LISTED = "[" + ", ".join(map(str, mixing.WEIGHTS)) + "]"


@query(rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln({unit_sql(f"'{mixing.SEED}:' || coalesce(doc_id::VARCHAR, md5(text), '')")})
         / greatest({mixing.LEAST_QUALITY}, coalesce(len(regexp_extract_all(text, '[\p{{Ll}}\x20]')) / nullif(length(text), 0), 0)) AS key
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, {LISTED}[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)::INT] AS w
            FROM sized GROUP BY source),
levels AS (SELECT *, (sum(source_size) OVER () - {mixing.MOST} * coalesce(sum(source_size) OVER before, 0))
                     / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
           FROM sources WINDOW before AS (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least({float(mixing.MOST)} * source_size,
                   w * (SELECT level FROM levels WHERE level <= {mixing.MOST} * source_size / w ORDER BY source_size / w, source LIMIT 1)) AS target FROM levels),
plan AS (SELECT s.doc_id, s.size, s.source, t.source_size, t.target, floor(t.target / nullif(t.source_size, 0))::BIGINT AS epochs,
                coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
         FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
cut AS (SELECT *, least(size, greatest(0, round(target - epochs * source_size)::BIGINT - before))::BIGINT AS part FROM plan)
SELECT doc_id, size, source, source_size, round(target, 6) AS target, coalesce(epochs, 0) * size + coalesce(part, 0) AS taken FROM cut""")
def op10_source_mix(spark, sf):
    mixed = mixing.mix(table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source", "source_size", F.round("target", 6).alias("target"), "taken")


@query(f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
r AS (SELECT *, sha256(h) AS payload_digest, payload_bytes >= {warc.LEAST_SHARED} AND row_number() OVER same > 1 AS again, first_value(page_id) OVER same AS first_id
      FROM p WINDOW same AS (PARTITION BY sha256(h) ORDER BY page_id NULLS LAST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to FROM r""")
def op11_seekable_bundles(spark, sf):
    pages_table = table(spark, sf, "pages")
    place = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    archive = warc.write(pages_table, uid=F.md5(place.cast("binary")))
    return warc.summary(archive.records(with_payload=False))


def _assigned(number: int) -> str:
    """The CTEs that give every part to its nearest entry and move the entries."""
    book, out = f"book{number}", f"given{number}"
    gap = "(p.x[k] - b.c[k])"
    return f"""
{out} AS (SELECT rid, p.part, min({{'far': list_sum([{gap} * {gap} for k in range(1, len(p.x) + 1)])::BIGINT, 'entry': b.entry}}) AS best, any_value(p.x) AS x
          FROM parts p JOIN {book} b ON b.part = p.part GROUP BY rid, p.part),
sums{number} AS (SELECT part, (best).entry AS entry, pos, sum(x[pos])::HUGEINT AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(x) + 1)) AS pos FROM {out}) GROUP BY ALL),
book{number + 1} AS (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM {book} b LEFT JOIN (
          SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS c FROM sums{number} GROUP BY ALL) m ON m.part = b.part AND m.entry = b.entry)"""


@query(rf"""
WITH kept AS (SELECT row_number() OVER () AS rid, row_number() OVER (ORDER BY vec_id) - 1 AS nth, vec_id, label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v
              FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (SELECT rid, nth, part, v[part * (len(v) // {codes.PARTS}) + 1 : (part + 1) * (len(v) // {codes.PARTS})] AS x
          FROM (SELECT *, unnest(range({codes.PARTS})) AS part FROM kept)),
book0 AS (SELECT part, nth AS entry, x AS c FROM parts WHERE nth < {codes.ENTRIES}),
{_assigned(0)}, {_assigned(1)}, {_assigned(2)},
coded AS (SELECT rid, string_agg(lower(printf('%02x', (best).entry)), '' ORDER BY part) AS code, sum((best).far)::BIGINT AS error FROM given2 GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM book2) AS codebooks_sha256
FROM coded JOIN kept USING (rid)""")
def op12_adaptive_bounds_codes(spark, sf):
    return codes.with_label_error(codes.encode(table(spark, sf, "embeddings")))


CRC_TABLE = "[list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) for n in range(256)]"


def crc32_sql(bytes_list: str) -> str:
    """CRC-32 of a list of byte values; the column crc_table of the row must hold CRC_TABLE."""
    step = "xor(c >> 8, crc_table[xor(c & 255, b) + 1])"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bytes_list}), lambda c, b: {step}), 4294967295)"


@query(rf"""
WITH RECURSIVE tables AS (SELECT {CRC_TABLE} AS crc_table),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 [ord(c)::BIGINT for c in string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')] AS bytes FROM conversations),
kinds AS (SELECT *, {crc32_sql("bytes")} % 20 AS kind FROM keyed, tables),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE kind WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM kinds),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS nth, left(role, 1) AS r,
                  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
                  regexp_replace(text, '[\x20\x09-\x0D]+\z', '') AS bare FROM damaged),
faults AS (SELECT *, bare = '' AS is_blank, bare <> '' AND again AS is_dup, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS is_cut,
                  coalesce(lag(r) OVER (PARTITION BY conv_id ORDER BY nth) || r NOT IN ('su', 'ua', 'au'), false) AS is_illegal FROM placed),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(is_blank::INT) AS blank, sum(is_dup::INT) AS duplicate,
                  sum(is_cut::INT) AS truncated, sum(is_illegal::INT) AS illegal, max(nth) AS n FROM faults GROUP BY conv_id),
turns(state, needed, after) AS (VALUES (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
moves AS (SELECT state AS before, state, 0 AS price, '' AS letters, '' AS put FROM turns
          UNION ALL SELECT state, after, 5, 'I', CASE needed WHEN 'u' THEN 'user:' ELSE 'assistant:' END || chr(10) FROM turns
          UNION ALL SELECT a.state, b.after, 10, 'II', CASE a.needed WHEN 'u' THEN 'user:' || chr(10) || 'assistant:' ELSE 'assistant:' || chr(10) || 'user:' END || chr(10)
                    FROM turns a JOIN turns b ON b.state = a.after),
edits AS (
  SELECT f.conv_id, f.nth, t.state, e.*
  FROM faults f, turns t, LATERAL (
    SELECT t.state AS after, 2 AS price, 'D' AS letter, '' AS put
    UNION ALL SELECT CASE WHEN f.r = 's' THEN 1 ELSE t.after END, 5 * f.is_cut::INT, 'K', f.role || ':' || f.text || chr(10)
              WHERE NOT f.is_blank AND NOT f.is_dup AND (f.r = t.needed OR f.r = 's' AND t.state = 0)
    UNION ALL SELECT t.after, 1 + 5 * f.is_cut::INT, 'R', CASE t.needed WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text || chr(10)
              WHERE NOT f.is_blank AND NOT f.is_dup) e),
paths AS (
  SELECT conv_id, 0::BIGINT AS nth, 0 AS state, {{'cost': 0, 'audit': '', 'put': ''}} AS best FROM counts
  UNION ALL
  SELECT p.conv_id, p.nth + 1, e.after, min({{'cost': (p.best).cost + m.price + e.price, 'audit': (p.best).audit || m.letters || e.letter, 'put': (p.best).put || m.put || e.put}})
  FROM paths p JOIN moves m ON m.before = p.state JOIN edits e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.nth = p.nth + 1 AND e.state = m.state
  GROUP BY p.conv_id, p.nth, e.after),
ends AS (SELECT p.conv_id, min({{'cost': (p.best).cost + m.price, 'audit': (p.best).audit || m.letters, 'put': (p.best).put || m.put}}) AS best
         FROM paths p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.nth JOIN moves m ON m.before = p.state
         WHERE m.state IN (0, 3) GROUP BY p.conv_id)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce((best).cost, 0)::BIGINT AS cost,
       coalesce((best).audit, '') AS audit, sha256(coalesce(left((best).put, -1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM i.conv_id""")
def op13_block_table_repair(spark, sf):
    damaged = repair.damage(table(spark, sf, "conversations"))
    return repair.repair(damaged, there_column="there").conversations
