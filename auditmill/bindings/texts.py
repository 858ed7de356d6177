"""Text functions and lookups over the given tables."""

import uuid

from pyspark.sql import functions as F

from auditmill import params as P
from auditmill.bindings.registry import query, spread_table, sql_lines, sql_strip, table
from auditmill.functions import lookup, text
from auditmill.session import shared_folder
from auditmill.sources import files


CLEANED = sql_strip(
    r"regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'),"
    r" '\n{3,}', chr(10) || chr(10), 'g')")


@query(f"SELECT page_id, md5({CLEANED}) AS body FROM pages")
def clean_markup(spark, sf):
    return spread_table(spark, sf, "pages", "page_id", "html").select("page_id", F.md5(text.clean_markup(F.col("html"))).alias("body"))


URL_WORDS = (("/en", "english"), ("e", "any"), ("/de", "german"))


@query("""
SELECT page_id, CASE WHEN contains(url, '/en') THEN 'english' WHEN contains(url, 'e') THEN 'any'
                     WHEN contains(url, '/de') THEN 'german' END AS value FROM pages""")
def first_match(spark, sf):
    return table(spark, sf, "pages").select("page_id", lookup.first_match(F.col("url"), URL_WORDS).alias("value"))


GUIDE_CASE = " ".join(f"WHEN contains(stem, '{k}') THEN '{v}'" for k, v in P.GUIDE_WEAKNESSES)


@query(f"""
WITH named AS (SELECT doc_id, lower(replace(replace(source || '-' || ['SQL_Injection', 'Session Management', 'x',
  'LDAP-injection', 'File upload', 'Mass-Assignment'][(1 + doc_id % 6)::INTEGER], '-', '_'), ' ', '_')) AS stem FROM documents)
SELECT doc_id, CASE {GUIDE_CASE} END AS cwe_id FROM named""")
def guide_weakness(spark, sf):
    names = F.array(*[F.lit(n) for n in (
        "SQL_Injection", "Session Management", "x", "LDAP-injection", "File upload", "Mass-Assignment")])
    stem = F.concat_ws("-", "source", F.element_at(names, (1 + F.col("doc_id") % 6).cast("int")))
    return table(spark, sf, "documents").select("doc_id", lookup.guide_weakness(stem).alias("cwe_id"))


@query("""
SELECT doc_id, array_to_string(list_filter([
  CASE WHEN regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])der($|[^\\p{L}\\p{N}_])') THEN 'german' END,
  CASE WHEN regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])(que|las?)($|[^\\p{L}\\p{N}_])') THEN 'romance' END,
  CASE WHEN regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])the($|[^\\p{L}\\p{N}_])') THEN 'english' END],
  lambda x: x IS NOT NULL).list_sort(), ',') AS found FROM documents""".replace("\\\\", "\\"))
def language_mentions(spark, sf):
    bank = (("german", ("der",)), ("english", ("the",)), ("romance", ("que", "las?")))
    found = lookup.mentioned(F.col("text"), bank)
    return spread_table(spark, sf, "documents", "doc_id", "text").select("doc_id", lookup.to_csv(found).alias("found"))


@query("""
SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages_csv, count(*) AS n,
       count(DISTINCT lang)::INTEGER AS n_parsed
FROM documents GROUP BY source""")
def language_sets(spark, sf):
    """Set of languages per source, as comma list, and parsed back from one with blanks."""
    sets = table(spark, sf, "documents").groupBy("source").agg(
        F.array_sort(F.collect_set("lang")).alias("languages"), F.count("*").alias("n"))
    csv = lookup.to_csv(F.col("languages"))
    parsed = lookup.parse_csv(F.concat(F.replace(csv, F.lit(","), F.lit(" , ,")), F.lit(", ")))
    return sets.select("source", csv.alias("languages_csv"), "n", F.size(parsed).alias("n_parsed"))


@query("""
WITH named AS (SELECT doc_id, list_filter(list_transform([upper(lang), source, 'EN'], lambda x:
         CASE lower(x) WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'src3' THEN 'third' END),
         lambda x: x IS NOT NULL) AS full_list,
       list_filter(list_transform([upper(lang), source], lambda x:
         CASE lower(x) WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'src3' THEN 'third' END),
         lambda x: x IS NOT NULL) AS short_list FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(full_list)), ',') AS known,
       CASE WHEN len(short_list) > 0 THEN array_to_string(list_sort(list_distinct(short_list)), ',') ELSE 'a,b' END AS or_default
FROM named""")
def canonical_languages(spark, sf):
    names = {"en": "english", "fr": "french", "src3": "third"}
    given = F.array(F.upper("lang"), F.col("source"))
    return table(spark, sf, "documents").select(
        "doc_id",
        lookup.to_csv(lookup.canonical_names(F.concat(given, F.array(F.lit("EN"))), names)).alias("known"),
        lookup.to_csv(lookup.canonical_names(given, names, ["a", "b"])).alias("or_default"),
    )


@query("""
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'CWE-' || user_id WHEN 1 THEN 'CWE-' || user_id WHEN 2 THEN NULL
  WHEN 3 THEN CASE WHEN user_id > 0 THEN 'CWE-' || user_id END WHEN 4 THEN NULL WHEN 5 THEN 'CWE-' || user_id ELSE NULL END AS cwe_id
FROM events""")
def weakness_ids(spark, sf):
    """Ids in the shapes rule files have them: text, list, null, number (zero is none), other text,
    fallback key."""
    user, case = F.col("user_id").cast("string"), F.col("event_id") % 7
    shape = (
        F.when(case == 0, F.concat(F.lit('{"a": "see cwe-'), user, F.lit(': title"}')))
        .when(case == 1, F.concat(F.lit('{"a": ["CWE-'), user, F.lit(' x", "CWE-1"]}')))
        .when(case == 2, F.lit('{"a": null}'))
        .when(case == 3, F.concat(F.lit('{"a": '), user, F.lit("}")))
        .when(case == 4, F.lit('{"a": "none of them"}'))
        .when(case == 5, F.concat(F.lit('{"a": "", "b": "CWE-'), user, F.lit('"}')))
        .otherwise(F.lit('{"a": [], "b": []}'))
    )
    value = F.parse_json(shape)
    first = lookup.first_truthy(F.try_variant_get(value, "$.a", "variant"), F.try_variant_get(value, "$.b", "variant"))
    return spread_table(spark, sf, "events", "event_id", "user_id").select("event_id", lookup.weakness_id(first).alias("cwe_id"))


@query(f"""
SELECT doc_id, md5(array_to_string(({sql_lines('text')})[(1 + doc_id % 5)::BIGINT:(3 + doc_id % 5)::BIGINT], chr(10))) AS chunk_part,
       md5(array_to_string((string_split(text, chr(10)))[2:3], chr(10))) AS file_part
FROM documents""")
def snippets(spark, sf):
    docs, code, doc_id = spread_table(spark, sf, "documents", "doc_id", "text"), F.col("text"), F.col("doc_id")
    start = 10 + doc_id % 5
    return docs.select(
        "doc_id",
        F.md5(text.chunk_snippet(code, F.lit(10).cast("bigint"), start, start + 2)).alias("chunk_part"),
        F.md5(text.file_snippet(code, F.lit(2), F.lit(3))).alias("file_part"),
    )


@query("SELECT doc_id, md5(replace(text, chr(10), chr(10)) || chr(10) || chr(65533) || 'a' || chr(10) || 'b') AS content FROM documents")
def decoded_texts(spark, sf):
    """Bytes with a bad one and mixed line ends."""
    raw = F.concat(F.encode(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), "UTF-8"),
                   F.unhex(F.lit("0DFF610D0A62")))
    return spread_table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.md5(text.decode_text(raw)).alias("content"))


PATH = "regexp_extract(url, '^https?://([^?#]*)', 1)"


@query(f"""
WITH paths AS (SELECT page_id, {PATH} AS p FROM pages),
hits AS (
  SELECT page_id, max(CASE WHEN regexp_matches(p, r) THEN ord * 2 + neg END) AS last
  FROM paths, (VALUES (1, 0, '^m\\.[^/]*/.*'), (2, 0, '^(.+/)?en/.*$'), (3, 1, '^(.+/)?[^/]*[02468](/.*)?$'),
                      (4, 0, '^(.+/)?[^/]*\\.html(/.*)?$'), (5, 0, '^blog\\.[^/]+/(.+/)?[^/]9[^/](/.*)?$')) AS rules(ord, neg, r)
  GROUP BY page_id)
SELECT page_id FROM hits WHERE last IS NULL OR last % 2 = 1""".replace("\\\\", "\\"))
def ignored_paths(spark, sf):
    """Paths that the lines leave in: directories, a line that takes back, suffixes, depth."""
    from auditmill.sources.ignore import is_ignored

    lines = ["# comment", "", "/m.*/", "en/", "!*[02468]", "*.html", "blog.*/**/?9?"]
    path = F.regexp_extract("url", r"^https?://([^?#]*)", 1)
    return table(spark, sf, "pages").filter(~is_ignored(path, lines)).select("page_id")


FILE_TABLE = """
files AS (
  SELECT doc_id, ['src', 'src/node_modules/x', 'lib', 'build', 'tests/unit', 'a/b/c'][(1 + doc_id % 6)::INTEGER]
         || '/f' || doc_id || ['.py', '.PY', '.tsx', '.txt', '.go', '.cjs', ''][(1 + doc_id % 7)::INTEGER] AS rel_path,
         n_chars * 300 AS size_bytes FROM documents)
"""


def _file_table(spark, sf):
    doc_id = F.col("doc_id")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (1 + doc_id % n).cast("int"))
    path = F.concat(
        pick(["src", "src/node_modules/x", "lib", "build", "tests/unit", "a/b/c"], 6), F.lit("/f"), doc_id.cast("string"),
        pick([".py", ".PY", ".tsx", ".txt", ".go", ".cjs", ""], 7))
    return table(spark, sf, "documents").select(
        "doc_id", path.alias("rel_path"), (F.col("n_chars") * 300).alias("size_bytes"))


@query(f"""WITH {FILE_TABLE}
SELECT doc_id, rel_path, CASE WHEN lower(rel_path) LIKE '%.py' THEN 'python' WHEN rel_path LIKE '%.tsx' THEN 'typescript'
       WHEN rel_path LIKE '%.go' THEN 'go' ELSE 'javascript' END AS language, size_bytes
FROM files WHERE size_bytes <= 1048576 AND regexp_matches(lower(rel_path), '\\.(py|tsx|go|cjs)$')
  AND NOT regexp_matches(rel_path, '(^|/)(node_modules|build)/') AND rel_path NOT LIKE 'tests/%'
  AND NOT (rel_path LIKE 'lib/%.go' AND NOT rel_path LIKE 'lib/f1%')""".replace("\\\\", "\\"))
def selected_files(spark, sf):
    return files.select_files(_file_table(spark, sf), ignore_lines=["tests/", "lib/*.go", "!lib/f1*"]).select(
        "doc_id", "rel_path", "language", "size_bytes")


@query(f"""WITH {FILE_TABLE}, short AS (SELECT doc_id, regexp_replace(rel_path, '^src/', '') AS rel_path FROM files)
SELECT doc_id, rel_path FROM short WHERE NOT contains(rel_path, '/') AND regexp_matches(lower(rel_path), '\\.(py|go)$')"""
       .replace("\\\\", "\\"))
def flat_files(spark, sf):
    """Only the top directory, and two languages."""
    flat = _file_table(spark, sf).withColumn("rel_path", F.regexp_replace("rel_path", "^src/", ""))
    chosen = files.select_files(flat, ["python", "go"], recursive=False, max_bytes=1 << 40)
    return chosen.select("doc_id", "rel_path")


@query("""
SELECT lang, count(*) AS n_lines, sum(length(l))::BIGINT AS n_chars
FROM (SELECT lang, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY lang""")
def source_tree(spark, sf):
    """Texts written to a tree of files (one directory per language), listed and read again."""
    root = f"{shared_folder(spark).removeprefix('file://').removeprefix('file:')}/tree-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").select("lang", "text")
    docs.write.mode("overwrite").option("maxRecordsPerFile", 2000).partitionBy("lang").text(root)
    texts = files.load_texts(spark, root, [".txt"], recursive=True)
    lines = texts.select(
        F.regexp_extract("rel_path", "lang=([^/]*)/", 1).alias("lang"),
        F.explode(F.split(F.regexp_replace("content", r"\n\z", ""), "\n", -1)).alias("line"))
    return lines.groupBy("lang").agg(
        F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("bigint").alias("n_chars"))
