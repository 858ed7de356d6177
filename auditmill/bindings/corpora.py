"""Corpora made of the given texts: catalogue records, guides, rules, code, knowledge rows.

The texts hold no security corpus, so each query first writes them in the form of one (XML,
Markdown, YAML, source code) with Spark and then reads that form. Whole texts go through.
"""

from pyspark.sql import functions as F

from auditmill import params as P
from auditmill.bindings.registry import query, spread_table, sql_strip, table
from auditmill.functions.lookup import to_csv
from auditmill.functions.text import let
from auditmill.operators import knowledge, segment
from auditmill.session import store
from auditmill.sources import catalogue, guides, rules

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _spread_docs(spark, sf):
    return spread_table(spark, sf, "documents", "doc_id", "source", "lang", "text", "n_chars")


def _text(c):
    """An id as text."""
    return F.col(c).cast("string")


# --- Catalogue -----------------------------------------------------------------------

RECORDS = rf"""
base AS (SELECT doc_id, source, lang, regexp_replace(text, '{CONTROL}', '', 'g') AS clean FROM documents),
parts AS (
  SELECT doc_id, 'CWE-' || doc_id AS cwe_id, source || CASE lang WHEN 'de' THEN ' SQL Injection' ELSE ' & <' || lang || '>' END AS name,
         CASE WHEN doc_id % 11 = 0 THEN 'Deprecated' ELSE 'Draft' END AS status,
         {sql_strip('clean')} AS description, source || ' ' || {sql_strip('clean')} AS details,
         [lang, ({sql_strip('clean')})[1:300]] AS mitigations,
         CASE WHEN lang = 'en' THEN [{sql_strip('clean')}[1:500], 'a < b && c'] ELSE [] END AS examples,
         CASE lang WHEN 'en' THEN 'cpp,python' WHEN 'fr' THEN 'csharp' ELSE 'python,java,javascript,go,c,cpp' END AS languages
  FROM base),
chunks AS (
  SELECT *, ('Name: ' || name || CASE WHEN description <> '' THEN chr(10) || chr(10) || 'Description: ' || description ELSE '' END
    || chr(10) || chr(10) || 'Details: ' || details[1:600]
    || chr(10) || chr(10) || 'Mitigations: ' || array_to_string(list_filter(mitigations, lambda m: m <> ''), ' | ')[1:400])[1:2000] AS text
  FROM parts WHERE status <> 'Deprecated')
"""


def _records(spark, sf):
    return catalogue.cut_records(_spread_docs(spark, sf), _record_text(), F.lit(""), F.col("doc_id"))


def _record_text():
    """A text as a catalogue element without its end tag."""
    def escaped(c):
        out = F.regexp_replace(c, CONTROL, "")
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            out = F.replace(out, F.lit(char), F.lit(entity))
        return out

    return let(escaped(F.col("text")), _record_of)


def _record_of(body):
    lang = F.col("lang")
    name = F.when(lang == "de", " SQL Injection").otherwise(F.concat(F.lit(" &amp; &lt;"), lang, F.lit("&gt;")))
    languages = (
        F.when(lang == "en", '<Language Name="C++"/><Language Name="Python"/><Language Name="COBOL"/>')
        .when(lang == "fr", '<Language Name="C#" Prevalence="Often"/>').otherwise(""))
    code = F.when(lang == "en", F.concat(
        F.lit('<Example_Code Nature="bad" Language="C"><xhtml:div>'), body,
        F.lit('</xhtml:div></Example_Code><Example_Code Nature="good">no</Example_Code>'
              '<Example_Code Language="C" Nature="bad"><xhtml:br/> a &lt; b &amp;&amp; c </Example_Code>'))).otherwise("")
    return F.concat(
        F.lit('<x:y>\n<Weakness ID="'), _text("doc_id"), F.lit('" Name="'), F.col("source"), name, F.lit('" Status="'),
        F.when(F.col("doc_id") % 11 == 0, "Deprecated").otherwise("Draft"), F.lit('">\n<Description>'), body,
        F.lit("</Description>\n<Extended_Description><xhtml:p> "), F.col("source"), F.lit("</xhtml:p><xhtml:p>"), body,
        F.lit("</xhtml:p></Extended_Description><Applicable_Platforms>"), languages,
        F.lit("</Applicable_Platforms><Demonstrative_Examples><Demonstrative_Example>"), code,
        F.lit("</Demonstrative_Example></Demonstrative_Examples><Potential_Mitigations><Mitigation><Description>"), lang,
        F.lit('</Description></Mitigation><Mitigation Mitigation_ID="M1"><Description><xhtml:p>'), body,
        F.lit("</xhtml:p></Description></Mitigation></Potential_Mitigations>"))


@query(rf"""WITH {RECORDS}
SELECT cwe_id, cwe_id || ': ' || name AS title, md5(text) AS body, languages, len(examples)::INTEGER AS n_examples,
       md5(array_to_string(examples, '|')) AS examples, CASE WHEN contains(lower(name || ' ' || description), 'sql injection')
       THEN 'critical' ELSE 'low' END AS severity_hint FROM chunks""")
def catalogue_corpus(spark, sf):
    rows = catalogue.knowledge(catalogue.parse_records(_records(spark, sf)))
    return rows.select(
        "cwe_id", "title", F.md5("text").alias("body"), to_csv(F.col("languages")).alias("languages"),
        F.size("examples").alias("n_examples"), F.md5(F.array_join("examples", "|")).alias("examples"),
        F.col("metadata")["severity_hint"].alias("severity_hint"))


@query("""
WITH ids AS (SELECT DISTINCT 'CWE-' || doc_id AS id FROM documents)
SELECT 0::INTEGER AS part, '' AS id, '[' AS value UNION ALL SELECT 2, '', ']'
UNION ALL SELECT 1, id, CASE WHEN id = (SELECT min(id) FROM ids) THEN '  ' ELSE ', ' END || '"' || id || '"' FROM ids""")
def id_dictionary(spark, sf):
    """Lines of the id list; retired entries are in it."""
    return knowledge.id_lines(catalogue.valid_ids(catalogue.parse_records(_records(spark, sf))))


# --- Guides --------------------------------------------------------------------------

NAMES = ("SQL_Injection", "XSS-Prevention", "Path Traversal", "CSRF", "Unknown", "LDAP_Injection")
TALKS = {"en": "Uses Python, C++ and Node.js here.", "fr": "Golang / Java, C++11", "de": "TS; rails and [cpp](http://x)", "es": "PHP_x <b>c#</b>"}

SECTIONS = rf"""
marked AS (
  SELECT doc_id, '# ' || source || chr(10) || array_to_string(list_transform(string_split(text, chr(10)),
         lambda l: CASE WHEN length(l) BETWEEN 1 AND 39 THEN '## ' || l ELSE l END), chr(10)) || chr(10) ||
         CASE lang {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in TALKS.items())} END AS content FROM documents),
listed AS (SELECT doc_id, content, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM marked),
flagged AS (SELECT *, regexp_matches(l, '^## .') AS head, sum(regexp_matches(l, '^## .')::INTEGER) OVER (PARTITION BY doc_id ORDER BY n) AS part,
                   sum(regexp_matches(l, '^## .')::INTEGER) OVER (PARTITION BY doc_id) AS heads FROM listed),
pieces AS (
  SELECT doc_id, part, max(heads) AS heads, any_value(content) AS content, max(CASE WHEN head THEN l[4:] END) AS heading,
         coalesce(string_agg(CASE WHEN NOT head THEN l END, chr(10) ORDER BY n), '') AS body FROM flagged GROUP BY doc_id, part),
titled AS (
  SELECT doc_id, part,
         CASE WHEN part = 0 THEN regexp_extract(body, '(?m)^# (.+)$', 1) ELSE {sql_strip('heading')} END AS title,
         CASE WHEN heads = 0 THEN content WHEN part = 0 THEN {sql_strip(f"regexp_replace({sql_strip('body')}, '^# .+' || chr(10) || '?', '')")}
              ELSE {sql_strip('body')} END AS body FROM pieces),
sections AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1)::INTEGER AS section_no, title, body
             FROM titled WHERE body <> '')
"""


def _marked(spark, sf):
    lines = F.transform(F.split("text", "\n", -1), lambda line: F.when(
        F.length(line).between(1, 39), F.concat(F.lit("## "), line)).otherwise(line))
    talk = None
    for lang, words in TALKS.items():
        talk = F.when(F.col("lang") == lang, words) if talk is None else talk.when(F.col("lang") == lang, words)
    content = F.concat(F.lit("# "), "source", F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"), talk)
    names = F.array(*[F.lit(n) for n in NAMES])
    path = F.concat(F.element_at(names, (1 + F.col("doc_id") % 6).cast("int")), F.lit("_"), _text("doc_id"), F.lit("_Cheat_Sheet.md"))
    return _spread_docs(spark, sf).select("doc_id", F.concat(F.lit("/g/"), path).alias("path"), path.alias("rel_path"), content.alias("content"))


@query(f"WITH {SECTIONS} SELECT doc_id, section_no, title, md5(body) AS body FROM sections")
def guide_sections(spark, sf):
    cut = F.posexplode(guides.sections(F.col("content"))).alias("section_no", "s")
    return _marked(spark, sf).select("doc_id", cut).select(
        "doc_id", "section_no", F.col("s.title").alias("title"), F.md5("s.body").alias("body"))


# Stated apart from the library's table, so that a wrong entry there shows.
TALK_CASES = ", ".join(
    rf"CASE WHEN regexp_matches(body, '(?i)(^|[^\p{{L}}\p{{N}}_])({words})') THEN '{lang}' END" for lang, words in (
        (lang, rf"({words})($|[^\p{{L}}\p{{N}}_]){more}") for lang, words, more in (
            ("python", "python", ""), ("javascript", r"javascript|node\.?js|js", ""), ("typescript", "typescript|ts", ""),
            ("java", "java", ""), ("go", "golang|go", ""), ("cpp", "cpp", r"|c\+\+[\p{L}\p{N}_]"), ("c", "c", ""),
            ("php", "php", ""), ("ruby", "ruby|rails", ""))))


CLEANED = sql_strip(
    r"regexp_replace(regexp_replace(regexp_replace(body, '<[^>]+>', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")


@query(rf"""WITH {SECTIONS},
cleaned AS (SELECT doc_id, section_no, title, {CLEANED} AS body FROM sections),
cut AS (SELECT doc_id, section_no, title, body[1:2000] AS body FROM cleaned WHERE length(body) >= 50)
SELECT ['CWE-89', 'CWE-79', 'CWE-22', 'CWE-352', NULL, 'CWE-89'][(1 + doc_id % 6)::INTEGER] AS cwe_id,
       'OWASP: ' || replace({list(NAMES)!r}[(1 + doc_id % 6)::INTEGER] || '_' || doc_id, '_', ' ') || ' — ' || title AS title,
       md5(body) AS body, section_no::BIGINT AS order_pos, array_to_string(list_sort(list_filter([
         {TALK_CASES}], lambda x: x IS NOT NULL)), ',') AS languages
FROM cut""")
def guide_corpus(spark, sf):
    return guides.knowledge(_marked(spark, sf)).select(
        "cwe_id", "title", F.md5("text").alias("body"), "order_pos", to_csv(F.col("languages")).alias("languages"))


# --- Rules ---------------------------------------------------------------------------

RULES = rf"""
rules AS (
  SELECT doc_id, CASE doc_id % 6 WHEN 4 THEN NULL ELSE 'CWE-' || n_chars END AS cwe_id,
         CASE doc_id % 3 WHEN 0 THEN 'cpp,python' WHEN 1 THEN 'javascript' ELSE NULL END AS languages,
         {sql_strip('text')} AS message, CASE doc_id % 2 WHEN 0 THEN 'warning' ELSE 'high' END AS severity,
         CASE doc_id % 4 WHEN 0 THEN source || '($X)' WHEN 1 THEN lang || chr(10) || source WHEN 2 THEN source ELSE '' END AS pattern
  FROM documents),
chunks AS (
  SELECT *, (CASE WHEN message <> '' THEN 'Description: ' || message[1:600] || chr(10) || chr(10) ELSE '' END || 'Severity: ' || severity
         || CASE WHEN pattern <> '' THEN chr(10) || chr(10) || 'Vulnerable pattern:' || chr(10) || pattern[1:400] ELSE '' END)[1:2000] AS text
  FROM rules WHERE cwe_id IS NOT NULL AND languages IS NOT NULL)
"""


def _rule_files(spark, sf):
    def quoted(c):
        text = F.to_json(F.array(c))
        return F.substring(text, F.lit(2), F.length(text) - 2)

    number, case = _text("n_chars"), F.col("doc_id") % 6
    weakness = (
        F.when(case == 0, F.concat(F.lit('"cwe": "cwe-'), number, F.lit(': title"')))
        .when(case == 1, F.concat(F.lit('"cwe": ["CWE-'), number, F.lit('", "CWE-1"]')))
        .when(case == 2, F.concat(F.lit('"cwe": '), number))
        .when(case == 3, F.concat(F.lit('"cwe": [], "cwe2022-top25": "CWE-'), number, F.lit('"')))
        .when(case == 4, F.lit('"cwe": null')).otherwise(F.concat(F.lit('"cwe": "'), number, F.lit('"'))))
    severity = F.when(F.col("doc_id") % 2 == 1, ', "severity": "High"').otherwise("")
    languages = F.when(F.col("doc_id") % 3 == 0, '["Python", "C++", "ruby"]').when(
        F.col("doc_id") % 3 == 1, '"javascript"').otherwise('["generic"]')
    pick = F.col("doc_id") % 4
    pattern = (
        F.when(pick == 0, F.concat(F.lit(', "pattern": "'), "source", F.lit('($X)", "patterns": [{"pattern": "no"}]')))
        .when(pick == 1, F.concat(
            F.lit(', "pattern-either": [{"pattern": "'), "lang", F.lit('"}, {"pattern-regex": "'), "source",
            F.lit('"}, {"other": 1}, {"pattern": "fourth"}]')))
        .when(pick == 2, F.concat(F.lit(', "patterns": [{"pattern-not": "x"}, {"pattern": "'), "source", F.lit('"}]')))
        .otherwise(""))
    content = F.concat(
        F.lit('rules:\n- {"id": "r'), _text("doc_id"), F.lit('", "message": '), quoted(F.col("text")), F.lit(', "languages": '),
        languages, F.lit(', "severity": "WARNING", "metadata": {'), weakness, severity, F.lit("}"), pattern, F.lit("}\n- other\n"))
    path = F.concat("lang", F.lit("/"), "source", F.lit("/r"), _text("doc_id"), F.lit(".yml"))
    return _spread_docs(spark, sf).select(path.alias("rel_path"), F.concat(F.lit("/r/"), path).alias("path"), content.alias("content"))


@query(f"""WITH {RULES}
SELECT cwe_id, 'Semgrep: r' || doc_id AS title, md5(text) AS body, languages, severity AS severity_hint,
       CASE WHEN pattern <> '' THEN 1 ELSE 0 END::INTEGER AS n_examples FROM chunks""")
def rule_corpus(spark, sf):
    return rules.knowledge(rules.explode_rules(_rule_files(spark, sf))).select(
        "cwe_id", "title", F.md5("text").alias("body"), to_csv(F.col("languages")).alias("languages"),
        F.col("metadata")["severity_hint"].alias("severity_hint"), F.size("examples").alias("n_examples"))


# --- Knowledge rows ------------------------------------------------------------------

KNOWN = """
united AS (
  SELECT 0 AS rank, 'cwe' AS source, 'CWE-' || n_chars AS cwe_id, source || ' ' || text AS title, text, lang AS path, doc_id AS pos,
         'high' AS hint, lang || ',' || source AS languages FROM documents
  UNION ALL SELECT 1, 'owasp', NULL, role, text, lpad(conv_id::VARCHAR, 12, '0'), turn, NULL, '' FROM conversations
  UNION ALL SELECT 2, 'semgrep', 'CWE-' || item_id, 'item', text, '', item_id, 'low', 'go' FROM benchmark)
"""


def _known(spark, sf):
    def rows(df, source, cwe_id, title, path, pos, hint, languages):
        return df.select(
            F.lit(source).alias("source"), cwe_id.cast("string").alias("cwe_id"), title.alias("title"), "text",
            F.array().cast("array<string>").alias("examples"), languages.cast("array<string>").alias("languages"),
            F.create_map(F.lit("severity_hint" if hint else "other"), F.lit(hint or "")).alias("metadata"),
            path.alias("order_path"), pos.cast("bigint").alias("order_pos"))

    weakness = lambda c: F.concat(F.lit("CWE-"), _text(c))
    return knowledge.union_sources([
        rows(_docs(spark, sf), "cwe", weakness("n_chars"), F.concat_ws(" ", "source", "text"), F.col("lang"), F.col("doc_id"),
             "high", F.array("lang", "source")),
        rows(table(spark, sf, "conversations"), "owasp", F.lit(None), F.col("role"), F.lpad(_text("conv_id"), 12, "0"),
             F.col("turn"), None, F.array()),
        rows(table(spark, sf, "benchmark"), "semgrep", weakness("item_id"), F.lit("item"), F.lit(""), F.col("item_id"), "low",
             F.array(F.lit("go"))),
    ])


@query(f"""WITH {KNOWN},
numbered AS (SELECT *, row_number() OVER (ORDER BY rank, path, pos) - 1 AS idx FROM united)
SELECT source || '-' || lower(replace(coalesce(cwe_id, 'none'), '-', '')) || '-' || idx AS id, md5(text) AS document, source,
       coalesce(cwe_id, '') AS cwe_id, title[1:200] AS title, coalesce(hint, '') AS severity_hint, languages AS languages_csv
FROM numbered""")
def knowledge_records(spark, sf):
    numbered = knowledge.number_rows(_known(spark, sf), ["source_rank", "order_path", "order_pos"])
    return knowledge.to_records(numbered).select(
        "id", F.md5("document").alias("document"), "source", "cwe_id", "title", "severity_hint", "languages_csv")


@query(f"WITH {KNOWN} SELECT source, count(*) AS n FROM united GROUP BY source UNION ALL SELECT 'total', count(*) FROM united")
def source_counts(spark, sf):
    return knowledge.count_by_source(_known(spark, sf))


@query(f"""
WITH cat AS (WITH {RECORDS} SELECT 0 AS rank, 'cwe' AS source, cwe_id, text, '' AS path, doc_id AS pos, languages FROM chunks),
guide AS (WITH {SECTIONS}, cleaned AS (SELECT doc_id, section_no, {CLEANED} AS body FROM sections)
  SELECT 1 AS rank, 'owasp' AS source, ['CWE-89', 'CWE-79', 'CWE-22', 'CWE-352', NULL, 'CWE-89'][(1 + doc_id % 6)::INTEGER] AS cwe_id,
         body[1:2000] AS text, {list(NAMES)!r}[(1 + doc_id % 6)::INTEGER] || '_' || doc_id || '_Cheat_Sheet.md' AS path, section_no AS pos,
         NULL AS languages FROM cleaned WHERE length(body) >= 50),
rule AS (WITH {RULES} SELECT 2 AS rank, 'semgrep' AS source, cwe_id, text, lang || '/' || source || '/r' || doc_id || '.yml' AS path,
         0 AS pos, languages FROM chunks JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id)),
united AS (FROM cat UNION ALL FROM guide UNION ALL FROM rule),
numbered AS (SELECT *, row_number() OVER (ORDER BY rank, path, pos) - 1 AS idx FROM united)
SELECT source || '-' || lower(replace(coalesce(cwe_id, 'none'), '-', '')) || '-' || idx AS id, md5(text) AS document,
       CASE WHEN rank <> 1 THEN languages END AS languages FROM numbered""")
def knowledge_index(spark, sf):
    """The three corpora parsed, put together and numbered: the rows an index build stores."""
    united = knowledge.union_sources([
        catalogue.knowledge(catalogue.parse_records(_records(spark, sf))),
        guides.knowledge(_marked(spark, sf)),
        rules.knowledge(rules.explode_rules(_rule_files(spark, sf))),
    ])
    records = knowledge.to_records(knowledge.number_rows(store(united), ["source_rank", "order_path", "order_pos"]))
    return records.select(
        "id", F.md5("document").alias("document"), F.when(F.col("source") != "owasp", F.col("languages_csv")).alias("languages"))


@query("""
WITH new AS (SELECT o_orderkey AS id, 'X' AS status, max(version) AS total FROM
  (SELECT o_orderkey, unnest([1, 2]) AS version FROM orders WHERE o_orderstatus = 'F'
   UNION ALL SELECT -o_orderkey, 1 FROM orders WHERE o_orderstatus = 'P') GROUP BY o_orderkey)
SELECT id, status, total::DOUBLE AS total FROM new
UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT id FROM new)""")
def upsert_latest(spark, sf):
    """Orders with two newer versions of the finished ones, and new ones for the pending."""
    orders = table(spark, sf, "orders")
    current = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
    status = F.col("status")
    new = current.filter(status.isin("F", "P")).select(
        F.when(status == "F", F.col("id")).otherwise(-F.col("id")).alias("id"), F.lit("X").alias("status"),
        F.explode(F.when(status == "F", F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(1.0)))).alias("total"))
    return knowledge.upsert(current, new, "id", "total")


@query(f"WITH {KNOWN} SELECT source, path, pos, md5(text) AS text FROM united ORDER BY rank, path, pos LIMIT 5")
def peek_knowledge(spark, sf):
    first = knowledge.peek(_known(spark, sf), 5, ["source_rank", "order_path", "order_pos"])
    return first.select("source", F.col("order_path").alias("path"), F.col("order_pos").alias("pos"), F.md5("text").alias("text"))


# --- Code ----------------------------------------------------------------------------

LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)"

PIECE = "CASE WHEN i % 4 = 3 THEN 'class K' || i || ':' || chr(10) || '    def m(self):' || chr(10) || '        pass  # ' || l ELSE 'def f' || i || '(x):' || chr(10) || '    y = x  # ' || l END"


@query(f"""WITH {LINES},
pieces AS (SELECT *, {PIECE} AS code, CASE WHEN i % 4 = 3 THEN 3 ELSE 2 END AS height FROM lines),
placed AS (SELECT *, 3 + sum(height + 1) OVER (PARTITION BY doc_id ORDER BY i) - height - 1 AS line_start FROM pieces)
SELECT doc_id, CASE WHEN i % 4 = 3 THEN 'K' ELSE 'f' END || i AS name, CASE WHEN i % 4 = 3 THEN 'class' ELSE 'function' END AS chunk_type,
       line_start::INTEGER AS line_start, (line_start + height - 1)::INTEGER AS line_end, md5(code) AS code, height > 2 AS oversized
FROM placed""")
def segment_indented(spark, sf):
    """Each text as a Python file: a function or class per line, the line as a comment in it."""
    piece = lambda line, i: F.when(i % 4 == 3, F.concat(
        F.lit("class K"), i.cast("string"), F.lit(":\n    def m(self):\n        pass  # "), line)).otherwise(F.concat(
            F.lit("def f"), i.cast("string"), F.lit("(x):\n    y = x  # "), line))
    pieces = F.transform(F.split("text", "\n", -1), piece)
    files = _spread_docs(spark, sf).select(
        _text("doc_id").alias("path"), F.lit("python").alias("language"),
        F.concat(F.lit("import os\n\n"), F.array_join(pieces, "\n\n"), F.lit("\n")).alias("content"))
    return segment.segment_files(files, max_lines=2).select(
        F.col("file_path").cast("bigint").alias("doc_id"), "name", "chunk_type", "line_start", "line_end",
        F.md5("code").alias("code"), "oversized")


HEADS = {"javascript": ("function f", "(a) {"), "go": ("func f", "(a interface{}) (int, error) {"),
         "java": ("public static int f", "(int a) throws E {"), "c": ("static int *f", "(int a) {")}


def _braced(spark, sf):
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (1 + F.col("doc_id") % 4).cast("int"))
    before, after = pick([h[0] for h in HEADS.values()]), pick([h[1] for h in HEADS.values()])
    pieces = F.transform(F.split("text", "\n", -1), lambda line, i: F.concat(
        before, i.cast("string"), after, F.lit("\n  // }"), line, F.lit('\n  return "{";\n}')))
    return _spread_docs(spark, sf).select(
        F.concat(F.lit("src/"), _text("doc_id")).alias("path"), pick(HEADS).alias("language"),
        F.concat(F.lit("/* { */\n"), F.array_join(pieces, ";\n\n"), F.lit("\n")).alias("content"))


@query(rf"""WITH {LINES},
pieces AS (SELECT doc_id, i, CASE i % 2 WHEN 0 THEN 4 ELSE 3 END AS height,
  CASE i % 2 WHEN 0 THEN 'function f' || i || '(a) {{' || chr(10) || '  // }}' || l || chr(10) || '  return a / 2 + /[}}"/]\/{{/g.exec(a).length / 2;' || chr(10) || '}}'
             ELSE 'a =>' || chr(10) || '  a.replace(/[{{''`]/g, ''{{'')' || chr(10) || '    .split(''}}'')' END AS code FROM lines),
placed AS (SELECT *, 2 + sum(height) OVER (PARTITION BY doc_id ORDER BY i) - height AS line_start FROM pieces)
SELECT doc_id, CASE i % 2 WHEN 0 THEN 'f' || i ELSE '<anonymous>' END AS name, line_start::INTEGER AS line_start,
       (line_start + height - 1)::INTEGER AS line_end, md5(code) AS code FROM placed""")
def segment_literals(spark, sf):
    """Each text as a JavaScript file: functions with braces and quotes in regular expressions beside divisions, and arrow
    functions whose expressions span lines."""
    pieces = F.transform(F.split("text", "\n", -1), lambda line, i: F.when(i % 2 == 0, F.concat(
        F.lit("function f"), i.cast("string"), F.lit("(a) {\n  // }"), line, F.lit('\n  return a / 2 + /[}"/]\\/{/g.exec(a).length / 2;\n}'))).otherwise(F.concat(
            F.lit("const g"), i.cast("string"), F.lit(" = a =>\n  a.replace(/[{'`]/g, '{')\n    .split('}');"))))
    files = _spread_docs(spark, sf).select(
        _text("doc_id").alias("path"), F.lit("javascript").alias("language"), F.concat(F.lit("/* { */\n"), F.array_join(pieces, "\n")).alias("content"))
    return segment.segment_files(files).select(
        F.col("file_path").cast("bigint").alias("doc_id"), "name", "line_start", "line_end", F.md5("code").alias("code"))


@query(f"""WITH {LINES},
heads AS (SELECT *, {[h[0] for h in HEADS.values()]!r}[(1 + doc_id % 4)::INTEGER] AS before, {[h[1] for h in HEADS.values()]!r}[(1 + doc_id % 4)::INTEGER] AS after FROM lines)
SELECT doc_id, {list(HEADS)!r}[(1 + doc_id % 4)::INTEGER] AS language,
       CASE WHEN doc_id % 4 = 3 THEN '<anonymous>' ELSE 'f' || i END AS name, 'function' AS chunk_type,
       (2 + 5 * i)::INTEGER AS line_start, (5 + 5 * i)::INTEGER AS line_end,
       md5(before || i || after || chr(10) || '  // }}' || l || chr(10) || '  return "{{";' || chr(10) || '}}') AS code
FROM heads""")
def segment_braced(spark, sf):
    """Each text as a file in one of four languages: a function per line, braces in comments and literals."""
    return segment.segment_files(_braced(spark, sf)).select(
        F.substring("file_path", 5, 20).cast("bigint").alias("doc_id"), "language", "name", "chunk_type",
        "line_start", "line_end", F.md5("code").alias("code"))


@query("""SELECT doc_id, 'module' AS chunk_type, 'd' || doc_id || '.rb' AS name, 1::INTEGER AS line_start,
  greatest(len(string_split_regex(regexp_replace(text, '(\\r\\n|[\\n-\\r\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}])\\z', ''), '\\r\\n|[\\n-\\r\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]')), 1)::INTEGER AS line_end,
  md5(text) AS code FROM documents""")
def segment_whole(spark, sf):
    """Files without any block, of languages with and without rules, are one chunk each."""
    language = F.when(F.col("doc_id") % 2 == 0, "ruby").otherwise("go")
    name = F.concat(F.lit("d"), _text("doc_id"), F.lit(".rb"))
    files = _spread_docs(spark, sf).select(F.concat(F.lit("lib/"), name).alias("path"), language.alias("language"), F.col("text").alias("content"))
    return segment.segment_files(files).select(
        F.regexp_extract("file_path", r"d(\d+)", 1).cast("bigint").alias("doc_id"), "chunk_type", "name", "line_start", "line_end",
        F.md5("code").alias("code"))
