from pyspark.sql import functions as F

from auditmill import params as P
from auditmill.functions import lookup


def test_severity_words(values):
    rows = [("Remote Code Execution", ""), ("x", "SQL injection in y"), ("Path traversal", "denial of service"),
            ("Cross-site Scripting", ""), ("Open Redirect", ""), ("Something", "else")]
    got = values(rows, "n string, d string", lambda c: lookup.guess_severity(c("n"), c("d")))
    assert got == ["critical", "critical", "high", "high", "medium", "low"]


def test_first_keyword_wins(values):
    stems = ["SQL_Injection_Prevention_Cheat_Sheet", "XSS_Prevention", "Path-Traversal Guide", "LDAP_Injection", "Unknown", "CSRF"]
    got = values([(s,) for s in stems], "s string", lambda c: lookup.guide_weakness(c("s")))
    assert got == ["CWE-89", "CWE-79", "CWE-22", "CWE-89", None, "CWE-352"]


def test_languages_in_prose(values):
    texts = ["Python and JAVA.", "use C++ code", "node.js or nodejs", "JavaScript", "go, golang", "_c c_", "ÉC", "rails", "tsx ts"]
    got = values([(t,) for t in texts], "t string", lambda c: lookup.mentioned(c("t")))
    assert got == [["java", "python"], ["c"], ["javascript"], ["javascript"], ["go"], [], [], ["ruby"], ["typescript"]]


def test_language_names(values):
    rows = [(["Python", "C++", "python"],), (["COBOL"],), ([],)]
    got = values(rows, "l array<string>", lambda c: lookup.canonical_names(c("l"), P.CATALOGUE_LANGUAGES, P.CATALOGUE_DEFAULT_LANGUAGES))
    assert got == [["cpp", "python"], list(P.CATALOGUE_DEFAULT_LANGUAGES), list(P.CATALOGUE_DEFAULT_LANGUAGES)]
    assert values(rows, "l array<string>", lambda c: lookup.canonical_names(c("l"), P.RULE_LANGUAGES)) == [["cpp", "python"], [], []]


def test_weakness_ids(values):
    shapes = ['"CWE-89: SQL"', '"cwe-22"', '["CWE-79: X", "CWE-80"]', "null", '"not one"', "89", "[]", '"89"', "89.5", "true", '[89]']
    got = values([(s,) for s in shapes], "j string", lambda c: lookup.weakness_id(F.parse_json(c("j"))))
    assert got == ["CWE-89", "CWE-22", "CWE-79", None, None, "CWE-89", None, "CWE-89", None, None, "CWE-89"]


def test_first_truthy(values):
    rows = [(a, '"b"') for a in ('""', "null", "[]", "0", "false", "{}", '"a"', "[1]")]
    pick = lambda c: lookup.first_truthy(F.parse_json(c("a")), F.parse_json(c("b"))).cast("string")
    got = values(rows, "a string, b string", pick)
    assert got == ["b"] * 6 + ["a", "[1]"]


def test_csv(values):
    got = values([("python, java , go",), ("",), (" , ,",)], "t string", lambda c: lookup.parse_csv(c("t")))
    assert got == [["python", "java", "go"], [], []]
    assert values([(["a", "b"],), ([],), (None,)], "l array<string>", lambda c: lookup.to_csv(c("l"))) == ["a,b", "", ""]


def test_file_languages_and_severities(values):
    paths = ["a.py", "b.PY", "c.tsx", "d.txt", "e.hpp", "f.cjs", "noext", "x/__init__.py"]
    got = values([(p,) for p in paths], "p string", lambda c: lookup.file_language(c("p")))
    assert got == ["python", "python", "typescript", None, "cpp", "javascript", None, "python"]
    got = values([(p,) for p in paths], "p string", lambda c: lookup.fence_language(c("p")))
    assert got == ["python", "text", "typescript", "text", "cpp", "text", "text", "python"]
    names = ["critical", "info", "odd"]
    assert values([(s,) for s in names], "s string", lambda c: lookup.severity_rank(c("s"))) == [1, 5, None]
    assert values([(s,) for s in names], "s string", lambda c: lookup.severity_icon(c("s"))) == ["🔴", "⚪", "?"]


def test_plus_plus_counts_before_a_word_character(values):
    rows = [("Use C++11 here",), ("C++ and more",), ("cpp",), ("xc++1",)]
    assert values(rows, "a string", lambda c: lookup.mentioned(c("a"))) == [["c", "cpp"], ["c"], ["cpp"], []]


def test_most_texts_are_searched_for_words_once(spark):
    from pyspark.sql import functions as F
    plan = spark.range(1).select(lookup.mentioned(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert all(word in plan.split(" THEN ")[0] for word in ("python", "golang", "rails")), "one search for all words comes first"
    rows = spark.createDataFrame([("none here",), ("Go and c++11",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(lookup.mentioned(F.col("t"))).collect()] == [[], ["c", "cpp", "go"], [], []]
