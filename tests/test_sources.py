import json
import os

import pytest
from pyspark.sql import functions as F

from auditmill import params as P
from auditmill.sources import catalogue, guides, onefile, rules

XML = """<?xml version="1.0"?>
<Weakness_Catalog xmlns="http://x" xmlns:xhtml="http://y"><Weaknesses>
<Weakness ID="89" Name="SQL Injection &amp; &quot;more&quot;" Abstraction="Base"
  Status="Stable"><!-- n --><Description>Builds a
 query &lt;b&gt; &#233; here.</Description>
<Extended_Description><xhtml:p> one </xhtml:p><xhtml:p>two<xhtml:br/>three</xhtml:p></Extended_Description>
<Related_Weaknesses><Related_Weakness ID="1"/></Related_Weaknesses>
<Applicable_Platforms><Language Name="Python" Prevalence="Often"/><Language Class="X" Name="C++"/></Applicable_Platforms>
<Potential_Mitigations><Mitigation><Phase>P</Phase><Description>%s</Description></Mitigation>
<Mitigation Mitigation_ID="M"><Description><xhtml:p>second</xhtml:p></Description></Mitigation><Mitigation><Description> </Description></Mitigation></Potential_Mitigations>
<Demonstrative_Examples><Demonstrative_Example><Example_Code Nature="good">safe</Example_Code>
<Example_Code Nature="bad" Language="C"><xhtml:div>if (x &lt; 3 &amp;&amp; y)<xhtml:br/> run();</xhtml:div></Example_Code>
<Example_Code Language="C" Nature='bad'>%s</Example_Code><Example_Code Nature="bad"> </Example_Code><Example_Code Nature="bad">c3</Example_Code>
<Example_Code Nature="bad">c4</Example_Code></Demonstrative_Example></Demonstrative_Examples>
</Weakness>
<Weakness ID="7" Name="Plain" Status="Draft"><Potential_Mitigations><Mitigation><Description>only here</Description></Mitigation></Potential_Mitigations></Weakness>
<Weakness ID="9" Name="Old" Status="Deprecated"><Description>gone</Description></Weakness>
<Weakness Name="No id" Status="Draft"><Description>x</Description></Weakness>
<Weakness ID="10" Name="C" Status="Draft"><Description><![CDATA[a < b]]> &amp; c</Description></Weakness>
</Weaknesses></Weakness_Catalog>
""" % ("m" * 400, "z" * 600)


@pytest.fixture()
def catalogue_rows(spark, tmp_path):
    path = tmp_path / "c.xml"
    path.write_text(XML, encoding="utf-8")
    return catalogue.parse_records(catalogue.read_catalogue(spark, str(path)))


def test_catalogue(catalogue_rows):
    rows = {r["cwe_id"]: r for r in catalogue_rows.collect()}
    first = rows["CWE-89"]
    assert first["name"] == 'SQL Injection & "more"' and first["status"] == "Stable"
    assert first["description"] == "Builds a\n query <b> é here."
    assert first["details"] == "one two three"
    assert first["languages"] == ["cpp", "python"]
    assert first["examples"] == ["if (x < 3 && y) run();", "z" * 500, "c3"]
    assert first["mitigations"] == ["m" * 300, "second"]
    assert rows["CWE-7"]["description"] == "" and rows["CWE-7"]["languages"][-1] == "cpp"
    assert rows["CWE-10"]["description"] == "a < b & c"
    assert {r[0] for r in catalogue.valid_ids(catalogue_rows).collect()} == {"CWE-89", "CWE-7", "CWE-9", "CWE-10"}


def test_catalogue_knowledge(catalogue_rows):
    rows = {r["cwe_id"]: r for r in catalogue.knowledge(catalogue_rows).collect()}
    assert set(rows) == {"CWE-89", "CWE-7", "CWE-10"}
    first = rows["CWE-89"]
    assert first["title"] == 'CWE-89: SQL Injection & "more"'
    assert first["text"] == ('Name: SQL Injection & "more"\n\nDescription: Builds a\n query <b> é here.\n\n'
                             "Details: one two three\n\nMitigations: " + "m" * 300 + " | second")
    assert first["metadata"]["severity_hint"] == "critical"
    assert rows["CWE-7"]["text"] == "Name: Plain\n\nMitigations: only here"


def test_missing_catalogue_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        catalogue.read_catalogue(spark, str(tmp_path / "none.xml"))


LONG = "word " * 20
GUIDES = {
    "SQL_Injection_Prevention_Cheat_Sheet.md":
        f"# Title\n\nIntro in Python {LONG}\n\n## One\n\n{LONG}\r\n\r\n\r\n\r\n[a](b) <i>C++</i>\n\n## Short\n\nx\n\n##  Two \n```\n## in code\n{LONG}\n```",
    "XSS.md": f"# Only title\n\n{LONG * 60}",
    "_hidden.md": f"no title {LONG}",
    "empty.md": "",
    "sub/other.md": f"## A\n{LONG}",
    "notes.txt": f"## A\n{LONG}",
}


@pytest.fixture()
def guide_dir(tmp_path):
    for name, text in GUIDES.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(text.encode())
    return str(tmp_path)


def test_guides(spark, guide_dir):
    rows = guides.knowledge(guides.read_guides(spark, guide_dir)).orderBy("order_path", "order_pos").collect()
    got = [(r["order_path"], r["title"], r["cwe_id"], r["languages"]) for r in rows]
    name = "SQL_Injection_Prevention_Cheat_Sheet.md"
    assert got == [
        (name, "OWASP: SQL Injection Prevention — Title", "CWE-89", ["python"]),
        (name, "OWASP: SQL Injection Prevention — One", "CWE-89", ["c"]),
        (name, "OWASP: SQL Injection Prevention — in code", "CWE-89", []),
        ("XSS.md", "OWASP: XSS — Only title", "CWE-79", []),
        ("_hidden.md", "OWASP:  hidden — Overview", None, []),
    ]
    assert rows[1]["text"] == f"{LONG}\n\na C++"
    assert len(rows[3]["text"]) == 2000 and rows[3]["text"].startswith("# Only title")
    assert guides.read_guides(spark, guide_dir + "/none").count() == 0


def test_sections(values):
    texts = ["# Top\nlead in\n## P\n\nq\nr\n## S\nt", "# T\n\nbody", "## P\nq\n## Nil\n \n\n## R\n\ns", "", "x\n## A\nb",
             "no start\n# Late\nrest\n## A\nb"]
    got = values([(t,) for t in texts], "t string", lambda c: guides.sections(c("t")))
    pairs = [[(s["title"], s["body"]) for s in r] for r in got]
    assert pairs == [
        [("Top", "lead in"), ("P", "q\nr"), ("S", "t")], [("T", "# T\n\nbody")], [("P", "q"), ("R", "s")], [("Overview", "")],
        [("Introduction", "x"), ("A", "b")], [("Late", "no start\n# Late\nrest"), ("A", "b")]]


def rule(**more):
    return {"id": "r", "languages": ["python"], "message": " m ", "severity": "ERROR", "pattern": "eval($X)", "metadata": {"cwe": "CWE-95: x"}, **more}


RULES = {
    "a/one.yml": [rule(), "no rule", rule(id="second", languages="Go", metadata={"cwe": ["CWE-1", "CWE-2"], "severity": "HIGH"})],
    "a/two.yaml": [rule(metadata={}), rule(metadata=None), rule(languages=["ruby"]), rule(languages=["python", "C++", "generic"], pattern=None)],
    "b/_three.yml": [{k: v for k, v in rule(metadata={"cwe": "", "cwe2022-top25": 20}).items() if k not in ("id", "pattern")}],
    "b/four.yml": [rule(**{"pattern-either": [{"pattern": "p1"}, {"pattern-regex": "p2"}, {"other": 1}, {"pattern": "p4"}]})],
    "tests/five.yml": [rule()],
    "b/test_six.yml": [rule()],
}


@pytest.fixture()
def rule_dir(tmp_path):
    RULES["b/four.yml"][0].pop("pattern", None)
    for name, listed in RULES.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(json.dumps({"rules": listed}))
    (tmp_path / "b" / "broken.yml").write_text("rules: [a: b: c")
    (tmp_path / "b" / "list.yml").write_text("- a\n- b\n")
    (tmp_path / "b" / "text.yml").write_text("rules: nothing\n")
    return str(tmp_path)


def test_rules(spark, rule_dir):
    rows = rules.knowledge(rules.explode_rules(rules.read_rule_files(spark, rule_dir))).orderBy("order_path", "order_pos").collect()
    got = [(r["order_path"], r["title"], r["cwe_id"], r["languages"], r["examples"], r["metadata"]["severity_hint"]) for r in rows]
    assert got == [
        ("a/one.yml", "Semgrep: r", "CWE-95", ["python"], ["eval($X)"], "error"),
        ("a/one.yml", "Semgrep: second", "CWE-1", ["go"], ["eval($X)"], "high"),
        ("a/two.yaml", "Semgrep: r", "CWE-95", ["cpp", "python"], ["None"], "error"),
        ("b/_three.yml", "Semgrep: _three", "CWE-20", ["python"], [], "error"),
        ("b/four.yml", "Semgrep: r", "CWE-95", ["python"], ["p1\np2"], "error"),
    ]
    assert rows[0]["text"] == "Description: m\n\nSeverity: error\n\nVulnerable pattern:\neval($X)"
    assert rules.read_rule_files(spark, rule_dir + "/none").count() == 0


def test_rule_without_severity(spark):
    listed = [{"id": 5, "languages": ["c"], "metadata": {"cwe": 1}, "patterns": [{"pattern-not": "a"}, {"pattern": "b"}]}]
    files = spark.createDataFrame([("/x/q.yml", "q.yml", json.dumps({"rules": listed}))], "path string, rel_path string, content string")
    row = rules.knowledge(rules.explode_rules(files)).first()
    assert (row["title"], row["text"], row["metadata"]["severity_hint"]) == ("Semgrep: 5", "Vulnerable pattern:\nb", "medium")
    assert rules.explode_rules(files.filter(F.lit(False))).count() == 0


def test_rules_are_looked_up_once(spark):
    """Each look-up stands in the plan once, however many columns and filters use it."""
    given = spark.createDataFrame([("a.yml", "a.yml", RULE_TEXT)], "path string, rel_path string, content string")
    plan = rules.knowledge(rules.explode_rules(given))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("variant_get") < 20
    row = rules.knowledge(rules.explode_rules(given), P.TextLimits(rule_message=3, rule_pattern_items=1)).first()
    assert row.text == "Description: abc\n\nSeverity: true\n\nVulnerable pattern:\np1" and row.examples == ["p1"] and row.cwe_id == "CWE-7"


RULE_TEXT = """rules:
- id: true
  message: "  abcdef "
  languages: [Python]
  severity: ERROR
  metadata: {severity: true, cwe: "x CWE-7 y"}
  pattern-either: [{pattern: p1}, {pattern-regex: p2}]
"""


def test_one_file_of_ordered_lines(spark, tmp_path):
    path = str(tmp_path / "out.txt")
    rows = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("id")).orderBy("id").select(F.col("id").cast("string").alias("value"))
    onefile.write_lines(rows, path)
    assert open(path).read().split("\n") == [*map(str, range(1000)), ""]
    boom = F.udf(lambda v: 1 / 0 if v == "500" else v, "string")
    with pytest.raises(Exception):
        onefile.write_lines(rows.select(boom("value")), path)
    assert open(path).read().split("\n") == [*map(str, range(1000)), ""], "a write that fails leaves the old file"
    onefile.write_lines(rows.limit(0), path)
    assert open(path).read() == "" and os.listdir(tmp_path) == ["out.txt"]
    onefile.write_lines(spark.createDataFrame([(None,), ("é\nx",)], "v string").coalesce(1), path)
    assert open(path, encoding="utf-8").read() == "\né\nx\n"


def test_limits_reach_every_corpus(spark):
    text = spark.createDataFrame([("g.md", "g.md", "# T\n## S\n" + "word " * 40)], "path string, rel_path string, content string")
    assert [len(r.text) for r in guides.knowledge(text, P.TextLimits(chunk_text=60)).collect()] == [60]
    assert guides.knowledge(text, P.TextLimits(section_minimum=1000)).count() == 0


def test_digest_of_a_file_is_streamed(spark, tmp_path, monkeypatch):
    import hashlib
    import inspect

    from auditmill.bindings import findings
    from auditmill.sources import onefile
    path, body = tmp_path / "r.md", "é\r\nx\n".encode() * 5000 + b"end"
    path.write_bytes(body)
    monkeypatch.setattr(onefile, "COPY_BYTES", 1000)
    assert [tuple(r) for r in onefile.read_digest(spark, str(path)).collect()] == [(hashlib.md5(body).hexdigest(), 10000)]
    assert "wholetext" not in inspect.getsource(findings.report_file)
