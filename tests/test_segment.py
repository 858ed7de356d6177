import pytest

from auditmill.operators import segment

PYTHON = '''import os

@deco
def first(
    a,
):
    """doc
zero indent def inside(x):
    """
    # note
    return {
1: 2}

# tail
if os:
    async def second(): pass
    x = 1
class Third(object):
    def hidden(self):
        def deeper(): pass
        return """x
  """
s = "def no(): pass"
'''

JAVASCRIPT = """import x from 'y';
const f = (a, {b}) => { return a; };
export default async function main(p = {a: 1}) {
  // }
  const s = "}" + `}${p}`;
  items.map(x => x + 1);
}
class K extends B { m() { return 1; } }
const o = { run(a) { if (a) { return 2; } }, go: function() {} };
const g = x => x * 2;
app.get('/x', async (req, res) => {
  res.send('{');
});
function* gen() { const inner = () => { return 1; }; }
"""

JAVA = """package p;
@Rest(a = "}", b = {1, 2})
public class Users<T> extends Base {
    private int n;
    public Users() { }
    // }
    int get(String s) throws E { return s.charAt('{'); }
}
interface I { void a(int x); default int b() { return 1; } }
enum E { A, B; E(int x) { } }
"""

GO = """package main
type S struct { a int }
var m = map[string]interface{}{"}": 1}
func one(w http.ResponseWriter, x interface{}) (int, error) {
	if x != nil { return 1, nil }
	s := `}`
	return 0, nil
}
func (s *S) Two() interface{} { return struct{}{} }
func empty() {}
"""

C = """#include <stdio.h>
#define A(x) { x }
static const char *name(int a,
    char **b)
{
    if (a) { return "}"; }
    return 0;
}
int proto(int);
struct s { int a; };
int main(void) { return 0; }
"""

CPP = """#define A(x) { x }
namespace n {
template <typename T> class Foo : public Bar { int a; void m() { if (a) {} } };
enum class Color { Red };
struct P { int get() const { return 1; } };
std::vector<int> run(const std::string& s, int n = 3) noexcept {
  /* } */ return {};
}
Foo::Foo(int a) : x(a), y(b) { }
}
"""

EXPECTED = {
    ("a.py", "python", PYTHON): [
        ("function", "first", 4, 12), ("function", "second", 16, 16), ("class", "Third", 18, 22)],
    ("a.js", "javascript", JAVASCRIPT): [
        ("function", "<anonymous>", 2, 2), ("function", "main", 3, 7), ("class", "K", 8, 8), ("function", "run", 9, 9),
        ("function", "<anonymous>", 9, 9), ("function", "<anonymous>", 10, 10), ("function", "<anonymous>", 11, 13),
        ("function", "<anonymous>", 14, 14)],
    ("a.java", "java", JAVA): [
        ("class", "Users", 2, 8), ("function", "a", 9, 9), ("function", "b", 9, 9), ("class", "E", 10, 10)],
    ("a.go", "go", GO): [("function", "one", 4, 8), ("function", "Two", 9, 9), ("function", "empty", 10, 10)],
    ("a.c", "c", C): [("function", "<anonymous>", 3, 8), ("function", "<anonymous>", 11, 11)],
    ("a.cpp", "cpp", CPP): [
        ("class", "Foo", 3, 3), ("function", "<anonymous>", 5, 5), ("function", "<anonymous>", 6, 8), ("function", "<anonymous>", 9, 9)],
    ("b.py", "python", "def half(a,\n   b"): [("function", "half", 1, 2)],
    ("c.py", "python", "LIMIT = 3  # rows\nprint(LIMIT)\n"): [("module", "c.py", 1, 2)],
    ("d.rb", "ruby", "module A; end"): [("module", "d.rb", 1, 1)],
    ("e.js", "javascript", ""): [("module", "e.js", 1, 1)],
    ("f.py", "python", "def load(p):\n    return p\n\n\ndef store():\n    ...\n"): [("function", "load", 1, 2), ("function", "store", 5, 6)],
    ("g.java", "java", "// c\npublic String run(String in) throws Exception {\n  return in;\n}"): [("function", "run", 2, 4)],
    ("i.js", "javascript", "const r = /[{/\"]}'/gi, h = a / b / c;\nfunction f(x) {\n  if (/}/.test(x)) { return x++ / 2; }\n  return /`/;\n}\nlet i = 1; i++ / 2; function g() { }\n"): [
        ("function", "f", 2, 5), ("function", "g", 6, 6)],
    ("j.ts", "typescript", "export const f = (a: number) =>\n  a +\n  b.map(x => ({ x }))\n   .filter(y => y);\nconst t = z => [z, { z }];\nconst u = () =>\n  v\n  || w\nlet q = 1;\n"): [
        ("function", "<anonymous>", 1, 4), ("function", "<anonymous>", 5, 5), ("function", "<anonymous>", 6, 8)],
    ("k.js", "javascript", "a = b\n/ c / d;\nfunction h() { return [1].map(e => e / 2) }\nconst k = <p>{x}</p>;\n"): [("function", "h", 3, 3)],
    ("h.ts", "typescript", "abstract class A { go(x: number): Promise<void> { } }\nexport function f<T>(x: T): T { return x; }"): [
        ("function", "go", 1, 1), ("function", "f", 2, 2)],
}


@pytest.fixture(scope="module")
def chunks(spark):
    files = spark.createDataFrame(list(EXPECTED), "path string, language string, content string")
    return segment.segment_files(files, max_lines=5).collect()


@pytest.mark.parametrize("file", list(EXPECTED), ids=lambda f: f[0])
def test_blocks(chunks, file):
    # The ordinal is not kept; line and length put blocks of one line in order.
    rows = [r for r in chunks if r["file_path"] == file[0]]
    at = {id(r): file[2].find(r["code"]) for r in rows}
    rows.sort(key=lambda r: (r["line_start"], at[id(r)]))
    assert [(r["chunk_type"], r["name"], r["line_start"], r["line_end"]) for r in rows] == EXPECTED[file]
    lines = file[2].split("\n")
    for r in rows:
        assert at[id(r)] >= 0 and r["code"].count("\n") in (r["line_end"] - r["line_start"], r["line_end"])
        assert r["code"].split("\n")[0] in lines[r["line_start"] - 1]
        assert r["oversized"] == (r["line_end"] - r["line_start"] + 1 > 5)


def test_keys_are_unique(chunks):
    assert len({r["chunk_id"] for r in chunks}) == len(chunks)


def test_nothing_is_shuffled_or_sent_to_python(spark):
    files = spark.createDataFrame(list(EXPECTED), "path string, language string, content string")
    plan = segment.segment_files(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan.replace("scan existing", "")


def test_long_files_do_not_overflow(spark):
    text = 'x = "' + "a\\n" * 200_000 + '"\n/* ' + "* " * 150_000 + "*/\nfunction f(a) {\n" + "  g('}');\n" * 20_000 + "}\n" + "w " * 50_000
    rows = segment.segment_files(spark.createDataFrame([("l.js", "javascript", text)], "path string, language string, content string")).collect()
    assert [(r["name"], r["line_start"], r["line_end"]) for r in rows] == [("f", 3, 20_004)]


def test_a_further_language(spark):
    """A language is an entry in the tables: extensions, and heads of its blocks."""
    rust = segment.BracedLanguage(segment.BRACED["c"].blanks, (segment.Head("function", r"fn\s+(\w+)\s*\([^(){}]*\)[^{};]*\{"),))
    files = spark.createDataFrame(
        [("a.rs", "rust", "use x;\nfn go(a: u8) -> u8 {\n  a\n}\n"), ("b.lua", "tabbed", "fun a\n\tx\nfun b\n\ty\n")],
        "path string, language string, content string")
    rows = segment.segment_files(files, braced={"rust": rust}, indented={"tabbed": r"^([ \t]*)(fun)[ \t]+(\w+)"}).collect()
    assert sorted((r["name"], r["line_start"], r["line_end"]) for r in rows) == [("a", 1, 2), ("b", 3, 4), ("go", 2, 4)]


def test_blocks_are_cut_from_their_own_lines(spark):
    rows = [("a.js", "javascript", "😀; a = 'é}'; function f(x) {\n  // }\n} function g() { return 1 }; /* }\n} */ class A {\r\n}\n"),
            ("b.c", "c", "int a; static\nint *h(int a) {\n  return '}'; }"),
            ("c.go", "go", None)]
    chunks = segment.segment_files(spark.createDataFrame(rows, "path string, language string, content string"))
    assert [(r["file_path"], r["line_start"], r["line_end"], r["code"]) for r in chunks.orderBy("file_path", "ordinal" if "ordinal" in chunks.columns else "line_end").collect()] == [
        ("a.js", 1, 3, "function f(x) {\n  // }\n}"), ("a.js", 3, 3, "function g() { return 1 }"), ("a.js", 4, 5, "class A {\r\n}"),
        ("b.c", 1, 3, "static\nint *h(int a) {\n  return '}'; }"), ("c.go", 1, 1, None)]
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan, "an object for every character"
    assert "substring(content" not in plan, "counts from the first character of the file for every block"
