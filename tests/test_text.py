import pathlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditmill.functions import text

BREAKS = "a \t\n\r\x0b\x0c\x1c\x1e\x1f\x85\xa0\u2028\u2029\u3000\u200b\ufeffé😀|"
TEXTS = ["", "\n", "a", "a\n", "a\r\nb\rc\n\n", "\x0b\x0cx\x1d\x85y\u2028\u2029", "\u3000\xa0\u2003q\x1f\n"]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=BREAKS, max_size=12), min_size=30, max_size=60))
def test_strip_and_split_like_python(values, cases):
    cases = cases + TEXTS
    rows = [(c,) for c in cases]
    assert values(rows, "t string", lambda c: text.strip(c("t"))) == [c.strip() for c in cases]
    assert values(rows, "t string", lambda c: text.split_lines(c("t"))) == [c.splitlines() for c in cases]


def numbered(code, first):
    lines = code.splitlines()
    width = len(str(first + len(lines)))
    return "\n".join(f"{first + i:>{width}} | {line}" for i, line in enumerate(lines))


def test_line_numbers(values):
    rows = [("a\nb", 1), ("a\nb", 10), ("pass", 5), ("\n".join("x" * 9), 1), ("x\n" * 3, 98), ("", 7)]
    got = values(rows, "t string, f int", lambda c: text.number_lines(c("t"), c("f")))
    assert got == [numbered(*r) for r in rows]
    assert got[3].startswith(" 1 | x")


def test_snippets_of_a_chunk(values):
    code = "l1\nl2\nl3\nl4"
    rows = [(code, 10, s, e) for s in (-3, 9, 10, 12, 13, 40, 10**12) for e in (-5, 9, 11, 13, 99, 10**12)]
    got = values(rows, "t string, b bigint, s bigint, e bigint",
                 lambda c: text.chunk_snippet(c("t"), c("b"), c("s"), c("e")))
    want = []
    for _, base, s, e in rows:
        low = max(0, s - base)
        want.append("\n".join(code.splitlines()[low:max(low + 1, e - base + 1)]))
    assert got == want


def test_snippets_of_a_file(values):
    rows = [("a\nb\nc", s, e) for s in (-1, 0, 1, 2, 3, 5) for e in (0, 1, 2, 3, 9)]
    got = values(rows, "t string, s int, e int", lambda c: text.file_snippet(c("t"), c("s"), c("e")))
    assert got == ["\n".join("abc"[max(0, s - 1):min(3, e)]) for _, s, e in rows]


def test_markup_is_cleaned(values):
    rows = [(" <b>x</b> [link](http://a/b) \n\n\n\n y ",), ("a < b > c",), ("[x] (y)",)]
    assert values(rows, "t string", lambda c: text.clean_markup(c("t"))) == ["x link \n\n y", "a  c", "[x] (y)"]


def test_decoding(values):
    raw = ["ok".encode(), b"a\r\nb\rc", b"x\xff\xfe\xc3\xa9\xe2\x82y", b"", b"\xf0\x9f\x98\x80"]
    got = values([(bytearray(r),) for r in raw], "t binary", lambda c: text.decode_text(c("t")))
    assert got == [r.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n") for r in raw]


def test_names_of_files(values):
    paths = ["a/b.PY", "x.tar.gz", ".gitignore", "d.d/noext", "a/.b.js", "a.", "/q/Guide One.md", "c++.cpp"]
    rows = [(p,) for p in paths]
    assert values(rows, "t string", lambda c: text.base_name(c("t"))) == [pathlib.PurePosixPath(p).name for p in paths]
    known = [p for p in paths if p != "a."]
    rows = [(p,) for p in known]
    assert values(rows, "t string", lambda c: text.suffix(c("t"))) == [pathlib.PurePosixPath(p).suffix for p in known]
    assert values(rows, "t string", lambda c: text.stem(c("t"))) == [pathlib.PurePosixPath(p).stem for p in known]


def test_small_forms(values):
    assert values([("x" * 30,), ("x" * 31,)], "t string", lambda c: text.ellipsis(c("t"), 30)) == ["x" * 30, "x" * 30 + "..."]
    assert values([(0.29,), (0.999,), (1.0,)], "p double", lambda c: text.percent(c("p"))) == [28, 99, 100]
    joined = lambda c: text.join_parts([c("a"), F.lit(None), F.lit(""), F.lit("z")], "-")
    assert values([("a",), (None,)], "a string", joined) == ["a-z", "z"]


def test_white_space_is_taken_off_the_ends_only(values):
    """By a trim, which looks at the ends: a regular expression tried every blank in between."""
    from auditmill.functions import text
    ends = "\t \x0b\x1c\x1f\x85\xa0     　\r\n"
    rows = [(ends + "a" + ends + "b" + ends,), (ends,), ("​x",), ("",), (None,)]
    assert values(rows, "a string", lambda c: text.strip(c("a"))) == ["a" + ends + "b", "", "​x", "", None]
    from pyspark.sql import functions as F
    assert "regexp" not in str(text.strip(F.col("a")))
