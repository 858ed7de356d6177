import os

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from auditmill.functions import text
from auditmill.sources import files, trees
from auditmill.sources.ignore import is_ignored


def write(root, name, data=b"x = 1\n"):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


@pytest.fixture()
def tree(tmp_path):
    for name in ("main.py", "pkg/__init__.py", "pkg/_priv.py", ".hidden.py", ".dot/in.py", "UP.PY", "a.js", "deep/x/y/z.go",
                 "notes.txt", "node_modules/lib.js", "deep/.venv/q.py", "secret.py", "logs/out.py", "logs/keep.py", "noext"):
        write(tmp_path, name)
    write(tmp_path, "limit.py", b"#" * 1_048_576)
    write(tmp_path, "over.py", b"#" * 1_048_577)
    write(tmp_path, "bad.py", b"a\r\nb\rc \xff\xc3\xa9\n")
    write(tmp_path, ".gitignore", b"# c\nsecret.py\nlogs/\n!logs/keep.py\n")
    os.symlink(tmp_path, tmp_path / "deep" / "loop")
    return tmp_path


def names(df, root):
    return sorted(os.path.relpath(r["path"], root) for r in df.select("path").collect())


EXPECTED = [".dot/in.py", ".hidden.py", "UP.PY", "a.js", "bad.py", "deep/x/y/z.go", "limit.py", "logs/keep.py", "main.py",
            "pkg/__init__.py", "pkg/_priv.py"]


def test_tree(spark, tree):
    df = files.load_files(spark, str(tree))
    assert names(df, tree) == EXPECTED
    rows = {os.path.basename(r["path"]): r for r in df.collect()}
    assert rows["bad.py"]["content"] == "a\nb\nc �é\n"
    assert rows["bad.py"]["size_bytes"] == 11
    assert rows["z.go"]["language"] == "go" and rows["UP.PY"]["language"] == "python"


def test_options(spark, tree):
    flat = files.load_files(spark, str(tree), recursive=False)
    assert names(flat, tree) == [n for n in EXPECTED if "/" not in n]
    assert names(files.load_files(spark, str(tree), languages=["go", "javascript"]), tree) == ["a.js", "deep/x/y/z.go"]


def test_single_file_passes_by_the_exclusions(spark, tree):
    assert files.load_files(spark, str(tree / "secret.py")).count() == 1
    assert files.load_files(spark, str(tree / "node_modules" / "lib.js")).count() == 1
    assert files.load_files(spark, str(tree / "notes.txt")).count() == 0
    assert files.load_files(spark, str(tree / "over.py")).count() == 0


def test_a_further_extension(spark, tree):
    write(tree, "x.rs")
    df = files.load_files(spark, "file://" + str(tree), extensions={".rs": "rust"})
    assert [r["language"] for r in df.collect()] == ["rust"]


def test_missing_and_empty_directories(spark, tmp_path):
    assert files.load_texts(spark, str(tmp_path / "none"), [".md"], True).count() == 0
    assert files.load_files(spark, str(tmp_path)).count() == 0


def test_pushed_filters_decide_in_the_source(spark, tree):
    spark.conf.set(trees.PUSHDOWN, "true")
    try:
        found = trees.listing(spark, str(tree)).filter("suffix = '.py' AND size_bytes <= 100 AND depth < 2 AND rel_path <> 'main.py'")
        plan = found._jdf.queryExecution().executedPlan().toString()
        filtered = [line for line in plan.splitlines() if "Filter" in line and "BatchScan" not in line]
        assert not any("size_bytes" in line or "suffix" in line or "depth" in line for line in filtered) and any("rel_path" in line for line in filtered)
        got = sorted(r.rel_path for r in found.collect())
    finally:
        spark.conf.unset(trees.PUSHDOWN)
    same = trees.listing(spark, str(tree)).filter("suffix = '.py' AND size_bytes <= 100 AND depth < 2 AND rel_path <> 'main.py'")
    assert got == sorted(r.rel_path for r in same.collect())
    assert got == [".dot/in.py", ".hidden.py", "UP.PY", "bad.py", "logs/keep.py", "logs/out.py", "pkg/__init__.py", "pkg/_priv.py", "secret.py"]
    tests = trees.Tests()
    for item, taken in ((D.EqualTo(("suffix",), ".py"), True), (D.In(("suffix",), (".py", ".go")), True), (D.GreaterThan(("size_bytes",), 2), True),
                        (D.EqualTo(("depth",), 1), True), (D.IsNotNull(("path",)), True), (D.EqualTo(("path",), "x"), False), (D.StringContains(("suffix",), "p"), False)):
        assert tests.take(item) is taken
    assert tests.hold(".py", 1, 3) and not tests.hold(".go", 1, 3) and not tests.hold(".py", 2, 3) and not tests.hold(".py", 1, 2) and tests.deepest() == 1


def test_planned_partitions_cover_the_tree_once(tree, monkeypatch):
    monkeypatch.setattr(trees, "SHARE_FILES", 3)
    for i in range(20):
        write(tree, f"many/f{i}.c")
    want = sorted(str(p.relative_to(tree)) for p in tree.rglob("*") if p.is_file() and "loop" not in p.parts)
    for width in (1, 2, 5, 1000):
        reader = trees.TreeReader(str(tree), True, ["node_modules"], trees.Tests(), width)
        planned = reader.partitions()
        got = [rel for part in planned for batch in reader.read(part) for rel in batch.column(1).to_pylist()]
        assert sorted(got) == [w for w in want if "node_modules" not in w]
        if width == 1000:
            many = [p for p in planned if p.rel_paths == ("many",)]
            assert len(many) == 7 and max(b.num_rows for p in many for b in reader.read(p)) < 20
        assert len(planned) <= 2 * width + 15
    assert trees.TreeReader(str(tree / "none_here"), True, [], trees.Tests(), 4) is not None


def test_names_leave_in_bounded_batches(tmp_path, monkeypatch):
    monkeypatch.setattr(trees, "BATCH_ROWS", 100)
    for i in range(1050):
        write(tmp_path, f"n{i}.py", b"")
    reader = trees.TreeReader(str(tmp_path), True, [], trees.Tests(), 1)
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [100] * 10 + [50]
    remote = [e for e in trees.entries(f"file://{tmp_path}")]
    assert len(remote) == 1050


def test_suffix_as_the_expression_has_it(values):
    rows = [(n,) for n in ("a.py", "A.PY", ".py", "..py", ".a.py", "a.", "a..b", "a", "x.tar.gz", "...", "a.b.")]
    assert values(rows, "n string", lambda c: F.lower(text.suffix(c("n")))) == [trees.suffix_of(n) for (n,) in rows]


CASES = {
    "*.log": (["a.log", "d/b.log", "c.log/x"], ["a.logs"]),
    "/top": (["top", "top/x"], ["d/top"]),
    "dir/": (["dir/x", "a/dir/y"], ["dir"]),
    "a/b": (["a/b", "a/b/c"], ["x/a/b"]),
    "**/x": (["x", "q/x", "q/x/y"], ["xx"]),
    "q/**": (["q/a", "q/a/b"], ["q", "z/q/a"]),
    "a/**/b": (["a/b", "a/x/b", "a/x/y/b"], ["ab", "a/xb"]),
    "f?.[ch]": (["f1.c", "d/fx.h"], ["f.c", "f1.d", "f/.c"]),
    "[!a]z": (["bz"], ["az"]),
    r"\#x": (["#x"], ["x"]),
    "# no": ([], ["# no", "no"]),
    "sp ": (["sp"], ["sp "]),
    "*.a.b": (["x.a.b"], ["x.aXb"]),
}


def test_ignore_lines(values):
    for line, (hit, miss) in CASES.items():
        rows = [(p,) for p in hit + miss]
        assert values(rows, "p string", lambda c: is_ignored(c("p"), [line])) == [True] * len(hit) + [False] * len(miss), line


def test_last_line_decides(values):
    lines = ["*.py", "!keep.py", "d/keep.py"]
    rows = [("a.py",), ("keep.py",), ("d/keep.py",), ("x.js",)]
    assert values(rows, "p string", lambda c: is_ignored(c("p"), lines)) == [True, False, True, False]
    assert values(rows, "p string", lambda c: is_ignored(c("p"), [])) == [False] * 4


def test_only_names_and_sizes_are_needed_to_select(spark):
    table = spark.createDataFrame([("a.py", "text", 3)], "rel_path string, content string, size_bytes bigint")
    assert [r["language"] for r in files.select_files(table).collect()] == ["python"]
    assert files.select_files(table, ["go"]).count() == 0
    assert files.select_files(table, max_bytes=2).filter(F.lit(True)).count() == 0


def test_files_are_read_in_batches_of_some_megabytes(spark, tmp_path):
    import pyarrow as pa

    from auditmill.session import BATCH_LIMITS
    from auditmill.sources import files
    (tmp_path / "f").write_bytes(b"x" * (1 << 20))
    names = [str(tmp_path / "f")] * 40
    listed = pa.RecordBatch.from_arrays([pa.array(names), pa.array(names), pa.array([1 << 20] * 40)], names=["path", "rel_path", "size_bytes"])
    sizes = [b.nbytes for b in files._read_files(iter([listed]))]
    assert len(sizes) > 4 and max(sizes) < 10 << 20
    files.read_listed(spark.createDataFrame([(names[0], "f", 1)], "path string, rel_path string, size_bytes bigint"))
    assert all(spark.conf.get(name, None) for name in BATCH_LIMITS)
