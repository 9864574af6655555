"""Front ends, graphs, taint and detectors; the labelled programs are the main body of cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.plans import cases
from faultline.scan import brace_front, engine, python_front, specs
from faultline.scan.detect import line_rules, regex_danger
from faultline.scan.ir import Graph, calls, dotted, folded, shown


def found(name, text, **k):
    return [(f.line, f.type, f.source_line) for f in engine.scan_text(name, text, **k)[0]]


@pytest.mark.parametrize("case", range(len(cases.CASES)))
def test_labelled_program(case):
    i, suffix, _, text = cases.CASES[case]
    got = found("x" + suffix, text.replace("QQ", "41"))
    assert sorted(map(str, got)) == sorted(str((line, kind, s)) for c, line, kind, s in cases.LABELS if c == i)


@pytest.mark.parametrize("language", ["c", "cpp", "java", "csharp", "javascript"])
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abx01 \n(){}[];,=+-*/<>!&|.\"'`$#:?@", max_size=120))
def test_no_text_breaks_a_front_end(language, text):
    module = brace_front.read(text, language)
    for f in module.functions:
        Graph(f.body, f.line).order()


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_any_file_scans(text):
    for name in ("a.py", "a.c", "a.js", "a.java", "a.cs", "a.cpp", "none"):
        engine.scan_text(name, text)


def test_files_that_cannot_be_read():
    assert engine.scan_text("a.py", None) == ([], ["no such file"])
    assert engine.scan_text("a.py", "def f(:\n")[1]
    assert engine.scan_text("a.js", "x" * 2001)[1] == ["generated"]
    assert found("a.py", "\ufeffeval(input())\n") == [(1, "code_injection", 1)]


def test_library_mode_takes_exported_parameters():
    text = "function f(a) { require('child_process').execSync(a); }\nmodule.exports = { f };\n"
    assert found("a.js", text) == [] and found("a.js", text, library_mode=True) == [(1, "command_injection", 1)]


def test_rows_of_the_user():
    extra = tuple(specs.read_rows('# own\n{"language": "python", "name": "mylib.run", "role": "sink", "kind": "shell", "args": [0]}'))
    text = "import mylib\nx = input()\nmylib.run(x)\n"
    assert found("a.py", text) == [] and found("a.py", text, extra=extra) == [(3, "command_injection", 2)]
    with pytest.raises(ValueError, match="role"):
        specs.read_rows('{"language": "python", "name": "a", "role": "other"}')


def test_names_are_spelled_and_found_by_suffix():
    assert specs.spelled("{a,b}.{c,d}") == ["a.c", "a.d", "b.c", "b.d"]
    lib = specs.library("python")
    assert lib.find("sink", "app.db.cursor.execute").name == "cursor.execute" and lib.find("sink", "x.nothing") is None
    assert all(len(specs.rows(x)) > 200 for x in specs.TABLES)


def test_graphs():
    body = python_front.read("def f(a):\n    while True:\n        if a:\n            break\n        a = g(a)\n    return a\n").functions[0].body
    g = Graph(body)
    assert g.reaches(0, {1}, set()) and [n.kind for n in g.nodes].count("head") == 1
    body = python_front.read("def f():\n    while True:\n        g()\n").functions[0].body
    assert not Graph(body).reaches(0, {1}, set())
    body = brace_front.read("void f(int a) { switch (a) { case 1: return; default: a = 2; } exit(1); }", "c").functions[0].body
    assert not [e for n in (Graph(body).nodes[3:]) for e in n.next if e[0] == 1 and n.stmt and n.stmt.kind != "return"]


def test_expressions():
    read = lambda t, lang="c": brace_front.Parser(brace_front.tokens(t, lang == "javascript"), lang).expr()
    for text, want in (("(7 * 18) + 106 > 200", 1), ("0x1F + 017 + 0b11", 49), ("-7 / 2", -3), ("-7 % 2", -1), ("1 << 4 | 1", 17), ("3 > 2 ? 8 : 9", 8)):
        assert folded(read(text), {}) == want, text
    assert folded(read("n + 1"), {"n": 4}) == 5 and folded(read("n / 0"), {"n": 4}) is None
    e = read("a.b(c[1], d(x => x + 1))", "javascript")
    assert [dotted(c.kids[0]) for c in calls(e)] == ["d", "a.b"] and shown(e).startswith("a.b(c[1]")


@pytest.mark.parametrize(("pattern", "bad"), [("(a+)+", True), ("(a|ab)*c", True), ("([a-z]+)*$", True), ("(\\w+\\s?)*", True), ("(?:x{2,}y)+", True), ("(ab)+", False), ("a+b+", False), ("[a+]+", False), ("(a|b)+", False), ("(\\d{3}-)+", False), ("(a+)?", False)])
def test_regex_danger(pattern, bad):
    assert regex_danger(pattern) is bad


def test_line_rules_leave_comments_alone():
    assert line_rules("/* rand(); \n*/ int a;\n// rand();\nint r = rand();\n") == [(4, 338)]


def test_a_scan_is_one_task_a_batch(spark):
    df = spark.createDataFrame([("a.py", "eval(input())\n", 1), ("b.py", None, 2), (None, "x = 1\n", 3)], "filename string, text string, file int")
    rows = engine.scan(df).collect()
    assert {(r.file, r.line, r.error) for r in rows} == {("a.py", 1, None), ("b.py", None, "no such file")}
    assert "Exchange" not in engine.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert engine.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("callers_first", [True, False])
def test_chains_of_calls_settle_in_any_order(callers_first):
    """Twenty wrappers around a sink, and around free: what the last one does reaches the first caller."""
    parts = [f"def f{i}(x):\n    f{i + 1}(x)\n" for i in range(20)] + ["def f20(x):\n    eval(x)\n"]
    found, errors = engine.scan_text("a.py", "".join(parts if callers_first else parts[::-1]) + "f0(input())\n")
    assert [f.type for f in found] == ["code_injection"] and not errors
    parts = ["void run(void) {\n  char *p = malloc(8);\n  if (!p) return;\n  g0(p);\n  free(p);\n}\n"] + [f"void g{i}(char *p) {{\n  g{i + 1}(p);\n}}\n" for i in range(20)] + ["void g20(char *p) {\n  free(p);\n}\n"]
    found, errors = engine.scan_text("a.c", "#include <stdlib.h>\n" + "".join(parts if callers_first else parts[::-1]))
    assert "double_free" in [f.type for f in found] and not errors


def test_line_rules_in_the_jvm_equal_those_in_python(spark):
    from faultline.operators.line_rules import c_line_rules
    from faultline.plans.programs import C_LINES

    lines = [text for text, _ in C_LINES]
    texts = ["\n".join(lines), "/* " + "\n".join(lines[:5]) + " */\n" + "\n".join(lines[5:]), "\n".join(f"x / y; // {t}" for t in lines), "/* open\n" + lines[0], "a /**/ " + lines[1] + " /* b\n\n*/ " + lines[2], "", "/" * 5000 + "\n" + lines[3], "x" * 200_000 + "\n" + lines[4]]
    df = spark.createDataFrame([*((str(i), t, 1) for i, t in enumerate(texts)), ("n", None, 1)], "filename string, text string, line int")
    want = sorted((str(i), line, f"CWE-{cwe}") for i, t in enumerate(texts) for line, cwe in line_rules(t))
    assert sorted(map(tuple, c_line_rules(df).collect())) == want and len(want) > 20


def test_files_of_one_split_are_dealt_over_tasks(spark):
    """A small table has one split, however long its files take to scan."""
    rows = spark.range(0, 2000, 1, 1).selectExpr("concat('f', id, '.py') AS filename", "'eval(input())\\n' AS text")
    for made in (engine.scan(rows), engine.facts(rows)):
        tasks = made.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("file").alias("files")).collect()
        assert sum(t.files for t in tasks) == 2000
        assert len(tasks) >= 8 and max(t.files for t in tasks) <= 300
    assert engine.scan(rows.limit(0)).count() == 0
