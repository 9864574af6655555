import pytest

from faultline.operators import fixpoint
from faultline.sources import readers


def test_yaml_subset():
    text = 'a: 1\nb:\n  - x: "q: r"\n    y: [1, two, \'3\']\n  - z\nc:\n- p: true\n  q:\n    - 4\n# end\nd: ~\n'
    assert readers.parse_yaml(text) == {"a": 1, "b": [{"x": "q: r", "y": [1, "two", "3"]}, "z"], "c": [{"p": True, "q": [4]}], "d": None}
    assert readers.parse_yaml("") is None
    assert readers.parse_yaml("a: \"b # c\" # d\nb: it's # e\nc: 'x' #y\nd: p#q\n#\ne: [\"#\", 1] # f") == {"a": "b # c", "b": "it's", "c": "x", "d": "p#q", "e": ["#", 1]}
    with pytest.raises(readers.YamlProblem):
        readers.parse_yaml("a: 1\n   b: 2\n")


def test_findings_of_odd_texts(spark):
    rows = [(1, "[]"), (2, None), (3, "not json"), (4, '{"files": []}'), (5, '{"vulnerabilities": null}'), (6, '[{"type": "t"}]')]
    got = readers.read_findings(spark.createDataFrame(rows, "k int, text string")).collect()
    assert [(r.k, r.type, r.line) for r in got] == [(6, "t", None)]


def test_a_failed_verdict_keeps_the_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string")

    def call(row):
        if row["k"] == 1:
            raise ValueError("no")
        return True, 0.5

    assert sorted(tuple(r) for r in readers.adjudicated(df, call, ["k"]).collect()) == [(1, None, None), (2, True, 0.5)]


def test_fixpoint_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)], "src long, dst long")
    got = {tuple(r) for r in fixpoint.reachable(spark.createDataFrame([(0,)], "node long"), edges).collect()}
    assert got == {(i, i) for i in range(71)}
