import json

from hypothesis import given, settings, strategies as st

from ledgerloom.operators.nested import elements, flat_table, nodes, triples, triples_of

SCALARS = st.one_of(st.none(), st.booleans(), st.integers(-10**6, 10**6), st.text(max_size=5))
TREES = st.recursive(SCALARS, lambda x: st.one_of(st.lists(x, max_size=4), st.dictionaries(st.sampled_from(["a", "b/c", "d~", "content", ""]), x, max_size=4)), max_leaves=20)


def brute(value):
    """Elements of a parsed payload, by plain recursion."""
    out = []

    def read(x):
        while isinstance(x, str):
            try:
                y = json.loads(x, parse_constant=lambda c: 1 / 0)
            except Exception:
                return x
            if y == x:
                return x
            x = y
        return x

    def walk(x, pointer, parent):
        if isinstance(x, dict):
            for k, v in x.items():
                walk(read(v) if k == "content" else v, pointer + "/" + k.replace("~", "~0").replace("/", "~1"), parent)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                p = f"{pointer}/{i}"
                out.append((p, parent))
                walk(v, p, p)

    walk(read(value), "", "")
    return out


def found(text):
    return [(r[1], r[2]) for r in triples_of(text) if r[1] and not r[4]]


@settings(max_examples=300, deadline=None)
@given(TREES, st.booleans())
def test_against_recursion(tree, spaced):
    text = json.dumps(tree, indent=1 if spaced else None)
    assert found(text) == brute(text)
    assert found(json.dumps(text)) == brute(text)
    assert found(json.dumps({"content": text})) == [("/content" + p, "/content" + q if q else "") for p, q in brute(text)]


def test_defined_results():
    for bad in (None, "", "   ", "{", '{"a":[1,2', "[1,]", "[NaN]", "[1] x", '{"a" 1}', "nul", '["a\nb"]'):
        assert found(bad) == []
    assert found('{"a":[1],"a":[2,3]}') == [("/a/0", ""), ("/a/1", "")]
    assert found('{"content":"no json","x":"[1]"}') == []
    assert len(found("[" * 5000 + "]" * 5000)) == 4999
    assert found('["\\ud800"]') == [("/0", "")]


def test_tables(spark):
    payload = json.dumps({"rows": [{"k": "a", "v": 1, "sub": [{"x": None}]}, {"k": "b"}, 7]})
    df = spark.createDataFrame([(1, payload, "x"), (1, payload, "y"), (2, None, "z"), (None, "[1]", ""), (3, "[" + "1," * 50000 + "1]", "")], "env_id long, payload string, node_path string")
    assert elements(df).filter("env_id = 1").count() == 8
    assert elements(df).filter("env_id = 3").count() == 50001
    assert elements(df).filter("env_id is null").count() == 1
    t = triples(df.filter("env_id = 1").limit(1))
    rows = {r.node_path: r for r in flat_table(t, "/rows/*").collect()}
    assert rows["/rows/0"].k == "a" and rows["/rows/0"].v == "1" and rows["/rows/1"].v is None and rows["/rows/2"].value == "7"
    assert {r.node_path: r.parent_path for r in flat_table(t, "/rows/*/sub/*", ["/x"]).collect()} == {"/rows/0/sub/0": "/rows/0"}
    assert nodes(t).filter("`table` = '/rows/*'").count() == 3
    assert elements(df.limit(0)).count() == 0
