import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chatterloom.operators.packed import BLANKS, ENCLOSING, NO_VALUE, SEPARATORS, split_values, unpack


def one(text):
    parent, pos, many, values = split_values(pa.array(["x", text, "y"], pa.string()))
    return [v for p, v in zip(parent, values.to_pylist()) if p == 1]


@pytest.mark.parametrize(
    "text, values",
    [
        (None, []), ("", []), (" \t ", []), ("NA", []), (" nan ", []), ("a", ["a"]),
        ("a, b;c|d+e\tf\ng • h，i、j；k", list("abcdefghijk")),
        ("a +  + b,", ["a", "b"]), (",;,", []), ('""', []),
        ('"Read, save or print", x', ["Read, save or print", "x"]),
        ("'Chart, table or map'\n“a; b”\t«c | d»", ["Chart, table or map", "a; b", "c | d"]),
        ('"Alarm ""sic"""，x', ['Alarm "sic"', "x"]),
        (json.dumps(["A", 'B "so called"', "c, d"]), ["A", 'B "so called"', "c, d"]),
        ("doctor's findings, it's", ["doctor's findings", "it's"]), ('5" pipe, b', ['5" pipe', "b"]),
        ("*a*, b (likely), c/d - e", ["*a*", "b (likely)", "c/d - e"]), (" a , 　b", ["a", "b"]),
        ('"a" and "b", c', ['"a" and "b"', "c"]), ("«a", ["«a"]),
        ("«“'a'”», b", ["a", "b"]),
    ],
)
def test_cases(text, values):
    assert one(text) == values


def scalar(text):
    """One character after another; double quotes only, balanced."""
    out, cur, inside = [], "", False
    for c in text:
        inside ^= c == '"'
        if c in SEPARATORS and not inside:
            out.append(cur)
            cur = ""
        else:
            cur += c
    values = []
    for v in [*out, cur]:
        v = v.strip(BLANKS)
        if len(v) > 1 and v[0] == v[-1] == '"' and '"' not in v[1:-1].replace('""', ""):
            v = v[1:-1].replace('""', '"').strip(BLANKS)
        if v:
            values.append(v)
    return [] if len(values) == 1 and values[0] in NO_VALUE else values


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet='ab ",;、é', max_size=12), max_size=6))
def test_against_scalar(texts):
    texts = [t for t in texts if t.count('"') % 2 == 0]
    parent, pos, many, values = split_values(pa.array(texts, pa.string()))
    got = [[v for p, v in zip(parent, values.to_pylist()) if p == i] for i in range(len(texts))]
    assert got == [scalar(t) for t in texts]
    assert [int(x) for x in pos] == [k + 1 for g in got for k in range(len(g))]


def test_table(spark):
    df = spark.createDataFrame([(1, "a,b", None, 5), (1, "a,b", "", 5), (2, "x" * 100_000 + ",y", "c", 6)], "id long, f string, g string, pos int")
    rows = unpack(df, ["id"], ["f", "g"]).collect()
    assert len(rows) == 7 and {r.tag_field for r in rows} == {"f", "g"}
    assert unpack(df.limit(0), ["id"], ["f"]).count() == 0
    assert ENCLOSING
