import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rankspark.operators.packed import infer_delimiters, split_packed

SEPARATORS = "\n\r\t;|·•"


def brute(text):
    """Character by character: values of one string."""
    tidy = lambda s: " ".join(s.split())
    if text is None or not text.strip():
        return []
    if text.strip().startswith("[") and text.strip().endswith("]"):
        try:
            return [tidy(v) for v in json.loads(text) if tidy(v)]
        except ValueError:
            pass

    def cut(separators):
        values, found, now, i, fresh = [], set(), "", 0, True
        while i < len(text):
            c = text[i]
            if fresh and c == '"' and not now.strip():
                j, inner = i + 1, ""
                while j < len(text) and text[j] != '"' or text[j : j + 2] == '""':
                    step = 2 if text[j : j + 2] == '""' else 1
                    inner += text[j]
                    j += step
                if j < len(text):
                    now, i, fresh = inner, j + 1, False
                    continue
            if c in separators:
                found.add(c)
                values.append(now)
                now, fresh = "", True
            else:
                fresh = fresh and c.isspace()
                now += c
            i += 1
        return [*values, now], found

    values, found = cut(SEPARATORS + ",")
    if found - {","}:
        values, _ = cut(SEPARATORS)
    return [tidy(v) for v in values if tidy(v)]


def split(spark, rows):
    frame = spark.createDataFrame(rows, "key long, source string, packed string, position string, chars string, delimiter string")
    out = {}
    for r in split_packed(frame, "key", "source", "packed").collect():
        out.setdefault(r.key, []).append((r.position, r.item))
    return {k: [i for _, i in sorted(v)] for k, v in out.items()}


CASES = [
    '1 cup flour\r\n2 eggs, beaten\r\n', "a; b;; c", '"1 crust for a 9"" pan"||2 cups milk', '3 eggs,"2 kg rice, washed",1 tsp salt', '["1 oz \\"fine\\" salt", "2 ½ cups  milk", ""]',
    "Topping: · 2 eggs · 3 rolls", "• 12 eggs•4 ml oil", 'x | "a; or b" | y\n2 c', '1 crust for a 9" pan\t2 eggs', "7-grain bread, to serve", '"2 cups honey,\nto serve",1 egg', None, "", "  \n", ",,;", '"unclosed; 2 eggs',
    "2 cups a; 3 cups b", "1 a|2 b",
]


def test_cases(spark):
    """Null, blank, quoted, bracketed and mixed strings; repeated rows; columns named as inside the operator."""
    rows = [(i, "s", c, "x", "y", "z") for i, c in enumerate(CASES)]
    assert split(spark, rows + rows) == {i: brute(c) for i, c in enumerate(CASES) if brute(c)}


def test_long_text_null_source_and_empty_table(spark):
    long = "; ".join(f'"{n} cups of thing, number ""{n}"""' for n in range(20_000))
    got = split(spark, [(1, None, long, "", "", ""), (2, None, "y" * 300_000, "", "", "")])
    assert got[1] == brute(long) and len(got[1]) == 20_000 and got[2] == ["y" * 300_000]
    assert split(spark, [(1, "s", None, "", "", "")]) == {}
    empty = spark.createDataFrame([], "key long, source string, packed string")
    assert split_packed(empty, "key", "source", "packed").count() == 0


value = st.sampled_from(["2 eggs", "1 cup milk, warm", "½ kg rice", "salt to taste", "For serving:", "3 large 9\" tins"])


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.lists(value, min_size=1, max_size=6), st.sampled_from(["\n", "; ", " | ", "\t", ",", " • "]), st.booleans()), min_size=5, max_size=20))
def test_against_brute_force(spark, lists):
    quoted = lambda v: '"' + v.replace('"', '""') + '"'
    packed = [s.join(quoted(v) if q or ("," in v and s == ",") else v for v in vs) for vs, s, q in lists]
    anchor = "; ".join(["1 cup a", "2 cups b"]), "1 cup a\n2 eggs", "1 a | 2 b", "1 a\t2 b", "1 a • 2 b"
    every = [*packed, *anchor]
    assert split(spark, [(i, f"s{i % 3}", p, "", "", "") for i, p in enumerate(every)]) == {i: brute(p) for i, p in enumerate(every) if brute(p)}


def test_inference_rejects_what_is_no_delimiter(spark):
    rows = [("a", f"{n} cups of rice; {n} eggs; {n} rolls") for n in range(9)] + [("b", "add love | and care | or none | whatever | so it is")] * 9
    said = {(r.source, r.delimiter): r.accepted for r in infer_delimiters(spark.createDataFrame(rows, "source string, packed string"), "source", "packed").collect()}
    assert said == {("a", ";"): True, ("b", "|"): False}


@pytest.mark.parametrize("partitions", [1, 7])
def test_same_for_any_partitioning(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert split(spark, [(i, "s", c, "", "", "") for i, c in enumerate(CASES)]) == {i: brute(c) for i, c in enumerate(CASES) if brute(c)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
