"""What the scores of the delimiter inference decide."""

from rankspark.operators.packed import infer_delimiters, split_packed


def test_rejected_candidate_does_not_split(spark):
    prose = "add love | and care | or none | whatever | so it is"
    rows = [(n, "a", f"{n} cups of rice; {n} eggs; {n} rolls") for n in range(9)] + [(10 + n, "b", prose) for n in range(9)]
    got = {}
    for r in split_packed(spark.createDataFrame(rows, "key long, source string, packed string"), "key", "source", "packed").collect():
        got.setdefault(r.key, []).append(r.item)
    assert all(len(got[n]) == 3 for n in range(9)) and all(got[10 + n] == [prose] for n in range(9))


def test_signs_inside_values_are_refused(spark):
    """A slash, a hyphen and a point stand inside values of one source; another one's lists are packed with slashes."""
    inside = [(n, "a", f"{n} 1/2 cups red-hot rice; 1/3 oz. eggs; 3-4 large rolls; 1.5 l cold milk; {n} tins of beans") for n in range(9)]
    slashes = [(10 + n, "b", f"{n} cups of rice / {n} large eggs / 12 small rolls / salt and pepper") for n in range(60)]
    frame = spark.createDataFrame(inside + slashes, "key long, source string, packed string")
    said = {(r.source, r.delimiter): r.accepted for r in infer_delimiters(frame, "source", "packed").collect()}
    assert {k for k, v in said.items() if v} == {("a", ";"), ("b", "/")} and {("a", "/"), ("a", "-"), ("a", ".")} < set(said)
    got = {}
    for r in split_packed(frame, "key", "source", "packed").collect():
        got.setdefault(r.key, []).append(r.item)
    assert all(len(got[n]) == 5 and got[n][3] == "1.5 l cold milk" for n in range(9)) and all(got[10 + n] == [f"{n} cups of rice", f"{n} large eggs", "12 small rolls", "salt and pepper"] for n in range(60))
