import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from railspoke.operators.packed import BAD_BRACKET, BAD_QUOTE, parse_value, split_packed


def elements(text):
    return [e for e, _ in parse_value(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []),
        ("", []),
        (" \xa0\t", []),
        (";,;", []),
        ("asphalt", ["asphalt"]),
        ("a;b,c|d/e+f&g\nh", list("abcdefgh")),
        ("  a ;; b ; ", ["a", "b"]),
        ("['a', 'b, c']", ["a", "b, c"]),
        ('["x","y"]', ["x", "y"]),
        ('{a,"b (alt)"}', ["a", "b (alt)"]),
        ('"so called ""asphalt""";grass', ['so called "asphalt"', "grass"]),
        ("concrete:plates;fine_gravel;x-y z", ["concrete:plates", "fine_gravel", "x-y z"]),
        ("l'a;b", ["l'a", "b"]),
        ('["a", ["b", "c"]]', ["a", "b", "c"]),
        ('"";a', ["a"]),
    ],
)
def test_elements(text, want):
    assert elements(text) == want


def test_errors_are_flagged_and_read_again():
    assert parse_value('a;"b;c') == [("a", ""), ('"b', BAD_QUOTE), ("c", "")]
    assert parse_value("[a;b") == [("[a", BAD_BRACKET), ("b", "")]


def test_hostile_values_take_linear_time():
    assert len(parse_value("[a," * 3000 + "]x" * 3000)) > 1000
    assert len(parse_value('"a;' * 20000)) == 20000
    assert elements("x" * 1_000_000 + ";y")[1] == "y"


def test_split_rows(spark):
    rows = spark.createDataFrame(
        [(1, "a;b", None, 9, "p"), (2, None, "c", 9, "q"), (1, "a;b", None, 9, "p"), (3, "", " ", 9, "r")],
        "row_id long, surface string, highway string, pos int, tag_field string",
    )
    got = sorted(map(tuple, split_packed(rows, "row_id", ["surface", "highway"], 2).collect()))
    assert got == [(1, "surface", 1, "a", None)] * 2 + [(1, "surface", 2, "b", None)] * 2
    assert split_packed(rows, "row_id", ["surface", "highway"]).count() == 5
    assert split_packed(rows.limit(0), "row_id", ["surface"]).count() == 0


# --- the same grammar once more, read naively by recursion over every alternative ---


def naive(text):
    seps, closers = ";,|/+&\n\r", {"[": "]", "{": "}"}

    def ws(i):
        while i < len(text) and text[i].isspace() and text[i] not in "\n\r":
            i += 1
        return i

    def boundary(i, close):
        i = ws(i)
        if i == len(text):
            return None if close else i
        return i if text[i] in seps or text[i] == close else None

    def quoted(i, close):
        q, i, body = text[i], i + 1, ""
        while i < len(text):
            if text[i] == q and text[i + 1 : i + 2] == q:
                body, i = body + q, i + 2
            elif text[i] == q:
                end = boundary(i + 1, close)
                return None if end is None else (end, [body])
            elif text[i] == "\\" and i + 1 < len(text):
                body, i = body + (q if text[i + 1] == q else text[i : i + 2]), i + 2
            else:
                body, i = body + text[i], i + 1
        return None

    def bare(i, close):
        j = i
        while j < len(text) and text[j] not in seps and text[j] != close:
            j += 1
        return j, [text[i:j]]

    def items(i, close):
        out = []
        while True:
            i = ws(i)
            if i == len(text):
                return i, out
            got = None
            if text[i] in "\"'":
                got = quoted(i, close)
            elif text[i] in closers:
                end, inner = items(i + 1, closers[text[i]])
                if end < len(text) and text[end] == closers[text[i]]:
                    after = boundary(end + 1, close)
                    got = None if after is None else (after, inner)
            i, found = got or bare(i, close)
            out += found
            if i < len(text) and text[i] in seps:
                i += 1
            else:
                return i, out

    return [e.strip() for e in items(0, "")[1] if e.strip()]


@given(st.text(alphabet="ab ;,|[]{}\"'\\\n", max_size=14))
@settings(max_examples=3000, deadline=None)
def test_same_as_the_naive_reading(text):
    assert [e for e, _ in parse_value(text)] == naive(text)


def test_any_depth():
    assert [e for e, _ in parse_value("[" * 20_000 + "a;b" + "]" * 20_000)] == ["a", "b"]
    for text in ("[" * 20_000 + "a", "[a;" * 20_000, "['" * 20_000, "[a]x;" * 20_000):
        assert parse_value(text)
