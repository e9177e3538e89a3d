"""Many rules by the index against every rule on every text."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runlake.operators import classify, rule_index as ri
from runlake.schemas import ERROR_RULES

RULE = "rule_id long, error_pattern string, category string, is_auto_fixable boolean"
RUN = "error_message string, error_code string"


@pytest.mark.parametrize(
    "pattern, literals",
    [
        ("OperationTimeout", ["OperationTimeout"]),
        ("TooManyRequests|429|RateLimitExceeded", ["429", "RateLimitExceeded", "TooManyRequests"]),
        (r"step \d+ failed at \w+", [" failed at "]),
        (r"(?:abc|defg)+hij", ["hij"]),
        (r"(long literal here)?x{2}yy", None),
        (r"a(bc)def", ["abcdef"]),
        (r"ab\.cd", ["ab.cd"]),
        (r"ab|\d+", None),
        (r".*", None),
        ("", None),
        (r"(?i)abcdef", None),
        (r"\Qabc.def\E", None),
        (r"[a[bc]]xyz", None),
        (r"[]abc]xyz", None),
        (r"(broken", None),
        (r"abcd\1", None),
        (r"colou?rful words", ["rful words"]),
        (r"abcd++efgh", ["abcd"]),
    ],
)
def test_required_literals(pattern, literals):
    found = ri.required_literals(pattern)
    assert found == literals or (pattern == r"abcd++efgh" and found in (["abc"], ["efgh"]))


PIECE = st.sampled_from(["abc", "abcdefghij", "x", "x?", "(?:ab|cde)", "(abc|defg)", "[ab]", "[^c]+", r"\d", r"\d{2}", "(abc){2}", "(?:xyz)*", ".", "a+", "^", "$", "|", "q{0,2}", r"\.", "(?:a|b|)"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECE, min_size=1, max_size=5).map("".join), st.lists(st.sampled_from(["abc", "abcdefghij", "x", "cde", "defg", "a", "c", "12", "xyz", "q", ".", "b"]), max_size=9).map("".join))
def test_every_match_holds_a_required_literal(pattern, text):
    literals = ri.required_literals(pattern)
    if literals is not None and re.search(pattern, text):
        assert any(x in text for x in literals)


def test_general_rules_give_what_the_case_gives(spark):
    words = ["OperationTimeout", "429", "TokenExpired", "503", "Connection reset", "ColumnNotFound", "404", "403", "DuplicateKey", "nothing", "operationtimeout"]
    rng = random.Random(1)
    rows = [(" ".join(rng.sample(words, rng.randint(0, 3))), rng.choice(["403", None, "x"])) for _ in range(150)] + [(None, None), ("", "429")]
    df = spark.createDataFrame(rows, RUN)
    table = spark.createDataFrame([(i, *x) for i, x in enumerate(ERROR_RULES)], RULE)
    columns = ["error_message", "error_code", "rule_id", "error_category", "is_auto_fixable", "confidence_score"]
    mine = ri.classify_by_table(df, table).select(columns).collect()
    case = classify.classify(df).select(columns).collect()
    assert sorted(map(repr, (tuple(r) for r in mine))) == sorted(map(repr, (tuple(r) for r in case)))


def many(n):
    return [(i, f"code-{i * 7919 % n:06}x[0-9]|E{i:07}(?:a|b)", ("auth", "infra")[i % 2], i % 3 == 0) for i in range(n)]


def test_fifty_thousand_rules_without_a_nested_loop(spark):
    n = 50_000
    rules = many(n) + [(n, r"^\d+$", "schema", False), (n + 1, "Zz", "permission", False), (n + 2, None, "auth", True), (None, "code", "auth", True)]
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        i, j = rng.randrange(n), rng.randrange(n)
        rows.append((rng.choice([f"at code-{i:06}x5 then E{j:07}b", f"E{i:07}c", f"has E{i:07}a", "12345", "pre Zz", f"code-{i:06}y", ""]), None))
    rows += [("one text that most share, E0000042a", None)] * 300
    df = spark.createDataFrame(rows, RUN)
    found = ri.classify_by_table(df, spark.createDataFrame(rules, RULE).repartition(4))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    known = [(i, re.compile(p)) for i, p, _, _ in sorted((r for r in rules if r[0] is not None and r[1]), key=lambda r: r[0])]
    by_code, by_number = {p.pattern.split("|")[0][:11]: i for i, p in known[:n]}, None
    assert len(by_code) == n and by_number is None
    expected = {}
    for text, _ in rows:
        full = (text or "") + " "
        near = {by_code[m] for m in re.findall(r"code-\d{6}", full)} | {int(m) for m in re.findall(r"E(\d{7})", full)} | {n, n + 1}
        expected[text] = min((i for i, p in known if i in near and p.search(full)), default=None)
    collected = found.collect()
    assert len(collected) == len(rows) and all(r["rule_id"] == expected[r["error_message"]] for r in collected)
    facts = {i: (c, x) for i, _, c, x in rules if i is not None}
    assert all((r["error_category"], r["is_auto_fixable"]) == (facts[r["rule_id"]] if r["rule_id"] is not None else ("unknown", False)) for r in collected)


def test_an_index_too_large_to_broadcast_is_joined(spark, monkeypatch):
    monkeypatch.setattr(ri, "BROADCAST_GRAMS", 10)
    df = spark.createDataFrame([("E0000042a", None), ("none", None)], RUN)
    found = ri.classify_by_table(df, spark.createDataFrame(many(100), RULE))
    assert {r["error_message"]: r["rule_id"] for r in found.collect()} == {"E0000042a": 42, "none": None}


def test_no_text_travels_once_for_each_of_its_grams(spark, monkeypatch):
    """Of a joined index: what is dealt out for a gram has a number for the text, and equal numbers do no harm."""
    monkeypatch.setattr(ri, "BROADCAST_GRAMS", 10)
    texts = spark.createDataFrame([("E0000042a and E0000007a",), ("none",)], "text string")
    found = ri.matched(texts, spark.createDataFrame(many(100), RULE))
    assert [(r["text"], r["rule_id"]) for r in found.collect()] == [("E0000042a and E0000007a", 7)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, \(gram#\d+L = gram#\d+L\)", plan)  # whole numbers on both sides
    assert not re.search(r"Project \[text#\d+, gram#", plan)


def test_too_many_patterns_without_a_literal_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(ri, "MOST_OPEN", 2)
    df = spark.createDataFrame([("x", None)], RUN)
    with pytest.raises(ValueError):
        ri.classify_by_table(df, spark.createDataFrame([(i, "." * (i + 1), "auth", True) for i in range(3)], RULE))


def test_no_rules(spark):
    found = ri.classify_by_table(spark.createDataFrame([("x", None)], RUN), spark.createDataFrame([], RULE)).first()
    assert found["rule_id"] is None and found["error_category"] == "unknown" and found["confidence_score"] == 0
