import pytest
from pyspark.sql import functions as F

from veritab.functions import canonical as cn
from veritab.functions import text as tx
from veritab.functions.patterns import InvalidPattern, to_java

DECIMALS = {
    "1,234.50": "1234.5", "1,2,3": "123", "-0.00": "0", "+007": "7", ".5": "0.5", "-.50": "-0.5", "5.": "5", "00.10": "0.1", "1.50e2": "150", "12e-3": "0.012", "0e5": "0",
    "": None, " 1": None, ".": None, "--1": None, "abc": None, "1e100001": None, "1\n": None, "123456789012345678901234567890123456789012.10": "123456789012345678901234567890123456789012.1",
}
DATES = {
    "9:05": "09:05:00.0000000", "12:30 AM": "00:30:00.0000000", "12:30 pm": "12:30:00.0000000", "23:59:59,12": "23:59:59.1200000", "13:00 PM": None, "24:00": None, "7:5": None,
    "7/4/2026": "2026-07-04T00:00:00.0000000Z", "2026-07-17": "2026-07-17T00:00:00.0000000Z", "2026-02-30": None, "0099-01-01": None, "2026-07-17T10:00+02:00": "2026-07-17T08:00:00.0000000Z",
    "2026-07-17 10:00:00.1239999": "2026-07-17T10:00:00.1230000Z", "2026-07-17T10:00": "2026-07-17T10:00:00.0000000Z", "2026-12-31T23:30-01:00": "2027-01-01T00:30:00.0000000Z",
}


@pytest.mark.parametrize("function, cases", [(cn.decimal, DECIMALS), (cn.date, DATES)])
def test_canonical(spark, function, cases):
    got = spark.createDataFrame([(k,) for k in cases], "x string").select("x", function(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in got} == cases


def test_order_of_comparison_steps(spark):
    rows = spark.createDataFrame([("  ",), (" ada ",), (None,)], "x string")
    value, failed = cn.comparison_value(F.col("x"), trim=True, case_fold=True, blank_null=True)
    assert [tuple(r) for r in rows.select(value, failed).collect()] == [(None, False), ("ADA", False), (None, False)]
    value, failed = cn.comparison_value(F.col("x"), kind="decimal")
    assert [r[0] for r in rows.select(failed).collect()] == [True, True, False]


def test_text(spark):
    row = spark.createDataFrame([(" ﻿a\t ", "\U0001f600", "x" * 161)], "a string, b string, c string")
    got = row.select(tx.trimmed(F.col("a")), tx.length(F.col("b")), tx.display(F.col("c")), tx.canonical([F.col("a").isNull().cast("string"), F.lit(None).cast("string")])).first()
    assert got[0] == "a" and got[1] == 2 and got[2] == "x" * 157 + "..." and got[3] == "V5:falseN;"


def test_patterns(spark):
    rows = spark.createDataFrame([("12",), ("12\n",), ("a b",), ("﻿",)], "x string")
    found = lambda p, **o: [r[0] for r in rows.select(F.col("x").rlike(to_java(p, **o))).collect()]
    assert found(r"^\d+$") == [True, False, False, False]
    assert found("^a.b$") == [False] * 4
    assert found(r"^\s$") == [False, False, False, True]
    assert found("A[^]B", ignore_case=True) == [False, False, True, False]
    for bad in ("[unterminated", "(", "a\\"):
        with pytest.raises(InvalidPattern):
            to_java(bad)


VALID = {
    # pattern: (texts that it finds something in, texts in which it doesn't)
    r"(?<=a+)b$": (["aab", "ab"], ["b", "cb"]), r"(?<!a*x)b": (["ab"], ["aaxb"]), r"^(?<y>\d{4})-\k<y>$": (["2024-2024"], ["2024-2025"]), r"^a{2}$": (["aa"], ["a", "a{2}"]), r"^a{,2}$": (["a{,2}"], ["aa"]), r"^x{$": (["x{"], ["x"]),
    r"^[\d-x]+$": (["1-x"], ["y"]), r"^[^\S]$": ([" ", "　"], ["a"]), r"^[\S\n]$": (["a", "\n"], [" "]), r"^\p{L}$": (["p{L}"], ["a"]), r"^\cJ$": (["\n"], ["J"]), r"^\c$": (["\\c"], ["c"]), r"^\v$": (["\x0b"], ["\n"]), r"^[\b]$": (["\x08"], ["b"]),
    r"^\0$": (["\0"], ["0"]), r"^\101$": (["A"], ["101"]), r"^\8$": (["8"], []), r"^(a)\1$": (["aa"], ["a"]), r"^\1(a)$": (["a"], ["aa"]), r"^(a\1)$": (["a"], ["aa"]), r"^(a)\10$": (["a\x08"], ["aa0"]), r"^\u0041\x42$": (["AB"], []), r"^\ud83d\ude00$": (["\U0001f600"], []),
    r"\bé": ([], ["é"]), r"é\b": ([], ["é"]), r"\Bé\B": (["é"], ["aé"]), r"^(?=a)*a$": (["a"], ["b"]), r"^(?i:a)b$": (["Ab", "ab"], ["AB"]), r"^(?s:.)$": (["\n"], []), r"^(?m:^b$)": (["b", "b\nc"], ["a\nb"]), r"(?m:^b$)": (["a\nb"], ["ab"]), r"^a]}$": (["a]}"], []),
    r"^[[]&&[^a]$": (["[&&b"], ["[&&a"]), r"^(?:(?<n>a)|(?<n>b))\k<n>$": (["aa", "bb"], ["ab"]), r"^\k<n>$": (["k<n>"], []), r"^[a-]$": (["-", "a"], ["b"]), r"^[]-a]$": ([], ["-"]), r"[^]": (["\n"], [""]), r"a{99999999999}": ([], ["a"]), r"^\-\/$": (["-/"], []), r"^#x ~$": (["#x ~"], []), r"": ([""], []),
    r"(?<=^(?:ab?)?)c": (["abc", "ac", "c"], ["bc"]), r"(?<=(?:ab)+)c": (["ababc"], ["bc"]), r"^a??b+?$": (["b", "abb"], ["aab"]),
}
INVALID = ["a++", "(?>a)", "a**", "a?+", "*a", "+", "?", "{1}", "a{2,1}", "(", ")", "a)", "(?", "(?a)", "[a", "[b-a]", "a\\", "(?<=a)*", "(?<!a)+", "^*", "$+", "\\b?", "(?<1>a)", "(?<n>a)(?<n>b)", "(?<n>a)\\k<m>", "(?<n>a)\\k", "(?ii:a)", "(?i-i:a)", "(?-:a)", "(?P<n>a)", "(?#c)", "[\\d-\\w", "(?:", "x{1}{2}", "(?<=(?:ab*)+)c"]


def test_ecmascript_patterns(spark):
    cases = [(p, t, want) for p, (good, bad) in VALID.items() for want, texts in ((True, good), (False, bad)) for t in texts]
    for p in VALID:
        assert to_java(p) and to_java(p, ignore_case=True) or p == ""
    rows = spark.createDataFrame([(t,) for _, t, _ in cases], "t string")
    found = rows.select(*(F.col("t").rlike(to_java(p)).alias(f"p{k}") for k, p in enumerate(VALID))).collect()
    at = {p: k for k, p in enumerate(VALID)}
    assert [(p, t) for (p, t, want), row in zip(cases, found) if row[at[p]] != want] == []


@pytest.mark.parametrize("pattern", INVALID)
def test_what_is_no_ecmascript_pattern(pattern):
    with pytest.raises(InvalidPattern):
        to_java(pattern)
