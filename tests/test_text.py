import random

from pyspark.sql import functions as F

from quarrylight.functions import ids, rates, text
from quarrylight.operators import chunking


def column(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_tokenizer(spark):
    cases = {
        "ERR_5521": "err_5521 err 5521",
        "PN-8891-A": "pn-8891-a pn 8891 a",
        "Recall@10": "recall@10 recall 10",
        "efConstruction": "efconstruction ef construction",
        "foo_barBaz": "foo_barbaz foo barbaz foo_bar baz",
        "a.B.cD": "a.b.cd a b cd a.b.c d",
        "HTTPServer2Go": "httpserver2go httpserver2 go",
        "": "",
    }
    got = column(spark, [(k,) for k in cases], "t string", F.array_join(text.tokenize(F.col("t")), " "))
    assert got == list(cases.values())
    assert column(spark, [(None,)], "t string", F.size(text.tokenize(F.col("t")))) == [0]


def test_numbers_and_cells(spark):
    cases = {"12": True, "1,234.5%": True, "0831.": True, "1e5": True, ".5": True, "-3": True, "1_000": True, "nan": True, "Inf": True, "": False, "a1": False, "1.2.3": False, "0.831 %": True, "..": False, None: False}
    assert column(spark, [(k,) for k in cases], "t string", text.is_numeric(F.col("t"))) == list(cases.values())
    rows = [([["", " "], ["Nordhafen", "17.25", "903", "6"]], "x"), ([["Harbour", "Depth"], ["Nordhafen", "17"]], "x"), ([], "x"), ([["", ""]], "x"), ([["a", "1"]], "x")]
    assert column(spark, rows, "rows array<array<string>>, p string", text.header_plausible(F.col("rows"))) == [False, True, False, False, False]
    bad = column(spark, [([["Harbour", "1725\n.", "9.5"]], "Harbour 17.25 9.5"), ([["1 000"]], "has 1000")], "rows array<array<string>>, p string", text.corrupt_cells(F.col("rows"), F.col("p")))
    assert bad == [["1725 ."], []]


def test_headings_prefixes_tables(spark):
    assert column(spark, [("**3 Results**",), ("{{",), ("  # a_b_c :",), (None,)], "t string", text.clean_heading(F.col("t"))) == ["3 Results", "", "abc", ""]
    cases = [("Guide", ["Guide", "Use"]), ("Part", ["The Part One", "part"]), ("", ["", "A"]), (None, None), ("A b", ["a-B", "C"])]
    want = ["Guide > Use\n\n", "The Part One\n\n", "A\n\n", "", "A b > C\n\n"]
    assert column(spark, cases, "t string, h array<string>", text.breadcrumb_prefix(F.col("t"), F.col("h"))) == want
    assert column(spark, [([["a", "b"], ["c"]],), ([],)], "rows array<array<string>>", text.markdown_table(F.col("rows"))) == ["| a | b |\n| --- | --- |\n| c |  |", ""]


def test_cover_is_the_longest_prefix(spark):
    rnd = random.Random(1)
    rows = [("".join(rnd.choice("ab") for _ in range(rnd.randint(0, 12))), "".join(rnd.choice("ab") for _ in range(30))) for _ in range(200)]
    got = column(spark, rows, "n string, t string", text.cover(F.col("n"), F.col("t")))
    for (n, t), share in zip(rows, got):
        best = max((k for k in range(len(n) + 1) if n[:k] in t), default=0)
        assert abs(share - (best / len(n) if n else 0)) < 1e-12
    assert column(spark, [(0.5,), (0.49,), (1.0,)], "s double", text.cover_state(F.col("s"))) == ["partial", "absent", "contained"]


def test_slices_agree_with_the_python_form(spark):
    rnd = random.Random(2)
    texts = [" ".join("w" * rnd.randint(1, 12) for _ in range(rnd.randint(0, 400))) for _ in range(40)] + ["", "  \n ", "one"]
    got = column(spark, [(t,) for t in texts], "t string", text.fixed_slices(F.col("t"), 60, 7))
    assert got == [chunking.word_windows(t, 60, 7) for t in texts]


def test_identifiers(spark):
    assert column(spark, [("data/raw/Sub/A.PDF",), ("/x/y/B.pdf",), ("C.md",)], "p string", ids.normalize_id(F.col("p"), "data/raw")) == ["sub/a.pdf", "b.pdf", "c.md"]
    assert column(spark, [("ab", "c"), ("a", "bc")], "x string, y string", ids.cache_key(F.col("x"), F.col("y"))).__len__() == 2
    one, two = column(spark, [("ab", "c"), ("a", "bc")], "x string, y string", ids.cache_key(F.col("x"), F.col("y")))
    assert one != two
    assert column(spark, [("a" * 22,), ("a" * 21,), ("b" * 22,), (None,)], "s string", ids.session_ok(F.col("s"), "b" * 22)) == ["a" * 22, None, None, None]
    reasons = [(None, "h", None, "f"), ("g", "h", "f", "f"), ("h", "h", "e", "f"), ("h", "h", "f", "f")]
    got = column(spark, reasons, "ph string, h string, pf string, f string", ids.reingest_reason(F.col("ph"), F.col("h"), F.col("pf"), F.col("f")))
    assert got == ["new document", "content changed", "pipeline changed (e -> f)", None]


def test_rates(spark):
    rows = column(spark, [(82, 92), (3, 9), (0, 0), (10, 10)], "h long, n long", rates.rate(F.col("h"), F.col("n")))
    assert rows[0].label == "82/92 = 89%" and (rows[0].low, rows[0].high) == (0.811, 0.94) and rows[0].rate == 0.891
    assert rows[1].label == "3 of 9" and rows[1].rate is None and not rows[1].sufficient
    assert rows[2].label == "no items" and rows[3].high == 1.0
