import random

from quarrylight.operators import tables

DDL = "source_id string, page int, table_no int, n_cols int, col_xs array<double>, bottom_gap double, top_gap double, rows array<array<string>>, page_text string"
XS = [40.0, 130.0, 290.0]
ROWS = [
    ("tides", 4, 1, 3, XS, 31.0, 650.0, [["Harbour", "Depth (m)", "Berths"], ["Nordhafen", "17.25", "6"]], "Harbour Depth (m) Berths Nordhafen 17.25 6"),
    ("tides", 5, 1, 3, [x - 2.5 for x in XS], 410.0, 35.0, [["Sudmole", "9.5", "11"], ["Westkai", "1 275\n,", "4"]], "Sudmole 9.5 11 Westkai 12.75 4"),
    ("tides", 5, 2, 3, [15.0, 205.0, 395.0], 55.0, 480.0, [[" ", ""], ["Signal", "Meaning", "Hours"], ["two lamps", "wait", "8"]], "Signal Meaning Hours two lamps wait 8"),
]


def test_headers_and_cells(spark):
    got = sorted(tables.detected(spark.createDataFrame(ROWS, DDL)).collect(), key=lambda r: (r.page, r.table_no))
    assert [r.header_ok for r in got] == [True, False, True]
    assert [r.n_corrupt for r in got] == [0, 1, 0]
    assert got[2].first_row == ["Signal", "Meaning", "Hours"]


def test_continuations(spark):
    found = tables.continuations(tables.detected(spark.createDataFrame(ROWS, DDL))).collect()
    assert [(r.page, r.table_no, r.signals, r.suspect) for r in found] == [(5, 1, 5, True)]


def test_candidates_are_consumed_in_order(spark):
    blocks = spark.createDataFrame([("s", 1, 0, "| Alpha one | Beta two |"), ("s", 1, 1, "| Alpha one | Beta two | Gamma |"), ("s", 1, 2, "none"), ("t", 1, 0, "x")], "source_id string, page int, ordinal int, text string")
    offered = spark.createDataFrame([("s", 1, 1, ["Alpha one", "ab"]), ("s", 1, 2, ["Beta-two", "Alpha ONE", "missing"]), ("s", 1, 3, ["ab"])], "source_id string, page int, table_no int, first_row array<string>")
    got = sorted((r.source_id, r.ordinal, r.table_no) for r in tables.matched(blocks, offered).collect())
    assert got == [("s", 0, 1), ("s", 1, 2)]


def test_propagation(spark):
    files = spark.createDataFrame([("a", 1, 1), ("b", 1, 0), ("c", 0, 1), ("d", 3, 2), ("e", 0, 0)], "source_id string, repaired int, labelled int")
    assert [r.ok for r in tables.provenance_propagation(files).orderBy("source_id").collect()] == [True, False, False, False, True]


def test_matching_takes_what_a_plain_loop_takes(spark):
    rng = random.Random(3)
    words = ["alpha", "betas", "gamma", "delta"]
    blocks = [(rng.choice(["s", "t", None]), rng.randrange(4), k, rng.choice([None, " | ".join(rng.choices(words, k=3)), "Alpha BETAS"])) for k in range(160)]
    offered = [(rng.choice(["s", "t", None]), rng.randrange(5), k, rng.choice([["x"], rng.choices(words, k=2), [rng.choice(words).upper(), "no", rng.choice(words), "never read"]])) for k in range(120)]
    want = set()
    for page in {(s, p) for s, p, _, _ in blocks}:
        free = sorted((n, [c.lower() for c in row if len(c) >= 5][:2]) for *at, n, row in offered if tuple(at) == page)
        free = [c for c in free if c[1]]
        for _, _, ordinal, text in sorted((b for b in blocks if b[:2] == page), key=lambda b: b[2]):
            hit = next((c for c in free if all(p in (text or "").lower().replace(" ", "") for p in c[1])), None)
            if hit:
                free.remove(hit)
                want.add((*page, ordinal, hit[0]))
    held = spark.createDataFrame(blocks, "source_id string, page int, ordinal int, text string")
    found = tables.matched(held, spark.createDataFrame(offered, "source_id string, page int, table_no int, first_row array<string>"))
    assert {tuple(r) for r in found.collect()} == want and len(want) > 20
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Arrow" not in plan and "CoGroup" not in plan
