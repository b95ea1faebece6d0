import random

from pyspark.sql import functions as F

from quarrylight.operators import geometry, tables
from quarrylight.operators.components import components


def grid(source, page, left, top, columns, rows, width=60.0, height=20.0, broken=False):
    xs, ys = [left + width * c for c in range(columns + 1)], [top + height * r for r in range(rows + 1)]
    middle = (xs[0] + xs[-1]) / 2
    flat = [(a, y, b, y) for y in ys for a, b in ([(xs[0], middle), (middle + 1, xs[-1])] if broken else [(xs[0], xs[-1])])]
    return [(source, page, *map(float, s)) for s in flat + [(x, ys[0], x, ys[-1]) for x in xs]]


def found(spark, segments, heights):
    frame = spark.createDataFrame(segments, "source_id string, page int, x0 double, y0 double, x1 double, y1 double").repartition(3)
    pages = spark.createDataFrame(heights, "source_id string, page int, height double")
    return geometry.ruled_tables(frame, pages)


def test_grids_are_found_with_their_columns(spark):
    segments = grid("a", 1, 50, 100, 3, 2) + grid("a", 1, 300, 100, 1, 4) + grid("a", 1, 50, 400, 2, 1, broken=True) + grid("b", 1, 10, 700, 2, 3)
    segments += [("a", 1, 0.0, 600.0, 500.0, 600.0), ("a", 1, 20.0, 650.0, 20.0, 690.0), ("a", 1, 0.0, 0.0, 90.0, 90.0), ("a", 1, 5.0, 5.0, 5.0, 5.0), ("a", 2, 0.0, 10.0, 90.0, 10.0)]
    segments += [("a", 1, None, 1.0, 2.0, 1.0), segments[0], segments[0]]
    got = sorted(map(tuple, found(spark, segments, [("a", 1, 800.0), ("a", 2, 800.0), ("b", 1, 792.0)]).collect()))
    assert got == [
        ("a", 1, 1, 2, 3, [50.0, 110.0, 170.0], 660.0, 100.0),
        ("a", 1, 2, 4, 1, [300.0], 620.0, 100.0),
        ("a", 1, 3, 1, 2, [50.0, 110.0], 380.0, 400.0),
        ("b", 1, 1, 3, 2, [10.0, 70.0], 32.0, 700.0),
    ]


def test_a_lone_cross_and_an_empty_page_are_no_tables(spark):
    assert found(spark, [("a", 1, 0.0, 50.0, 100.0, 50.0), ("a", 1, 50.0, 0.0, 50.0, 100.0)], [("a", 1, 800.0)]).count() == 0
    assert found(spark, [], [("a", 1, 800.0)]).count() == 0


def test_found_tables_feed_continuations(spark):
    segments = grid("a", 1, 50, 700, 3, 2) + grid("a", 2, 50.5, 40, 3, 5) + grid("a", 3, 50, 40, 2, 5)
    rows = found(spark, segments, [("a", p, 800.0) for p in (1, 2, 3)]).withColumn("header_ok", F.lit(True))
    got = {(r["page"], r["suspect"]) for r in tables.continuations(rows).collect()}
    assert got == {(2, True), (3, False)}


def test_pages_in_one_row_equal_distributed_joins(spark, monkeypatch):
    rng = random.Random(7)
    rows = []
    for page in range(60):
        for _ in range(rng.randrange(1, 40)):
            x, y, size = rng.randrange(0, 200, 4) + rng.choice([0.0, 0.05, 2.0]), rng.randrange(0, 200, 4) + 0.1, rng.randrange(0, 120)
            rows.append((str(page % 7), page, x, y, x + size, y) if rng.random() < 0.5 else (str(page % 7), page, x, y, x, y + size))
    segments = spark.createDataFrame(rows, "source_id string, page int, x0 double, y0 double, x1 double, y1 double")
    pages = segments.select("source_id", "page").distinct().withColumn("height", F.lit(792.0))
    found = lambda: sorted(map(tuple, geometry.ruled_tables(segments, pages).collect()))
    whole = found()
    calls = []
    monkeypatch.setattr(geometry, "components", lambda edges: calls.append(1) or components(edges))
    assert found() == whole and not calls  # pages of few rules need no contraction
    monkeypatch.setattr(geometry, "PAGE_RULES", 12)
    assert found() == whole and calls and len(whole) > 30
