"""Pages read by rank against the sorted whole."""

import random

import pytest
from pyspark.sql import functions as F

from parley.operators import filters
from parley.sources.tables import shared_dir

SCHEMA = "id long, a int, b string"


def order():
    return [F.desc("a"), F.asc("b"), F.asc("id")]


def table(rows, n):
    rng = random.Random(3)
    return rows(SCHEMA, *[
        (i, rng.choice([None, 1, 2, 3]), rng.choice([None, "", "x", "y"])) for i in range(n)
    ])


def test_pages_over_several_ranges_make_up_the_whole(spark, rows):
    people = table(rows, 997)
    path = shared_dir(spark, "ranked")
    filters.write_ranked(people, order(), path, 7)
    whole = [tuple(r) for r in people.orderBy(*order()).collect()]
    for size in (10, 250, 2000):
        pages = -(-len(whole) // size)
        for page in (1, 2, pages // 2 + 1, pages):
            got = filters.ranked_page(spark, path, page, size).collect()
            assert [tuple(r)[:3] for r in got] == whole[(page - 1) * size : page * size]
            assert {(r.total_rows, r.total_pages) for r in got} <= {(997, pages)}
        assert filters.ranked_page(spark, path, pages + 1, size).collect() == []
    ranks = {r.id: (r["rank"], r.page, r.page_row) for r in filters.ranked_rows(spark, path, 10).collect()}
    assert ranks == {r[0]: (n + 1, n // 10 + 1, n % 10 + 1) for n, r in enumerate(whole)}


def test_a_page_reads_only_its_ranges(spark, rows):
    path = shared_dir(spark, "ranked")
    filters.write_ranked(table(rows, 997), order(), path, 7)
    page = filters.ranked_page(spark, path, 50, 10)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_range" in plan and "GreaterThanOrEqual(_place" in plan
    assert len(page.select(F.input_file_name()).distinct().collect()) == 1


def test_the_way_of_reading_changes_no_page(spark, rows):
    people = table(rows, 60)
    for page in (0, 1, 3, 6, 7):
        if page:
            plain = filters.paginate(people, order(), page, 10).collect()
            assert filters.paginate(people, order(), page, 10, shallow_rows=0).collect() == plain
    path = shared_dir(spark, "ranked")
    filters.write_ranked(people, order(), path)
    assert filters.ranked_page(spark, path, 0, 10).collect() == []


@pytest.mark.parametrize("page", [1, 5])
def test_pages_of_an_empty_table(rows, page):
    got = filters.paginate(table(rows, 0), order(), page, 10, shallow_rows=0)
    assert got.columns == ["id", "a", "b", "total_rows", "total_pages"] and got.collect() == []
