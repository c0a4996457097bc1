"""Queries over pages of line items whose keys are as large as those of larger tables."""

import pytest
from pyspark.sql import functions as F

from palimpsest.plans import pages

#: More parts than the number of an item in SQL has room for in 64 bits; a multiple of all divisors by which pages are laid out.
STEP = 2**7 * 3**2 * 5**2 * 13 * 23 * 37


@pytest.fixture(scope="module")
def shifted(spark, tmp_path_factory):
    """The smallest line items, and the same with parts of higher numbers that lay them out in the same places."""
    near, far = (str(tmp_path_factory.mktemp(n)) for n in ("near", "far"))
    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").filter("l_suppkey % 3 = 0")
    items.write.parquet(f"{near}/lineitem.parquet")
    items.withColumn("l_partkey", F.col("l_partkey") + STEP).write.parquet(f"{far}/lineitem.parquet")
    return near, far


@pytest.mark.parametrize("name", ["coordinate_clusters", "interval_cover", "page_boxes", "page_smallest_boxes", "page_captions", "rule_groups", "document_violations"])
def test_parts_of_any_number_are_laid_out(spark, shifted, name):
    near, far = (pages.QUERIES[name](spark, d) for d in shifted)
    assert near.schema == far.schema
    counts = near.count(), far.count()
    assert min(counts) > 0
    # Documents' blocks follow from more divisors than pages do.
    assert counts[0] == counts[1] or name == "document_violations"


def test_items_of_more_than_64_bits_differ_within_their_page(spark, shifted):
    found = pages.QUERIES["page_boxes"](spark, shifted[1])
    assert found.count() == found.select("id", "page", "block").distinct().count()


def test_numbers_are_those_of_the_sql(spark):
    rows = spark.createDataFrame([(3, 2, 5 * 10**9 + 7), (3, 2, None), (1, 1, 1_200_000 * 10**9 + 1)], "id long, page int, m long")
    got = [r["m"] for r in rows.select(pages._named("m")).collect()]
    far = ((1_200_000 * 10**9 + 1) * 1000 + 1) * 10 + 1
    assert got == [((5 * 10**9 + 7) * 1000 + 3) * 10 + 2, None, (far + 2**63) % 2**64 - 2**63]
