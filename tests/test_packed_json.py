"""Compressed JSON lines: fewer bytes, the same rows."""

from pathlib import Path

import pytest

from pricewake import schemas
from pricewake.catalog import inputs as I
from pricewake.catalog import table_queries as T
from pricewake.sources import files

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def stored(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("part-*"))


def test_packed_lines_are_read_back(spark, tmp_path):
    rows = I.listings(spark, SF).select(*schemas.LISTINGS_BATCH.names)
    files.write_json(rows, str(tmp_path / "plain"))
    files.write_json(rows, str(tmp_path / "packed"), compression="gzip")
    assert stored(tmp_path / "packed") < stored(tmp_path / "plain") / 4
    plain, packed = (files.read_listings_json(spark, str(tmp_path / n), as_array=False) for n in ("plain", "packed"))
    assert plain.exceptAll(packed).isEmpty() and packed.exceptAll(plain).isEmpty()


@pytest.mark.parametrize("query", [T.listings_json, T.json_to_csv])
def test_queries_write_packed_lines(spark, tmp_path, monkeypatch, query):
    monkeypatch.setattr(T, "scratch_path", lambda _, name: str(tmp_path / name))
    query(spark, SF)
    packed = stored(tmp_path / "listings-json")
    files.write_json(I.listings(spark, SF).select(*schemas.LISTINGS_BATCH.names), str(tmp_path / "plain"))
    assert packed < stored(tmp_path / "plain") / 4


def test_each_file_of_the_feed_stays_a_batch(spark):
    """Posts dealt to many tasks would land as many files, and each file is a batch."""
    plain = I.sale_posts(spark, "/root/testdata/sf0.01", dealt=False)
    assert plain.rdd.getNumPartitions() == I.table(spark, "/root/testdata/sf0.01", "lineitem").rdd.getNumPartitions()
