from pathlib import Path

from burstline.lineage import cut, free, shared_folder, written_tables_freed


def tables(spark):
    return {p.name for p in Path(shared_folder(spark)).glob("burstline-*")}


def test_written_tables_are_freed(spark):
    before = tables(spark)
    with written_tables_freed(spark):
        kept, gone = cut(spark.range(5)), cut(spark.range(3))
        assert len(tables(spark) - before) == 2 and gone.count() == 3
        free(gone)
        assert len(tables(spark) - before) == 1 and kept.count() == 5
    assert tables(spark) == before
