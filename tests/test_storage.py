import glob

from ocellus.storage import cut_lineage, release, shared_folder


def test_released_frames_leave_no_files(spark):
    here = lambda: set(glob.glob(f"{shared_folder(spark)}/rdd-*".removeprefix("file:")))
    before = here()
    first = cut_lineage(spark.range(100))
    second = cut_lineage(first.selectExpr("id * 2 id"))
    assert len(here() - before) == 2
    release(first, spark.range(3))
    assert len(here() - before) == 1 and second.count() == 100
