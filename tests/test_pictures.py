"""Picture files are written by many tasks and read once."""

from framegate.plans import registry
from framegate.sources import images


def test_a_picture_file_is_read_once(spark, tmp_path, monkeypatch):
    tasks = []
    write = images.write_files

    def counted(files, *args):
        tasks.append(files.rdd.getNumPartitions())
        return write(files, *args)

    monkeypatch.setattr(images, "write_files", counted)
    out = registry.QUERIES["image_files"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Exchange" not in plan
    assert tasks[0] >= spark.sparkContext.defaultParallelism > 1
