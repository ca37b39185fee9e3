"""The scratch folder where the machine's Spark defaults name none."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = """
from tidemark.session import clear_scratch, local_session, scratch_dir, written
spark = local_session(2, 2, "1g")
assert spark.conf.get("spark.checkpoint.dir", None) is None
one, two = written(spark.range(5)), written(spark.range(7))
assert scratch_dir(spark) == scratch_dir(spark) and (one.count(), two.count()) == (5, 7)
print("FOLDER", scratch_dir(spark))
"""


def test_without_machine_defaults(tmp_path):
    (tmp_path / "conf").mkdir()
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, timeout=300,
                          env=os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": str(ROOT)})
    assert done.returncode == 0, done.stderr[-2000:]
    folder = next(line.split()[1] for line in done.stdout.splitlines() if line.startswith("FOLDER"))
    assert str(tmp_path) in folder and not Path(folder.removeprefix("file:")).exists()  # gone with the process


def test_shuffles_start_from_partitions_for_the_largest_table(spark, monkeypatch):
    """With 1 KB of table to a partition there are more partitions than the session's, and a smaller table lowers nothing."""
    from pyspark.sql import functions as F
    from tidemark import session
    from tidemark.plans import inputs
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(first, None)
    try:
        monkeypatch.setattr(session, "BYTES_PER_PARTITION", 1 << 10)
        inputs.table(spark, "/root/testdata/sf0.01", "orders")
        many = int(spark.conf.get(first))
        assert many > 100
        inputs.table(spark, "/root/testdata/sf0.01", "region")
        assert int(spark.conf.get(first)) == many
    finally:
        spark.conf.unset(first) if before is None else spark.conf.set(first, before)


def test_a_scan_task_reads_a_bounded_number_of_bytes(spark, monkeypatch):
    from tidemark import session
    from tidemark.plans import inputs
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        monkeypatch.setattr(session, "BYTES_PER_SCAN", 1 << 16, raising=False)
        lineitem = inputs.table(spark, "/root/testdata/sf0.1", "lineitem")
        assert lineitem.rdd.getNumPartitions() > 100
    finally:
        spark.conf.set(name, before)
