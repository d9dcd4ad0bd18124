"""The archive source: round trips, one task a matrix, both orders and compression, refusal of what isn't whole."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from duochron.sources import archives
from duochron.sources.files import read_npz


def arrays(n_angles, n, seed=0, order="C"):
    rng = np.random.default_rng(seed)
    return {"c2_exp": np.asarray(rng.random((n_angles, n, n)), order=order), "t1": np.arange(n) * 0.5, "t2": np.arange(n) * 0.5, "wavevector_q_list": np.full(n_angles, 0.01), "phi_angles_list": np.linspace(0, 90, n_angles)}


def as_rows(df):
    return sorted(tuple(r) for r in df.drop("file").collect())


@pytest.mark.parametrize(("save", "order"), [(np.savez, "C"), (np.savez_compressed, "C"), (np.savez, "F")])
def test_reads_what_the_other_reader_reads(spark, tmp_path, monkeypatch, save, order):
    monkeypatch.setattr(archives, "CELLS", 20)
    archives.register(spark)
    for k, n in enumerate((7, 4)):
        save(f"{tmp_path}/run{k}.npz", **arrays(3, n, k, order))
    df = spark.read.format(archives.NAME).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 6
    assert as_rows(df) == as_rows(read_npz(spark, str(tmp_path)))
    one = spark.read.format(archives.NAME).load(f"{tmp_path}/run1.npz")
    assert one.count() == 3 * 16 and one.select("file").distinct().count() == 1


def test_round_trip_and_refusal(spark, tmp_path):
    np.savez(f"{tmp_path}/run.npz", **arrays(5, 6))
    cells = read_npz(spark, f"{tmp_path}/run.npz")
    out = str(tmp_path / "out")
    archives.write(cells.repartition(7), out)
    assert sorted(os.listdir(out)) == [f"angle-{a:05d}.npz" for a in range(5)]
    back = spark.read.format(archives.NAME).load(out)
    angle = F.regexp_extract("file", r"angle-(\d+)", 1).cast("int")
    assert as_rows(back.withColumn("angle_idx", angle)) == as_rows(cells)
    for broken in (cells.where("NOT (angle_idx = 2 AND i = 3 AND j = 1)"), cells.union(cells.limit(1))):
        with pytest.raises(Exception, match="don't fill"):
            archives.write(broken, str(tmp_path / "broken"))
        assert not [f for f in os.listdir(tmp_path / "broken") if not f.startswith(".")]


def test_wrong_shapes(spark, tmp_path):
    archives.register(spark)
    np.savez(f"{tmp_path}/a.npz", **{**arrays(2, 4), "c2_exp": np.zeros((2, 4, 5))})
    with pytest.raises(Exception, match="angles, frames, frames"):
        spark.read.format(archives.NAME).load(f"{tmp_path}/a.npz").count()
