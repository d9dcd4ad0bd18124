import json
import os

import numpy as np
import pytest

from duochron import api
from duochron.config import ConfigError, load_config, physics_issues, save_config
from duochron.sources import files
from duochron.sources.events import events_dataset


def archive(path, n=12, angles=3, **changes):
    t = np.arange(n) * 0.5
    lag = np.abs(t[:, None] - t)
    c2 = np.stack([1 + (0.30 + 0.02 * k) * np.exp(-lag / 2) for k in range(angles)])
    np.savez(path, **{**dict(c2_exp=c2, t1=t, t2=t, wavevector_q_list=np.full(angles, 0.0237), phi_angles_list=np.linspace(0, 144, angles)), **changes})
    return c2


def test_npz_round_trip_through_the_cache(spark, tmp_path):
    c2 = archive(tmp_path / "a.npz")
    for _ in range(2):
        d = files.load(spark, str(tmp_path / "a.npz"), str(tmp_path / "cache"))
        got = {(r.angle_idx, r.i, r.j): r.c2 for r in d.c2.collect()}
        assert len(got) == 3 * 12 * 12 and got[2, 3, 7] == c2[2, 3, 7]
        assert d.angle.count() == 3 and d.frame.count() == 12
    with pytest.raises(ValueError):
        files.read_dataset(spark, str(tmp_path / "cache"), q=0.5)


@pytest.mark.parametrize("change", [{"c2_exp": np.full((1, 4, 4), np.nan)}, {"c2_exp": np.ones((1, 4, 5))}, {"t1": np.array([1.0, 0.0])}, {"t1": np.ones((2, 2))}])
def test_bad_archives_are_refused(change, tmp_path):
    archive(tmp_path / "b.npz", **change)
    with np.load(tmp_path / "b.npz") as z, pytest.raises(ValueError):
        files.check_arrays({k: z[k] for k in z.files})


def test_guards():
    assert files.file_name("c2_${start}_${end}.npz", start=1, end=9) == "c2_1_9.npz"
    with pytest.raises(ValueError):
        files.file_name("../x.npz")
    with pytest.raises(ValueError):
        files.safe_path("/base", "../x.json")
    assert files.safe_path("/base", "a/x.json") == "/base/a/x.json"
    assert json.dumps(files.json_safe({"a": float("nan"), "b": np.array([1.0, float("inf")]), "c": 1 + 2j})) == '{"a": null, "b": [1.0, "Infinity"], "c": {"real": 1.0, "imag": 2.0}}'
    with pytest.raises(ValueError):
        files.json_safe(np.zeros(1001))
    assert files.detect_layout(set(files.OLD_LAYOUT)) == "aps_old" and files.detect_layout({"x"}) == "unknown"


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("analysis_mode: laminar_flow\nanalyzer_parameters: {dt: 0.5}\noptimization: {recover: false}\n")
    c = load_config(str(tmp_path / "c.yaml"))
    assert c["analyzer_parameters"]["dt"] == 0.5 and c["optimization"]["max_iterations"] == 50
    with pytest.raises(ConfigError, match="dt"):
        load_config({"analyzer_parameters": {"dt": -1}})
    assert physics_issues({"f0": 0.8, "f3": 0.5})[0][0] == "error"


def test_load_and_fit_an_archive(spark, tmp_path):
    archive(tmp_path / "a.npz", n=16)
    d = api.load_data(spark, str(tmp_path / "a.npz"), {"analyzer_parameters": {"dt": 0.5}, "preprocessing": {"diagonal": "basic"}})
    result, names = api.fit(spark, d, {"analyzer_parameters": {"dt": 0.5}, "optimization": {"max_iterations": 15}})
    assert len(names) == len(result.parameters) == 5 and result.history == sorted(result.history, reverse=True)
    files.write_result(spark, result, names, d.c2, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/fitted")).count() == d.c2.count()


def test_plot_tables_and_stream(spark, sf, tmp_path):
    from duochron.streaming.intensity import read_events, windowed_intensity

    d = events_dataset(spark, sf)
    t = api.plot_tables(d, 0.3, 1.0, {"D0": 1000.0, "alpha": 0.5, "D_offset": 10.0}, pixels=8)
    assert t["comparison"].count() == 4500 and t["raster"].count() == 320
    q = windowed_intensity(read_events(spark, sf)).writeStream.format("memory").queryName("win").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM win").first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


class Array(np.ndarray):
    """An array that is read whole by ``[()]``, as a stored one is."""


def stored(x):
    return np.asarray(x).view(Array)


def test_both_layouts_of_correlation_files():
    rng = np.random.default_rng(1)
    half = [np.triu(rng.random((4, 4))) for _ in range(12)]
    q = np.array([0.005] * 6 + [0.0052] * 2 + [0.009] * 4)
    old = {"xpcs/dqlist": stored(q[None]), "xpcs/dphilist": stored(np.arange(12.0)[None]), "exchange/C2T_all": {str(k): stored(h) for k, h in enumerate(half)}}
    got = files.arrays_of(old, 0.0049)
    assert got["phi_angles_list"].tolist() == list(range(8)) and got["c2_exp"].shape == (8, 4, 4)
    np.testing.assert_allclose(got["c2_exp"][3], np.triu(half[3], 1) + np.triu(half[3], 1).T + np.diag(np.diag(half[3])))
    assert len(files.choose_old(np.linspace(0.001, 0.02, 30), 0.01)) == 10 or len(files.choose_old(np.linspace(0.001, 0.02, 30), 0.01)) >= 5
    new = {
        "xpcs/qmap/dynamic_v_list_dim0": stored([0.004, 0.006]), "xpcs/qmap/dynamic_v_list_dim1": stored([0.0, 45.0, 90.0]), "xpcs/twotime/processed_bins": stored([1, 3, 5, 6, 99]),
        "xpcs/twotime/correlation_map": {f"c2_{k:05d}": stored(h) for k, h in reversed(list(enumerate(half[:5])))},
    }
    got = files.arrays_of(new, 0.0061)
    assert got["wavevector_q_list"].tolist() == [0.006, 0.006] and got["phi_angles_list"].tolist() == [45.0, 90.0]
    np.testing.assert_allclose(got["c2_exp"][0][0], half[2][0])
    with pytest.raises(ValueError):
        files.arrays_of({}, 0.005)


def test_configuration_is_checked_and_saved(tmp_path):
    for wrong in ({"optimization": {"per_angle_mode": "furrier"}}, {"optimization": {"loss": "cauchy"}}, {"preprocessing": {"repair": "all"}}):
        with pytest.raises(ConfigError):
            load_config(wrong)
    (tmp_path / "a.json").write_text('{"analysis_mode": "laminar_flow"}')
    save_config(load_config(str(tmp_path / "a.json")), str(tmp_path / "b.yaml"))
    assert load_config(str(tmp_path / "b.yaml"))["analysis_mode"] == "laminar_flow"


def test_command_line(spark, tmp_path, capsys):
    from duochron.__main__ import main

    (tmp_path / "c.yaml").write_text("analysis_mode: static_isotropic\nanalyzer_parameters: {dt: 0.5}\noptimization: {recover: false}\n")
    assert main(["check", str(tmp_path / "c.yaml")]) == 0
    (tmp_path / "bad.yaml").write_text("analysis_mode: static\n")
    assert main(["check", str(tmp_path / "bad.yaml")]) == 1
    archive(tmp_path / "a.npz", n=16)
    one = ["fit", str(tmp_path / "a.npz"), "--config", str(tmp_path / "c.yaml"), "--output", str(tmp_path / "out")]
    assert main([*one, "--max-iterations", "1"]) == 2
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["status"] != "converged"
    assert os.path.isdir(tmp_path / "out" / "parameters") and os.path.isdir(tmp_path / "out" / "fitted")


def test_loaded_cells_are_repaired(spark, tmp_path):
    c2 = archive(tmp_path / "n.npz")
    c2[1, 2, 3] = np.nan
    archive(tmp_path / "n.npz", c2_exp=c2)
    options = {"analyzer_parameters": {"dt": 0.5}, "preprocessing": {"diagonal": None, "repair": "conservative"}}
    cells = api.load_data(spark, str(tmp_path / "n.npz"), options).c2
    got = cells.where("angle_idx = 1 AND i = 2 AND j = 3").first().c2
    assert abs(got - np.nanmedian(c2[1])) < 1e-12
