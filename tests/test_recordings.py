import struct
import zlib

import numpy as np
import pytest

from wavemill.sources import recordings


def element(kind, data):
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def matrix(name, value):
    if isinstance(value, dict):
        names = b"".join(k.encode().ljust(32, b"\0") for k in value)
        body = element(6, struct.pack("<II", 2, 0)) + element(5, struct.pack("<ii", 1, 1)) + element(1, name.encode()) + struct.pack("<HHi", 5, 4, 32) + element(1, names)
        return element(14, body + b"".join(matrix("", v) for v in value.values()))
    value = np.atleast_2d(np.asarray(value))
    kind, mx = (9, 6) if value.dtype.kind == "f" else (5, 12)
    data = value.astype("<f8" if kind == 9 else "<i4").tobytes(order="F")
    return element(14, element(6, struct.pack("<II", mx, 0)) + element(5, struct.pack("<ii", *value.shape)) + element(1, name.encode()) + element(kind, data))


def mat(**variables):
    out = b"MATLAB 5.0".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    for k, v in variables.items():
        packed = zlib.compress(matrix(k, v))
        out += struct.pack("<II", 15, len(packed)) + packed
    return out


def streams(n=20, m=5):
    rng = np.random.default_rng(0)
    eeg = {"Raw": rng.normal(size=(n, 3)), "States": np.arange(n) % 3, "Blocks": np.ones(n, dtype=int), "Frq": 250.0}
    nirs = {"HbO": rng.normal(size=(m, 2)), "HbR": rng.normal(size=(m, 2)), "Frame": np.arange(m) * 4, "States": np.zeros(m, dtype=int), "Blocks": np.ones(m, dtype=int), "SamplingRate": 12.5}
    return eeg, nirs


def test_files_to_tables(spark, tmp_path):
    eeg, nirs = streams()
    (tmp_path / "2025_N01.mat").write_bytes(mat(EEG=eeg, NIRS=nirs))
    (tmp_path / "2025_N02.mat").write_bytes(mat(EEG=eeg))
    s, e, n = recordings.load(spark, str(tmp_path))
    got = {r.session_id: r for r in s.collect()}
    assert got["2025_N01"].subject == "N01" and got["2025_N01"].has_nirs and got["2025_N01"].n_nirs_ch == 2 and got["2025_N01"].fs_nirs == 12.5
    assert not got["2025_N02"].has_nirs and got["2025_N02"].fs_nirs is None and got["2025_N02"].n_samples == 20
    rows = e.where("session_id = '2025_N02'").orderBy("sample").collect()
    np.testing.assert_allclose([r.x for r in rows], eeg["Raw"])
    assert [r.state for r in rows] == eeg["States"].tolist()
    assert n.count() == 5 and [r.frame for r in n.orderBy("seq").collect()] == nirs["Frame"].tolist()


def test_contract():
    eeg, _ = streams()
    with pytest.raises(KeyError):
        recordings._recording(mat(X=np.ones((2, 2))))
    with pytest.raises(ValueError, match="differ in length"):
        recordings._recording(mat(EEG=eeg | {"States": np.arange(3)}))


def test_columns_are_the_electrodes(spark, tmp_path):
    """A file whose column k holds k: names give the right columns, and so do references."""
    from wavemill.operators import signal
    from wavemill.sources import schemas

    n = 10
    raw = np.tile(np.arange(21.0), (n, 1))
    eeg = {"Raw": raw, "States": np.ones(n, dtype=int), "Blocks": np.ones(n, dtype=int), "Frq": 250.0}
    (tmp_path / "2025_N01.mat").write_bytes(mat(EEG=eeg))
    _, e, _ = recordings.load(spark, str(tmp_path))
    at = {r.channel: r for r in schemas.channels(spark).collect()}
    x = np.array(e.first().x)
    assert x[at["c4"].place] == 0 and x[at["c3"].place] == 18 and len(at) == 21 and sum(r.in_average for r in at.values()) == 13
    m, kept = signal.spatial_matrix(("c3", "c4"), "none")
    assert kept == ["c3", "c4"] and (m @ x).tolist() == [18, 0]
    m, _ = signal.spatial_matrix(("c3", "pz"), "laplacian")
    np.testing.assert_allclose(m @ x, [18 - (14 + 13 + 19 + 8) / 4, 9])
    m, kept = signal.spatial_matrix(("c3", "c4"), "laplacian", ("c3", "f4"))
    np.testing.assert_allclose(m @ x, [0 - (5 + 20 + 8) / 3])
    m, kept = signal.spatial_matrix(("c3",), "none", ("c3", "p3"), interpolate=True)
    np.testing.assert_allclose(m @ x, [(14 + 19 + 8) / 3])
    good = [k for c, k in zip(schemas.CHANNELS, range(21), strict=True) if c not in schemas.LEFT_OUT]
    m, _ = signal.spatial_matrix(("cz",), "car_clean")
    np.testing.assert_allclose(m @ x, [8 - np.mean(good)])
