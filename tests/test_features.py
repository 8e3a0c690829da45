import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.operators import dynamic, normalise

WIDTH = 13


@pytest.fixture(scope="module")
def utterances():
    rng = np.random.default_rng(0)
    return {u: rng.normal(0, 3, (n, WIDTH)) for u, n in (("a", 9), ("b", 1), ("c", 3))}


@pytest.fixture(scope="module")
def frames(spark, utterances):
    rows = [(u, i, r.tolist()) for u, x in utterances.items() for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "utt string, frame_no int, c array<double>").repartition(3).cache()


def at(x, i):
    return x[min(max(i, 0), len(x) - 1)]


def brute(x, kind):
    out = []
    for i in range(len(x)):
        c, d = x[i], at(x, i + 2) - at(x, i - 2)
        dd = (at(x, i + 3) - at(x, i - 1)) - (at(x, i + 1) - at(x, i - 3))
        ld = at(x, i + 4) - at(x, i - 4)
        power = np.array([c[0], d[0], dd[0]])
        out.append({
            "1s_c": [c], "1s_c_d": [np.r_[c, d]], "1s_c_d_dd": [np.r_[c, d, dd]], "1s_c_d_ld_dd": [np.r_[c, d, ld, dd]], "s3_1x39": [np.r_[c[1:], d[1:], power, dd[1:]]],
            "s2_4x": [c[1:], np.r_[d[1:], ld[1:]], power, dd[1:]], "1s_3c": [np.concatenate([at(x, i + k) for k in range(-3, 4)])], "1s_4c": [np.concatenate([at(x, i + k) for k in range(-4, 5)])],
            "13:1": [np.concatenate([at(x, i + k) for k in (-1, 0, 1)])], "4,9": [c[:4], c[4:]], "1,12:2": [np.concatenate([at(x, i + k)[:1] for k in range(-2, 3)]), np.concatenate([at(x, i + k)[1:] for k in range(-2, 3)])],
        }[kind])
    return out


@pytest.mark.parametrize("kind", ["1s_c", "1s_c_d", "1s_c_d_dd", "1s_c_d_ld_dd", "s3_1x39", "s2_4x", "1s_3c", "1s_4c", "13:1", "4,9", "1,12:2"])
def test_dynamic_features(frames, utterances, kind):
    got = {(r.utt, r.frame_no): r.feat for r in dynamic.features(frames, kind, ["utt"]).collect()}
    for u, x in utterances.items():
        for i, streams in enumerate(brute(x, kind)):
            assert len(got[u, i]) == len(streams) and all(a == pytest.approx(b.tolist()) for a, b in zip(got[u, i], streams, strict=True))


def test_wrong_kinds(frames):
    for kind, width in (("x", 13), ("4,4", 13), ("s2_4x", 12)):
        with pytest.raises(ValueError):
            dynamic.features(frames, kind, ["utt"], width=width)


def test_subvectors(spark):
    assert dynamic.parse_subvectors("24,0-11/25,12-23") == [[24, *range(12)], [25, *range(12, 24)]]
    for spec in ("1,1", "3-1", "a", "1//2"):
        with pytest.raises(ValueError):
            dynamic.parse_subvectors(spec)
    x = F.array(*[F.lit(float(i)) for i in range(5)])
    assert spark.range(1).select(dynamic.subvectors(x, "4,0-1/2").alias("v")).first().v == [[4, 0, 1], [2]]


def cells(df):
    return {(r.utt, r.frame_no): r.c for r in df.collect()}


def test_mean_and_variance(frames, utterances):
    m, v = cells(normalise.mean_norm(frames, ["utt"], WIDTH)), cells(normalise.mean_norm(frames, ["utt"], WIDTH, variance=True))
    for u, x in utterances.items():
        used = x[x[:, 0] >= 0]
        y = x - (used.mean(axis=0) if len(used) else 0)
        s = np.sqrt((y**2).mean(axis=0)) if len(used) else np.sqrt((x**2).mean(axis=0))
        for i in range(len(x)):
            assert m[u, i] == pytest.approx(y[i].tolist())
            if len(used) and len(x) > 1:
                assert v[u, i] == pytest.approx((y[i] / s).tolist())


def test_gain(frames, utterances):
    top, noise = cells(normalise.gain_max(frames, ["utt"])), cells(normalise.gain_noise(frames, ["utt"]))
    for u, x in utterances.items():
        low = x[x[:, 0] < x[:, 0].min() + 2.0, 0].mean()
        for i, r in enumerate(x):
            assert top[u, i] == pytest.approx([r[0] - x[:, 0].max(), *r[1:]]) and noise[u, i] == pytest.approx([r[0] - low, *r[1:]])


def test_modes_are_explicit(frames, utterances):
    got = {(r.utt, r.frame_no): r.c for r in normalise.normalise(frames, ["utt"], WIDTH, "batch", "max").collect()}
    for u, x in utterances.items():
        voiced = x[x[:, 0] >= 0]
        y = x - (voiced.mean(axis=0) if len(voiced) else 0)
        y[:, 0] -= y[:, 0].max()
        assert all(got[u, i] == pytest.approx(r) for i, r in enumerate(y))
    assert normalise.normalise(frames, ["utt"], WIDTH, "none", "none", whole=False).count() == frames.count()
    for wrong in (dict(mean="live"), dict(gain="emax"), dict(mean="mean"), dict(mean="batch", whole=False), dict(mean="none", gain="max", whole=False)):
        with pytest.raises(ValueError):
            normalise.normalise(frames, ["utt"], WIDTH, **wrong)


@pytest.mark.parametrize("start, end, window", [(0, 3, 0), (2, 5, 2), (0, None, 3), (1, 99, 4), (7, 8, 3)])
def test_padded_range(frames, utterances, start, end, window):
    got = {(r.utt, r.frame_no): r.c for r in dynamic.padded_range(frames, ["utt"], start, end, window, WIDTH).collect()}
    want = {}
    for u, x in utterances.items():
        if len(x) <= start:
            continue
        last = min(len(x) - 1, len(x) if end is None else end)
        part = x[max(0, start - window) : last + window + 1]
        voiced = part[part[:, 0] >= 0]
        part = part - (voiced.mean(axis=0) if len(voiced) else 0)
        for i in range(start - window, last + window + 1):
            want[u, i] = at(part, i - max(0, start - window))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    with pytest.raises(ValueError):
        dynamic.padded_range(frames, ["utt"], 3, 3, 1, WIDTH)
