import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alluvia.functions import signal
from alluvia.functions.lists import WIDE, agg_of_range, aggregate_elementwise, aggregate_list_col_elementwise, ieee_div, list_ext, list_join_exploded, mean_of_range, operate_scalar_on_list
from alluvia.functions.parsing import first_date, replace_values, rolling_mean, strftime, to_date, zfill
from alluvia.functions.signal import apply_fft, fft_freqs, fft_freqs_linspace, interpolate_columns

NAN, INF = float("nan"), float("inf")
quick = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


def one(spark, ddl, row, **columns):
    return spark.createDataFrame([row], ddl).select(*[c.alias(n) for n, c in columns.items()]).first()


def plain(x):
    return [tuple(e) if hasattr(e, "asDict") else e for e in x] if x is not None else None


def test_zip_and_unzip(spark):
    df = spark.createDataFrame([([1, 2, 3], [9, 8]), ([], [1]), (None, [1]), ([1], None)], "a array<int>, b array<int>")
    got = [plain(r[0]) for r in df.select(list_ext("a").zip("b")).collect()]
    assert got == [[(1, 9), (2, 8)], [], None, None]
    back = df.select(list_ext(list_ext("a").zip("b")).unzip().alias("u")).select("u.*").collect()
    assert [tuple(r) for r in back] == [([1, 2], [9, 8]), ([], []), (None, None), (None, None)]


def test_enumerate_dedup_rotate(spark):
    r = one(spark, "a array<int>, e array<int>, n array<int>", ([1, 1, 2, 2, 1], [], None), en=list_ext("a").enumerate(), d=list_ext("a").dedup(), r2=list_ext("a").rotate(2), l1=list_ext("a").rotate(-1), over=list_ext("a").rotate(12), e=list_ext("e").rotate(3), n=list_ext("n").rotate(3), dn=list_ext("n").dedup())
    assert plain(r.en) == list(enumerate([1, 1, 2, 2, 1])) and r.d == [1, 2, 1] and r.r2 == [2, 1, 1, 1, 2] and r.l1 == [1, 2, 2, 1, 1] and r.over == r.r2
    assert r.e == [] and r.n is None and r.dn is None
    assert one(spark, "a array<string>", ([None, None, "x", None],), d=list_ext("a").dedup()).d == [None, "x", None]


def test_windows_and_chunks(spark):
    r = one(spark, "a array<int>, s array<int>, n array<int>", ([1, 2, 3, 4, 5], [1], None), w=list_ext("a").windows(2, 2), sw=list_ext("s").windows(2), c=list_ext("a").chunks(2), sc=list_ext("s").chunks(3), nc=list_ext("n").chunks(2), nw=list_ext("n").windows(2))
    assert r.w == [[1, 2], [3, 4]] and r.sw == [] and r.c[-1] == [5] and len(r.c) == 3 and r.sc == [[1]] and r.nc is None and r.nw is None
    for wrong in (lambda: list_ext("a").windows(0), lambda: list_ext("a").windows(1, 0), lambda: list_ext("a").chunks(0)):
        with pytest.raises(ValueError):
            wrong()


@pytest.mark.parametrize("op,want", [("eq", 2), ("ne", 0), ("gt", 3), ("ge", 2), ("lt", 0), ("le", 0)])
def test_position(spark, op, want):
    assert one(spark, "a array<int>", ([1, 2, 3, 4],), p=list_ext("a").position(op, 3)).p == want
    nan = one(spark, "a array<double>", ([None, NAN, 1.0],), p=list_ext("a").position(op, 3)).p
    assert nan == {"ne": 1, "lt": 2, "le": 2}.get(op)
    assert one(spark, "a array<int>", ([],), p=list_ext("a").position(op, 3)).p is None
    with pytest.raises(ValueError):
        list_ext("a").position("like", 1)


def test_arithmetic_follows_ieee(spark):
    r = one(spark, "a array<double>, s double, z double", ([1.0, -1.0, 0.0, None, NAN], 2.0, None), d=list_ext("a").flat_map("div", 0), m=list_ext("a").flat_map("mul", 3), o=operate_scalar_on_list("a", "s", "sub"), n=operate_scalar_on_list("a", "z", "add"))
    assert r.d[:2] == [INF, -INF] and math.isnan(r.d[2]) and r.d[3] is None and math.isnan(r.d[4])
    assert r.m[:4] == [3.0, -3.0, 0.0, None] and r.o[:4] == [-1.0, -3.0, -2.0, None] and r.n is None
    assert one(spark, "a double, b double", (1.0, -0.0), q=ieee_div(F.col("a"), F.col("b"))).q == -INF
    with pytest.raises(ValueError):
        operate_scalar_on_list("a", "s", "pow")


def join_frame(spark, left, right):
    return spark.createDataFrame([(left, right)], "a array<struct<id: int, val: int>>, b array<struct<id: int, val: string>>")


def test_list_join(spark):
    df = join_frame(spark, [(1, 10), (2, 20), (None, 0), (2, 21)], [(2, "x"), (2, "y"), (None, "z"), (5, "w")])
    got = {how: [plain(r[0]) for r in df.select(list_ext("a").join("b", "id", how, schema=df.schema)).collect()][0] for how in "inner left anti odd".split()}
    assert got["inner"] == [(2, 20, "y"), (2, 21, "y")]
    assert got["left"] == [(1, 10, None), (2, 20, "y"), (None, 0, None), (2, 21, "y")]
    assert got["anti"] == [(1, 10), (None, 0)] and got["odd"] == []
    joined = df.select(list_ext("a").join("b", "id", schema=df.schema, suffix="_b").alias("j"))
    assert joined.schema["j"].dataType.elementType.fieldNames() == ["id", "val", "val_b"]
    for how in list(got)[:3]:
        assert plain(list_join_exploded(df, "a", "b", "id", how).first().joined) == got[how]
    with pytest.raises(ValueError):
        list_ext("a").join("b", "no", schema=df.schema)


pairs = st.lists(st.tuples(st.none() | st.integers(0, 5), st.integers(0, 9)), max_size=6)


@quick
@given(left=pairs, right=pairs)
def test_join_laws(spark, left, right):
    df = join_frame(spark, left, [(a, str(b)) for a, b in right])
    j = lambda how: list_ext("a").join("b", "id", how, schema=df.schema)
    inner, outer, anti = df.select(j("inner"), j("left"), j("anti")).first()
    assert len(inner) + len(anti) == len(outer) == len(left)
    last = {a: str(b) for a, b in right if a is not None}
    assert plain(outer) == [(a, b, last.get(a)) for a, b in left]


@quick
@given(xs=st.lists(st.integers(0, 3), max_size=8), n=st.integers(-9, 9), size=st.integers(1, 4), step=st.integers(1, 3))
def test_list_laws(spark, xs, n, size, step):
    r = one(spark, "a array<int>", (xs,), rot=list_ext(list_ext("a").rotate(n)).rotate(-n), ch=F.flatten(list_ext("a").chunks(size)), w=list_ext("a").windows(size, step), d=list_ext("a").dedup())
    assert r.rot == xs and r.ch == xs
    assert r.w == [xs[i : i + size] for i in range(0, len(xs) - size + 1, step)]
    assert r.d == [x for i, x in enumerate(xs) if i == 0 or xs[i - 1] != x]


def test_range_aggregates(spark):
    x = [float(i) for i in range(10)]
    data = [([NAN, 1.0] + [0.0] * 10, x), ([None, 0.0, 0.0], x), ([NAN] * 10, x), ([1.0, 8.0, 3.0, 2.0], x), ([4.0, 5.0, 2.0, 3.0], x), (None, x)]
    df = spark.createDataFrame(data, "y array<double>, x array<double>")
    got = df.select(mean_of_range("y", "x", 0, 1), mean_of_range("y", "x", 0, 3, x_min_idx_offset=1), agg_of_range("y", "x", "median", 0, 3), agg_of_range("y", "x", "median", 0, 3, (1, 2))).collect()
    want = [(1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, None), (None,) * 4, (4.5, 13 / 3, 2.5, 1.5), (4.5, 10 / 3, 3.5, 3.5), (None,) * 4]
    for g, w in zip(got, want):
        assert all((a is None and b is None) or abs(a - b) < 1e-12 for a, b in zip(g, w))
    few = df.select(agg_of_range("y", "x", "count", 0, 3, x_max_idx_offset=9), agg_of_range("y", "x", "count", 0, 3, x_max_idx_offset=1), agg_of_range("y", "x", "max", 0, 3), agg_of_range("y", "x", "min", 0, 3), agg_of_range("y", "x", "sum", 0, 3)).collect()[3]
    assert tuple(few) == (None, 3.0, 8.0, 1.0, 14.0)
    for wrong in (lambda: agg_of_range("y", "x", "mode", 0, 1), lambda: agg_of_range("y", "x", "sum", 0, 1, (NAN, 1))):
        with pytest.raises(ValueError):
            wrong()


@pytest.mark.parametrize("size", [2, WIDE + 16])
def test_elementwise_aggregates(spark, size):
    n = WIDE + 16
    data = [("k", [None] + [0.0] * (n - 1)), ("k", [NAN, 1.0] + [0.0] * (n - 2)), ("k", [INF] * n), ("k", None), ("m", None)]
    df = spark.createDataFrame(data, "k string, l array<double>")
    for agg, first, empty in (("mean", [None, 0.5], None), ("sum", [None, 1.0], None), ("count", [0.0, 2.0], 0.0)):
        got = {r.k: r.v for r in aggregate_elementwise(df, ["k"], "l", size, agg, "v").collect()}
        assert got["k"][:2] == first and len(got["k"]) == size and got["m"] == [empty] * size
    with pytest.raises(Exception, match="shorter"):
        aggregate_elementwise(df, ["k"], "l", n + 1).collect()
    with pytest.raises(ValueError):
        aggregate_list_col_elementwise("l", 0)


def test_spectra(spark):
    g = np.random.default_rng(1)
    rows = [g.normal(size=16).tolist(), None, g.normal(size=8).tolist(), g.normal(size=16).tolist()]
    df = spark.createDataFrame([(r,) for r in rows], "s array<double>")
    for kw, f in (({}, lambda x: np.abs(np.fft.rfft(x))), ({"window": "hanning", "norm": "window"}, lambda x: np.abs(np.fft.rfft(x * signal.hann_window(len(x)))) / signal.hann_window(len(x) // 2 + 1).sum()), ({"window": "hamming", "norm": "length"}, lambda x: np.abs(np.fft.rfft(x * signal.hamming_window(len(x)))) / (len(x) / 2 + 1)), ({"window": "other", "skip_fft": True}, lambda x: x)):
        for got, x in zip(df.select(apply_fft("s", 100, **kw)).collect(), rows):
            assert got[0] is None if x is None else np.allclose(got[0], f(np.array(x)))
    for bad in ([1.0, 2.0, 3.0], [], [1.0, None], [1.0, NAN]):
        with pytest.raises(Exception, match="apply_fft"):
            spark.createDataFrame([(bad,)], "s array<double>").select(apply_fft("s", 100)).collect()
    for wrong in ((-1, None), (30, 20), (0, 51)):
        with pytest.raises(ValueError):
            apply_fft("s", 100, bp_min=wrong[0], bp_max=wrong[1])


@pytest.mark.parametrize("low,high", [(None, 20.0), (20.0, None), (10.0, 30.0)])
@pytest.mark.parametrize("order", [1, 2, 4, 5])
def test_band_limits(low, high, order):
    fs, n = 200.0, 4096
    sos = signal.butterworth(order, fs, *signal.band_kind(fs, low, high))
    assert all(np.all(np.abs(np.roots(s[3:])) < 1) for s in sos)
    response = lambda f: abs(np.prod([(s[0] + s[1] * w + s[2] * w**2) / (1 + s[4] * w + s[5] * w**2) for s in sos for w in [np.exp(-2j * np.pi * f / fs)]]))
    for edge in (x for x in (low, high) if x):
        assert abs(response(edge) - 2**-0.5) < 1e-6  # half power at the limits, whatever the order
    t = np.arange(n) / fs
    middle = {(None, 20.0): 2.0, (20.0, None): 80.0}.get((low, high), 17.5)
    outside = 90.0 if high else 1.0
    inner, outer = np.sin(2 * np.pi * middle * t), np.sin(2 * np.pi * outside * t)
    y = signal.bandpass(np.stack([inner, outer]), fs, order, low, high)[:, n // 4 : -n // 4]
    x = inner[n // 4 : -n // 4]
    assert abs(np.dot(y[0], x) / np.dot(x, x) - 1) < 0.03  # the gain is one and there is no shift
    assert np.abs(y[1]).max() < (0.25 if order == 1 else 0.05)
    assert np.array_equal(signal.bandpass(y, fs, order, 0, 100), y)


def test_interpolation_and_frequencies(spark):
    r = one(spark, "x array<double>, y array<double>, p array<double>, n array<double>, e array<double>", ([0.0, 1.0, 2.0], [0.0, 10.0, 0.0], [-1.0, 0.5, 1.5, 9.0], None, []), a=interpolate_columns("x", "y", "p"), n=interpolate_columns("x", "n", "p"), e=interpolate_columns("e", "y", "p"))
    assert r.a == [0.0, 5.0, 5.0, 0.0] and r.n is None and r.e is None
    assert fft_freqs(5, 200) == [0, 25, 50, 75, 100] and fft_freqs_linspace(3, 10) == [0, 5, 10]


def test_parsing(spark):
    df = spark.createDataFrame([("2024.03.05", "202311", "7"), ("05.03.2024", "bad", "123"), (None, None, None)], "d string, m string, z string")
    got = df.select(first_date("d", ["%Y.%m.%d", "%d.%m.%Y"]).cast("string"), to_date("m", "%Y%m").cast("string"), zfill("z", 2), replace_values("z", {"7": "seven"}), strftime(F.lit("2024-03-05").cast("date"), "%b")).collect()
    assert [tuple(r) for r in got] == [("2024-03-05", "2023-11-01", "07", "seven", "Mar"), ("2024-03-05", None, "123", "123", "Mar"), (None, None, None, None, "Mar")]
    roll = spark.createDataFrame([("a", i, float(i)) for i in range(4)], "k string, t int, v double").select("t", rolling_mean("v", 3, "t", "k").alias("m")).orderBy("t")
    assert [r.m for r in roll.collect()] == [None, None, 1.0, 2.0]
