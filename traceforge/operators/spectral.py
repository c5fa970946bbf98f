"""Spectral analysis. The unit of work is one segment of a series, not the series.

Samples are dealt to their overlapping segments by Spark, each segment becomes one array, a vectorised
function gives its FFT, and spectra are averaged by Spark. Spectra are long: ``(keys, k, freq_hz, psd)``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceforge.functions.blocks import positioned, spectra
from traceforge.functions.series import KEYS, by_series
from traceforge.operators.prep import fill_all

# The bands of a band-power table, in Hz.
BANDS = [("low", 0.1, 5.0), ("mid", 5.0, 50.0), ("high", 50.0, 500.0), ("acoustic", 500.0, 5000.0)]


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def signals(readings: DataFrame, least: int = 8) -> DataFrame:
    """Series without gaps, renumbered from 0, with their size; series under ``least`` samples are left out."""
    at = fill_all(readings).withColumn("at", (F.row_number().over(by_series()) - 1).cast("long"))
    return at.withColumn("size", F.count("*").over(Window.partitionBy(*KEYS))).where(F.col("size") >= least)


def segments(series: DataFrame, nperseg: int) -> DataFrame:
    """``(keys, segment, x)``: half-overlapping segments of equal length; a last short one is dropped."""
    n = F.least(F.lit(nperseg), F.col("size")).cast("long")
    step = (n - F.floor(n / 2)).cast("long")
    last_start = F.floor((F.col("size") - n) / step)
    first, last = F.greatest(F.lit(0), F.ceil((F.col("at") - n + 1) / step)).cast("long"), F.least(F.floor(F.col("at") / step), last_start).cast("long")
    dealt = series.withColumns({"first": first, "last": last}).where("first <= last").select(*KEYS, "at", "value", F.explode(F.sequence("first", "last")).alias("segment"))
    g = dealt.groupBy(*KEYS, "segment").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v"))
    return g.select(*KEYS, "segment", F.col("v.value").alias("x"))


def detrended(x: np.ndarray, how: str) -> np.ndarray:
    if how == "constant":
        return x - x.mean()
    t = np.arange(len(x)) - (len(x) - 1) / 2
    return x - x.mean() - t * (t @ x) / (t @ t)


def density_scale(n: int, rate: float) -> np.ndarray:
    """One-sided density scale of each line."""
    scale = np.full(n // 2 + 1, 2.0)
    scale[0] = 1.0
    if n % 2 == 0:
        scale[-1] = 1.0
    return scale / (rate * (hann(n) ** 2).sum())


def segment_spectra(segs: DataFrame, rate: float, detrend: str = "linear", more: tuple[str, ...] = KEYS) -> DataFrame:
    """Power density of every segment as an array."""
    schema = ", ".join(f"{k} string" for k in more) + ", segment long, n long, p array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x in batch["x"]:
                x = np.asarray(x, float)
                y = np.fft.rfft(detrended(x, detrend) * hann(len(x)))
                out.append(np.abs(y) ** 2 * density_scale(len(x), rate))
            yield batch[[*more, "segment"]].assign(n=[len(x) for x in batch["x"]], p=out)

    return segs.mapInPandas(run, schema)


def psd(readings: DataFrame, rate: float, nperseg: int = 256) -> DataFrame:
    """Welch power spectral density of every series; series of no variance have zeros."""
    found = segment_spectra(segments(signals(readings), nperseg), rate)
    lines = found.select(*KEYS, "n", F.posexplode("p").alias("k", "p"))
    return lines.groupBy(*KEYS, "n", "k").agg(F.avg("p").alias("psd")).select(*KEYS, F.col("k").cast("long").alias("k"), (F.col("k") * rate / F.col("n")).alias("freq_hz"), "psd")


def periodogram(readings: DataFrame, rate: float) -> DataFrame:
    """Power density of one segment as long as the series, with linear trend removed and a periodic Hann window.

    The transform is taken in blocks of the series and added up, so no task holds a long series.
    """
    x = positioned(fill_all(readings)).where("size >= 8")
    at, n = F.col("at").cast("double"), F.col("size")
    fit = x.groupBy(*KEYS).agg(F.regr_slope("value", at).alias("b"), F.regr_intercept("value", at).alias("a"), F.lit(0).cast("long").alias("k0"), F.floor(F.first("size") / 2).alias("k1"))
    hann_at = 0.5 - 0.5 * F.cos(2 * math.pi * at / n)
    flat = x.join(fit.select(*KEYS, "a", "b"), list(KEYS)).select(*KEYS, "at", "size", ((F.col("value") - F.col("a") - F.col("b") * at) * hann_at).alias("x"))
    sizes = x.groupBy(*KEYS).agg(F.first("size").alias("n"))
    lines = spectra(flat, fit).select(*KEYS, "k0", F.posexplode("power").alias("i", "p")).join(sizes, list(KEYS)).withColumn("k", F.col("k0") + F.col("i"))
    scale = F.when((F.col("k") == 0) | (2 * F.col("k") == F.col("n")), 1.0).otherwise(2.0) / (rate * 0.375 * F.col("n"))  # the squared window sums to 3/8 n
    return lines.select(*KEYS, "k", (F.col("k") * rate / F.col("n")).alias("freq_hz"), (F.col("p") * scale).alias("psd"))


def trapezoid(spectra: DataFrame) -> DataFrame:
    """Adds the area from each line to the next of its spectrum."""
    w = Window.partitionBy(*KEYS).orderBy("k")
    return spectra.withColumn("area", (F.lead("freq_hz").over(w) - F.col("freq_hz")) * (F.col("psd") + F.lead("psd").over(w)) / 2)


def spectrum_summary(spectra: DataFrame) -> DataFrame:
    """Dominant line (not the mean's) and total power."""
    w = trapezoid(spectra)
    return w.groupBy(*KEYS).agg(F.max_by(F.struct("k", "freq_hz", "psd"), F.when(F.col("k") > 0, F.struct("psd", -F.col("k")))).alias("d"), F.sum("area").alias("total_power")).select(*KEYS, F.col("d.k").alias("peak_k"), F.col("d.freq_hz").alias("dominant_hz"), F.col("d.psd").alias("peak_psd"), "total_power")


def bandwidth(spectra: DataFrame, peaks: DataFrame) -> DataFrame:
    """Half-power width around ``peaks(keys, peak_k)``, sides interpolated, the spectrum's ends where it stays above."""
    p = spectra.join(peaks.select(*KEYS, "peak_k"), list(KEYS))
    half = p.where("k = peak_k").select(*KEYS, "peak_k", (F.col("psd") / 2).alias("half"))
    p = p.join(half, [*KEYS, "peak_k"])
    w = Window.partitionBy(*KEYS, "peak_k").orderBy("k")
    p = p.withColumns({"f1": F.lead("freq_hz").over(w), "p1": F.lead("psd").over(w), "f0": F.lag("freq_hz").over(w), "p0": F.lag("psd").over(w)})
    below = F.col("psd") < F.col("half")

    def side(f: str, q: str) -> Column:
        return F.col("freq_hz") + (F.col("half") - F.col("psd")) / (F.col(q) - F.col("psd")) * (F.col(f) - F.col("freq_hz"))

    g = p.groupBy(*KEYS, "peak_k").agg(
        F.max_by(side("f1", "p1"), F.when(below & (F.col("k") < F.col("peak_k")), F.col("k"))).alias("left"), F.min_by(side("f0", "p0"), F.when(below & (F.col("k") > F.col("peak_k")), F.col("k"))).alias("right"),
        F.min("freq_hz").alias("lo"), F.max("freq_hz").alias("hi"),
    )
    return g.select(*KEYS, "peak_k", F.coalesce("left", "lo").alias("left_hz"), F.coalesce("right", "hi").alias("right_hz"), (F.coalesce("right", "hi") - F.coalesce("left", "lo")).alias("bandwidth_hz"))


def spectrogram(readings: DataFrame, rate: float, nperseg: int = 256) -> DataFrame:
    """Squared short-time transform: ends extended by half a segment of zeros, windowed, scaled by the window's sum."""
    s = signals(readings).withColumn("n", F.least(F.lit(nperseg), F.col("size")).cast("long"))
    pad = F.floor(F.col("n") / 2).cast("long")
    moved = s.select(*KEYS, (F.col("at") + pad).alias("at"), "value", F.col("size"), "n")
    step = (F.col("n") - F.floor(F.col("n") / 2)).cast("long")
    first, last = F.greatest(F.lit(0), F.ceil((F.col("at") - F.col("n") + 1) / step)).cast("long"), F.floor(F.col("at") / step).cast("long")
    dealt = moved.select(*KEYS, "at", "value", "n", step.alias("step"), F.explode(F.sequence(first, last)).alias("segment"))
    g = dealt.groupBy(*KEYS, "segment").agg(F.collect_list(F.struct((F.col("at") - F.col("segment") * F.col("step")).alias("i"), "value")).alias("v"), F.first("n").alias("n"), F.first("step").alias("step"))
    flat = g.select(*KEYS, "segment", "n", "step", F.col("v.i").alias("i"), F.col("v.value").alias("x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for n, i, v in zip(batch["n"], batch["i"], batch["x"]):
                x = np.zeros(n)
                x[np.asarray(i, int)] = v
                out.append(np.abs(np.fft.rfft(x * hann(n)) / hann(n).sum()) ** 2)
            yield batch[[*KEYS, "segment", "n", "step"]].assign(p=out)

    lines = flat.mapInPandas(run, "test_id string, channel string, segment long, n long, step long, p array<double>")
    return lines.select(*KEYS, "segment", (F.col("segment") * F.col("step") / rate).alias("time_s"), F.posexplode("p").alias("k", "power"), "n").select(*KEYS, "segment", "time_s", "k", (F.col("k") * rate / F.col("n")).alias("freq_hz"), "power")


def harmonics(spectra: DataFrame, peaks: DataFrame, count: int = 5, tolerance_hz: float = 1.0) -> DataFrame:
    """The strongest local peak near each multiple of the fundamental, relative to the fundamental's power."""
    w = Window.partitionBy(*KEYS).orderBy("k")
    local = spectra.withColumn("top", (F.col("psd") >= F.coalesce(F.lag("psd").over(w), F.lit(0.0))) & (F.col("psd") >= F.coalesce(F.lead("psd").over(w), F.lit(0.0))))
    multiples = peaks.select(*KEYS, F.col("dominant_hz").alias("f0"), F.col("peak_psd").alias("p0"), F.explode(F.sequence(F.lit(1), F.lit(count))).alias("harmonic"))
    near = local.join(multiples, list(KEYS)).where(F.col("top") & (F.abs(F.col("freq_hz") - F.col("harmonic") * F.col("f0")) <= tolerance_hz))
    g = near.groupBy(*KEYS, "harmonic", "f0", "p0").agg(F.max_by(F.struct("freq_hz", "psd"), F.struct("psd", -F.col("k"))).alias("b"))
    return g.select(*KEYS, "harmonic", F.col("b.freq_hz").alias("freq_hz"), F.col("b.psd").alias("psd"), (F.col("b.psd") / F.col("p0")).alias("relative"))


def cross_spectrum(readings: DataFrame, left: str, right: str, rate: float, nperseg: int = 256) -> DataFrame:
    """Coherence, phase and complex cross density of two channels of every test, aligned by sample."""
    from traceforge.operators.qc import paired

    pair = paired(readings, left, right).where("a is not null and b is not null")
    order = Window.partitionBy("test_id").orderBy("seq")
    size = pair.groupBy("test_id").agg(F.count("*").alias("size")).where("size >= 8")
    series = pair.join(size, "test_id").withColumn("at", (F.row_number().over(order) - 1).cast("long"))
    one = series.select("test_id", F.lit("a").alias("channel"), "at", F.col("a").alias("value"), "size").unionByName(series.select("test_id", F.lit("b").alias("channel"), "at", F.col("b").alias("value"), "size"))
    segs = segments(one, nperseg)
    both = segs.where("channel = 'a'").select("test_id", "segment", "x").join(segs.where("channel = 'b'").select("test_id", "segment", F.col("x").alias("y")), ["test_id", "segment"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for test, x, y in zip(batch["test_id"], batch["x"], batch["y"]):
                x, y = np.asarray(x, float), np.asarray(y, float)
                w, s = hann(len(x)), density_scale(len(x), rate)
                fx, fy = np.fft.rfft(detrended(x, "constant") * w), np.fft.rfft(detrended(y, "constant") * w)
                xy = np.conj(fx) * fy * s
                rows.append((test, len(x), np.abs(fx) ** 2 * s, np.abs(fy) ** 2 * s, xy.real, xy.imag))
            yield pd.DataFrame(rows, columns=["test_id", "n", "pxx", "pyy", "re", "im"])

    arrays = both.mapInPandas(run, "test_id string, n long, pxx array<double>, pyy array<double>, re array<double>, im array<double>")
    lines = arrays.select("test_id", "n", F.posexplode(F.arrays_zip("pxx", "pyy", "re", "im")).alias("k", "v"))
    g = lines.groupBy("test_id", "n", "k").agg(*[F.avg(f"v.{c}").alias(c) for c in ("pxx", "pyy", "re", "im")])
    power = F.col("pxx") * F.col("pyy")
    coherence = F.when(power > 0, (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / power)
    return g.select("test_id", F.col("k").cast("long").alias("k"), (F.col("k") * rate / F.col("n")).alias("freq_hz"), coherence.alias("coherence"), F.atan2("im", "re").alias("phase"), F.struct("re", "im").alias("csd"))


def bases(x: np.ndarray) -> np.ndarray:
    """For each line the smallest value back to the nearest higher line; a stack holds the lines that are not yet passed by a higher one."""
    out, higher = np.empty(len(x)), []
    for i, v in enumerate(x):
        least = v
        while higher and higher[-1][0] <= v:
            least = min(least, higher.pop()[1])
        higher.append((v, least))
        out[i] = least
    return out


def half_power(f: np.ndarray, p: np.ndarray, top: int) -> tuple[float, float]:
    """Where the density first falls under half of line ``top`` on each side, interpolated; the spectrum's ends where it does not."""
    half, ends = p[top] / 2, []
    for step, end in ((-1, 0), (1, len(p) - 1)):
        i = top
        while i != end and not p[i] < half:
            i += step
        ends.append(f[i] + (half - p[i]) / (p[i - step] - p[i]) * (f[i - step] - f[i]) if p[i] < half else f[end])
    return ends[0], ends[1]


def resonances(spectra: DataFrame, low_hz: float = 0.0, high_hz: float = float("inf"), least_db: float = 3.0) -> DataFrame:
    """Peaks that stand out by ``least_db`` or more in a band, with their half-power width (as by :func:`bandwidth`) and quality factor.

    Prominence and widths are found a spectrum at a time, so the lines are computed once; prominence in time linear in the lines.
    """
    columns = ["test_id", "channel", "peak_k", "freq_hz", "psd", "prominence_db", "left_hz", "right_hz"]

    def run(part: pa.Table) -> pa.Table:
        k = part["k"].to_numpy()
        order = np.argsort(k)
        k, f, p = k[order], part["freq_hz"].to_numpy()[order], part["psd"].to_numpy()[order]
        db = 10 * np.log10(np.maximum(p, 1e-300))
        left, right = bases(db), bases(db[::-1])[::-1]
        rows, i = [], 1
        while i < len(db) - 1:
            j = i
            while j + 1 < len(db) and db[j + 1] == db[i]:
                j += 1
            if db[i - 1] < db[i] and j + 1 < len(db) and db[j + 1] < db[i]:
                top = (i + j) // 2
                prominence = db[i] - max(left[i], right[j])
                if prominence >= least_db and low_hz <= f[top] <= high_hz:
                    rows.append((k[top], f[top], p[top], prominence, *half_power(f, p, top)))
            i = j + 1
        made = part.select(list(KEYS)).take(pa.array([0] * len(rows), pa.int64()))
        for name, column in zip(columns[2:], zip(*rows) if rows else [()] * 6):
            made = made.append_column(name, pa.array(column, pa.int64() if name == "peak_k" else pa.float64()))
        return made

    spec = "test_id string, channel string, peak_k long, freq_hz double, psd double, prominence_db double, left_hz double, right_hz double"
    peaks = spectra.select(*KEYS, "k", "freq_hz", "psd").groupBy(*KEYS).applyInArrow(run, spec).withColumn("bandwidth_hz", F.col("right_hz") - F.col("left_hz"))
    return peaks.withColumn("q_factor", F.when(F.col("bandwidth_hz") > 0, F.col("freq_hz") / F.col("bandwidth_hz")))


def band_power(spectra: DataFrame) -> DataFrame:
    """Area under the density inside each band, between lines of the band only, and in total."""
    bands = spectra.sparkSession.createDataFrame([*BANDS, ("total", 0.0, 1e300)], "band string, low double, high double")
    inside = spectra.join(bands, F.col("freq_hz").between(F.col("low"), F.col("high")))
    w = Window.partitionBy(*KEYS, "band").orderBy("k")
    area = (F.lead("freq_hz").over(w) - F.col("freq_hz")) * (F.col("psd") + F.lead("psd").over(w)) / 2
    return inside.withColumn("area", area).groupBy(*KEYS, "band").agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("power"))
