"""Spectral queries. Samples of a test count as one a second, so frequencies are in cycles per sample."""

from pyspark.sql import functions as F

from traceforge.operators import spectral
from traceforge.queries.base import READINGS, query, readings, rounded

N = 32
# Welch's method by the definition: half-overlapping segments, linear trend removed, periodic Hann, DFT as a join
SEGMENTS = f"""{READINGS}, sz AS (SELECT test_id, channel, count(*) AS size FROM readings GROUP BY ALL HAVING count(*) >= {N}),
  sg AS (SELECT test_id, channel, unnest(range(0, (size - {N}) // {N // 2} + 1)) AS segment FROM sz),
  x AS (SELECT s.test_id, s.channel, segment, seq - segment * {N // 2} AS i, value AS x FROM sg s JOIN readings r ON r.test_id = s.test_id AND r.channel = s.channel AND r.seq >= segment * {N // 2} AND r.seq < segment * {N // 2} + {N}),
  tr AS (SELECT test_id, channel, segment, regr_slope(x, i::DOUBLE) AS b, regr_intercept(x, i::DOUBLE) AS a FROM x GROUP BY ALL),
  y AS (SELECT x.test_id, x.channel, x.segment, i, (x - a - b * i) * (0.5 - 0.5 * cos(2 * pi() * i / {N})) AS y FROM x JOIN tr USING (test_id, channel, segment)),
  ks AS (SELECT unnest(range(0, {N // 2 + 1})) AS k),
  f AS (SELECT test_id, channel, segment, k, (pow(sum(y * cos(2 * pi() * k * i / {N})), 2) + pow(sum(y * sin(2 * pi() * k * i / {N})), 2)) * any_value(CASE WHEN k IN (0, {N // 2}) THEN 1 ELSE 2 END) / {float((spectral.hann(N) ** 2).sum())!r}::DOUBLE AS p FROM y, ks GROUP BY ALL),
  psd AS (SELECT test_id, channel, k, k / {N}::DOUBLE AS freq_hz, avg(p) AS psd FROM f GROUP BY ALL)"""


def psd(spark, sf):
    return spectral.psd(readings(spark, sf), 1.0, N)


@query("f1_psd", f"WITH {SEGMENTS} SELECT test_id, channel, k, freq_hz, round(psd, 4) AS psd FROM psd")
def f1(spark, sf):
    return psd(spark, sf).select("test_id", "channel", "k", "freq_hz", F.round("psd", 4).alias("psd"))


PERIODOGRAM = f"""{READINGS}, sz AS (SELECT test_id, channel, count(*) AS n, regr_slope(value, seq::DOUBLE) AS b, regr_intercept(value, seq::DOUBLE) AS a FROM readings GROUP BY ALL HAVING count(*) >= 8),
  y AS (SELECT r.test_id, r.channel, seq AS i, n, (value - a - b * seq) * (0.5 - 0.5 * cos(2 * pi() * seq / n)) AS y FROM readings r JOIN sz USING (test_id, channel)),
  f AS (SELECT test_id, channel, k, any_value(n) AS n, pow(sum(y * cos(2 * pi() * (k * i % n) / n)), 2) + pow(sum(y * sin(2 * pi() * (k * i % n) / n)), 2) AS p
    FROM y JOIN (SELECT unnest(range(0, 400)) AS k) ON k <= n // 2 GROUP BY test_id, channel, k)"""


@query("f1_periodogram", f"WITH {PERIODOGRAM} SELECT test_id, channel, k, round(k / n, 9) AS freq_hz, round(p * CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END / (0.375::DOUBLE * n), 4) AS psd FROM f")
def f1_whole(spark, sf):
    return spectral.periodogram(readings(spark, sf), 1.0).select("test_id", "channel", "k", F.round("freq_hz", 9).alias("freq_hz"), F.round("psd", 4).alias("psd"))


SUMMARY = """ar AS (SELECT *, (lead(freq_hz) OVER w - freq_hz) * (psd + lead(psd) OVER w) / 2 AS area FROM psd WINDOW w AS (PARTITION BY test_id, channel ORDER BY k)),
  pk AS (SELECT test_id, channel, k AS peak_k, freq_hz AS dominant_hz, psd AS peak_psd FROM psd WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY test_id, channel ORDER BY psd DESC, k) = 1)"""


@query("f1_summary", f"WITH {SEGMENTS}, {SUMMARY} SELECT test_id, channel, peak_k, dominant_hz, round(peak_psd, 4) AS peak_psd, round(sum(area), 4) AS total_power FROM ar JOIN pk USING (test_id, channel) GROUP BY ALL")
def f1b(spark, sf):
    return spectral.spectrum_summary(psd(spark, sf)).select("test_id", "channel", "peak_k", "dominant_hz", F.round("peak_psd", 4).alias("peak_psd"), F.round("total_power", 4).alias("total_power"))


@query("f2_bandwidth", f"""WITH {SEGMENTS}, {SUMMARY}, p AS (SELECT psd.*, peak_k, peak_psd / 2 AS half, lead(freq_hz) OVER w AS f1, lead(psd) OVER w AS p1, lag(freq_hz) OVER w AS f0, lag(psd) OVER w AS p0 FROM psd JOIN pk USING (test_id, channel) WINDOW w AS (PARTITION BY test_id, channel ORDER BY k)),
  g AS (SELECT test_id, channel, max_by(freq_hz + (half - psd) / (p1 - psd) * (f1 - freq_hz), k) FILTER (psd < half AND k < peak_k) AS l, min_by(freq_hz + (half - psd) / (p0 - psd) * (f0 - freq_hz), k) FILTER (psd < half AND k > peak_k) AS r, min(freq_hz) AS lo, max(freq_hz) AS hi FROM p GROUP BY ALL)
  SELECT test_id, channel, round(coalesce(r, hi) - coalesce(l, lo), 7) AS bandwidth_hz FROM g""")
def f2(spark, sf):
    s = psd(spark, sf)
    return spectral.bandwidth(s, spectral.spectrum_summary(s)).select("test_id", "channel", F.round("bandwidth_hz", 7).alias("bandwidth_hz"))


@query("f3_spectrogram")
def f3(spark, sf):
    return spectral.spectrogram(readings(spark, sf), 1.0, N)


@query("f4_harmonics", f"""WITH {SEGMENTS}, {SUMMARY}, lo AS (SELECT *, psd >= coalesce(lag(psd) OVER w, 0) AND psd >= coalesce(lead(psd) OVER w, 0) AS top FROM psd WINDOW w AS (PARTITION BY test_id, channel ORDER BY k)),
  h AS (SELECT l.test_id, l.channel, n AS harmonic, freq_hz, psd, peak_psd FROM lo l JOIN pk USING (test_id, channel), (SELECT unnest([1, 2, 3, 4, 5]) AS n) WHERE top AND abs(freq_hz - n * dominant_hz) <= 0.04 QUALIFY row_number() OVER (PARTITION BY test_id, channel, n ORDER BY psd DESC, k) = 1)
  SELECT test_id, channel, harmonic, freq_hz, round(psd / peak_psd, 7) AS relative FROM h""")
def f4(spark, sf):
    s = psd(spark, sf)
    return spectral.harmonics(s, spectral.spectrum_summary(s), 5, 0.04).select("test_id", "channel", "harmonic", "freq_hz", F.round("relative", 7).alias("relative"))


CROSS = f"""{READINGS}, pr AS (SELECT test_id, seq, max(value) FILTER (channel = 'view') AS a, max(value) FILTER (channel = 'click') AS b FROM readings WHERE channel IN ('view', 'click') GROUP BY ALL),
  o AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY seq) - 1 AS pos, count(*) OVER (PARTITION BY test_id) AS size FROM pr WHERE a IS NOT NULL AND b IS NOT NULL),
  sg AS (SELECT DISTINCT test_id, unnest(range(0, (size - {N}) // {N // 2} + 1)) AS segment FROM o WHERE size >= {N}),
  x AS (SELECT s.test_id, segment, pos - segment * {N // 2} AS i, (a - avg(a) OVER w) * (0.5 - 0.5 * cos(2 * pi() * (pos - segment * {N // 2}) / {N})) AS a, (b - avg(b) OVER w) * (0.5 - 0.5 * cos(2 * pi() * (pos - segment * {N // 2}) / {N})) AS b
    FROM sg s JOIN o ON o.test_id = s.test_id AND pos >= segment * {N // 2} AND pos < segment * {N // 2} + {N} WINDOW w AS (PARTITION BY s.test_id, segment)),
  f AS (SELECT test_id, segment, k, sum(a * cos(2 * pi() * k * i / {N})) AS ar, -sum(a * sin(2 * pi() * k * i / {N})) AS ai, sum(b * cos(2 * pi() * k * i / {N})) AS br, -sum(b * sin(2 * pi() * k * i / {N})) AS bi FROM x, (SELECT unnest(range(1, {N // 2 + 1})) AS k) GROUP BY ALL),
  g AS (SELECT test_id, k, avg(ar * ar + ai * ai) AS xx, avg(br * br + bi * bi) AS yy, avg(ar * br + ai * bi) AS re, avg(ar * bi - ai * br) AS im FROM f GROUP BY ALL)"""


@query("f5_cross_spectrum", f"WITH {CROSS} SELECT test_id, k, k / {N}::DOUBLE AS freq_hz, round((re * re + im * im) / (xx * yy), 6) AS coherence, round(cos(atan2(im, re)), 5) AS cos_phase FROM g")
def f5(spark, sf):
    df = spectral.cross_spectrum(readings(spark, sf), "view", "click", 1.0, N).where("k > 0")
    return df.select("test_id", "k", "freq_hz", F.round("coherence", 6).alias("coherence"), F.round(F.cos("phase"), 5).alias("cos_phase"))


@query("f6_resonances")
def f6(spark, sf):
    return spectral.resonances(psd(spark, sf))


@query("f7_band_power", f"""WITH {SEGMENTS}, bands(band, lo, hi) AS (VALUES ('low', 0.1::DOUBLE, 5.0::DOUBLE), ('mid', 5.0, 50.0), ('high', 50.0, 500.0), ('acoustic', 500.0, 5000.0), ('total', 0.0, 1e300::DOUBLE)),
  a AS (SELECT test_id, channel, band, (lead(freq_hz) OVER w - freq_hz) * (psd + lead(psd) OVER w) / 2 AS area FROM psd JOIN bands ON freq_hz BETWEEN lo AND hi WINDOW w AS (PARTITION BY test_id, channel, band ORDER BY k))
  SELECT test_id, channel, band, round(coalesce(sum(area), 0), 4) AS power FROM a GROUP BY ALL""")
def f7(spark, sf):
    return spectral.band_power(psd(spark, sf)).select("test_id", "channel", "band", F.round("power", 4).alias("power"))
