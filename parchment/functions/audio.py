"""Functions over arrays of samples: frames, edges, gaps, checks of a take."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from . import text as T

# Rates and thresholds of the checks.
SAMPLE_RATE = 24_000
LOUD_DB = -45.0
PROFILE = {"rate": 18.0, "overhead": 0.15, "absolute_rate": 10.0, "absolute_overhead": 0.8, "least_chars": 12, "least": 0.75, "most": 1.45, "gap_ms": 500, "tail_ms": 400, "overrun": 1.6}


def loud_frames(audio: Column, window: int, db: float = LOUD_DB) -> Column:
    """Numbers of the whole frames whose level is above db."""
    n = F.floor(F.size(audio) / window).cast("int")
    energy = lambda i: F.aggregate(F.slice(audio, i * window + 1, F.lit(window)), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    level = lambda i: 20 * F.log10(F.sqrt(energy(i) / window) + 1e-12)
    return F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: level(i) > db)).otherwise(F.array().cast("array<int>"))


def trim_edges(audio: Column, loud: Column, window: int, keep: int = 4) -> Column:
    """audio from `keep` frames before the first loud frame to as many behind the last."""
    n = F.floor(F.size(audio) / window).cast("int")
    start = F.greatest(F.lit(0), F.element_at(loud, 1) - keep) * window
    end = F.least(n, F.element_at(loud, -1) + 1 + keep) * window
    return F.when(F.size(loud) == 0, audio).otherwise(F.slice(audio, start + 1, end - start))


def _last_gap(loud: Column, frames: int) -> Column:
    """The loud frame behind the last gap of at least `frames`; null if there is none."""
    after = F.slice(loud, F.lit(2), F.greatest(F.lit(0), F.size(loud) - 1))
    wide = F.filter(F.zip_with(F.slice(loud, F.lit(1), F.greatest(F.lit(0), F.size(loud) - 1)), after, lambda a, b: F.when(b - a >= frames, b)), lambda x: x.isNotNull())
    return F.when(F.size(wide) > 0, F.element_at(wide, -1))


def last_run(audio: Column, loud: Column, window: int, rate: float, gap_frames: int) -> Column:
    """Seconds of the last run of speech; of all, where no gap parts it."""
    behind = F.when(F.size(loud) >= 2, _last_gap(loud, gap_frames))
    return F.coalesce((F.element_at(loud, -1) - behind + 1) * window / rate, F.size(audio) / rate)


def trailing_artifact(loud: Column, frame_ms: float, gap_frames: int, tail_ms: float) -> Column:
    behind = F.when(F.size(loud) >= 2, _last_gap(loud, gap_frames))
    return F.coalesce((F.element_at(loud, -1) - behind + 1) * frame_ms <= tail_ms, F.lit(False))


def expected_seconds(text: Column, rate: Column | float = PROFILE["rate"]) -> Column:
    return F.length(text) / rate + PROFILE["overhead"]


def verdict(duration: Column, text: Column, artifact: Column, run: Column, rate: float = PROFILE["rate"]) -> Column:
    """What is wrong with a take; empty if nothing."""
    expected = expected_seconds(text, rate)
    parts = F.filter(F.split(text, T.QC_SENTENCE_END), lambda s: F.trim(s) != "")
    overrun = (F.size(parts) >= 2) & (run > expected_seconds(F.element_at(parts, -1), rate) * PROFILE["overrun"])
    odd = (F.length(text) >= PROFILE["least_chars"]) & ~duration.between(expected * PROFILE["least"], expected * PROFILE["most"])
    return (
        F.when(duration > F.length(text) / PROFILE["absolute_rate"] + PROFILE["absolute_overhead"], "absurd length")
        .when(odd, "length").when(artifact, "trailing sound").when(overrun, "long last sentence").otherwise("")
    )


def resample(audio: Column, source: int, target: int) -> Column:
    """Linear interpolation to another rate."""
    n = F.size(audio)
    m = F.floor(n / source * target).cast("int")

    def at(k):
        x = F.when(m > 1, k * (n - 1) / (m - 1)).otherwise(F.lit(0.0))
        i = F.least(F.floor(x).cast("int"), n - 1)
        a = F.element_at(audio, i + 1).cast("double")
        b = F.element_at(audio, F.least(i + 2, n)).cast("double")
        return a + (b - a) * (x - i)

    return F.when((n > 0) & (m > 0), F.transform(F.sequence(F.lit(0), m - 1), at)).otherwise(F.array().cast("array<double>"))


def joined(parts: Column, rate: int = SAMPLE_RATE, lead_ms: int = 600) -> Column:
    """Samples of array<struct<audio, pause_ms>> end to end, with silences."""
    quiet = lambda ms: F.array_repeat(F.lit(0.0).cast("float"), F.floor(rate * ms / 1000).cast("int"))
    return F.concat(quiet(F.lit(lead_ms)), F.flatten(F.transform(parts, lambda p: F.concat(p["audio"], quiet(p["pause_ms"])))))


def rounded(x: Column, places: int) -> Column:
    """x rounded half away from zero; what rounds to zero keeps its sign, which round() loses."""
    r = F.round(x, places)
    return F.when((r == 0) & (x <= 0), x * 0.0).otherwise(r)


def spliced(audio: Column, start: Column, stop: Column, new: Column) -> Column:
    """audio with samples start .. stop - 1 replaced."""
    return F.concat(F.slice(audio, F.lit(1), start), new, F.slice(audio, stop + 1, F.greatest(F.lit(0), F.size(audio) - stop)))


@F.pandas_udf(ArrayType(FloatType()))
def decode_wav(raw: pd.Series) -> pd.Series:
    """16-bit WAV bytes to samples in -1 .. 1; channels are averaged; null for what isn't such a file."""

    def one(data: bytes | None):
        try:
            with wave.open(io.BytesIO(data)) as w:
                if w.getsampwidth() != 2:
                    return None
                x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768
                return x.reshape(-1, w.getnchannels()).mean(axis=1)
        except (TypeError, EOFError, wave.Error):
            return None

    return raw.map(one)


def quantised(audio: Column) -> Column:
    """Samples as 16-bit whole numbers, clipped to -1 .. 1."""
    return F.transform(audio, lambda x: (F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x.cast("double"))) * 32767).cast("int"))


def encode_wav(samples: Column, rate: int = SAMPLE_RATE) -> Column:
    """Whole numbers as quantised() gives them, as the bytes of a one-channel 16-bit WAV file."""

    @F.pandas_udf("binary")
    def pack(rows: pd.Series) -> pd.Series:
        def one(x) -> bytes:
            out = io.BytesIO()
            with wave.open(out, "wb") as w:
                w.setnchannels(1)
                w.setsampwidth(2)
                w.setframerate(rate)
                w.writeframes(np.asarray(x if x is not None else [], "<i2").tobytes())
            return out.getvalue()

        return rows.map(one)

    return pack(samples)
