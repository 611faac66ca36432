"""Expressions over windows of samples (``array<double>``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.vector import let


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def rms(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.sqrt(total(F.transform(x, lambda v: v * v)) / F.size(x))).otherwise(0.0)


def level(x: Column) -> Column:
    """Loudness from 0 to 1."""
    return F.least(rms(x) * 10, F.lit(1.0))


def zero_crossings(x: Column) -> Column:
    """Share of neighbouring samples with different signs."""
    n = F.size(x)
    pairs = F.zip_with(F.slice(x, 1, F.greatest(n - 1, F.lit(0))), F.slice(x, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.when((a >= 0) != (b >= 0), 1.0).otherwise(0.0))
    return F.when(n > 1, total(pairs) / (n - 1)).otherwise(0.0)


def centroid(x: Column) -> Column:
    """Mean place of the samples, weighted by their size."""
    mass = total(F.transform(x, lambda v: F.abs(v)))
    return F.when(mass > 0, total(F.transform(x, lambda v, i: F.abs(v) * i)) / mass).otherwise(0.0)


def rolloff(x: Column, share: float = 0.85) -> Column:
    """The first place at which so much of the total size has been passed."""
    bound = total(F.transform(x, lambda v: F.abs(v))) * share
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def count(s: Column) -> Column:
        step = lambda a, v: F.when(a["sum"] >= s["b"], a).otherwise(F.struct((a["sum"] + F.abs(v)).alias("sum"), (a["n"] + 1).alias("n")))
        return F.greatest(F.aggregate(s["x"], start, step, lambda a: a["n"]) - 1, F.lit(0))

    return let(F.struct(x.alias("x"), bound.alias("b")), count)


def frequency_centroid(x: Column, rate: float, half: bool = False) -> Column:
    """``centroid`` as a frequency: places times rate over size, or half of that."""
    return F.when(F.size(x) > 0, centroid(x) * rate / F.size(x) / (2 if half else 1)).otherwise(0.0)


def energy_rolloff(x: Column, share: float = 0.85) -> Column:
    """The part of the window after which so much of its energy has been passed; 1 for an empty one."""
    return F.when(F.size(x) > 0, rolloff(F.transform(x, lambda v: v * v), share) / F.size(x)).otherwise(1.0)


def sorted_rolloff(x: Column, rate: float, share: float = 0.85) -> Column:
    """``rolloff`` over the sizes from the largest down, as a frequency."""
    sizes = F.sort_array(F.transform(x, lambda v: F.abs(v)), asc=False)
    return F.when(F.size(x) > 0, rolloff(sizes, share) * rate / F.size(x) / 2).otherwise(rate / 2)


def band_energies(x: Column, bands: int = 8, kept: int = 4) -> Column:
    """Root mean square of the first ``kept`` of ``bands`` equal parts; 0 for parts without samples."""
    width = F.floor(F.size(x) / bands).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(kept - 1)), lambda b: F.when(width > 0, F.sqrt(total(F.transform(F.slice(x, b * width + 1, F.greatest(width, F.lit(1))), lambda v: v * v)) / width)).otherwise(0.0))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of feature vectors; 1 where their sizes differ."""
    return F.when(F.size(a) == F.size(b), F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))).otherwise(1.0)


def speech_probability(energy: Column, centre: Column) -> Column:
    return F.when(energy > 0.01, 0.6).otherwise(0.0) + F.when((centre > 10) & (centre < 1000), 0.4).otherwise(0.0)


def snr_db(x: Column) -> Column:
    """Signal power over the noise floor (the first quarter of sorted sizes), in decibels."""
    sizes = F.array_sort(F.transform(x, lambda v: F.abs(v)))
    floor_ = F.try_element_at(sizes, (F.size(x) / 4).cast("int") + 1)
    return F.when((floor_ > 0) & (rms(x) > 0), 20 * F.log10(rms(x) / floor_))


def clipped(x: Column) -> Column:
    return F.size(F.filter(x, lambda v: F.abs(v) > 0.95)) > 0.01 * F.size(x)


def resample(x: Column, rate_in: int, rate_out: int) -> Column:
    """Linear interpolation to another rate."""

    def spread(own: Column) -> Column:
        n = F.floor(F.size(own) * F.lit(rate_out) / rate_in).cast("int")

        def at(i: Column) -> Column:
            place = i * (rate_in / rate_out)
            low = F.floor(place).cast("int")
            a = F.element_at(own, F.least(low, F.size(own) - 1) + 1)
            b = F.element_at(own, F.least(low + 1, F.size(own) - 1) + 1)
            return a + (b - a) * (place - low)

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at)).otherwise(F.array().cast("array<double>"))

    return let(x, spread)


def pre_emphasis(x: Column, factor: float = 0.97) -> Column:
    """Each sample less a part of the one before it."""
    return let(x, lambda own: F.transform(own, lambda v, i: F.when(i == 0, v).otherwise(v - factor * F.element_at(own, F.greatest(i, F.lit(1))))))


def high_pass(x: Column, rate: int, cutoff: float = 80.0) -> Column:
    """First-order recursive high-pass filter that starts settled on the first sample, as a fold."""
    rc, dt = 1 / (2 * 3.141592653589793 * cutoff), 1 / rate
    a = rc / (rc + dt)
    first = F.coalesce(F.try_element_at(x, F.lit(1)), F.lit(0.0))
    start = F.struct(first.alias("x"), first.alias("y"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, v: Column) -> Column:
        y = a * (s["y"] + v - s["x"])
        return F.struct(v.alias("x"), y.alias("y"), F.concat(s["out"], F.array(y)).alias("out"))

    return F.aggregate(x, start, step, lambda s: s["out"])


def level_to(x: Column, target: float = 0.1) -> Column:
    """The samples scaled to a root mean square; silence stays."""
    return let(x, lambda own: let(rms(own), lambda r: F.transform(own, lambda v: F.when(r > 0, v * (target / r)).otherwise(v))))


def peak_limited(x: Column) -> Column:
    """The samples scaled down to at most 1, if any is larger."""
    top = lambda own: F.array_max(F.transform(own, lambda v: F.abs(v)))
    return let(x, lambda own: let(top(own), lambda t: F.transform(own, lambda v: F.when(t > 1, v / t).otherwise(v))))


def gated(x: Column, width: int, threshold: float = 0.01, factor: float = 0.1) -> Column:
    """Parts of ``width`` samples with less mean energy than ``threshold`` at a tenth of their size."""
    cut = lambda own: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(own) / width).cast("int") - 1, F.lit(0))), lambda k: F.slice(own, k * width + 1, width))
    power = lambda p: total(F.transform(p, lambda v: v * v)) / F.greatest(F.size(p), F.lit(1))
    return F.flatten(F.transform(let(x, cut), lambda p: F.when(power(p) < threshold, F.transform(p, lambda v: v * factor)).otherwise(p)))


def recogniser_input(x: Column, width: int = 1600) -> Column:
    """Peak at most 1, pre-emphasis, quiet parts attenuated."""
    return gated(pre_emphasis(peak_limited(x)), width)


def attenuated(x: Column, window: int, hop: int, threshold: float, factor: float = 0.1) -> Column:
    """Overlapping windows below ``threshold`` of mean energy are attenuated one after the other, on what
    the ones before have left, so attenuation adds up; a fold over the windows."""
    starts = lambda own: F.filter(F.sequence(F.lit(0), F.size(own), F.lit(hop)), lambda s: s + window < F.size(own))

    def step(out: Column, s: Column) -> Column:
        own = F.slice(out, s + 1, window)
        quiet = total(F.transform(own, lambda v: v * v)) / window < threshold
        return F.when(quiet, F.transform(out, lambda v, i: F.when((i >= s) & (i < s + window), v * factor).otherwise(v))).otherwise(out)

    return let(x, lambda own: F.aggregate(starts(own), own, step))


def diarizer_input(x: Column, rate: int, threshold: float) -> Column:
    """High-pass at 80 Hz, level 0.1, quiet windows of 25 ms every 10 ms attenuated."""
    return attenuated(level_to(high_pass(x, rate)), max(1, int(rate * 0.025)), max(1, int(rate * 0.01)), threshold * 0.001)


def snr_between(original: Column, processed: Column) -> Column:
    """Signal over what processing changed, in decibels; 100 if nothing."""
    noise = total(F.zip_with(original, processed, lambda a, b: (a - b) * (a - b)))
    return F.when(noise > 0, 10 * F.log10(total(F.transform(original, lambda v: v * v)) / noise)).otherwise(100.0)


def adapted_threshold(snr: Column, threshold: float) -> Column:
    """The speech threshold, higher the noisier it is, at most 0.9; null without an estimate."""
    more = F.when(snr < 10, 0.3).when(snr < 20, 0.2).when(snr < 30, 0.1).otherwise(0.0)
    return F.when(snr.isNotNull(), F.least(threshold + more, F.lit(0.9)))


def guessed_language(crossings: Column, energy: Column) -> Column:
    """Language and confidence guessed from crossings and mean energy (struct)."""
    guess = lambda name, c: F.struct(F.lit(name).alias("language"), F.lit(c).alias("confidence"))
    return F.when((crossings > 0.1) & (energy > 0.01), F.when(crossings > 0.15, guess("ja", 0.75)).otherwise(guess("en", 0.8))).when(energy > 0.005, guess("en", 0.7)).otherwise(guess("en", 0.6))


#: Colours of speakers.
PALETTE = ("#3B82F6", "#EF4444", "#10B981", "#F59E0B", "#8B5CF6", "#EC4899", "#06B6D4", "#84CC16", "#F97316", "#6366F1")


def speaker_colour(name: Column) -> Column:
    """A colour by the sum of the bytes of the name's characters (the lowest byte of each)."""
    codes = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.pmod(F.ascii(c), F.lit(256)))
    place = F.pmod(F.pmod(F.aggregate(codes, F.lit(0), lambda s, c: s + c), F.lit(256)), F.lit(len(PALETTE)))
    return F.element_at(F.array(*[F.lit(c) for c in PALETTE]), place.cast("int") + 1)


def tier(memory_gb: Column, cores: Column) -> tuple[Column, Column]:
    """The model tier that a machine can run, and warnings."""
    best = F.when((memory_gb >= 16) & (cores >= 8), "high-accuracy").when((memory_gb >= 8) & (cores >= 4), "standard").otherwise("turbo")
    return best, F.array_compact(F.array(F.when(memory_gb < 4, "low_memory"), F.when(cores < 4, "limited_cpu_cores")))


def mono(channels: Column) -> Column:
    """Mean of interleaved channel arrays (``array<array<double>>``, one array for each frame)."""
    return F.transform(channels, lambda frame: total(frame) / F.size(frame))


def preferred_rate(rates: Column, order: tuple[int, ...] = (16000, 48000, 44100)) -> Column:
    """The first rate of ``order`` that is offered, else the highest, else 16000."""
    wanted = F.array_intersect(F.array(*[F.lit(r) for r in order]), rates)
    return F.coalesce(F.try_element_at(wanted, F.lit(1)), F.array_max(rates), F.lit(16000))


def readable_on(colour: Column) -> Column:
    """Black or white, whichever reads better on ``#rrggbb``."""
    part = lambda k: F.conv(F.substring(colour, k, 2), 16, 10).cast("double")
    return F.when((0.299 * part(2) + 0.587 * part(4) + 0.114 * part(6)) / 255 > 0.5, "#000000").otherwise("#ffffff")
