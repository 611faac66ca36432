"""Where an utterance may end: boundary kinds of each frame, buffering, and utterances made of both.

A frame counts as ``FRAME`` milliseconds. Kinds come from window expressions; utterances depend on
earlier decisions and are folded in time order by ``Assembler``, in a batch or as state of a stream.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.operators.speech import ORDER, trailing

#: Milliseconds of a frame, frames of history, speech frames that make up the speech pattern.
FRAME, HISTORY, PATTERN = 100, 50, 20


@dataclass(frozen=True)
class Policy:
    """Bounds: loudness of silence; milliseconds; variance of natural speech."""

    silence: float = 0.015
    soft_ms: int = 600
    hard_ms: int = 1000
    speech_ms: int = 4500
    least_variance: float = 0.05
    most_variance: float = 0.5
    shortest_ms: int = 4500
    longest_ms: int = 20_000
    rest_ms: int = 15_000


def classify(frames: DataFrame, policy: Policy, key: str = "stream", unit_us: int = 1000) -> DataFrame:
    """``frames`` (key, seq, t_us, energy) with ``kind``: none, soft, hard or sentence_end.

    Nothing ends before enough speech lies in the history. A hard end needs a long silence after a
    pattern of speech that was clearly louder, or six silent frames of eight; a soft one a shorter
    silence, no hard end within the second before, and natural variance; a sentence ends where the
    loudness of speech rose in seven of nine steps (a quirk of the method that is kept). ``unit_us``
    is the length of a millisecond of the policy in event time. Also: ``run`` lengths ``quiet_run``,
    ``speech_run``, and ``speech_frames`` of the history.
    """
    own = W.partitionBy(key).orderBy(*ORDER)
    t = trailing(frames, policy.silence, key)
    loud = F.when(F.col("speech"), F.col("energy"))
    t = t.withColumn("speech_frames", F.sum(F.col("speech").cast("long")).over(own.rowsBetween(1 - HISTORY, 0))).withColumn("_nth", F.sum(F.col("speech").cast("long")).over(own))
    # the pattern of speech as of each speech frame; silent frames take the last one
    spoken = W.partitionBy(key, "speech").orderBy(*ORDER)
    rise = F.when(F.col("speech"), (F.col("energy") > F.lag("energy").over(spoken)).cast("long"))
    t = t.withColumn("_loud", F.when(F.col("speech"), F.avg(loud).over(spoken.rowsBetween(1 - PATTERN, 0)))).withColumn("_rise", rise)
    t = t.withColumn("_rises", F.when(F.col("speech"), F.sum("_rise").over(spoken.rowsBetween(-8, 0))))
    last = lambda c: F.last(c, ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, 0))
    t = t.withColumn("_loud", last("_loud")).withColumn("_rises", last("_rises"))
    t = t.withColumn("quiet_run", F.when(F.col("speech"), 0).otherwise(F.col("in_run"))).withColumn("speech_run", F.when(F.col("speech"), F.col("in_run")).otherwise(0))
    enough, quiet = F.col("speech_frames") * FRAME >= policy.speech_ms, F.col("quiet_run") * FRAME
    hard = enough & (quiet >= policy.hard_ms) & (F.col("_nth") >= 5) & ((F.col("energy") < 0.2 * F.col("_loud")) | (F.col("silent8") >= 6))
    t = t.withColumn("_hard", hard).withColumn("_before", F.max(F.when(F.col("_hard"), F.col("t_us"))).over(own.rowsBetween(W.unboundedPreceding, -1)))
    apart = F.col("_before").isNull() | (F.col("t_us") - F.col("_before") >= 1000 * unit_us)
    natural = (F.col("n10") >= 10) & F.col("var10").between(policy.least_variance, policy.most_variance)
    soft = enough & (quiet >= policy.soft_ms) & apart & natural
    ended = enough & (F.col("_nth") >= 10) & (F.col("_rises") >= 7)
    kind = F.when(F.col("_hard"), "hard").when(soft, "soft").when(ended, "sentence_end").otherwise("none")
    return t.withColumn("kind", kind).drop("_nth", "_loud", "_rise", "_rises", "_hard", "_before")


def keep_buffering(held_ms: Column, policy: Policy) -> Column:
    """Whether to wait for more, given ``classify``'s columns: below the least length, within speech, or up to ``rest_ms`` without a clear end."""
    inside = (F.col("speech_run") > 0) & (F.col("quiet_run") < 3)
    return (held_ms < policy.speech_ms) | inside | ((held_ms < policy.rest_ms) & F.col("kind").isin("none", "soft"))


def best_point(frames: DataFrame, policy: Policy, key: str = "stream") -> Column:
    """Time of the latest silent frame of the history that is ``hard_ms`` or more ago; null without one."""
    back = -(-policy.hard_ms // FRAME)
    past = W.partitionBy(key).orderBy(*ORDER).rowsBetween(1 - HISTORY, -back)
    return F.max(F.when(F.col("energy") <= policy.silence, F.col("t_us"))).over(past)


@dataclass
class Assembler:
    """One stream's utterances, frame by frame; ``add`` gives those that end (start, end, frames, reason)."""

    policy: Policy
    unit_us: int = 1000
    energies: deque = field(default_factory=lambda: deque(maxlen=HISTORY))
    pattern: deque = field(default_factory=lambda: deque(maxlen=PATTERN))
    quiet: int = 0
    speech: int = 0
    hard_at: int | None = None
    start: int | None = None
    last: int = 0
    frames: int = 0

    def kind(self, t: int) -> str:
        p, own = self.policy, list(self.energies)
        if sum(e > p.silence for e in own) * FRAME < p.speech_ms:
            return "none"
        quiet = self.quiet * FRAME
        if quiet >= p.hard_ms and len(self.pattern) >= 5 and (own[-1] < 0.2 * sum(self.pattern) / len(self.pattern) or sum(e <= p.silence for e in own[-8:]) >= 6):
            self.hard_at = t
            return "hard"
        ten = own[-10:]
        mean = sum(ten) / len(ten)
        if quiet >= p.soft_ms and (self.hard_at is None or t - self.hard_at >= 1000 * self.unit_us) and len(ten) == 10 and p.least_variance <= sum((e - mean) ** 2 for e in ten) / 10 <= p.most_variance:
            return "soft"
        tail = list(self.pattern)[-10:]
        return "sentence_end" if len(tail) == 10 and sum(b > a for a, b in zip(tail, tail[1:], strict=False)) >= 7 else "none"

    def add(self, t: int, energy: float) -> Iterator[tuple[int, int, int, str]]:
        p = self.policy
        loud = energy > p.silence
        self.energies.append(energy)
        self.quiet, self.speech = (0, self.speech + 1) if loud else (self.quiet + 1, 0)
        if loud:
            self.pattern.append(energy)
        found = self.kind(t)
        if self.start is not None and t - self.last > 2 * p.shortest_ms * self.unit_us:
            yield self.close("stale")
        if not (loud or self.start is not None):
            return
        self.start, self.last, self.frames = t if self.start is None else self.start, t, self.frames + 1
        held = (t - self.start) // self.unit_us
        waits = held < p.speech_ms or self.speech > 0 and self.quiet < 3 or held < p.rest_ms and found in ("none", "soft")
        if found in ("hard", "sentence_end") and held >= p.shortest_ms or found == "soft" and held >= p.shortest_ms + 2000:
            yield self.close(found)
        elif held >= p.longest_ms:
            yield self.close("longest")
        elif not waits:
            yield self.close("rest")

    def close(self, reason: str) -> tuple[int, int, int, str]:
        out = self.start, self.last, self.frames, reason
        self.start, self.frames = None, 0
        return out

    def pack(self) -> tuple:
        """The state as plain values, for a state store."""
        none = lambda x: -1 if x is None else int(x)
        return list(map(float, self.energies)), list(map(float, self.pattern)), int(self.quiet), int(self.speech), none(self.hard_at), none(self.start), int(self.last), int(self.frames)

    @classmethod
    def unpack(cls, policy: Policy, unit_us: int, state: tuple) -> Assembler:
        none = lambda x: None if x < 0 else x
        e, p, quiet, speech, hard, start, last, frames = state
        return cls(policy, unit_us, deque(e, HISTORY), deque(p, PATTERN), quiet, speech, none(hard), none(start), last, frames)


STATE = "energies array<double>, pattern array<double>, quiet long, speech long, hard_at long, start long, last long, frames long"
