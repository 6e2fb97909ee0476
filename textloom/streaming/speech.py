"""Stateful operators of a live speech stream: voice segments, incremental commit, rate windows, adaptive limits.

The state machines are plain classes; `stateful()` runs one per key in Structured Streaming, and the batch forms run the
same classes over a stored stream, which is what tests compare.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.tokens import units
from textloom.operators.segments import Machine, fold

# Fixed values, milliseconds.
FRAME, ONSET, PREROLL, HANG, LONGEST, SHORTEST = 16, 90, 500, 900, 30_000, 280


@dataclass
class VoiceSegments:
    """Frames (ms, voiced) to segments (start, end): voice for ONSET ms opens one, and the PREROLL ms up to then belong to
    it; a silence closes it, shorter the longer the segment is, and belongs to it too; LONGEST cuts it, SHORTEST is the
    least that counts."""

    began: int | None = None  #: of the stream
    voice: int = 0
    silence: int = 0
    start: int | None = None
    end: int = 0

    def hang(self, age: int) -> float:
        return HANG if age < 4000 else HANG * 0.7 if age < 8000 else max(500, HANG * 0.55)

    def add(self, ms: int, voiced: bool) -> list[tuple[int, int]]:
        self.began = ms if self.began is None else self.began
        self.end = ms + FRAME
        if self.start is None:
            self.voice = self.voice + FRAME if voiced else 0
            if self.voice >= ONSET:
                self.start, self.silence = max(self.began, self.end - PREROLL), 0
            return []
        self.silence = 0 if voiced else self.silence + FRAME
        age = self.end - self.start
        return self.close() if self.silence >= self.hang(age) or age >= LONGEST else []

    def close(self) -> list[tuple[int, int]]:
        done = [(self.start, self.end)] if self.start is not None and self.end - self.start >= SHORTEST else []
        self.start, self.voice = None, 0
        return done


def common_prefix(a: str, b: str) -> str:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return a[:n]


SEAM = "。！？!?.，、,；; "  # Fixed value: marks that a new hypothesis may put anywhere between old and new text
PROBE = 10


@dataclass
class Agreement:
    """Hypotheses (text, final) to committed units of text: of what two hypotheses in a row agree on, the units that have
    an end; a final one commits the rest. What has been committed is never given again, also where a hypothesis changes
    the words before."""

    committed: str = ""
    last: str = ""

    def tail(self, text: str) -> str:
        """What of a hypothesis is behind the committed text: by its beginning, else by where the last committed letters
        stand, else by length."""
        if text.startswith(self.committed):
            return text[len(self.committed) :]
        probe = self.committed[-PROBE:].rstrip(SEAM)
        before, found, behind = text.partition(probe) if probe else ("", "", "")
        return (behind if found else text[len(self.committed) :]).lstrip(SEAM)

    def add(self, text: str, final: bool) -> list[str]:
        tail = self.tail(text or "")
        if final:
            self.committed = self.last = ""
            return units(tail, True)[0]
        agreed = common_prefix(tail, self.tail(self.last)) if self.last else ""
        self.last = text or ""
        ready, used = units(agreed, False)
        self.committed += agreed[:used]
        return ready


@dataclass
class Limit:
    """Outcomes to a limit on calls in flight: halved by an overload, one more after twelve successes, 2 to 16."""

    limit: int = 8
    run: int = 0

    def add(self, ok: bool) -> int:
        if not ok:
            self.limit, self.run = max(2, self.limit // 2), 0
        else:
            self.run += 1
            if self.run >= 12:
                self.limit, self.run = min(16, self.limit + 1), 0
        return self.limit


@dataclass
class NoiseFloor:
    """Energies to voiced or not: a slow mean of quiet frames is the floor, three times it turns voice on, twice off."""

    floor: float = 0.01
    on: bool = False

    def add(self, energy: float) -> bool:
        self.on = energy > self.floor * (2.0 if self.on else 3.0)
        if not self.on:
            self.floor = 0.99 * self.floor + 0.01 * energy
        return self.on


@dataclass
class Cooldown:
    """Quarantine of service keys: a key is out until its time, the next usable one by turns serves."""

    until: dict[str, float] = field(default_factory=dict)
    turn: int = 0

    def add(self, key: str, now: float, ttl: float = 600.0) -> None:
        self.until[key] = max(self.until.get(key, 0.0), now + ttl)

    def pick(self, keys: list[str], now: float) -> str | None:
        usable = [k for k in keys if self.until.get(k, 0.0) <= now]
        self.turn += 1
        return usable[(self.turn - 1) % len(usable)] if usable else None


def stateful(stream: DataFrame, key: str, order: str, make: Callable[[], object], step: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str, timeout_ms: int | None = None) -> DataFrame:
    """One state per key over a stream: step(state, rows in order) gives rows to append. State lives in Spark's state
    store, so a restart from the checkpoint goes on where it stood; a key idle for `timeout_ms` is dropped
    (which keeps a query running for ever, so not with trigger(availableNow=True))."""

    def run(_key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = pickle.loads(state.get[0]) if state.exists else make()
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        out = step(now, rows)
        state.update((pickle.dumps(now),))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield out

    return stream.groupBy(key).applyInPandasWithState(run, schema, "state binary", "append", "ProcessingTimeTimeout" if timeout_ms else "NoTimeout")


def voice_step(state: VoiceSegments, rows: pd.DataFrame) -> pd.DataFrame:
    found = [(k, s, e) for k, ms, v in zip(rows["key"], rows["ms"], rows["voiced"], strict=True) for s, e in state.add(int(ms), bool(v))]
    return pd.DataFrame(found, columns=["key", "start", "end"])


def commit_step(state: Agreement, rows: pd.DataFrame) -> pd.DataFrame:
    found = [(k, int(n), unit) for k, n, t, f in zip(rows["key"], rows["n"], rows["text"], rows["final"], strict=True) for unit in state.add(t, bool(f))]
    return pd.DataFrame(found, columns=["key", "n", "text"])


VOICE, COMMIT = "key long, start long, end long", "key long, n long, text string"


class Stored(Machine):
    """A state machine of this module over a stored stream: rows (key, place, *values) to (key, *what is ready)."""

    def __init__(self, state, placed: bool):
        self.state, self.placed, self.key = state, placed, None

    def add(self, key, at, *values) -> list[tuple]:
        self.key = key
        ready = self.state.add(*values) if self.placed else self.state.add(at, *values)
        return [(key, at, x) if self.placed else (key, *x) for x in ready]

    def close(self) -> list[tuple]:
        return [] if self.placed else [(self.key, *x) for x in self.state.close()]


class Told(Machine):
    """A state of this module over stored rows (key, n, value): (key, n, what it says)."""

    def __init__(self, state):
        self.state = state

    def add(self, key, n, value) -> list[tuple]:
        return [(key, n, self.state.add(value))]


def voice_segments(frames: DataFrame) -> DataFrame:
    """(key, start, end) of stored frames (key, ms, voiced); a stream takes stateful(..., VoiceSegments, voice_step)."""
    return fold(frames.select("key", "ms", "voiced"), "key", ["ms"], lambda: Stored(VoiceSegments(), False), VOICE)


def commits(hypotheses: DataFrame) -> DataFrame:
    """(key, n, text) of the units committed of stored hypotheses (key, n, text, final)."""
    return fold(hypotheses.select("key", "n", "text", "final"), "key", ["n"], lambda: Stored(Agreement(), True), COMMIT)


def request_counts(events: DataFrame, key: str, ts: str, length: str = "60 seconds", slide: str = "10 seconds", late: str = "30 seconds") -> DataFrame:
    """(window, key, n): requests of a key in sliding windows, late ones within the watermark counted; works on streams
    and on tables."""
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    stamped = stamped.withWatermark("_ts", late) if events.isStreaming else stamped
    return stamped.groupBy(F.window("_ts", length, slide), F.col(key)).agg(F.count("*").alias("n"))


def stream_sessions(events: DataFrame, key: str, ts: str, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of sessions with a fixed gap, on streams and tables."""
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    stamped = stamped.withWatermark("_ts", late) if events.isStreaming else stamped
    s = stamped.groupBy(F.session_window("_ts", gap).alias("s"), F.col(key)).agg(F.count("*").alias("n"), F.max("_ts").alias("end"))
    return s.select(key, F.col("s.start").alias("start"), "end", "n")


def changes(progress: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows of a progress log whose value differs from the one before."""
    from pyspark.sql import Window

    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return progress.withColumn("_before", before).where(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")


# Fixed values, milliseconds: a silence that ends a region, the least and the longest region, what is added at both ends.
REGION_HANG, REGION_LEAST, REGION_MOST, REGION_PAD = 300, 160, 30_000, 100
REGIONS = "key long, start double, end double"


class Regions(Machine):
    """Frames (key, ms, voiced) of a recording to its regions of speech: a silence ends one, and so does its length; those
    that are long enough are widened at both ends, as far as the recording goes."""

    def __init__(self):
        self.start, self.silent, self.until, self.ready, self.key = None, 0, 0, [], None

    def add(self, key, ms, voiced) -> list[tuple]:
        self.key, self.until = key, ms + FRAME
        if self.start is None:
            self.start, self.silent = (ms, 0) if voiced else (None, 0)
            return []
        self.silent = 0 if voiced else self.silent + FRAME
        if self.silent >= REGION_HANG or self.until - self.start >= REGION_MOST:
            self.flush(self.until - self.silent)
        return []

    def flush(self, end: int) -> None:
        if end - self.start >= REGION_LEAST:
            self.ready.append((self.start, end))
        self.start, self.silent = None, 0

    def close(self) -> list[tuple]:
        if self.start is not None:
            self.flush(self.until)
        return [(self.key, max(0.0, float(a - REGION_PAD)), min(float(self.until), float(b + REGION_PAD))) for a, b in self.ready]


def speech_regions(frames: DataFrame) -> DataFrame:
    """(key, start, end) of the regions of frames (key, ms, voiced): see Regions."""
    return fold(frames.select("key", "ms", "voiced"), "key", ["ms"], Regions, REGIONS)


class Blocks(Machine):
    """Packets (key, n, pcm) of 16-bit samples to frames of `samples`; what is no whole frame waits for the next packet."""

    def __init__(self, samples: int = 256):
        self.size, self.rest, self.frame = 2 * samples, b"", 0

    def add(self, key, n, pcm) -> list[tuple]:
        self.rest += pcm or b""
        whole = len(self.rest) // self.size
        out = [(key, self.frame + i, self.rest[i * self.size : (i + 1) * self.size]) for i in range(whole)]
        self.rest, self.frame = self.rest[whole * self.size :], self.frame + whole
        return out


def reblocked(packets: DataFrame, samples: int = 256) -> DataFrame:
    """(key, frame, pcm) of packets (key, n, pcm): see Blocks."""
    return fold(packets.select("key", "n", "pcm"), "key", ["n"], lambda: Blocks(samples), "key long, frame long, pcm binary")


class Requests(Machine):
    """Times (key, ms, age, final) of an utterance to requests (key, ms, kind): a partial one every `every` ms once there
    is enough speech, and the final one."""

    def __init__(self, every: int = 360):
        self.every, self.since = every, 0

    def add(self, key, ms, age, final) -> list[tuple]:
        self.since += FRAME
        if final:
            self.since = 0
            return [(key, ms, "final")] if age >= SHORTEST else []
        if self.since >= self.every and age >= SHORTEST:
            self.since = 0
            return [(key, ms, "partial")]
        return []


def live_context(lines: DataFrame, last: int = 3, size: int = 200) -> DataFrame:
    """Adds context to lines (key, n, text): the last lines before that have words, the end of them."""
    from pyspark.sql import Window

    from textloom.functions import captions

    told = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    spoken = F.when(captions.worth_showing(F.col("text")), F.struct("n", "text"))
    # lines before are numbered, so that only the last few are held
    numbered = lines.withColumn("_no", F.coalesce(F.count(spoken).over(told), F.lit(0)))
    real = numbered.where(captions.worth_showing(F.col("text"))).select("key", F.col("_no").alias("_i"), F.col("text").alias("_t"))
    wanted = numbered.withColumn("_i", F.explode_outer(F.when(F.col("_no") > 0, F.sequence(F.greatest(F.col("_no") - last, F.lit(0)), F.col("_no") - 1))))
    got = wanted.join(real, ["key", "_i"], "left").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("_i", "_t")))).alias("_l"))
    return got.select("key", "n", F.right(F.array_join(F.transform("_l", lambda x: x["_t"]), " "), F.lit(size)).alias("context"))


def served(requests: DataFrame) -> DataFrame:
    """Adds served to requests (kind, busy): a busy recogniser drops partial ones, the next brings their sound again; final
    ones wait."""
    return requests.withColumn("served", ~F.col("busy") | (F.col("kind") == "final"))


def cumulative(deltas: DataFrame, key: list[str], order: str) -> DataFrame:
    """Adds text to deltas (.., delta): all that a reply has said so far. A reply is bounded by its model's cap."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumn("text", F.array_join(F.collect_list("delta").over(w), ""))


def resting(failures: DataFrame) -> DataFrame:
    """(model, until) of failures (model, now, seconds): the latest time that any of them has named, a second at least."""
    return failures.groupBy("model").agg(F.max(F.col("now") + F.greatest(F.lit(1.0), F.col("seconds").cast("double"))).alias("until"))


def on_time(results: DataFrame, sessions: DataFrame) -> DataFrame:
    """Results (session, at, ..) that came before their session was stopped (session, stopped); one that goes on takes all."""
    return results.join(sessions, "session", "left").where(F.col("stopped").isNull() | (F.col("at") < F.col("stopped"))).drop("stopped")
