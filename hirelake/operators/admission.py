"""Admission of events by rate and by cooldown.

Both rules look back at admitted events only, so they are a scan per key.  The scan is streamed:
rows arrive sorted, the state is the last few admitted times, and a key is first cut wherever it
was quiet for so long that nothing before can matter; the pieces are scanned in parallel.
"""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab
from .running import BUCKET_BITS, running_before

_c = F.col


def quiet_pieces(events, key, ts, order, quiet_us, bucket_bits=BUCKET_BITS):
    """Number the pieces of a key between pauses longer than ``quiet_us`` microseconds.

    ``order`` is a LONG that follows time.  Both steps are running aggregates over ranges, so a
    busy key is not sorted in one task.
    """
    timed = events.withColumn("_us", F.unix_micros(ts))
    last = running_before(timed, key, order, {"_prev": ("last", _c("_us"))}, bucket_bits)
    starts = last.withColumn("_start", F.when(
        _c("_prev").isNull() | (_c("_us") - _c("_prev") > quiet_us), _c(order)))
    pieces = running_before(starts, key, order, {"_piece": ("last", _c("_start"))}, bucket_bits)
    return pieces.withColumn("_piece", F.coalesce("_start", "_piece")).drop("_prev", "_start")


class RateState:
    """Sliding window over admitted times of one key, then a cooldown after the last run."""

    def __init__(self, limit, window_us, cooldown_us):
        self.limit, self.window_us, self.cooldown_us = limit, window_us, cooldown_us
        self.log, self.finished = [], None

    def step(self, now, took=0):
        if self.limit is not None:
            self.log = [t for t in self.log if now - t <= self.window_us]
            if len(self.log) >= self.limit:
                return "rate"
            self.log.append(now)
        if self.cooldown_us is not None:
            if self.finished is not None and self.cooldown_us - (now - self.finished) > 0:
                return "cooldown"
            self.finished = now + took
        return "admitted"


def _scan(events, key, ts, order, limit, window_s, cooldown_s, duration):
    us = lambda s: None if s is None else int(s * 1_000_000)
    window_us, cooldown_us = us(window_s), us(cooldown_s)
    took = F.lit(0).cast("bigint") if duration is None else (_c(duration) * 1_000_000).cast("bigint")
    longest = F.lit(0) if duration is None else took
    quiet = max(window_us or 0, cooldown_us or 0)
    timed = events.withColumn("_took", took)
    pieces = quiet_pieces(timed, key, ts, order, quiet) if duration is None else \
        _pieces_with_duration(timed, key, ts, order, quiet, longest)
    parts = pieces.repartition(key, "_piece").sortWithinPartitions(key, "_piece", order)
    schema = T.StructType([*events.schema.fields, T.StructField("decision", T.StringType())])
    names = events.columns

    def run(batches):
        at, state = None, None
        for pdf in batches:
            out = []
            for k, piece, now, dur in zip(pdf[key], pdf["_piece"], pdf["_us"], pdf["_took"]):
                if (k, piece) != at:
                    at, state = (k, piece), RateState(limit, window_us, cooldown_us)
                out.append(state.step(int(now), int(dur)))
            yield pdf[names].assign(decision=pd.Series(out, index=pdf.index, dtype="object"))

    return parts.mapInPandas(run, schema)


def _pieces_with_duration(timed, key, ts, order, quiet, took):
    """As ``quiet_pieces``; a pause counts from the latest possible end of a run."""
    ends = timed.withColumns({"_us": F.unix_micros(ts), "_end": F.unix_micros(ts) + took})
    last = running_before(ends, key, order, {"_prev": ("max", _c("_end"))})
    starts = last.withColumn("_start", F.when(
        _c("_prev").isNull() | (_c("_us") - _c("_prev") > quiet), _c(order)))
    pieces = running_before(starts, key, order, {"_piece": ("last", _c("_start"))})
    return pieces.withColumn("_piece", F.coalesce("_start", "_piece")).drop("_prev", "_start", "_end")


def admit_by_rate(events, key, ts, order, limit=vocab.RATE_LIMIT, window_s=vocab.RATE_WINDOW_SECONDS):
    """Admit an event only if fewer than ``limit`` admitted ones lie within the last ``window_s``.

    An admitted event stops counting once it is strictly older than the window; rejected events
    never count.  Adds ``decision``: admitted or rate.
    """
    return _scan(events, key, ts, order, limit, window_s, None, None)


def admit_by_cooldown(events, key, ts, order, cooldown_s=vocab.COOLDOWN_SECONDS, limit=None,
                      window_s=vocab.RATE_WINDOW_SECONDS, duration=None):
    """Reject an event that starts within ``cooldown_s`` of the end of the last admitted one.

    With ``limit`` the rate rule is checked first, and an event the cooldown rejects has already
    used up quota.  ``duration`` names a column with the seconds a run takes.  Adds ``decision``:
    admitted, rate or cooldown.
    """
    return _scan(events, key, ts, order, limit, window_s, cooldown_s, duration)
