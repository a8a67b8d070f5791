"""Admission rules on a stream of events, with the state kept per key."""

from pyspark.sql import types as T

from .. import vocab
from ..operators.admission import RateState

_STATE = T.StructType([T.StructField("log", T.ArrayType(T.LongType())), T.StructField("finished", T.LongType())])


def admit_stream(events, key, ts, limit=vocab.RATE_LIMIT, window_s=vocab.RATE_WINDOW_SECONDS, cooldown_s=None):
    """Decide each event as it arrives; the state of a key is its last admitted times.

    Within a micro-batch the events of a key are taken in time order; what a key can hold there is
    bounded by the rate options of the source (files, bytes or offsets per trigger).
    """
    schema = T.StructType([events.schema[key], events.schema[ts], T.StructField("decision", T.StringType())])
    window_us = int(window_s * 1_000_000)
    cooldown_us = None if cooldown_s is None else int(cooldown_s * 1_000_000)

    def decide(_, batches, state):
        rule = RateState(limit, window_us, cooldown_us)
        if state.exists:
            log, rule.finished = state.get
            rule.log = list(log)
        import pandas as pd

        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        moments = rows[ts].astype("datetime64[us]").astype("int64")
        decisions = [rule.step(int(t)) for t in moments]
        state.update((rule.log, rule.finished))
        yield rows[[key, ts]].assign(decision=decisions)

    return events.select(key, ts).groupBy(key).applyInPandasWithState(
        decide, schema, _STATE, "append", "NoTimeout")
