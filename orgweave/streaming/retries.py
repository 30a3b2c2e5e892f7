"""The retry queue as a stream: state with each lookup's earliest attempts, in any order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.retries import ATTEMPTS
from .shards import SHARDS, STATE, by_shard, load, save

OUTPUT = "key string, state string, reason string, attempts int, at timestamp, updated_at timestamp"


def _earliest(rows: pd.DataFrame, attempts: int) -> pd.DataFrame:
    """Each key's earliest distinct attempts in their order, an attempt that came twice with its largest status; ``newest`` and ``until`` at each key's highest."""
    codes, keys = pd.factorize(rows["key"], use_na_sentinel=False)
    high = {name: np.full(len(keys), np.iinfo(np.int64).min) for name in ("newest", "until")}
    for name, most in high.items():
        np.maximum.at(most, codes, rows[name].to_numpy())
    at, seq, status = (rows[c].to_numpy() for c in ("at", "seq", "status"))
    order = np.lexsort((-status, seq, at, codes))
    c, a, s = codes[order], at[order], seq[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (c[1:] != c[:-1]) | (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    order, c = order[new], c[new]
    early = np.arange(len(c)) - np.searchsorted(c, c) < attempts
    return rows.iloc[order[early]].assign(**{name: most[c[early]] for name, most in high.items()})


def _told(rows: pd.DataFrame, attempts: int) -> pd.DataFrame:
    """What ``operators.retries.lookups`` tells of the rows of ``_earliest``."""
    codes = pd.factorize(rows["key"], use_na_sentinel=False)[0]
    status = rows["status"].to_numpy()
    reason = np.select([(status >= 200) & (status <= 299), status == 429, (status <= 0) | (status >= 500)], ["done", "rate_limited", "transient"], "http").astype(object)
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    nth = np.arange(len(codes)) - starts[codes]
    last = np.diff(np.append(starts, len(codes))) - 1
    settled = np.where((reason == "done") | (reason == "http"), nth, len(codes))
    n = np.minimum(np.minimum.reduceat(settled, starts), last) if len(codes) else last
    row = rows.iloc[starts + n]
    reason = reason[starts + n]
    final = np.select([reason == "done", reason == "http", n + 1 >= attempts], ["done", "refused", "given_up"], "waiting").astype(object)
    return pd.DataFrame({"key": row["key"].to_numpy(), "state": final, "reason": reason, "attempts": (n + 1).astype(np.int32), "at": pd.to_datetime(row["at"].to_numpy(), unit="us"),
                         "updated_at": pd.to_datetime(row["newest"].to_numpy(), unit="us")})


def stream_lookups(log: DataFrame, lateness: str = "30 days", keep_days: int = 7, attempts: int = ATTEMPTS, shards: int = SHARDS) -> DataFrame:
    """An update stream of what ``operators.retries.lookups`` tells of a streaming log (key, seq, at, http_status), with ``updated_at``, the newest time seen of the key.

    Only the earliest distinct attempts of a key are kept, so its state is bounded, and attempts that come late or twice change nothing they shouldn't. Rows without a time or beyond
    ``lateness`` are left out. A lookup is forgotten ``keep_days`` after its newest attempt, in the log's time; what comes for its key then begins anew.
    The number of ``shards`` of a checkpoint can't be changed.
    """

    def fold(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, rows, came = state.getCurrentWatermarkMs(), load(state), set()
        for batch in [] if state.hasTimedOut else batches:
            at = batch["at"].to_numpy().astype("datetime64[us]").astype("int64")
            part = pd.DataFrame({"key": batch["key"], "at": at, "seq": batch["seq"].fillna(-1).astype("int64"), "status": batch["http_status"].fillna(0).astype("int64"), "newest": at,
                                 "until": np.maximum(at // 1000 + keep_days * 86_400_000, now + 1)})
            came.update(part["key"].unique())
            rows = [_earliest(pd.concat([*rows, part], ignore_index=True), attempts)]
        (kept,) = rows
        touched = kept["key"].isin(came).to_numpy()
        kept, told = kept[touched | (kept["until"].to_numpy() >= now)], kept[touched]
        save(state, kept, int(kept["until"].min()) if len(kept) else None)
        if len(told):
            yield _told(told, attempts)

    return by_shard(log.where("at IS NOT NULL").withWatermark("at", lateness), "key", shards).applyInPandasWithState(fold, OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
