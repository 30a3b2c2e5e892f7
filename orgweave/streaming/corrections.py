"""The correction merge as a stream: state with each key's newest correction and tombstone, folded in any order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.corrections import MISSING, TOMBSTONE_DAYS
from .shards import SHARDS, STATE, by_shard, load, save

OUTPUT = "company_key string, company_name string, domain string, updated_at timestamp, state string"
_NEVER = np.iinfo(np.int64).min


def _newest(rows: pd.DataFrame) -> pd.DataFrame:
    """Of each key the newest correction and the newest deletion; of equal times and numbers what came last."""
    return rows.sort_values(["at", "seq"], kind="stable").drop_duplicates(["company_key", "gone"], keep="last", ignore_index=True)


def _fold(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now, rows, came = state.getCurrentWatermarkMs(), load(state), set()
    for batch in [] if state.hasTimedOut else batches:
        at = batch["updated_at"].fillna(pd.Timestamp(MISSING)).to_numpy().astype("datetime64[us]").astype("int64")
        gone = batch["deleted"].fillna(False).to_numpy(dtype=bool)
        part = pd.DataFrame({"company_key": batch["company_key"], "company_name": batch["company_name"], "domain": batch["domain"], "at": at, "seq": batch["seq"].fillna(-1).astype("int64"), "gone": gone,
                             "until": np.where(gone, np.maximum(at // 1000 + TOMBSTONE_DAYS * 86_400_000, now + 1), np.iinfo(np.int64).max)})
        came.update(part["company_key"].unique())
        rows = [_newest(pd.concat([*rows, part], ignore_index=True))]
    (all_rows,) = rows
    codes, found = pd.factorize(all_rows["company_key"], use_na_sentinel=False)
    keys = np.empty(len(found), dtype=object)
    keys[codes] = all_rows["company_key"]  # a null key as it came
    at, gone, until = (all_rows[c].to_numpy() for c in ("at", "gone", "until"))
    written, deleted, row = np.full(len(keys), _NEVER), np.full(len(keys), _NEVER), np.zeros(len(keys), dtype=np.int64)
    written[codes[~gone]], deleted[codes[gone]], row[codes[~gone]] = at[~gone], at[gone], np.flatnonzero(~gone)
    kept, touched = written > deleted, pd.Series(keys, dtype=object).isin(came).to_numpy()
    # a tombstone is a year old: only a correction that is newer stays
    over = np.zeros(len(keys), dtype=bool)
    over[codes[gone]] = until[gone] < now
    over &= ~touched
    # what comes in with a later batch wins over equal times, whatever its number
    left = all_rows[~over[codes] | (~gone & kept[codes])].assign(seq=_NEVER)
    timers = left["until"][left["gone"]]
    save(state, left, int(timers.min()) if len(timers) else None)
    if touched.any():
        kept, text = kept[touched], all_rows.iloc[row[touched]]
        one = lambda c: np.where(kept, text[c].to_numpy(dtype=object), None)
        yield pd.DataFrame({"company_key": keys[touched], "company_name": one("company_name"), "domain": one("domain"), "updated_at": pd.to_datetime(np.maximum(written, deleted)[touched], unit="us"),
                            "state": np.where(kept, "kept", "deleted").astype(object)})


def stream_corrections(log: DataFrame, lateness: str = "30 days", shards: int = SHARDS) -> DataFrame:
    """An update stream of (company_key, company_name, domain, updated_at, state) for a streaming log (company_key, company_name, domain, updated_at, deleted, seq).

    Every row is compared by its own time, so late rows within ``lateness`` change nothing they shouldn't. A tombstone's timer forgets it after a year.
    The number of ``shards`` of a checkpoint can't be changed.
    """
    return by_shard(log.withWatermark("updated_at", lateness), "company_key", shards).applyInPandasWithState(_fold, OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
