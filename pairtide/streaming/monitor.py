"""The rolling monitor as a stream: count-based windows and persistent alerts per (domain, mode).

Spark's time windows don't count rows, so each key keeps the rows of its open window and its last alert flags in
state, behind a buffer that event-time timers empty in order.  Replaying a finished log in any order gives the same windows and flags as the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.metrics import EDGES

OUTPUT = "domain string, mode string, window_id int, n int, window_auc double, window_ece double, window_coverage double, any_alert boolean, hard_alert boolean, soft_alert boolean"


def auroc_of(y: np.ndarray, p: np.ndarray) -> float | None:
    pos = y.sum()
    if pos in (0, len(y)):
        return None
    order, counts = np.unique(p, return_inverse=True, return_counts=True)[1:]
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[order]
    return float((ranks[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos)))


def ece_of(y: np.ndarray, p: np.ndarray) -> float:
    bins = np.searchsorted(EDGES[1:-1], p, side="right")
    return float(sum(abs(y[bins == b].sum() - p[bins == b].sum()) for b in np.unique(bins)) / len(y))


def alert_of(key: tuple[str, str], auc: float | None, ece: float, coverage: float, baselines: dict, caps: tuple[float, float, float]) -> bool:
    """The batch operators' alert: rounded values strictly above the caps, an unknown mode by either metric; a key without a baseline is an error."""
    if key not in baselines:
        raise ValueError(f"no baseline for {' '.join(key)}")
    base_auc, base_ece, base_coverage = baselines[key]
    drift = base_coverage is not None and base_coverage > 0 and abs(round((coverage - base_coverage) / max(base_coverage, 1e-8), 6)) > caps[2]
    ranking = auc is not None and base_auc is not None and round(base_auc - auc, 6) > caps[0]
    reliability = base_ece is not None and round(ece - base_ece, 6) > caps[1]
    return bool(drift or {"ranking_first": ranking, "reliability_first": reliability}.get(key[1], ranking or reliability))


#: Microseconds of event time, and what a window needs of a row.
_ROW = "at long, event_id long, label int, policy_prob double, referral_flag int"


class WindowMonitor(StatefulProcessor):
    """Puts a key's rows in order of event time, emits a row per full window, and remembers the last flags.

    Rows wait until the watermark has passed them; a timer at the earliest waiting row releases all that are due, in order.  Baselines are the key's initial state."""

    def __init__(self, size: int, caps: tuple[float, float, float], soft: tuple[int, int] = (3, 5)):
        self.size, self.caps, self.soft = size, caps, soft

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.baseline = handle.getValueState("baseline", "auc double, ece double, coverage double")
        self.waiting = handle.getListState("waiting", _ROW)
        self.rows = handle.getListState("rows", _ROW)
        self.past = handle.getValueState("past", "n_windows int, flags string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        known = initialState[["baseline_auc", "baseline_ece", "baseline_coverage"]].iloc[0]
        self.baseline.update(tuple(None if pd.isna(v) else float(v) for v in known))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [_plain(r) for part in rows for r in part[_ROW_NAMES].itertuples(index=False, name=None)]
        self.waiting.appendList(new)
        self._wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        due = [r for r in waiting if r[0] <= passed]
        if rest := waiting[len(due) :]:
            self.waiting.put(rest)
            self._wake(rest[0][0])
        else:
            self.waiting.clear()
        held = [tuple(r) for r in self.rows.get()] + due
        n_windows, flags = self.past.get() if self.past.exists() else (0, "")
        out = []
        while len(held) >= self.size:
            window, held = held[: self.size], held[self.size :]
            n_windows += 1
            if seen := self._seen(key, window):
                flags = (flags + "01"[seen[-1]])[-self.soft[1] :]
                out.append((*key, n_windows - 1, self.size, *seen, flags.endswith("11"), flags.count("1") >= self.soft[0]))
        self.past.update((n_windows, flags))
        if held:
            self.rows.put(held)
        else:
            self.rows.clear()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def _seen(self, key, window):
        """The window's metrics and alert; None if no row has a label and a score."""
        counted = [(w[2], w[3]) for w in window if w[2] is not None and w[3] is not None and np.isfinite(w[3])]
        if not counted:
            return None
        y, p = np.array(counted, float).T
        auc, ece, coverage = auroc_of(y, p), ece_of(y, p), float(np.mean([w[4] for w in window]))
        known = {key: self.baseline.get()} if self.baseline.exists() else {}
        return auc, ece, coverage, alert_of(key, auc, ece, coverage, known, self.caps)

    def close(self) -> None:
        pass


_ROW_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _plain(row) -> tuple:
    """State values are plain numbers; missing ones are None."""
    at, event, label, p, flag = row
    return int(at), int(event), None if pd.isna(label) else int(label), None if pd.isna(p) else float(p), int(flag)


def monitored(log: DataFrame, baselines: DataFrame, *, size: int = 250, time: str = "ts", delay: str = "1 hour", auc_cap: float = 0.05, ece_cap: float = 0.05, coverage_cap: float = 0.2) -> DataFrame:
    """Windows and alerts of a stream of replayed rows, in order of ``time`` and event_id whatever the order of arrival.

    Rows may come up to ``delay`` late and out of order; a row that is later still is dropped by the watermark.  Windows appear once the watermark has passed their last row, and a restart from
    the checkpoint goes on in the open window.  ``baselines`` has one row per (domain, mode), which becomes that key's state."""
    rows = log.withWatermark(time, delay).select("domain", "mode", time, F.unix_micros(F.col(time)).alias("at"), "event_id", "label", "policy_prob", "referral_flag")
    known = baselines.select("domain", "mode", "baseline_auc", "baseline_ece", "baseline_coverage").groupBy("domain", "mode")
    return rows.groupBy("domain", "mode").transformWithStateInPandas(WindowMonitor(size, (auc_cap, ece_cap, coverage_cap)), OUTPUT, "Append", "EventTime", initialState=known)
