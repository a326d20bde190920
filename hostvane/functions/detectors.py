"""Detector settings, and the step functions shared by the batch and the streaming jobs.

A step takes a run of consecutive rows per host and the state before them, and returns results and
the state after them. Batch jobs, slices of large hosts, and streams all advance the same state.
"""

from __future__ import annotations

import json
from base64 import b64decode, b64encode
from bisect import bisect_left
from dataclasses import dataclass, field, replace

import numpy as np

from hostvane.functions.pca import DEFAULT_MODEL, PcaModel
from hostvane.schemas import FEATURES

# Names and limits of the fused verdicts.
BOTH, ONLY_MODEL, ONLY_STATS = "FUSION_A_B", "DETECTOR_B_PCA", "DETECTOR_A_STATS"
CRITICAL, HIGH, MEDIUM = "CRITICAL", "HIGH", "MEDIUM"
HIGH_SCORE = 10.0
FLAT_MAD = 1e-6
NOT_RUN = -1.0


@dataclass(frozen=True)
class WindowConfig:
    size: int = 60
    recompute_interval: int = 10
    min_history: int = 10


@dataclass(frozen=True)
class OutlierConfig:
    robust_z_threshold: float = 3.5
    mitigate_poison: bool = False
    poison_threshold: float = 7.0


@dataclass(frozen=True)
class GateConfig:
    enabled: bool = False
    period_ms: int = 60_000


@dataclass(frozen=True)
class AlertConfig:
    consecutive: int = 2
    cooldown_seconds: int = 600


@dataclass(frozen=True)
class PipelineConfig:
    window: WindowConfig = field(default_factory=WindowConfig)
    outliers: OutlierConfig = field(default_factory=OutlierConfig)
    gate: GateConfig = field(default_factory=GateConfig)
    alerts: AlertConfig = field(default_factory=AlertConfig)
    model: PcaModel = DEFAULT_MODEL
    log1p_network: bool = False


class RobustZ:
    """Rolling robust z with optional poison mitigation, for many hosts at once.

    Between two recompute rows the median and MAD are constants, so a block of
    ``recompute_interval`` rows is judged in one vector operation; the only sequential part is the
    walk from block to block, taken by all hosts of a batch together.
    """

    def __init__(self, window: WindowConfig, outliers: OutlierConfig, metrics: int = len(FEATURES)):
        self.window, self.outliers, self.metrics = window, outliers, metrics

    def initial(self):
        m = self.metrics
        # history is right-aligned: the newest accepted value is last, unused cells are NaN
        return (np.full((m, self.window.size), np.nan), np.zeros(m), np.zeros(m))

    def advance(self, values, starts, ends, positions, states):
        """``values`` (rows, metrics); host i owns rows starts[i]:ends[i], the first at ``positions[i]``.

        Returns z and skipped, each (rows, metrics), and the states after.
        """
        size, every, needed = self.window.size, self.window.recompute_interval, self.window.min_history
        n, m = values.shape
        z_all = np.zeros((n, m))
        skipped_all = np.zeros((n, m), dtype=bool)
        phase = positions % every
        blocks = -(-(phase + ends - starts) // every)
        # hosts with most blocks first, so the ones still going are always a prefix
        order = np.argsort(-blocks, kind="stable")
        first, ends, blocks = (starts - phase)[order], ends[order], blocks[order]
        starts = starts[order]
        history = np.stack([states[i][0] for i in order])
        median = np.stack([states[i][1] for i in order])
        mad = np.stack([states[i][2] for i in order])
        held = np.count_nonzero(~np.isnan(history), axis=2)
        offsets = np.arange(every)
        live_counts = np.searchsorted(-blocks, -np.arange(blocks[0]), side="left")
        whole_until = (ends - first) // every
        begins_whole = bool((first == starts).all())
        for b in range(int(blocks[0])):
            live = int(live_counts[b])
            rows = (first[:live] + b * every)[:, None] + offsets
            whole = (b > 0 or begins_whole) and b < whole_until[:live].min()
            if whole:
                present = None
            else:
                present = (rows >= starts[:live, None]) & (rows < ends[:live, None])
                rows = np.clip(rows, 0, n - 1)
            hist, count = history[:live], held[:live]
            due = count >= needed
            if present is not None:
                due = due & present[:, :1]
            self._recompute(hist, median[:live], mad[:live], count, due)
            x = values[rows]
            spread = np.where(mad[:live] > 0, mad[:live], FLAT_MAD)
            z = np.abs(x - median[:live, None, :]) / spread[:, None, :]
            if count.min() < needed:
                seen = offsets[None, :] if present is None else np.cumsum(present, axis=1) - present
                z[np.minimum(count[:, None, :] + seen[:, :, None], size) < needed] = 0.0
            if present is None:
                z_all[rows] = z
            else:
                z_all[rows[present]] = z[present]
            fresh = x.transpose(0, 2, 1)
            keep = None
            if self.outliers.mitigate_poison:
                skip = z > self.outliers.poison_threshold
                if skip.any():
                    keep = ~skip
                    if present is None:
                        skipped_all[rows] = skip
                    else:
                        skipped_all[rows[present]] = skip[present]
            if present is not None:
                keep = present[:, :, None] & (True if keep is None else keep)
            if keep is None:
                joined = np.concatenate([hist, fresh], axis=2)
                held[:live] = np.minimum(count + every, size)
            else:
                keep = np.broadcast_to(keep, x.shape)
                joined = np.concatenate([hist, np.where(keep.transpose(0, 2, 1), fresh, np.nan)], axis=2)
                by_age = np.argsort(~np.isnan(joined), axis=2, kind="stable")
                joined = joined[np.arange(live)[:, None, None], np.arange(m)[None, :, None], by_age]
                held[:live] = np.minimum(count + keep.sum(axis=1), size)
            history[:live] = joined[:, :, -size:]
        after = [None] * len(states)
        for place, host in enumerate(order):
            after[host] = (history[place].copy(), median[place].copy(), mad[place].copy())
        return z_all, skipped_all, after

    @staticmethod
    def _recompute(history, median, mad, count, due):
        """Upper median of each due history and of the distances to it."""
        if not due.any():
            return
        hosts, metrics = np.arange(count.shape[0])[:, None], np.arange(count.shape[1])
        middle = np.minimum(count // 2, history.shape[2] - 1)
        # NaN sorts last, so the first ``count`` cells are the values in order
        ordered = np.sort(history, axis=2)
        center = ordered[hosts, metrics, middle]
        distance = np.abs(ordered - center[:, :, None])
        distance.sort(axis=2)
        spread = distance[hosts, metrics, middle]
        median[due] = center[due]
        mad[due] = np.where(spread == 0.0, FLAT_MAD, spread)[due]


def z_details(z, above, skipped) -> list[str]:
    """Per row, the metrics above the threshold in feature order, with one decimal."""
    texts: list[list[str]] = [[] for _ in range(len(z))]
    for row, metric in zip(*(a.tolist() for a in np.nonzero(above))):
        mark = "(skipped)" if skipped[row, metric] else ""
        texts[row].append(f"{FEATURES[metric]}:rz={z[row, metric]:.1f}{mark} ")
    return ["".join(t) for t in texts]


def gate(times_us: list[int], flagged: np.ndarray, last_run: int | None, period_ms: int):
    """Which rows run the model: flagged ones, and the first one a full period after the last run.

    ``times_us`` and ``flagged`` are one host's rows in order; ``last_run`` is None before any run.
    Only the rows that run are visited.
    """
    n = len(times_us)
    runs = flagged.copy()
    upcoming = [*np.flatnonzero(flagged).tolist(), n]
    at = f = 0
    while True:
        due = at if last_run is None else bisect_left(times_us, last_run + period_ms * 1000, at)
        while upcoming[f] < at:
            f += 1
        chosen = min(due, upcoming[f])
        if chosen >= n:
            return runs, last_run
        runs[chosen] = True
        last_run = times_us[chosen]
        at = chosen + 1


@dataclass(frozen=True)
class AlertState:
    count: int = 0
    last_alert: int | None = None
    last_position: int = -2


def alert_rows(positions, times_us, state: AlertState, cfg: AlertConfig):
    """Indexes (into the flagged rows given) that raise an alert, and the state after.

    A gap in positions means an unflagged row came between, which restarts the count.
    """
    count, last, previous = state.count, state.last_alert, state.last_position
    cooldown = cfg.cooldown_seconds * 1_000_000
    fired = []
    for i in range(len(positions)):
        position, now = int(positions[i]), int(times_us[i])
        count = count + 1 if position == previous + 1 else 1
        previous = position
        if count >= cfg.consecutive and (last is None or now - last >= cooldown):
            fired.append(i)
            last, count = now, 0
    return fired, replace(state, count=count, last_alert=last, last_position=previous)


def last_in_chain(following: np.ndarray) -> np.ndarray:
    """Where each chain ends. ``following[i]`` is the next link after i, or len(following) for none."""
    n = len(following)
    end = np.where(following == n, np.arange(n), following)
    while True:
        further = end[end]
        if np.array_equal(further, end):
            return end
        end = further


@dataclass(frozen=True)
class GateSummary:
    """What a slice does to the gate, for any time of the last run before it.

    ``times`` are rows that may be the first to run; the first one a period after the last run is, or
    else the last one listed, which runs in any case. ``exits`` are the slice's last run that follows.
    """

    times: list[int]
    exits: list[int]
    forced: bool

    def after(self, last_run: int | None, period_ms: int) -> int | None:
        place = 0 if last_run is None else bisect_left(self.times, last_run + period_ms * 1000)
        if place == len(self.times):
            if not self.forced:
                return last_run
            place -= 1
        return self.exits[place]

    def then(self, later: GateSummary, period_ms: int) -> GateSummary:
        """The effect of this slice and the ``later`` one together."""
        exits = [later.after(x, period_ms) for x in self.exits]
        if self.forced:  # whatever came before, some row here runs
            return GateSummary(self.times, exits, True)
        return GateSummary(self.times + later.times, exits + later.exits, later.forced)


def summarize_gate(times: np.ndarray, flagged: np.ndarray, period_ms: int) -> GateSummary:
    n = len(times)
    period = period_ms * 1000
    rows = np.arange(n)
    flags = np.append(np.flatnonzero(flagged), n)
    next_flag = flags[np.searchsorted(flags, rows, side="right").clip(max=len(flags) - 1)]
    next_flag = np.where(next_flag <= rows, n, next_flag)
    following = np.minimum(next_flag, np.searchsorted(times, times + period, side="left"))
    ends = times[last_in_chain(np.maximum(following, rows + 1))]
    # A last run lies before the slice, so a row one period into it runs at the latest.
    latest = min(int(flags[0]), int(np.searchsorted(times, times[0] + period, side="left")))
    forced = latest < n
    first, out = times[: latest + 1], ends[: latest + 1]
    keep = np.append(out[1:] != out[:-1], True)
    return GateSummary(first[keep].tolist(), out[keep].tolist(), forced)


@dataclass(frozen=True)
class AlertSummary:
    """What a slice of flagged rows does to the alert state, for any state before it.

    A listed row is the first to fire if the cooldown is over at its time and at least ``needs``
    consecutive flags precede the slice without a gap. ``exits`` and ``counts`` describe the end.
    """

    first_position: int
    last_position: int
    tail: int
    unbroken: bool
    times: list[int]
    needs: list[int]
    exits: list[int]
    counts: list[int]
    sure: bool  # whether the last listed row fires if none before it does

    def then(self, later: AlertSummary, cooldown_us: int) -> AlertSummary:
        """The effect of this slice and the ``later`` one together."""
        ends = [later.after(AlertState(c, x, self.last_position), cooldown_us) for c, x in zip(self.counts, self.exits)]
        times, needs = list(self.times), list(self.needs)
        exits, counts = [s.last_alert for s in ends], [s.count for s in ends]
        joined = later.first_position == self.last_position + 1
        for t, n, x, c in zip(later.times, later.needs, later.exits, later.counts) if not self.sure else ():
            # Flags of this slice count for the later one if nothing lies between, and those before it if it is one run.
            n = max(n - self.tail, 0) if joined else n
            if n == 0 or (joined and self.unbroken):
                times.append(t)
                needs.append(n)
                exits.append(x)
                counts.append(c)
        on = joined and later.unbroken
        return AlertSummary(
            self.first_position, later.last_position, later.tail + (self.tail if on else 0), on and self.unbroken,
            times, needs, exits, counts, self.sure or later.sure,
        )

    def after(self, state: AlertState, cooldown_us: int) -> AlertState:
        before = state.count if self.first_position == state.last_position + 1 else 0
        at = 0 if state.last_alert is None else bisect_left(self.times, state.last_alert + cooldown_us)
        while at < len(self.times) and self.needs[at] > before:
            at += 1
        if at < len(self.times):
            return AlertState(self.counts[at], self.exits[at], self.last_position)
        count = self.tail + before if self.unbroken else self.tail
        return AlertState(count, state.last_alert, self.last_position)


def summarize_alerts(positions: np.ndarray, times: np.ndarray, cfg: AlertConfig) -> AlertSummary:
    n, needed = len(positions), cfg.consecutive
    rows = np.arange(n)
    cooldown = cfg.cooldown_seconds * 1_000_000
    breaks = np.append(True, np.diff(positions) != 1)
    run = rows - np.maximum.accumulate(np.where(breaks, rows, 0)) + 1  # flags in a row, up to here
    enough = np.append(np.flatnonzero(run >= needed), n)
    next_enough = lambda i: np.where(i < n, enough[np.searchsorted(enough, np.minimum(i, n), side="left")], n)
    following = next_enough(np.maximum(rows + max(needed, 1), np.searchsorted(times, times + cooldown, side="left")))
    end = last_in_chain(following)
    counts = np.minimum(run[-1], n - 1 - end)
    # The last alert lies before the slice, so no row after this one can be the first to fire.
    latest = int(next_enough(np.searchsorted(times, times[0] + cooldown, side="left")))
    opening = int(np.flatnonzero(breaks)[1]) if breaks.sum() > 1 else n  # rows that continue the slice before
    possible = rows[: latest + 1]
    possible = possible[(run[possible] >= needed) | (possible < opening)]
    needs = np.maximum(needed - run[possible], 0)
    return AlertSummary(
        int(positions[0]), int(positions[-1]), int(run[-1]), opening == n,
        times[possible].tolist(), needs.tolist(), times[end[possible]].tolist(), counts[possible].tolist(), latest < n,
    )


def severity(a_flag: bool, a_score: float, b_flag: bool, b_score: float) -> tuple[str, str, float]:
    """(severity, source, score) of a flagged row."""
    if a_flag and b_flag:
        return CRITICAL, BOTH, max(a_score, b_score)
    if b_flag:
        return HIGH, ONLY_MODEL, b_score
    return (HIGH if a_score > HIGH_SCORE else MEDIUM), ONLY_STATS, a_score


def pack(state) -> bytes:
    """Same bytes for same state, so states can be compared by digest."""

    def plain(part):
        if isinstance(part, np.ndarray):
            return {"shape": part.shape, "data": b64encode(part.astype("<f8").tobytes()).decode()}
        if isinstance(part, AlertState):
            return {"alerts": [part.count, part.last_alert, part.last_position]}
        if isinstance(part, tuple):
            return [plain(p) for p in part]
        return part

    return json.dumps(plain(state)).encode()


def unpack(data: bytes):
    def rich(part):
        if isinstance(part, list):
            return tuple(rich(p) for p in part)
        if isinstance(part, dict) and "alerts" in part:
            return AlertState(*part["alerts"])
        if isinstance(part, dict):
            return np.frombuffer(b64decode(part["data"]), dtype="<f8").reshape(part["shape"]).copy()
        return part

    return rich(json.loads(data))
