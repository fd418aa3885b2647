"""Markets that pass by: a run's bars come in the order of time, and only what its strategy looks back on is kept."""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Mapping
from itertools import islice

import numpy as np

from tidelake.plans.broker import Bar, CorporateAction

PRICES = ("open", "high", "low", "close", "volume", "amount")


class Bars(Mapping):
    """The bars of one point of time by code; a bar is made when it is asked for."""

    def __init__(self, ids: dict[str, int], codes: list[str], at: memoryview, values: np.ndarray):
        self.ids, self.codes, self.at, self.values = ids, codes, at, values

    def row(self, security: str) -> int:
        i = self.ids.get(security, len(self.at))
        return self.at[i] if i < len(self.at) else -1

    def __contains__(self, security) -> bool:
        return self.row(security) >= 0

    def __getitem__(self, security: str) -> Bar:
        row = self.row(security)
        if row < 0:
            raise KeyError(security)
        return Bar(*self.values[row].tolist())

    def get(self, security, default=None):
        row = self.row(security)
        return Bar(*self.values[row].tolist()) if row >= 0 else default

    def __iter__(self):
        return iter(self.codes)

    def __len__(self) -> int:
        return len(self.codes)


class Facts(Mapping):
    """The other columns of one point of time, by code."""

    def __init__(self, codes: list[str], columns: dict[str, list]):
        self.at, self.columns = {c: i for i, c in enumerate(codes)}, columns

    def __getitem__(self, security: str) -> dict:
        i = self.at[security]
        return {c: v[i] for c, v in self.columns.items()}

    def __iter__(self):
        return iter(self.at)

    def __len__(self) -> int:
        return len(self.at)


class Passing:
    """What a Market tells, of the points of time so far. ``looks_back`` has how many of them a strategy looks back on, by price."""

    def __init__(self, looks_back: dict[str, int]):
        self.fields = tuple(dict.fromkeys(["close", *looks_back]))
        self.kept: deque = deque()
        self.most = max([0, *looks_back.values()]) + 1
        self.times: list[str] = []
        self.ids: dict[str, int] = {}
        self.codes: list[str] = []  # by id: one text for each code, whenever it comes
        self.now = Bars(self.ids, [], memoryview(np.zeros(0, np.int32)), np.zeros((0, len(PRICES))))
        self.latest = self.before = np.zeros(0)  # last closes: by now, and before what is kept
        self.factors: dict[str, list[tuple[str, float]]] = {}
        self.actions: dict[str, list[CorporateAction]] = {}
        self.facts: dict[str, Mapping] = {}
        self.names: dict[str, str] = {}
        self.listed: dict[str, tuple[str | None, str | None]] = {}

    def push(self, time: str, codes: list[str], values: np.ndarray, facts: dict[str, list]) -> None:
        """The next point of time, with codes in ascending order; of equal ones the last counts."""
        ids = self.ids
        own = np.fromiter((ids.setdefault(c, len(ids)) for c in codes), np.int64, len(codes))
        if len(ids) > len(self.codes):
            self.codes.extend(islice(ids, len(self.codes), None))
        codes = [self.codes[i] for i in own]
        at = np.full(len(ids), -1, np.int32)
        at[own] = np.arange(len(codes))
        if len(set(codes)) < len(codes):
            last = np.flatnonzero(at[own] == np.arange(len(codes)))
            codes, values, own = [codes[i] for i in last], values[last], own[last]
            facts = {c: [v[i] for i in last] for c, v in facts.items()}
            at[own] = np.arange(len(codes))
        grown = np.full(len(ids) - len(self.latest), np.nan)
        self.latest, self.before = np.concatenate([self.latest, grown]), np.concatenate([self.before, grown])
        if self.most > 1:
            self.kept.append((time, own, memoryview(at), {f: memoryview(np.ascontiguousarray(values[:, PRICES.index(f)])) for f in self.fields}))
            if len(self.kept) > self.most:
                _, gone, _, prices = self.kept.popleft()
                self.before[gone] = np.asarray(prices["close"])
        self.latest[own] = values[:, PRICES.index("close")]
        self.times.append(time)
        self.now = Bars(ids, codes, memoryview(at), values)
        day = time[:10]
        for d in [d for d in self.actions if d < day]:
            del self.actions[d]
        told = Facts(codes, facts) if facts else {}
        self.facts = {day: {**self.facts[day], **told} if facts and day in self.facts else told}

    def values(self, securities: list[str], times: list[str], name: str) -> dict[str, list[float]]:
        """Values at some of the last points of time; a gap has the last close, or zero if it is a volume or an amount."""
        if times and (not self.kept or times[0] < self.kept[0][0] or name not in self.fields):
            raise ValueError(f"the strategy looks back on {name} further than its looks_back tells")
        out, wanted = {}, set(times)
        for s in securities:
            i = self.ids.get(s)
            if i is None:
                out[s] = [0.0] * len(times)
                continue
            last, own = float(self.before[i]) if times else 0.0, []
            for t, _, at, prices in self.kept:
                row = at[i] if i < len(at) else -1
                if row >= 0:
                    last = prices["close"][row]
                if t in wanted:
                    own.append(prices[name][row] if row >= 0 else last if last != last or name not in ("volume", "amount") else 0.0)
            out[s] = own
        return out

    def factor(self, security: str, day: str) -> float:
        """The latest factor by a day, else the earliest so far, else one."""
        known = self.factors.get(security)
        return known[max(0, bisect_right(known, (day[:10], float("inf"))) - 1)][1] if known else 1.0

    def add_factor(self, security: str, day: str, factor: float) -> None:
        known = self.factors.setdefault(security, [])
        if not known or known[-1][1] != factor:
            known.append((day, factor))

    def close_at(self, security: str, time: str) -> float:
        """The last close by now."""
        i = self.ids.get(security)
        return float("nan") if i is None else float(self.latest[i])
