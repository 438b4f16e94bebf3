"""Keyed machines that need more than a window: caches with a limit and a lifetime, thresholds, tabs, single flight.

Each machine is a small class with ``step(row) -> dict``; fold() runs it over every key's rows in order. Rows are dealt by key and
sorted inside partitions, then pass through once, batch by batch: a key's rows are never gathered, so memory holds one
machine and one Arrow batch whatever a key's share of the rows is. The same classes serve streams (state.py's keyed processors
hand them the rows of a micro-batch in the same order).
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Fixed values of the machines.
PAGE_ENTRIES, PAGE_TTL_S = 20, 90.0
HARD_REASONS = frozenset({"navigation", "new_tab", "ssrf_blocked", "browser_dead", "timeout"})
TEMPLATE_ENTRIES, TEMPLATE_TTL_S, TEMPLATE_FAILURES, RATIO_TOLERANCE = 50, 86_400.0, 3, 0.3
EMA_ALPHA, LOOSEN_BELOW, TIGHTEN_ABOVE, TIGHTEN_AFTER = 0.3, 0.5, 0.8, 50
LEAST_SAMPLES, WINDOW_SAMPLES, WINDOW_S, MOST_TIMES, LEAST_BUDGET = 3, 20, 3600.0, 3, 500
ROBOTS_TTL_S, ROBOTS_ERROR_TTL_S, ROBOTS_LEAST_TTL_S = 3600.0, 300.0, 60.0
MAX_TABS, TAB_TTL_S, TAB_NAME = 5, 1800.0, re.compile(r"[a-zA-Z0-9_]{1,30}")


def fold(rows: DataFrame, key: str, order: list[str], machine: Callable[[], object], out: str) -> DataFrame:
    """What ``machine().step`` makes of every row, one machine a key, rows of a key in the given order. A null key is a key."""
    schema = StructType.fromDDL(out)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, now = object(), None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if now is None or row[key] != current:
                    current, now = row[key], machine()
                made.append(now.step(row))
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


class PageCache:
    """Rows (at, op, url): 'fetch' looks a page up and stores it when it isn't there; any other op is a reason to drop the active one.

    A hard reason removes its entry, a soft one only means that there is no active page any more. Beyond ``most`` entries the
    least recently used goes.
    """

    def __init__(self, most: int = PAGE_ENTRIES, ttl: float = PAGE_TTL_S):
        self.most, self.ttl = most, ttl
        self.made: OrderedDict[str, float] = OrderedDict()
        self.active: str | None = None

    def step(self, row: dict) -> dict:
        evicted = 0
        if row["op"] != "fetch":
            outcome = "hard" if row["op"] in HARD_REASONS else "soft"
            if outcome == "hard" and self.active is not None:
                self.made.pop(self.active, None)
            self.active = None
        else:
            url, at = row["url"], row["at"]
            since = self.made.get(url)
            if since is not None and at - since <= self.ttl:
                outcome = "hit"
            else:
                outcome = "miss" if since is None else "expired"
                self.made[url] = at
            self.made.move_to_end(url)
            while len(self.made) > self.most:
                self.made.popitem(last=False)
                evicted += 1
            self.active = url
        return {"id": row["id"], "outcome": outcome, "entries": len(self.made), "evicted": evicted}


def template_fits(known: dict, row: dict) -> list[str]:
    """What of a learnt template a page contradicts."""
    out = []
    if known["has_main"] != row["has_main"]:
        out.append("has_main")
    if known["source"] and row["source"] and known["source"] != row["source"]:
        out.append("metadata_source")
    out += [n for n in ("removal", "selection") if abs(known[n] - row[n]) > RATIO_TOLERANCE]
    return out


class TemplateCache:
    """Rows (at, domain, page_type, has_main, source, removal, selection): learnt on a miss, checked on a hit, dropped after
    three failures in a row, a lifetime of a day, the least recently used one beyond the limit."""

    def __init__(self, most: int = TEMPLATE_ENTRIES, ttl: float = TEMPLATE_TTL_S):
        self.most, self.ttl = most, ttl
        self.known: OrderedDict[tuple, dict] = OrderedDict()

    def step(self, row: dict) -> dict:
        key = (row["domain"], row["page_type"])
        known = self.known.get(key)
        wrong: list[str] = []
        if known is not None and row["at"] - known["at"] > self.ttl:
            del self.known[key]
            known = None
        if known is None:
            self.known[key] = {**row, "failures": 0}
            outcome = "learned"
        else:
            self.known.move_to_end(key)
            wrong = template_fits(known, row)
            known["failures"] = known["failures"] + 1 if wrong else 0
            outcome = "failed" if wrong else "passed"
            if known["failures"] >= TEMPLATE_FAILURES:
                del self.known[key]
                outcome = "dropped"
        while len(self.known) > self.most:
            self.known.popitem(last=False)
        return {"id": row["id"], "outcome": outcome, "mismatches": ",".join(wrong), "entries": len(self.known)}


class AutoThreshold:
    """Rows (at, confidence, budget): the budget follows an exponential mean of confidence, evaluated by samples or by the hour."""

    def __init__(self):
        self.ema, self.samples, self.high, self.adjustment, self.since = 0.5, 0, 0, 0, None

    def step(self, row: dict) -> dict:
        x, at, base = row["confidence"], row["at"], row["budget"]
        if self.since is None:
            self.since = at
        self.ema = x if self.samples == 0 else EMA_ALPHA * x + (1 - EMA_ALPHA) * self.ema
        self.samples += 1
        self.high = self.high + 1 if x > TIGHTEN_ABOVE else 0
        if self.samples >= WINDOW_SAMPLES or at - self.since >= WINDOW_S:
            self._evaluate(base)
            self.since, self.samples = at, 0
        budget = max(LEAST_BUDGET, min(base + self.adjustment, base * MOST_TIMES))
        return {"id": row["id"], "ema": self.ema, "adjustment": self.adjustment, "budget": budget}

    def _evaluate(self, base: int) -> None:
        if self.samples < LEAST_SAMPLES:
            return
        if self.ema < LOOSEN_BELOW:
            self.adjustment = min(self.adjustment + max(100, int(base * 0.15)), base * (MOST_TIMES - 1))
        elif self.ema > TIGHTEN_ABOVE and self.high >= TIGHTEN_AFTER and self.adjustment > 0:
            self.adjustment = max(0, self.adjustment - max(50, int(self.adjustment * 0.1)))
            self.high = 0


def robots_policy(status: int | None) -> tuple[str, float]:
    """How a fetch of robots.txt ended -> the policy and how long it holds."""
    if status is not None and 200 <= status < 300:
        return "rules", ROBOTS_TTL_S
    if status in (401, 403):
        return "disallow_all", ROBOTS_TTL_S
    if status is not None and 400 <= status < 500:
        return "allow_all", ROBOTS_TTL_S
    return "allow_all", ROBOTS_ERROR_TTL_S


class RobotsCache:
    """Rows (at, status, max_age) of one origin: status and max_age are what a fetch at that moment would give."""

    def __init__(self):
        self.until, self.policy = float("-inf"), ""

    def step(self, row: dict) -> dict:
        cached = row["at"] < self.until
        if not cached:
            self.policy, ttl = robots_policy(row["status"])
            if self.policy == "rules" and row["max_age"] is not None:
                ttl = max(ROBOTS_LEAST_TTL_S, row["max_age"])
            self.until = row["at"] + ttl
        return {"id": row["id"], "cached": cached, "policy": self.policy, "until": self.until}


class Tabs:
    """Rows (at, op, name) with op open, close or switch: at most five tabs, each gone half an hour after it was opened."""

    def __init__(self):
        self.opened: dict[str, float] = {}
        self.active: str | None = None

    def _close(self, name: str) -> None:
        del self.opened[name]
        if self.active == name:
            self.active = next(reversed(self.opened), None)

    def step(self, row: dict) -> dict:
        name, at = row["name"], row["at"]
        for old in [n for n, since in self.opened.items() if at - since > TAB_TTL_S]:
            self._close(old)
        status = "ok"
        if not TAB_NAME.fullmatch(name or ""):
            status = "invalid_name"
        elif row["op"] == "open":
            if name in self.opened:
                status = "tab_exists"
            elif len(self.opened) >= MAX_TABS:
                status = "max_tabs_reached"
            else:
                self.opened[name], self.active = at, name
        elif name not in self.opened:
            status = "tab_not_found"
        elif row["op"] == "close":
            self._close(name)
        else:
            self.active = name
        return {"id": row["id"], "status": status, "tabs": len(self.opened), "active": self.active}


class SingleFlight:
    """Rows (at, seconds): a request that begins while another of its key is under way waits for that one's answer."""

    def __init__(self):
        self.leader, self.until = None, float("-inf")

    def step(self, row: dict) -> dict:
        joins = row["at"] < self.until
        if not joins:
            self.leader, self.until = row["id"], row["at"] + row["seconds"]
        return {"id": row["id"], "leader": self.leader, "joined": joins}


#: The state that a step of a purchase ends in: with nothing analysed, with a good analysis, with any other. None: the flow failed.
FLOW = {
    "barrier": ("barrier_check", "barrier_resolved", None),
    "discovery": (None, "discovery_analyzed", None),
    "product": (None, "product_analyzed", None),
    "cart": (None, "cart_ready", "product_analyzed"),
}


class PurchaseFlow:
    """Rows (step, good): good says whether the analysis found what the step needs (no barrier or one that can be dismissed, cards, a
    name or price, a cart button), null that there was no analysis. After a failure every later step but a new barrier check fails."""

    def __init__(self):
        self.state, self.steps, self.successes = "init", 0, 0

    def step(self, row: dict) -> dict:
        missing, good, other = FLOW[row["step"]]
        new = missing if row["good"] is None else good if row["good"] else other
        if self.state == "flow_failed" and row["step"] != "barrier":
            new = None
        self.state = new or "flow_failed"
        self.steps += 1
        self.successes += new is not None
        return {"id": row["id"], "state": self.state, "steps": self.steps, "successes": self.successes}


class GreedyBuckets:
    """Rows (bucket, tokens, budget) of a page in order of bucket and place: taken while they fit; the first that doesn't closes its bucket,
    and the next one goes on with what was spent."""

    def __init__(self):
        self.spent, self.closed = 0, None

    def step(self, row: dict) -> dict:
        if row["bucket"] == self.closed:
            kept = False
        elif self.spent + row["tokens"] > row["budget"]:
            kept, self.closed = False, row["bucket"]
        else:
            kept = True
            self.spent += row["tokens"]
        return {"id": row["id"], "kept": kept, "spent": self.spent}
