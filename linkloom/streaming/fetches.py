"""Which pages of a stream belong to which fetch, and how far each fetch reads.

A fetch of a feed starts from the mark its predecessor left and reads its pages in order until it
meets what it already knows. A stream brings the pages of several fetches mixed, late and out of
order. ``FetchOrder`` keeps, per feed, the current mark and the open pages of its fetches (their
times, not their texts) and decides a fetch once its pages are there without a gap up to where it
ends, earlier fetches first. A timer closes a fetch whose missing pages do not come.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources.feeds import FeedSpec, TAKE_WHILE, page_times

#: What a decision says: a fetch was first seen, was read to its end or given up, one of its pages is read
#: up to an item, or came after the fetch was closed.
OPENED, CLOSED, FAILED, PAGE, LATE = "opened", "closed", "failed", "page", "late"
DECISION = "feed string, fetched bigint, page_no int, upto int, mark bigint, newest bigint, what string"
#: Closed fetches a feed remembers, so that a page of theirs is known as late.
REMEMBERED = 1000


@dataclass(frozen=True)
class Reading:
    """``pages`` holds ``(page_no, upto)``: the items before ``upto`` are read."""

    pages: list[tuple[int, int]]
    newest: int | None
    failed: bool = False


def read_fetch(
    spec: FeedSpec, pages: dict[int, tuple], mark: int | None, now: int, first_page: int, as_is: bool = False
) -> Reading | None:
    """How far a fetch reads its ``pages`` of ``(bad, ends, secs)``; None while a page it needs is missing.

    ``as_is`` reads what there is, past gaps and to the last page, as a batch sync does. Times are
    whole seconds; ``now`` stands for an undated item where the feed's rule asks for one.
    """
    visited: list[tuple[int, int]] = []
    newest = None
    numbers = sorted(pages) if as_is else itertools.count(first_page)
    for no in numbers:
        if no not in pages:
            return None
        bad, ends, secs = pages[no]
        if bad:
            given_up = spec.fail_whole or not visited
            return Reading([], None, True) if given_up else Reading(visited, newest)
        upto, stop = len(secs), False
        if spec.rule == TAKE_WHILE:
            for i, sec in enumerate(secs):
                sec = now if sec is None else sec
                newest = sec if newest is None else max(newest, sec)
                if mark is not None and sec <= mark:
                    upto, stop = i, True
                    break
        else:
            newest = max((s for s in (newest, *secs) if s is not None), default=None)
            stop = bool(secs) and mark is not None and all(s is not None and s <= mark for s in secs)
        visited.append((no, upto))
        if stop or ends:
            return Reading(visited, newest)
    return Reading(visited, newest)


class FetchOrder(StatefulProcessor):
    """One feed's fetches. Input rows ``feed, fetched, page_no, bad, ends, secs``, output ``DECISION``."""

    def __init__(self, specs: Iterable[FeedSpec], first_page: int, patience_ms: int):
        self.specs = {spec.name: spec for spec in specs}
        self.first_page, self.patience_ms = first_page, patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", "sec bigint")
        self.pages = handle.getMapState("pages", "fetched bigint, page_no int", "bad boolean, ends boolean, secs array<bigint>")
        # ``mark`` is the one valid at the start of a closed fetch; ``seen`` the last arrival in an open one.
        self.fetches = handle.getMapState("fetches", "fetched bigint", "closed boolean, mark bigint, seen bigint")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        if initialState["mark"] is not None:
            self.mark.update((initialState["mark"],))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        feed, now = key[0], timerValues.getCurrentProcessingTimeInMs()
        for row in rows:
            known = self.fetches.getValue((row["fetched"],))
            if known and known[0]:
                yield self._row(feed, row["fetched"], LATE, page_no=row["page_no"], upto=len(row["secs"]), mark=known[1])
                continue
            if not known:
                yield self._row(feed, row["fetched"], OPENED)
            self.fetches.updateValue((row["fetched"],), (False, None, now))
            self.pages.updateValue((row["fetched"], row["page_no"]), (row["bad"], row["ends"], list(row["secs"])))
        yield from self._advance(feed, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key[0], timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass

    @staticmethod
    def _row(feed, fetched, what, page_no=None, upto=None, mark=None, newest=None) -> Row:
        return Row(feed=feed, fetched=fetched, page_no=page_no, upto=upto, mark=mark, newest=newest, what=what)

    def _advance(self, feed: str, now: int) -> Iterator[Row]:
        """Decides the earliest open fetch, and then the next, until one has to wait."""
        fetches = {k[0]: v for k, v in self.fetches.iterator()}
        waiting = sorted(f for f, v in fetches.items() if not v[0])
        stored: dict[int, dict[int, tuple]] = {}
        if waiting:
            for (fetched, page_no), value in self.pages.iterator():
                stored.setdefault(fetched, {})[page_no] = tuple(value)
        held = self.mark.get()
        mark = held[0] if held else None
        for fetched in waiting:
            given_up = fetches[fetched][2] + self.patience_ms <= now
            read = read_fetch(self.specs[feed], stored[fetched], mark, fetched // 1_000_000, self.first_page, given_up)
            if read is None:
                break
            for page_no, upto in read.pages:
                yield self._row(feed, fetched, PAGE, page_no=page_no, upto=upto, mark=mark)
            yield self._row(feed, fetched, FAILED if read.failed else CLOSED, mark=mark, newest=read.newest)
            self.fetches.updateValue((fetched,), (True, mark, now))
            for page_no in stored[fetched]:
                self.pages.removeKey((fetched, page_no))
            if read.newest is not None and (mark is None or read.newest > mark):
                mark = read.newest
                self.mark.update((mark,))
        self._forget()
        self._wait(now)

    def _forget(self) -> None:
        closed = sorted(k[0] for k, v in self.fetches.iterator() if v[0])
        for fetched in closed[:-REMEMBERED]:
            self.fetches.removeKey((fetched,))

    def _wait(self, now: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        waits = [v[2] + self.patience_ms for _, v in self.fetches.iterator() if not v[0]]
        if waits:
            self.handle.registerTimer(max(min(waits), now + 1))


def decisions(
    specs: list[FeedSpec], pages: DataFrame, marks: DataFrame, first_page: int = 0, patience_ms: int = 3_600_000
) -> DataFrame:
    """The decisions on a stream of ``(feed, fetched_at, page_no, body)``, see ``DECISION``.

    ``fetched`` is the start of a fetch in microseconds and tells fetches of a feed apart; ``marks(feed,
    mark)`` are the saved marks in seconds the stream starts from. A page's texts stay out of the state.
    """
    fetched = pages.withColumn("fetched", F.unix_micros("fetched_at"))
    parts = [page_times(spec, fetched, ["fetched"]) for spec in specs]
    times = parts[0]
    for part in parts[1:]:
        times = times.unionByName(part)
    return times.groupBy("feed").transformWithState(
        statefulProcessor=FetchOrder(specs, first_page, patience_ms),
        outputStructType=DECISION,
        outputMode="Append",
        timeMode="ProcessingTime",
        initialState=marks.groupBy("feed"),
    )
