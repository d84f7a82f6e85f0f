"""Checking the pages of a crawl as they come: repeats and pages that don't move get two more tries."""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..workers import ready

#: Tries after the first one.
RETRIES = 2
#: Pages as they come: the page that was asked for, the one that it says it is, and how many there are.
PAGES = "category string, url string, page int, shown_page int, last_page int, urls array<string>, ts timestamp"
OUTCOMES = "category string, url string, page int, outcome string, reason string, attempt int"


def judge_page(held: dict, url: str, page: int, shown: int, last: int, urls: list[str]) -> tuple[str, str | None, int]:
    """What becomes of a page, given what its category has seen, which it updates: outcome, reason and attempt.

    A repeated set of products or a page other than asked for is to be fetched again, twice at
    most; a page without products, one visited before and another number of pages are errors
    at once. An accepted last page finishes its category.
    """
    attempt = held["attempts"].get(url, 0)
    if url in held["visited"]:
        return "rejected", "pagination loop", attempt
    if not urls:
        return "rejected", "no products", attempt
    if held["last"] is not None and last != held["last"]:
        return "rejected", f"number of pages changed from {held['last']} to {last}", attempt
    signature = sha256("\n".join(sorted(set(urls))).encode()).hexdigest()
    reason = "repeated page" if signature in held["signatures"] else "page did not move" if shown != page else None
    if reason:
        held["attempts"][url] = attempt + 1
        return ("retry" if attempt < RETRIES else "rejected"), reason, attempt
    held["signatures"].append(signature)
    held["visited"].append(url)
    held["attempts"].pop(url, None)
    held["last"] = last
    held["finished"] = held["finished"] or page >= last
    return "accepted", None, attempt


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, patience_ms: int) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in OUTCOMES.split(", ")]
    if state.hasTimedOut:
        held = json.loads(state.get[0])
        state.remove()
        if not held["finished"]:
            yield pd.DataFrame([(key[0], None, None, "rejected", "category was not finished in time", None)], columns=columns).astype({"page": "Int32", "attempt": "Int32"})
        return
    held = json.loads(state.get[0]) if state.exists else {"visited": [], "signatures": [], "attempts": {}, "last": None, "finished": False}
    rows = pd.concat(list(frames)).sort_values(["ts", "page"], kind="stable")
    found = [(key[0], r.url, r.page, *judge_page(held, r.url, r.page, r.shown_page, r.last_page, [] if r.urls is None else list(r.urls))) for r in rows.itertuples(index=False)]
    state.update((json.dumps(held),))
    state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + patience_ms)
    yield pd.DataFrame(found, columns=columns).astype({"page": "Int32", "attempt": "Int32"})


def checked_pages(pages: DataFrame, delay: str = "10 minutes", patience_ms: int = 3_600_000) -> DataFrame:
    """A stream of pages (PAGES) as a stream of outcomes: accepted, retry or rejected with a reason.

    What a category has seen is its state: signatures and addresses of its pages, tries and the
    number of pages. A category that is not finished and gets no page for ``patience_ms`` is
    rejected when the watermark passes and may begin anew; a finished one is then forgotten.
    """
    ready(pages.sparkSession)
    return pages.withWatermark("ts", delay).groupBy("category").applyInPandasWithState(
        lambda key, frames, state: _update(key, frames, state, patience_ms), OUTCOMES, "held string", "append", GroupStateTimeout.EventTimeTimeout
    )
