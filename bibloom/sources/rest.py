"""Paged sources of a web service as a Python data source, with the pages kept in files where there is no network."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Ids that a search gives at most, ids in a batch of records, seconds between two calls without and with a key (fixed values).
CEILING, BATCH, PAUSE, PAUSE_WITH_KEY = 10_000, 50, 0.34, 0.11
RETRY = (429, 500, 502, 503, 504)


class Throttle:
    """At most one call in ``pause`` seconds."""

    def __init__(self, pause: float = PAUSE, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.pause, self.clock, self.sleep, self.last = pause, clock, sleep, float("-inf")

    def wait(self) -> None:
        left = self.last + self.pause - self.clock()
        if left > 0:
            self.sleep(left)
        self.last = self.clock()


def with_retries(call: Callable[[], tuple[int, dict[str, str], bytes]], attempts: int = 3, longest: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> bytes | None:
    """The body of an answer, tried again on RETRY codes and time-outs after what Retry-After says, at most ``longest`` seconds; null if it stays out."""
    for k in range(attempts):
        try:
            status, headers, body = call()
        except TimeoutError:
            status, headers, body = 503, {}, b""
        if status == 200:
            return body
        if status not in RETRY:
            return None
        if k + 1 < attempts:
            after = headers.get("retry-after", "")
            sleep(min(longest, float(after) if after.replace(".", "", 1).isdigit() else 2.0**k))
    return None


def budget(total: int, wanted: int, ceiling: int = CEILING) -> tuple[int, bool]:
    """How many ids to fetch of ``total``, and whether that cuts the result short."""
    n = max(0, min(total, wanted, ceiling))
    return n, n < total


def page_starts(total: int, wanted: int, page: int = 100) -> list[tuple[int, int]]:
    """Offset and size of each page of a search."""
    n, _ = budget(total, wanted)
    return [(i, min(page, n - i)) for i in range(0, n, page)]


class Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Replay(DataSource):
    """Pages of a service kept as JSON files, one partition each: ``spark.read.format("replayed_pages").load(folder)``.

    Option ``items`` names the list within a page, ``key`` the field that tells repeated items of a page apart. A page
    that can't be read gives no rows. A service paged by cursors must be read by one partition; kept pages need not.
    """

    @classmethod
    def name(cls) -> str:
        return "replayed_pages"

    def schema(self) -> str:
        return "page string, position int, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options.get("path", ".")
        self.items, self.key = options.get("items", "results"), options.get("key")

    def partitions(self) -> list[Page]:
        return [Page(str(p)) for p in sorted(Path(self.folder).glob("*.json"))]

    def read(self, partition: Page) -> Iterator[tuple]:
        try:
            found = json.loads(Path(partition.path).read_text(encoding="utf-8"))
        except (OSError, ValueError):
            return
        rows = found.get(self.items, []) if isinstance(found, dict) else found
        seen = set()
        for i, x in enumerate(rows if isinstance(rows, list) else []):
            k = x.get(self.key) if self.key and isinstance(x, dict) else None
            if k is None or k not in seen:
                seen.add(k)
                yield Path(partition.path).name, i, json.dumps(x, ensure_ascii=False)


def name_variants(author: str) -> list[str]:
    """Forms under which an index may hold "Surname Forename": the name as typed, and the surname with any initials that begin with the first."""
    words = author.split()
    if len(words) < 2:
        return [f"{words[0]}[Author]"] if words else []
    return [f'"{author.strip()}"[Author]', f'"{words[0]} {words[1][0].upper()}*"[Author]']


def search_term(author: str, orcid: str = "", affiliations: tuple[str, ...] = ()) -> str:
    """A search of a person: the identifier, or any form of the name together with any of the institutions. The identifier isn't narrowed by these."""
    person = " OR ".join(name_variants(author))
    where = " OR ".join(f'"{a}"[Affiliation]' for a in affiliations)
    named = f"(({person}) AND ({where}))" if person and where else f"({person})" if person else ""
    return " OR ".join(x for x in (f"{orcid}[auid]" if orcid else "", named) if x)


def remedy(total: int, wanted: int, ceiling: int = CEILING) -> str | None:
    """What helps a search that finds more than it fetches: a higher budget, or, over what the service gives at all, a narrower search."""
    return None if total <= min(wanted, ceiling) else "narrow_search" if total > ceiling else "raise_budget"


def scan_ids(fetch: Callable[[str, int, int], tuple[int, list[str]]], author: str, orcid: str = "", affiliations: tuple[str, ...] = (), wanted: int = CEILING, page: int = 100) -> tuple[list[str], dict]:
    """All ids that a search finds, and where they come from.

    ``fetch(term, start, size)`` gives the total and a page of ids; a probe of size 0 tells the total. A search that finds
    more than its budget is narrowed by the affiliations, if there are any and it wasn't yet. Ids given twice count once.
    """
    term = search_term(author, orcid)
    total = fetch(term, 0, 0)[0]
    narrowed = total > min(wanted, CEILING) and bool(affiliations)
    if narrowed:
        term = search_term(author, orcid, affiliations)
        total = fetch(term, 0, 0)[0]
    ids: dict[str, None] = {}
    for start, size in page_starts(total, wanted, page):
        ids |= dict.fromkeys(fetch(term, start, size)[1])
    return list(ids), {"term": term, "esearch_count": total, "pmids_returned": len(ids), "narrowed": narrowed, "remedy": remedy(total, wanted)}


def scan_records(fetch: Callable[[list[str]], str | None], ids: list[str], batch: int = BATCH) -> Iterator[str]:
    """The answers for all ids, in batches; a batch that fails is left out and the others go on."""
    for i in range(0, len(ids), batch):
        if (body := fetch(ids[i : i + batch])) is not None:
            yield body


def scan_cursor(fetch: Callable[[str], dict | None], most: int = 2000, key: str = "id") -> tuple[list[dict], dict]:
    """Works of a service paged by cursors, each once, up to ``most``; whether that cut the result short, and whether a page failed."""
    found: dict[str, dict] = {}
    cursor, failed = "*", False
    while cursor and len(found) < most:
        page = fetch(cursor)
        if page is None:
            failed = True
            break
        for x in page.get("results", []):
            found.setdefault(x.get(key), x)
        cursor = page.get("meta", {}).get("next_cursor") if page.get("results") else None
    rows = list(found.values())
    return rows[:most], {"truncated": bool(cursor) and not failed or len(rows) > most, "request_failed": failed}


def jitter(least: float = 0.3, most: float = 1.5, draw: Callable[[float, float], float] | None = None) -> float:
    """Seconds to wait besides the throttle, so that calls of several workers don't fall together."""
    import random

    return (draw or random.uniform)(least, most)


def first_count(fetchers: list[tuple[str, Callable[[str], int | None]]], key: str) -> tuple[int | None, str | None]:
    """The first service that knows a count; zero is an answer, null or a failure is none."""
    for name, fetch in fetchers:
        try:
            n = fetch(key)
        except (OSError, ValueError):
            n = None
        if n is not None and n >= 0:
            return n, name
    return None, None


def topics_of(lookups: dict[str, str], fetch: Callable[[str], dict | None]) -> dict[str, dict]:
    """Topic and status of every record, ``lookups`` giving what each is asked by (empty: no identifier); equal lookups are asked once."""
    kept: dict[str, dict | None] = {}
    out = {}
    for record, by in lookups.items():
        if by and by not in kept:
            kept[by] = fetch(by)
        answer = kept.get(by) if by else None
        topic = (answer or {}).get("topic")
        out[record] = {"topic": topic, "status": "no_identifier" if not by else "topic_lookup_failed" if answer is None else "topic_found" if topic else "no_topic"}
    return out
