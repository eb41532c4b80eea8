"""A paged JSON source for Spark: old pages are never read, others one by one.

Pages are columnar JSON (parallel arrays). How a page's bytes are had is injected: by
default they are read as files, one task per page; a getter over a network is slowed
down by a ``Policy`` and gets all pages in one task, as its rate is a global one.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

Getter = Callable[[str], bytes]


class Answer(Enum):
    """What is to be done after a request."""

    DONE = "done"
    FINAL = "final"
    AGAIN = "again"


#: Statuses after which the same request may succeed (fixed values).
TRANSIENT = frozenset([429, 500, 502, 503, 504])


def classified(status: int | None) -> Answer:
    """The one place that judges a status; None is a lost connection or a timeout."""
    if status == 200:
        return Answer.DONE
    return Answer.AGAIN if status is None or status in TRANSIENT else Answer.FINAL


@dataclass(frozen=True)
class Policy:
    """At least ``gap`` seconds between requests; up to ``tries`` of them for one
    address, with waits that double from ``first_wait`` after each transient failure."""

    gap: float = 0.2
    tries: int = 5
    first_wait: float = 1.0

    def waits(self) -> Iterator[float]:
        return (self.first_wait * 2**i for i in range(self.tries))


class Polite:
    """A getter under a policy. ``request`` gives (status, body) of an address; the
    clock and the sleep can be replaced."""

    def __init__(self, request: Callable[[str], tuple[int, bytes]], policy: Policy = Policy(), sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> None:
        self.request, self.policy, self.sleep, self.clock = request, policy, sleep, clock
        self.free_at: float | None = None

    def _asked(self, url: str) -> tuple[int | None, bytes]:
        if self.free_at is not None and (early := self.free_at - self.clock()) > 0:
            self.sleep(early)
        self.free_at = self.clock() + self.policy.gap
        try:
            return self.request(url)
        except (ConnectionError, TimeoutError):
            return None, b""

    def __call__(self, url: str) -> bytes:
        for wait in self.policy.waits():
            status, body = self._asked(url)
            verdict = classified(status)
            if verdict is Answer.DONE:
                return body
            if verdict is Answer.FINAL:
                raise RuntimeError(f"{status} for {url}")
            self.sleep(wait)
        raise RuntimeError(f"gave up after {self.policy.tries} tries: {url}")


def file_getter(path: str) -> bytes:
    """The bytes of a file that all executors see under the same path."""
    with open(path.removeprefix("file://"), "rb") as f:
        return f.read()


class _Pages(InputPartition):
    def __init__(self, addresses: list[str]) -> None:
        self.addresses = addresses


class PagesReader(DataSourceReader):
    """``together``: one task reads all pages, for getters whose rate is limited."""

    def __init__(self, options: dict[str, str], columns: Sequence[str], get: Getter = file_getter, together: bool = False) -> None:
        self.index, self.columns = options["index"], list(columns)
        self.since = options.get("since", "")
        self.date = options.get("date", "filingDate")
        self.get, self.together = get, together

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Lower bounds of the date skip whole pages; Spark filters the rows again."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)) and f.attribute == (self.date,):
                self.since = max(self.since, str(f.value))
            yield f

    def partitions(self) -> list[_Pages]:
        listed = json.loads(self.get(self.index))["pages"]
        folder = self.index.rpartition("/")[0]
        wanted = [f"{folder}/{p['name']}" for p in listed if not self.since or p.get("to", "9") >= self.since]
        return [_Pages(wanted)] if self.together else [_Pages([w]) for w in wanted]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for address in partition.addresses:  # type: ignore[attr-defined]
            table = json.loads(self.get(address))
            yield from zip(*(table[c] for c in self.columns))


class PagesSource(DataSource):
    """``spark.read.format("json_pages").option("index", ...)``: an index lists the
    pages ({"pages": [{"name": ..., "to": last date}]}), each columnar JSON."""

    COLUMNS = ("accessionNumber", "filingDate", "reportDate", "form", "primaryDocument")
    get: Getter = staticmethod(file_getter)
    together = False

    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in self.COLUMNS)

    def reader(self, schema: object) -> PagesReader:
        return PagesReader(dict(self.options), [f.name for f in schema.fields], self.get, self.together)  # type: ignore[attr-defined]


def register(spark: SparkSession, request: Callable[[str], tuple[int, bytes]] | None = None, policy: Policy = Policy()) -> None:
    """Make ``json_pages`` known to the session, with filter pushdown on. With
    ``request`` ((status, body) of an address) the index and pages are fetched by it,
    politely and from one task; without, they are files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    source = PagesSource
    if request is not None:
        source = type("FetchedPages", (PagesSource,), {"get": staticmethod(Polite(request, policy)), "together": True})
    spark.dataSource.register(source)
