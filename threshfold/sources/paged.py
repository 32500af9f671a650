"""A paged record service as a Python data source, batch and streaming.

The service is asked for records of a time window, a page at a time. Where it fails softly the
window is halved down to a floor (and the stretch then logged as a gap), where it answers the
window grows. Offsets are times, so a restarted stream goes on where it stopped; records at a
page's border are read again and left to the deduplication by identifier.

``format("paged").option("service", "file").option("path", ...)`` reads newline JSON files as if they
were the service, for tests and offline runs (on a cluster the path is one that all executors mount); other services are registered in ``SERVICES``.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FLOOR, CEILING, GROWTH = 900, 30 * 86_400, 1.6
SCHEMA = "id string, created_utc long, payload string"


class SoftFailure(Exception):
    """The service could not answer this window: ask for less."""


class HardFailure(Exception):
    """The request itself is wrong: asking again does not help."""


def with_backoff(call: Callable[[], object], tries: int = 7, sleep: Callable[[float], None] = time.sleep, base: float = 1.6) -> object:
    """Call until it answers: waits double, a refusal (status 403, 429) waits four times as long, a
    bad request (400) raises at once, a late one (422) fails softly after two tries, others at the end."""
    for k in range(tries):
        try:
            return call()
        except StatusError as e:
            if e.status == 400:
                raise HardFailure(str(e)) from e
            if e.status == 422 and k >= 1:
                raise SoftFailure(str(e)) from e
            sleep(base * 2**k * (4 if e.status in (403, 429) else 1))
        except TimeoutError:
            sleep(base * 2**k)
    raise SoftFailure("no answer")


class StatusError(Exception):
    def __init__(self, status: int) -> None:
        super().__init__(f"status {status}")
        self.status = status


@dataclass
class FileService:
    """Newline JSON files as a service: records with ``created_utc`` in [start, end), by time, at most a page."""

    path: str
    page: int = 100

    def fetch(self, start: int, end: int) -> list[dict]:
        import glob

        rows = []
        for p in sorted(glob.glob(self.path)):
            with open(p) as f:
                rows += [r for line in f if line.strip() and start <= (r := json.loads(line))["created_utc"] < end]
        return sorted(rows, key=lambda r: (r["created_utc"], r["id"]))[: self.page]


SERVICES: dict[str, Callable[[dict], object]] = {"file": lambda o: FileService(o["path"], int(o.get("page", 100)))}


class Patient:
    """A service that is asked again, as :func:`with_backoff` says."""

    def __init__(self, service, base: float = 1.6) -> None:
        self.service, self.base, self.page = service, base, service.page

    def fetch(self, start: int, end: int) -> list[dict]:
        return with_backoff(lambda: self.service.fetch(start, end), base=self.base)


def gap_log(records):
    """``gap_from, gap_to`` of the stretches that a read gave up."""
    from pyspark.sql import functions as F

    return records.where("id is null").select(F.get_json_object("payload", "$.gap_from").cast("long").alias("gap_from"), F.get_json_object("payload", "$.gap_to").cast("long").alias("gap_to"))


def walk(service, start: int, end: int, window: int = 86_400, gaps: list | None = None) -> Iterator[dict]:
    """All records of [start, end), each identifier once: adaptive windows, full pages re-read from
    the last second they reached."""
    at, seen = start, set()
    while at < end:
        to = min(end, at + window)
        try:
            rows = service.fetch(at, to)
        except SoftFailure:
            if window <= FLOOR:
                if gaps is not None:
                    gaps.append((at, to))
                at = to
            window = max(FLOOR, window // 2)
            continue
        for r in rows:
            if r["id"] not in seen:
                seen.add(r["id"])
                yield r
        full = len(rows) >= service.page
        last = rows[-1]["created_utc"] if rows else at
        if full and last > at:
            at = last  # the same second again: the page may have cut it
            seen = {r["id"] for r in rows if r["created_utc"] >= last}
        elif full:
            raise HardFailure(f"more records in one second than a page holds: {at}")
        else:
            at, seen = to, set()
            window = min(CEILING, int(window * GROWTH))


class Slice(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.o = dict(options)

    def partitions(self) -> list[Slice]:
        a, z, n = int(self.o["start"]), int(self.o["end"]), int(self.o.get("partitions", 1))
        cuts = [a + (z - a) * i // n for i in range(n + 1)]
        return [Slice(x, y) for x, y in zip(cuts, cuts[1:], strict=False) if x < y]

    def read(self, part: Slice) -> Iterator[tuple]:
        service = Patient(SERVICES[self.o.get("service", "file")](self.o), float(self.o.get("wait", 1.6)))
        gaps: list[tuple[int, int]] = []
        for r in walk(service, part.start, part.end, gaps=gaps):
            yield (r["id"], r["created_utc"], json.dumps(r, separators=(",", ":")))
        for a, z in gaps:  # a stretch that was given up is a row without identifier
            yield (None, a, json.dumps({"gap_from": a, "gap_to": z}))


class _Stream(_Reader, DataSourceStreamReader):
    """Offsets are seconds; a batch takes at most ``step`` seconds."""

    def initialOffset(self) -> dict:
        return {"at": int(self.o["start"])}

    def latestOffset(self) -> dict:
        self.now = min(int(self.o["end"]), getattr(self, "now", int(self.o["start"])) + int(self.o.get("step", 30 * 86_400)))
        return {"at": self.now}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        self.now = max(getattr(self, "now", 0), end["at"])
        return [Slice(start["at"], end["at"])] if start["at"] < end["at"] else []

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark) -> None:
    spark.dataSource.register(PagedSource)
