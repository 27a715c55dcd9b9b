"""Paged records as a Spark data source: pages are followed until the last, filters go to where the records are."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import NamedTuple, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import LongType, StringType, StructField, StructType

PAGE_ROWS, TIMEOUT_S, RETRIES, BACKOFF = 10_000, 60, 5, 2.0
#: Comparisons that a source understands, by the kind of Spark's filter.
COMPARISONS = {GreaterThan: "gt", GreaterThanOrEqual: "gte", LessThan: "lt", LessThanOrEqual: "lte", EqualTo: "eq"}
_HOLDS = {"gt": str.__gt__, "gte": str.__ge__, "lt": str.__lt__, "lte": str.__le__, "eq": str.__eq__}


def with_retry(fetch: Callable[[], object], retries: int = RETRIES, backoff: float = BACKOFF, sleep: Callable[[float], None] = time.sleep) -> object:
    """``fetch`` with exponential back-off between attempts; the last error is raised."""
    for i in range(retries):
        try:
            return fetch()
        except Exception:
            if i == retries - 1:
                raise
            sleep(backoff**i)
    raise ValueError("retries must be positive")


class Condition(NamedTuple):
    column: str
    comparison: str
    value: str

    def holds(self, record: Mapping[str, object]) -> bool:
        v = record.get(self.column)
        return v is not None and _HOLDS[self.comparison](str(v), self.value)


class Page(NamedTuple):
    records: list[Mapping[str, object]]
    more: bool


class Provider(Protocol):
    """What an API client offers. ``pages`` is None where only following the pages tells how many there are."""

    def pages(self) -> int | None: ...

    def fetch(self, number: int, conditions: list[Condition]) -> Page: ...


def _page(payload: Mapping) -> Page:
    return Page(payload.get("data") or [], bool((payload.get("links") or {}).get("next")))


class FileProvider:
    """Landed pages: one JSON file each. All are read at once, or followed like an API's where ``follow``."""

    def __init__(self, files: list[str], follow: bool = False):
        self.files, self.follow = files, follow

    def pages(self) -> int | None:
        return None if self.follow else len(self.files)

    def fetch(self, number: int, conditions: list[Condition]) -> Page:
        if number >= len(self.files):
            return Page([], False)

        def read() -> dict:
            with open(self.files[number], encoding="utf-8") as f:
                return json.load(f)

        found = _page(with_retry(read))
        return Page([r for r in found.records if all(c.holds(r) for c in conditions)], found.more)


class WebProvider:
    """Pages of a web API that numbers them from one and takes filters as column:comparison:value."""

    def __init__(self, url: str, page_rows: int = PAGE_ROWS, timeout: float = TIMEOUT_S, backoff: float = BACKOFF):
        self.url, self.page_rows, self.timeout, self.backoff = url, page_rows, timeout, backoff

    def pages(self) -> int | None:
        return None

    def fetch(self, number: int, conditions: list[Condition]) -> Page:
        asked = {"page[size]": self.page_rows, "page[number]": number + 1}
        if conditions:
            asked["filter"] = ",".join(":".join(c) for c in conditions)

        def get() -> dict:
            with urllib.request.urlopen(f"{self.url}?{urllib.parse.urlencode(asked)}", timeout=self.timeout) as answer:
                return json.load(answer)

        return _page(with_retry(get, backoff=self.backoff))


def one_shot(url: str, timeout: float = TIMEOUT_S, retries: int = RETRIES, backoff: float = BACKOFF, sleep: Callable[[float], None] = time.sleep) -> list[Mapping[str, object]]:
    """All records of an API that answers at once; whatever content type it names, the answer must be JSON, and no other is tried again and again."""

    def get() -> list[Mapping[str, object]]:
        asked = urllib.request.Request(url, headers={"Accept": "application/json"})
        with urllib.request.urlopen(asked, timeout=timeout) as answer:
            body, kind = answer.read(), answer.headers.get_content_type()
            try:
                found = json.loads(body.decode(answer.headers.get_content_charset() or "utf-8"))
            except ValueError as wrong:
                raise ValueError(f"{url} answered {kind} that is no JSON") from wrong
        return found if isinstance(found, list) else found.get("data") or []

    return with_retry(get, retries, backoff, sleep)


def landed(spark: SparkSession, records: list[Mapping[str, object]]) -> DataFrame:
    """Records of one answer as text columns, with ``ingest_seq`` in their order; columns of all records together."""
    names = list(dict.fromkeys(n for r in records for n in r))
    rows = [(*[None if r.get(n) is None else str(r[n]) for n in names], i) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, StructType([*[StructField(n, StringType()) for n in names], StructField("ingest_seq", LongType())]))


class _Start(InputPartition):
    """A page, or all pages from the first on."""

    def __init__(self, number: int, follow: bool):
        super().__init__(number)
        self.number, self.follow = number, follow


class PagedReader(DataSourceReader):
    """Every field as text, then ``ingest_seq`` in page order. Pages whose number is known are read by a partition each."""

    def __init__(self, provider: Provider, schema: StructType, conditions: list[Condition], page_rows: int):
        self.provider, self.schema, self.conditions, self.page_rows = provider, schema, list(conditions), page_rows

    def partitions(self) -> list[InputPartition]:
        known = self.provider.pages()
        return [_Start(0, True)] if known is None else [_Start(i, False) for i in range(known)]

    def read(self, partition: _Start) -> Iterator[tuple]:
        names = [f.name for f in self.schema if f.name != "ingest_seq"]
        numbered = len(names) < len(self.schema)
        number = partition.number
        while True:
            page = self.provider.fetch(number, self.conditions)
            if len(page.records) > self.page_rows:
                raise ValueError(f"page {number} holds {len(page.records)} records, more than the page size of {self.page_rows}")
            for k, r in enumerate(page.records):
                row = [None if r.get(n) is None else str(r[n]) for n in names]
                yield (*row, number * self.page_rows + k) if numbered else tuple(row)
            number += 1
            if not partition.follow or not page.more or not page.records:
                return


class FilteringReader(PagedReader):
    """Comparisons of text columns go to where the records are; Spark keeps the others."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        texts = {f.name for f in self.schema if f.name != "ingest_seq"}
        for f in filters:
            name = COMPARISONS.get(type(f))
            if name and len(f.attribute) == 1 and f.attribute[0] in texts and isinstance(f.value, str) and not set(",:") & set(f.value):
                self.conditions.append(Condition(f.attribute[0], name, f.value))
            else:
                yield f


PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class PagedRecords(DataSource):
    """spark.read.format("paged_records") with the option url, or files (a JSON list) and follow; after: auction dates later than a day.

    With pushdown set to true, comparisons in ``where`` reach the source as well; Spark allows that only under its setting PUSHDOWN.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return "cusip string, auction_date string, ingest_seq long"

    def reader(self, schema: StructType) -> DataSourceReader:
        rows = int(self.options.get("page_rows", PAGE_ROWS))
        after = self.options.get("after")
        conditions = [Condition("auction_date", "gt", after)] if after else []
        if url := self.options.get("url"):
            provider: Provider = WebProvider(url, rows, float(self.options.get("timeout", TIMEOUT_S)))
        else:
            provider = FileProvider(json.loads(self.options["files"]), self.options.get("follow", "false").lower() == "true")
        kind = FilteringReader if self.options.get("pushdown", "false").lower() == "true" else PagedReader
        return kind(provider, schema, conditions, rows)


def paged_records(spark: SparkSession, schema: str | None = None, **options: str) -> DataFrame:
    """The records of a paged source, with filters pushed to it where the session allows that."""
    spark.dataSource.register(PagedRecords)
    reader = spark.read.format("paged_records").options(**{"pushdown": spark.conf.get(PUSHDOWN, "false")} | options)
    return (reader.schema(schema) if schema else reader).load()
