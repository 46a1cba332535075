"""Catalogs behind GraphQL connections whose cursors are offsets, as a batch or a stream that resumes where it stopped.

    spark.dataSource.register(CursorJson)
    spark.readStream.format("cursor_json").options(url=..., query=..., connection="datasets").load()

A cursor is the base64 form of ``{"offset": n}``, so the cursor of each page is known without the page before it: every page is
a partition that an executor asks for, with its own retries. A page that cannot be had is one row of status
``offline``; the others go on. In a stream the offset is the checkpointed state: a query that is killed and started again asks for no
page twice that was committed."""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Failures in a row after which a source is given up.
FAILURES = 3


def cursor_at(offset: int) -> str | None:
    """The cursor after ``offset`` records; none before the first."""
    return base64.b64encode(json.dumps({"offset": offset}).encode()).decode() if offset else None


class CursorPage(InputPartition):
    def __init__(self, offset: int):
        super().__init__(offset)


class Client:
    """Requests for pages: options url, query, connection (name of the connection in ``data``), size, retries, wait, timeout."""

    def __init__(self, options):
        self.options = {k.lower(): v for k, v in options.items()}
        self.size = int(self.options.get("size", 25))

    def page(self, offset: int, first: int) -> tuple[dict, list]:
        """(connection, errors) of one page; raises when all tries fail. Waits twice as long after each."""
        body = json.dumps({"query": self.options.get("query", ""), "variables": {"first": first} | ({"after": cursor_at(offset)} if offset else {})}).encode()
        tries, wait = int(self.options.get("retries", 4)), float(self.options.get("wait", 1))
        for n in range(tries):
            try:
                ask = urllib.request.Request(self.options["url"], body, {"Content-Type": "application/json"})
                with urllib.request.urlopen(ask, timeout=float(self.options.get("timeout", 90))) as answer:
                    told = json.load(answer)
                return (told.get("data") or {}).get(self.options.get("connection", "datasets")) or {}, told.get("errors") or []
            except (OSError, ValueError) as e:
                if n == tries - 1 or isinstance(e, urllib.error.HTTPError) and e.code != 429 and e.code < 500:
                    raise
            time.sleep(wait * 2**n)
        raise ValueError("no tries")

    def rows(self, offset: int) -> Iterator[tuple]:
        """(source, offset, status, raw) of the nodes of a page: ok, broken (no node, or one without an id), error (of a node), or one offline."""
        source = self.options.get("source", "")
        try:
            connection, errors = self.page(offset, self.size)
        except (OSError, ValueError) as e:
            yield source, offset, "offline", json.dumps(f"{type(e).__name__}: {e}")
            return
        for e in errors:
            yield source, offset, "error", json.dumps(e)
        for edge in connection.get("edges") or []:
            node = edge.get("node") if isinstance(edge, dict) else None
            yield source, offset, "ok" if isinstance(node, dict) and node.get("id") else "broken", json.dumps(node)

    def more(self, offset: int) -> bool:
        """Whether there are records beyond ``offset``; a page that fails is taken for one that has some, FAILURES in a row are an error."""
        for n in range(FAILURES):
            try:
                return bool(self.page(offset + n * self.size, 1)[0].get("edges"))
            except (OSError, ValueError) as e:
                last = e
        raise RuntimeError(f"{FAILURES} pages in a row failed, from record {offset}: {last}")


class CursorJson(DataSource):
    """Options beside those of :class:`Client`: start (records to leave out), pages (in a batch: in all; in a stream: of a micro-batch)."""

    @classmethod
    def name(cls) -> str:
        return "cursor_json"

    def schema(self) -> str:
        return "source string, offset long, status string, raw string"

    def reader(self, schema) -> DataSourceReader:
        return CursorReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CursorStreamReader(self.options)


class CursorReader(DataSourceReader):
    def __init__(self, options):
        self.client = Client(options)
        self.start, self.pages = int(self.client.options.get("start", 0)), int(self.client.options.get("pages", 8))

    def partitions(self) -> list[CursorPage]:
        return [CursorPage(self.start + n * self.client.size) for n in range(self.pages)]

    def read(self, partition: CursorPage) -> Iterator[tuple]:
        return self.client.rows(partition.value)


class CursorStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.client = Client(options)
        self.start, self.pages = int(self.client.options.get("start", 0)), int(self.client.options.get("pages", 8))
        self.reached: int | None = None

    def initialOffset(self) -> dict:
        return {"offset": self.start}

    def latestOffset(self) -> dict:
        """The records known to be there, at most ``pages`` pages further each time; only one small page is asked for here."""
        at = self.start if self.reached is None else self.reached
        for _ in range(self.pages):
            if not self.client.more(at):
                break
            at += self.client.size
        self.reached = at
        return {"offset": at}

    def partitions(self, start: dict, end: dict) -> list[CursorPage]:
        self.reached = max(self.reached or 0, end["offset"])
        return [CursorPage(at) for at in range(start["offset"], end["offset"], self.client.size)]

    def read(self, partition: CursorPage) -> Iterator[tuple]:
        return self.client.rows(partition.value)

    def commit(self, end: dict) -> None:
        pass


def report(rows: DataFrame) -> DataFrame:
    """One row: pages asked for, pages skipped, nodes retrieved, broken ones, errors of nodes."""
    counts = {"retrieved": "ok", "broken": "broken", "errors": "error"}
    return rows.agg(
        F.count_distinct("offset").alias("pages"), F.count_if(F.col("status") == "offline").alias("skipped_pages"), *[F.count_if(F.col("status") == s).alias(n) for n, s in counts.items()]
    )
