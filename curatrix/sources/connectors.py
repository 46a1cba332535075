"""Paged JSON interfaces of catalogs as a Spark data source: one input partition per page.

    spark.dataSource.register(PagedJson)
    spark.read.format("paged_json").options(**search("zenodo", "working memory", pages=5)).load()

Where pages can only be found by the link in the page before (option ``next``, a path), one partition follows the links.

A page that cannot be had after its retries is one row of status ``offline`` without a payload; it never
fails the job. Payloads go on to :mod:`curatrix.sources.mappers`."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from curatrix.operators.shared import written

#: Addresses by source: page template, where the records are, the largest page. Fixed values.
INTERFACES = {
    "dandi": ("https://api.dandiarchive.org/api/dandisets/?search={query}&page={page}&page_size={size}", "results", 100),
    "neurovault": ("https://neurovault.org/api/collections/?search={query}&limit={size}&offset={offset}", "results", 100),
    "zenodo": ("https://zenodo.org/api/records?q={query}&type=dataset&page={page}&size={size}", "hits.hits", 25),
    "figshare": ("https://api.figshare.com/v2/articles?search_for={query}&item_type=3&page={page}&page_size={size}", "", 100),
    "dryad": ("https://datadryad.org/api/v2/search?q={query}&page={page}&per_page={size}", "_embedded.stash:datasets", 100),
    "osf": ("https://api.osf.io/v2/registrations/?q={query}&filter[category]=data&page={page}&page[size]={size}", "data", 25),
}

#: Sources whose queries are Lucene's.
LUCENE = ("zenodo",)


def search(source: str, query: str, pages: int = 5, size: int | None = None) -> dict[str, str]:
    """Reader options for a search in one source; signs of a query language are escaped where the source has one."""
    url, records, most = INTERFACES[source]
    query = lucene_escaped(query) if source in LUCENE else query
    return {"source": source, "url": url, "records": records, "query": query, "pages": str(pages), "size": str(min(size or most, most))}


def lucene_escaped(query: str) -> str:
    return "".join("\\" + c if c in '+-&|!(){}[]^"~*?:\\/' else c for c in query)


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "source string, page int, status string, raw string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[Page]:
        if self.options.get("next"):
            return [Page(1)]
        return [Page(n) for n in range(1, int(self.options.get("pages", 1)) + 1)]

    def _address(self, page: int) -> str:
        size = int(self.options.get("size", 25))
        query = urllib.parse.quote(self.options.get("query", ""))
        return self.options["url"].format(query=query, page=page, offset=(page - 1) * size, size=size)

    def _fetch(self, address: str):
        """The parsed answer. Waits longer after each failure that may pass; others end at once."""
        tries = int(self.options.get("retries", 3))
        for n in range(tries):
            try:
                with urllib.request.urlopen(address, timeout=float(self.options.get("timeout", 8))) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if e.code != 429 and e.code < 500 or n == tries - 1:
                    return None
            except (OSError, ValueError):
                if n == tries - 1:
                    return None
            time.sleep(float(self.options.get("wait", 0.5)) * 2**n)
        return None

    def read(self, partition: Page):
        page, source = partition.value, self.options.get("source", "")
        address = self._address(page)
        while address and page <= int(self.options.get("pages", 1)):
            answer = self._fetch(address)
            found = _at(answer, self.options.get("records", ""))
            if not isinstance(found, list):
                yield source, page, "offline", None
                return
            for record in found:
                yield source, page, "ok", json.dumps(record)
            link = self.options.get("next") and _at(answer, self.options["next"])
            address, page = urllib.parse.urljoin(address, link) if link else None, page + 1


def _at(answer, path: str):
    """What stands at a dotted path; the answer itself for none, null where a part is missing."""
    for key in filter(None, path.split(".")):
        answer = answer.get(key) if isinstance(answer, dict) else None
    return answer


def weaker(terms: str, *parts: list[str]) -> list[str]:
    """Search texts from the strongest to none: all terms, then each of ``parts`` (such as modalities, regions) alone, then everything.

    For interfaces that look for all words at once, where a full query often finds nothing."""
    asked = [terms, *[" ".join(p for p in part if p) for part in parts]]
    return [*dict.fromkeys(a for a in asked if a.strip()), ""]


def ladder(spark: SparkSession, requests: list[dict[str, str]], keep: Column | None = None) -> DataFrame:
    """Rows of the first of ``requests`` (reader options, the strongest first) that finds any record to ``keep``, with its number
    in ``rung``; rows of pages that could not be had, of all requests tried, stay.

    ``keep`` reads ``payload``, the record as VARIANT, so what a weaker request no longer asks for still holds. Each request is
    made once; null counts as not kept."""
    tried: DataFrame | None = None
    for n, options in enumerate(requests):
        rows = spark.read.format("paged_json").options(**options).load()
        rows = written(rows, "requests").select("*", F.lit(n).alias("rung"), F.try_parse_json("raw").alias("payload"))
        wanted = rows.where((F.col("status") == "ok") & (F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))))
        offline = rows.where("status <> 'ok'")
        tried = offline if tried is None else tried.unionByName(offline)
        if not wanted.isEmpty():
            return tried.unionByName(wanted)
    if tried is None:
        raise ValueError("no requests")
    return tried


def query_terms(structured: list[Column], keywords: Column, limit: int = 500) -> Column:
    """Search text: structured values first, then keywords that repeat none of them and hold no letter three
    times in a row (a sign of a typing error); blanks are left out, repeats too."""
    own = F.array_compact(F.flatten(F.array(*structured)))
    own = F.filter(own, lambda t: F.trim(t) != "")
    lower = F.transform(own, lambda t: F.lower(F.trim(t)))
    words = F.filter(F.transform(F.array_compact(F.coalesce(keywords, F.array().cast("array<string>"))), lambda k: F.trim(k)), lambda k: (k != "") & ~F.array_contains(lower, F.lower(k)) & ~F.lower(k).rlike(r"(.)\1{2,}"))
    return F.substring(F.array_join(F.array_distinct(F.concat(own, words)), " "), 1, limit)
