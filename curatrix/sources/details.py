"""From a list to its details: a remote record of each key, asked for once and joined back."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.operators.graph import labelled
from curatrix.operators.shared import written

#: Addresses of one record by source; ``{key}`` is the id. Fixed values.
DETAILS = {
    "dandi": "https://api.dandiarchive.org/api/dandisets/{key}/versions/draft/",
    "zenodo": "https://zenodo.org/api/records/{key}",
    "figshare": "https://api.figshare.com/v2/articles/{key}",
    "osf": "https://api.osf.io/v2/registrations/{key}/",
}


def look_up(keys: DataFrame, key: str, address: str, together: int = 4, tries: int = 4, wait: float = 1.0, longest: float = 10.0, timeout: float = 90.0) -> DataFrame:
    """(key, status, detail, tries) of each different key that is not null: ok with the record as JSON, or missing (an answer that
    no repetition changes), or failed (all tries), both with what was said.

    ``together`` tasks ask at a time at most, one key after another, and wait longer after each failure that may pass. The
    result is written once, so no key is asked for again by what follows."""

    def ask(k: str) -> tuple[str, str, int]:
        said = ""
        for n in range(1, tries + 1):
            try:
                with urllib.request.urlopen(address.format(key=urllib.parse.quote(k, safe="")), timeout=timeout) as answer:
                    return "ok", json.dumps(json.load(answer)), n
            except urllib.error.HTTPError as e:
                said = f"HTTP {e.code}"
                if e.code != 429 and e.code < 500:
                    return "missing", said, n
            except (OSError, ValueError) as e:
                said = f"{type(e).__name__}: {e}"
            if n < tries:
                time.sleep(min(longest, wait * 2 ** (n - 1)))
        return "failed", said, tries

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["key"]:  # a row as soon as it is there
                yield pd.DataFrame([(k, *ask(k))], columns=["key", "status", "detail", "tries"])

    asked = keys.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key")).distinct().repartition(together)
    return written(asked.mapInPandas(run, "key string, status string, detail string, tries int"), "details")


def detailed(rows: DataFrame, key: str, by: str, **look) -> DataFrame:
    """``rows`` with ``status``, ``detail`` and ``tries`` of their ``key``; rows without one have the status ``no key``.

    ``by`` (such as an id) deals rows of one key to several tasks. Every row stays, once."""
    found = look_up(rows, key, **look)
    none = F.lit(None)
    lacking = rows.where(F.col(key).isNull()).select("*", F.lit("no key").alias("status"), none.cast("string").alias("detail"), F.lit(0).alias("tries"))
    text = rows.where(F.col(key).isNotNull()).withColumn("_key", F.col(key).cast("string"))
    return labelled(text, found.withColumnRenamed("key", "_key"), "_key", by).drop("_key").select(*rows.columns, "status", "detail", "tries").unionByName(lacking)
