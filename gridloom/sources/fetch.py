"""Fetching tiles by a function that the caller gives; the engine itself opens no connection."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import text
from gridloom.runtime import ship_package

#: Messages after which a fetch is tried again; see text.retryable for the classes.
AGAIN = re.compile(r"HTTP (?:429|5[0-9][0-9])(?:\s|$)|timed out|onnect|dns|resolve")


def fetched(urls: DataFrame, fetch: Callable[[str], bytes], attempts: int = 4, pause_s: float = 0.25, deadline_s: float = 60.0) -> DataFrame:
    """urls (url and more) with `body`, or with `kind`, the class of the last failure, and how many `tries` it took.

    fetch gives the bytes of a URL or raises; a message that speaks of a busy or unreachable
    service is tried again after a pause that doubles, as long as the deadline of the tile
    allows. An empty body is a failure. One row's failure is no other row's.
    """
    names = [c for c in urls.columns if c != "url"]

    def one(url: str):
        end, wait = time.monotonic() + deadline_s, pause_s
        for tries in range(1, attempts + 1):
            try:
                body = fetch(url)
                if body:
                    return bytes(body), None, tries
                said = "invalid: no bytes"
            except Exception as e:  # noqa: BLE001  a failure is a row
                said = str(e) or type(e).__name__
            if tries == attempts or not AGAIN.search(said) or time.monotonic() + wait >= end:
                return None, said, tries
            time.sleep(wait)
            wait *= 2

    def run(batches):
        for pdf in batches:
            got = [one(u) for u in pdf["url"]]
            yield pd.concat([pdf[["url", *names]].reset_index(drop=True), pd.DataFrame(got, columns=["body", "said", "tries"], dtype=object)], axis=1)

    ship_package(urls.sparkSession)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for n in ("url", *names) for f in urls.schema if f.name == n)
    got = urls.select("url", *names).mapInPandas(run, f"{kind}, body binary, said string, tries long")
    return got.withColumn("kind", F.when(F.col("said").isNotNull(), text.failure_class(F.col("said")))).drop("said")
