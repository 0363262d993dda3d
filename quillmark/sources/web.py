"""Pages and files by HTTP, fetched by the tasks."""

from __future__ import annotations

import os
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

FETCHED = "url string, status int, body binary, error string"


def get(url: str, retries: int = 3, pause: float = 1.0, timeout: float = 30.0) -> tuple[int, bytes | None, str | None]:
    """(status, body, error); tried ``retries`` times, the pause doubles; answers below 500 are final."""
    status, error = 0, "not tried"
    for attempt in range(max(1, retries)):
        if attempt:
            time.sleep(pause * 2 ** (attempt - 1))
        try:
            with urllib.request.urlopen(url, timeout=timeout) as reply:  # noqa: S310
                return reply.status, reply.read(), None
        except urllib.error.HTTPError as e:
            status, error = e.code, str(e)
            if e.code < 500:
                break
        except (OSError, ValueError) as e:
            status, error = 0, str(e)
    return status, None, error


def fetch(urls: DataFrame, column: str = "url", retries: int = 3, pause: float = 1.0) -> DataFrame:
    """(url, status, body, error) of every address, a failed one without a body."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(u, *get(u, retries, pause)) for u in batch["url"]], columns=["url", "status", "body", "error"])

    return urls.selectExpr(f"`{column}` AS url").mapInPandas(run, FETCHED)


def download(urls: DataFrame, folder: str, retries: int = 3, pause: float = 1.0) -> DataFrame:
    """Writes each (url, name) to a file of ``folder``, which all executors share: (url, name, status, size, error).

    A file appears under its name only when it is whole; one that is there stays.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, name in zip(batch["url"], batch["name"]):
                target = os.path.join(folder, name)
                if os.path.exists(target):
                    rows.append((url, name, "kept", os.path.getsize(target), None))
                    continue
                status, body, error = get(url, retries, pause)
                if body is None:
                    rows.append((url, name, "failed", 0, error or str(status)))
                    continue
                part = f"{target}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(body)
                os.replace(part, target)
                rows.append((url, name, "written", len(body), None))
            yield pd.DataFrame(rows, columns=["url", "name", "status", "size", "error"])

    return urls.select("url", "name").mapInPandas(run, "url string, name string, status string, size long, error string")
