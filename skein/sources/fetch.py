"""Pages from the web: a fetch in Arrow batches, one connection a row, with the limits of a polite crawler."""

from __future__ import annotations

import http.client
import socket
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds to wait, redirects to follow, bytes of a page that are kept.
TIMEOUT, MAX_REDIRECTS, MAX_BYTES = 5.0, 5, 51_200
FAILED, REFUSED, TOO_MANY = -1, -3, -4
AGENT = "skein/1.0"


class _Redirects(urllib.request.HTTPRedirectHandler):
    max_redirections = MAX_REDIRECTS


def fetch_one(url: str | None, timeout: float = TIMEOUT, max_bytes: int = MAX_BYTES, schemes: tuple[str, ...] = ("https", "http")) -> tuple[int, bytes, str]:
    """(status, body, final URL). status: length of the body, or FAILED, REFUSED (4xx, 5xx), TOO_MANY (429)."""
    if not url or urllib.parse.urlsplit(url).scheme not in schemes:
        return FAILED, b"", url or ""
    try:
        request = urllib.request.Request(url, headers={"User-Agent": AGENT, "Accept-Encoding": "identity"})
        with urllib.request.build_opener(_Redirects).open(request, timeout=timeout) as answer:
            body = answer.read(max_bytes)
            return len(body), body, answer.geturl()
    except urllib.error.HTTPError as error:
        code = FAILED if error.code < 400 else TOO_MANY if error.code == 429 else REFUSED
        return code, b"", url
    except (OSError, ValueError, http.client.HTTPException, socket.timeout):
        return FAILED, b"", url


def fetch(urls: DataFrame, url_col: str = "url", timeout: float = TIMEOUT, max_bytes: int = MAX_BYTES, schemes: tuple[str, ...] = ("https",)) -> DataFrame:
    """(url, status, final_url, html) of each row of urls; html is null unless the page came. Other schemes fail.

    A task fetches one page at a time: politeness comes from how rows are partitioned (by domain) and
    scheduled before this. A lost task fetches its rows again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column("url").to_pylist():
                status, body, final = fetch_one(url, timeout, max_bytes, schemes)
                html = body.decode("utf-8", "replace") if status >= 0 else None
                yield pa.RecordBatch.from_arrays([pa.array([url], pa.string()), pa.array([status], pa.int32()), pa.array([final], pa.string()), pa.array([html], pa.string())], ["url", "status", "final_url", "html"])

    return urls.select(F.col(url_col).alias("url")).mapInArrow(run, "url string, status int, final_url string, html string")
