"""Searches typed at a prompt: python -m skein.repl FOLDER [QUERY ...]. An empty line ends it; "+" shows the next page."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession

from .queries import search


def answers(lines: Iterable[str], find: Callable[[str, int], list]) -> Iterator[str]:
    """Output lines for input lines. find: results (url, title, score) of a query's page."""
    query, page = "", 1
    for line in lines:
        line = line.strip()
        if not line:
            return
        query, page = (query, page + 1) if line == "+" else (line, 1)
        rows = find(query, page) if query else []
        yield from (f"{10 * (page - 1) + i:3}. {r.score:.4f}  {r.title or '(no title)'}  {r.url}" for i, r in enumerate(rows, 1))
        yield f"{len(rows)} results on page {page}"


def main(args: list[str]) -> None:
    if not args:
        sys.exit(__doc__)
    spark = SparkSession.builder.getOrCreate()
    for line in answers([" ".join(args[1:])] if args[1:] else sys.stdin, lambda q, n: search(spark, args[0], q, n).collect()):
        print(line, flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
