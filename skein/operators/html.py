"""Page operators: native extractions, and the exact page scanner as an Arrow map.

The scanner follows the page rules to the letter (breaks at known tags and entities, glue at
dropped characters, discarded sections, link records, the two cut-offs); the native columns
are the plain forms of its parts.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..data import words as listed
from ..functions import text as T

#: Consecutive non-alphanumeric characters, and unknown words in a row, at which a page is cut.
JUNK_RUN, UNKNOWN_RUN = 100, 20


def strip_comments(h: Column) -> Column:
    return F.regexp_replace(h, "(?s)<!--.*?-->", "")


def strip_sections(h: Column) -> Column:
    for tag in ("script", "style", "svg"):
        h = F.regexp_replace(h, rf"(?is)<{tag}\b.*?</{tag}[^>]*>", "")
    return h


def strip_tags(h: Column) -> Column:
    return F.regexp_replace(h, "<[^>]*>", " ")


def plain_text(h: Column) -> Column:
    return T.entities_to_space(T.fold_apostrophes(strip_tags(strip_sections(strip_comments(h)))))


def title(h: Column) -> Column:
    return F.regexp_extract(h, "(?is)<title[^>]*>(.*?)</title>", 1)


def resolve(url: Column, href: Column) -> Column:
    return F.when(href.startswith("/"), F.concat(F.regexp_extract(url, "^[^:]+://[^/]*", 0), href)).otherwise(href)


def links(pages: DataFrame) -> DataFrame:
    """(page_id, src_url, href, url): one row a link, in any order."""
    found = pages.select("page_id", F.col("url").alias("src_url"), F.explode(F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*?href="([^"]+)"'), F.lit(1))).alias("href"))
    return found.withColumn("url", resolve(F.col("src_url"), F.col("href")))


def anchor_words(pages: DataFrame) -> DataFrame:
    """(page_id, href, word): words of each link's text, markup inside it aside."""
    pair = F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*?href="[^"]+"[^>]*>.*?</a>'), F.lit(0))
    one = pages.select("page_id", F.explode(pair).alias("a"))
    text = strip_tags(F.col("a"))
    return one.select("page_id", F.regexp_extract("a", r'(?is)href="([^"]+)"', 1).alias("href"), F.explode(T.words_of(text)).alias("word"))


def embeds(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?is)<embed[^>]*?src="([^"]+)"'), F.lit(1))).alias("src"))


@dataclasses.dataclass
class Scanned:
    words: list[str]
    title: str
    title_words: int
    body_words: int | None
    links: list[tuple[str, list[str]]]


_BREAK = frozenset(b' \t\n\r\x0b\x0c,.:;!?()"[]{}-+')
_WHITE = frozenset(b" \t\n\r\x0b\x0c")
_ALNUM = re.compile(rb"[A-Za-z0-9]+")
_HREF = re.compile(rb'\shref="([^"]*)', re.I)
_SRC = re.compile(rb'src="([^"]*)', re.I)
_SECTIONS = frozenset((b"script", b"style", b"svg"))


class _Pieces:
    """Words written with or without an end; what has no end glues to the next."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []

    def put(self, w: bytes, end: bool = True) -> None:
        self.parts.append(w + b"\n" if end else w)

    def words(self) -> list[str]:
        return [x.decode("ascii", "ignore") for x in b"".join(self.parts).lower().split(b"\n") if x]


def scan(page: bytes, url: str = "", cut_unknown: bool = True, glue_trailing: bool = True) -> Scanned:
    """One pass over a page's bytes. Text behind the last > isn't read, if there is one."""
    known, tags = frozenset(w.encode() for w in listed("english_words")), frozenset(w.encode() for w in listed("html_tags"))
    last = page.rfind(b">")
    page = page[: last + 1] if last >= 0 else page + b" "
    out, link_words = _Pieces(), _Pieces()
    links: list[tuple[str, _Pieces]] = []
    title: list[bytes] = []
    n = len(page)
    p = begin = count = unknown = junk = title_words = 0
    in_link = in_title = titled = False
    root = re.match(r"[^:]*:?(?://)?[^/]*", url)[0]

    def result(whole: bool) -> Scanned:
        return Scanned(out.words(), b"".join(b" " + t for t in title).decode("utf-8", "replace"), title_words, count if whole else None, [(u, w.words()) for u, w in links])

    def word(end: int, delimited: bool = True) -> bool:
        """Write page[begin:end]; false if it completes a run of unknown words."""
        nonlocal count, unknown
        w = page[begin:end]
        out.put(w, delimited)
        if in_link:
            link_words.put(w, delimited)
        if in_title and not titled:
            title.append(w)
        count += 1
        if cut_unknown and len(w) > 2:
            unknown = 0 if len(w) <= 30 and w.lower() in known else unknown + 1
            return unknown < UNKNOWN_RUN
        return True

    while p < n:
        m = _ALNUM.match(page, p)
        if m:
            junk, p = 0, m.end()
            continue
        c = page[p]
        if c in _BREAK:
            if p > begin:
                inside = c in b",." and p + 1 < n and page[p - 1 : p].isdigit() and page[p + 1 : p + 2].isdigit()
                if not word(p, not inside):
                    return result(False)
            p += 1
            begin = p
        elif c == 0x3C:
            p += 1
            closing = page[p : p + 1] == b"/"
            p += closing
            start = p
            while p < n and page[p] not in _WHITE and page[p] not in b"/>":
                p += 1
            if page[start : start + 3] == b"!--":
                p = start + 3
            name = page[start:p].lower()
            if name not in tags:
                if p < n and page[p] not in _BREAK:
                    p += 1
                continue
            end = start - 1 - closing
            if end > begin and not word(end):
                return result(False)
            close = page.find(b">", p)
            close = n if close < 0 else close
            if name == b"title":
                in_title = not closing
                if closing and not titled:
                    title_words, titled = count, True
            elif name == b"!--":
                stop = page.find(b"-->", p)
                if stop < 0:
                    return result(False)
                p = begin = stop + 3
                continue
            elif name in _SECTIONS and not closing:
                at = p
                while True:
                    at = page.find(b"</", at)
                    if at < 0:
                        return result(False)
                    at += 2
                    if page[at : at + len(name)].lower() == name:
                        break
                close = page.find(b">", at)
                close = n if close < 0 else close
            elif name == b"a":
                if closing:
                    in_link = False
                else:
                    for h in _HREF.finditer(page, p - 1, close):
                        target = h[1].decode("utf-8", "replace")
                        if target:
                            link_words = _Pieces()
                            links.append((root + target if target.startswith("/") else target, link_words))
                            in_link = True
            elif name == b"embed":
                links.extend((h[1].decode("utf-8", "replace"), _Pieces()) for h in _SRC.finditer(page, p, close))
            p = begin = close + 1
        elif c == 0x26:
            end = p + 1
            while end < n and page[end] not in b";<" and page[end] not in _WHITE:
                end += 1
            if p > begin:
                if page[p + 1 : end] in (b"rsquo", b"apos"):
                    out.put(page[begin:p], False)
                    if in_link:
                        link_words.put(page[begin:p], False)
                elif not word(p):
                    return result(False)
            p = begin = end + 1 if page[end : end + 1] == b";" else end
        elif c == 0x27 or page[p : p + 3] == b"\xe2\x80\x99":
            if p > begin:
                out.put(page[begin:p], False)
                if in_link:
                    link_words.put(page[begin:p], False)
            p = begin = p + (1 if c == 0x27 else 3)
        elif page[p : p + 2] == b"\xc2\xa0":
            if p > begin and not word(p):
                return result(False)
            p = begin = p + 2
        else:
            junk += 1
            if junk >= JUNK_RUN:
                return result(False)
            if p > begin:
                glues = glue_trailing or (p + 1 < n and page[p + 1] not in _BREAK)
                out.put(page[begin:p], not glues)
            p += 1
            begin = p
    return result(True)


def scan_pages(pages: DataFrame, cut_unknown: bool = True) -> DataFrame:
    """(page_id, url, words, title, title_words, body_words, link_urls, link_words) of each page. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column("url").to_pylist()
            rows = [scan((h or "").encode(), u or "", cut_unknown) for h, u in zip(batch.column("html").to_pylist(), urls)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"), batch.column("url"), pa.array([r.words for r in rows], pa.list_(pa.string())), pa.array([r.title for r in rows], pa.string()),
                    pa.array([r.title_words for r in rows], pa.int32()), pa.array([r.body_words for r in rows], pa.int32()),
                    pa.array([[u for u, _ in r.links] for r in rows], pa.list_(pa.string())), pa.array([[" ".join(w) for _, w in r.links] for r in rows], pa.list_(pa.string())),
                ],
                ["page_id", "url", "words", "title", "title_words", "body_words", "link_urls", "link_words"],
            )

    schema = "page_id long, url string, words array<string>, title string, title_words int, body_words int, link_urls array<string>, link_words array<string>"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
