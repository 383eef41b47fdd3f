"""Main-text extraction from HTML in two passes over its blocks.

Pass one looks at each block alone: link density, length and stop-word density make it good,
near good, bad or short. Pass two settles the ambiguous ones: short blocks take the label of
their nearest decided neighbours, near good ones follow unless both neighbours are bad.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a block's characters in links above which it is bad.
MAX_LINK_DENSITY = 0.2
#: Characters below which a block is short, above which a dense one is good outright.
LENGTH_LOW, LENGTH_HIGH = 70, 200
#: Shares of stop words: from LOW near good, from HIGH good.
STOPWORDS_LOW, STOPWORDS_HIGH = 0.20, 0.25

STOPWORDS = {
    "en": "the of and to in a is that it for was on are as with his they at be this have from or one had by but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into has look two more go see no way could my than been who its now did get may over also after such our only most any where just because between through during before under again very".split(),
    "fr": "le la les de des du un une et est en que qui dans pour par sur pas ne ce il elle au aux se son sa ses avec plus ou mais nous vous ils elles leur leurs cette ces être avoir fait comme tout si sont été même où dont".split(),
    "de": "der die das und ist in den von zu mit sich des auf für nicht im eine ein als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei".split(),
    "es": "el la los las de del que y en un una ser se no haber por con su para como estar tener le lo todo pero más hacer o poder este ir ese si me ya ver porque dar cuando muy sin vez mucho saber qué sobre mi alguno mismo también hasta año dos querer entre es al son fue ha sus".split(),
}
_STOP = {k: frozenset(v) for k, v in STOPWORDS.items()}
# Every pattern either matches or gives up at the next mark, so a page is read in time that follows its length.
_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|svg|template|title)\b.*?(?:</\1(?=[\s>/])[^<>]*>?|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>", re.S | re.I)
#: A tag ends at the first > outside quotes; a quote that isn't closed is a character like any other.
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)(?=[\s/>"'])(?>[^<>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|"[^"<>]*"|'[^'<>]*'|["'=])*+>|<(/?)([a-zA-Z][a-zA-Z0-9]*)>""")
_BLOCK = frozenset("address article aside blockquote body br button caption center dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section select table tbody td tfoot th thead title tr ul".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_WORD = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s+")


def blocks(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters in links, heading) of each block with text, in page order."""
    page = _SKIP.sub(" ", page)
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = links = 0
    heading = False

    def close() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append((text, min(linked, len(text)), heading))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(_SPACE.sub(" ", text).strip())

    at = 0
    for m in _TAG.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        ends, name = m[1], m[2].lower()
        if name == "a":
            links = max(0, links - 1) if ends else links + 1
        elif name in _BLOCK:
            close()
            if name in _HEADING:
                heading = not ends
    rest = page[at:]
    cut = rest.find("<")
    # a tag that the page breaks off in isn't text
    add(rest if cut < 0 or not rest[cut + 1 : cut + 2].isalpha() else rest[:cut])
    close()
    return out


def stop_density(text: str) -> float:
    """Share of stop words of the language that has most of them in the text."""
    words = _WORD.findall(text.lower())
    return max(sum(w in s for w in words) for s in _STOP.values()) / len(words) if words else 0.0


def first_pass(text: str, linked: int) -> str:
    if linked / len(text) > MAX_LINK_DENSITY or "©" in text:
        return "bad"
    if len(text) < LENGTH_LOW:
        return "bad" if linked else "short"
    density = stop_density(text)
    if density >= STOPWORDS_HIGH:
        return "good" if len(text) > LENGTH_HIGH else "neargood"
    return "neargood" if density >= STOPWORDS_LOW else "bad"


def second_pass(labels: list[str]) -> list[str]:
    """Labels with short and near good ones settled. Beyond the page's ends everything is bad."""
    n = len(labels)

    def nearest(kinds: list[str], wanted: frozenset[str]) -> tuple[list[str], list[str]]:
        before, after, last = [], [""] * n, "bad"
        for k in kinds:
            before.append(last)
            last = k if k in wanted else last
        last = "bad"
        for i in range(n - 1, -1, -1):
            after[i] = last
            last = kinds[i] if kinds[i] in wanted else last
        return before, after

    decided, hinted = frozenset(("good", "bad")), frozenset(("good", "bad", "neargood"))
    before, after = nearest(labels, decided)
    before_near, after_near = nearest(labels, hinted)
    settled = list(labels)
    for i, k in enumerate(labels):
        if k == "short":
            if before[i] == after[i]:
                settled[i] = before[i]
            else:
                near = (before[i] == "bad" and before_near[i] == "neargood") or (after[i] == "bad" and after_near[i] == "neargood")
                settled[i] = "good" if near else "bad"
    before, after = nearest(settled, decided)
    return ["bad" if k == "neargood" and before[i] == after[i] == "bad" else "good" if k == "neargood" else k for i, k in enumerate(settled)]


def extract(page: str | None) -> tuple[str, int, int]:
    """(good blocks, one a line; number of blocks; number of good ones)."""
    found = blocks(page or "")
    labels = [first_pass(t, linked) for t, linked, _ in found]
    # a short heading over good text goes with it
    last = second_pass(labels)
    for i, (_, _, heading) in enumerate(found):
        if heading and labels[i] == "short" and last[i] == "bad" and "good" in last[i + 1 : i + 2]:
            last[i] = "good"
    good = [t for (t, _, _), k in zip(found, last) if k == "good"]
    return "\n".join(good), len(found), len(good)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, html): page_id, text, n_blocks, n_good.

    Null and empty pages have no blocks and empty text. Whole pages are read, broken markup too, in time
    that follows their length: an unclosed comment, script or title reaches to the end, a head need not be
    closed, a tag ends at the first > outside quoted values, a tag that the page breaks off in isn't text.
    Ids are whole numbers (others make the cast fail). An empty table gives no rows.
    Repeated rows are extracted alike; other columns are ignored. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [extract(x) for x in batch.column("html").to_pylist()]
            text, total, good = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(text, pa.string()), pa.array(total, pa.int32()), pa.array(good, pa.int32())], ["page_id", "text", "n_blocks", "n_good"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, text string, n_blocks int, n_good int")
