"""Main text of web pages: standard-library parser events, text-to-tag ratios, Gaussian smoothing.

The parser streams over a page once and cuts it into lines, one for each block,
and notes the element that holds each. Lines inside menus, headers, footers,
sidebars, notices, adverts, forms and comment sections are no candidates. Every
line has a text-to-tag ratio (characters of text for each tag in it); being
inside an article or main element raises it. The ratios are smoothed with a
Gaussian and split in two clusters, and the smoothed ratios of the upper one are
the weight of the elements around its lines. From the whole page down, the
content region is the part that holds most of the weight, as long as more than
headings is left behind; all candidates of the region are the text, so that
its short paragraphs stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineaframe.storage import ship

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody tfoot thead title tr ul".split()
)
#: Elements whose text is never part of an article.
_DROPPED = frozenset(
    "head title script style noscript template iframe object svg canvas nav menu header footer aside form button "
    "select option textarea input label dialog".split()
)
#: Elements that hold several blocks: the regions among which the content is looked for.
_CONTAINERS = frozenset("html body main article section div center table td th".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: How much more a line counts inside an article or main element.
ARTICLE, MAIN = 4.0, 2.0
#: Share of the dense text of an element that one part of it must hold to be the content alone.
DOMINANT = 0.7
#: Words in class, id or role of an element that is not part of an article; inside one, a header may hold its title.
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?=$|[\s_-])", re.I)
_BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads\w*|adv|advert\w*|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notice\w*|alert|"
    r"comment\w*|disqus\w*|respond|replies|sidebar\w*|side|complementary|widget\w*|menu\w*|nav|navbar|navigation|breadcrumb\w*|footer|"
    r"contentinfo|search|share\w*|sharing|social\w*|related\w*|newsletter\w*|subscribe|signup|popup\w*|modal\w*|"
    r"pagination|toolbar)(?=$|[\s_-])",
    re.I,
)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


def _unwanted(named: str, inside: bool) -> bool:
    words = _HUMP.sub("-", named)
    return bool(_BOILERPLATE.search(words) or not inside and _HEADER.search(words))


class _Lines(HTMLParser):
    """Cuts a page into lines and containers.

    ``lines`` are ``(text, tags, dropped, container, is a heading)``; ``parents``
    and ``names`` are those of each container, container 0 being the page. Open
    elements are found by name and kind, never by a search, so that damaged
    pages take linear time.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, int, bool]] = []
        self.open: list[tuple[str, bool, int, bool]] = []  # name, dropped, container, inside content
        self.blocks: list[int] = []  # places of block elements in ``open``
        self.named: dict[str, list[int]] = {}  # places of the elements of each name
        self.parents, self.names = [-1], [""]
        self.text: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            name, dropped, container, _ = self._around()
            self.lines.append((text, self.tags, dropped, container, bool(self.blocks) and self.open[self.blocks[-1]][0] in _HEADINGS))
            self.tags = 0
        self.text = []

    def _around(self) -> tuple[str, bool, int, bool]:
        return self.open[-1] if self.open else ("", False, 0, False)

    def _close(self, place: int) -> None:
        """End the open element at ``place`` and all inside it."""
        while len(self.open) > place:
            name = self.open.pop()[0]
            self.named[name].pop()
        while self.blocks and self.blocks[-1] >= place:
            self.blocks.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in _BLOCK
        if block:
            self.flush()
            if tag in ("p", "li") and self.blocks and self.open[self.blocks[-1]][0] == tag:
                self._close(self.blocks[-1])  # a paragraph or list item ends an open one of its own level
        elif tag == "br" or tag in ("td", "th"):
            self.text.append(" ")
        self.tags += 1
        if tag in _VOID:
            return
        _, dropped, container, inside = self._around()
        words = " ".join(v for k, v in attrs if v and k in ("class", "id", "role")) if attrs else ""
        kind = "article" if tag == "article" else "main" if tag == "main" or "main" in words.split() else tag
        if not dropped:
            # the words of an outermost article or main element say what kind of article it is
            outermost = kind == "article" and not self._inside("article") or kind == "main" and not inside
            dropped = tag in _DROPPED or not outermost and tag not in ("html", "body") and bool(words) and _unwanted(words, inside)
            if dropped and not block:
                self.flush()
        if not dropped and (tag in _CONTAINERS or kind == "main"):
            self.parents.append(container)
            self.names.append(kind)
            container = len(self.names) - 1
            inside = inside or kind in ("article", "main")
        if block:
            self.blocks.append(len(self.open))
        self.named.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, dropped, container, inside))

    def _inside(self, name: str) -> bool:
        return bool(self.named.get(name))

    def handle_endtag(self, tag: str) -> None:
        block = tag in _BLOCK
        if block:
            self.flush()
        self.tags += 1
        places = self.named.get(tag)
        if not places or not block and self.blocks and self.blocks[-1] > places[-1]:
            return  # nothing to end; an inline end tag does not close a block
        place = places[-1]
        if not block and self.open[place][1] and not (place and self.open[place - 1][1]):
            self.flush()
        self._close(place)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if not self.open or not self.open[-1][1] or self.open[-1][0] not in ("script", "style"):
            self.text.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """An odd ``<![...`` is skipped like a comment."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def error(self, message: str) -> None:  # pragma: no cover - required by the base class
        raise AssertionError(message)


def smooth(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing; weights beyond the ends are left out and the rest rescaled."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        part = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(w * v for w, v in zip(part, values[lo:hi], strict=True)) / sum(part))
    return out


def threshold(values: list[float]) -> float:
    """Border between two clusters of numbers: repeated means, from the overall mean."""
    t = sum(values) / len(values)
    for _ in range(50):
        low = [v for v in values if v < t]
        high = [v for v in values if v >= t]
        if not low or not high:
            return t
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - t) < 1e-9:
            return t
        t = new
    return t


def _upward(parents: list[int], values: list[float]) -> list[float]:
    """Sums of ``values`` over each container and all inside it; parents come before children."""
    out = list(values)
    for i in range(len(parents) - 1, 0, -1):
        out[parents[i]] += out[i]
    return out


def _inward(parents: list[int], start: list[float], pick) -> list:  # noqa: ANN001
    """Each container's value from its own and its parent's."""
    out = list(start)
    for i in range(1, len(parents)):
        out[i] = pick(out[i], out[parents[i]])
    return out


def main_text(html: str | None) -> str:
    """The article of a page, blocks joined by line feeds; empty where there is none.

    Null and empty pages have an empty text. Damaged markup never fails: open
    elements end with the page.
    """
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines, parents, names = parser.lines, parser.parents, parser.names
    if all(dropped for _, _, dropped, _, _ in lines):
        return ""
    prior = _inward(parents, [{"article": ARTICLE, "main": MAIN}.get(n, 1.0) for n in names], max)
    smoothed = smooth([0.0 if dropped else len(text) / max(1, tags) * prior[at] for text, tags, dropped, at, _ in lines])
    least = threshold(smoothed)
    weight, others = [0.0] * len(parents), [0.0] * len(parents)  # dense text; lines that are not headings
    for value, (_, _, dropped, at, heading) in zip(smoothed, lines, strict=True):
        if not dropped:
            weight[at] += value if value >= least else 0.0
            others[at] += not heading
    weight, others = _upward(parents, weight), _upward(parents, others)
    heaviest: dict[int, int] = {}
    for i in range(1, len(parents)):
        if parents[i] not in heaviest or weight[i] > weight[heaviest[parents[i]]]:
            heaviest[parents[i]] = i
    region = 0
    while region in heaviest:
        part = heaviest[region]
        enclosed = names[region] == "article" and names[part] != "article"
        if weight[part] < DOMINANT * weight[region] or not weight[part] or enclosed or others[part] == others[region] and names[region] not in ("", "html", "body"):
            break
        region = part
    held = _inward(parents, [i == region for i in range(len(parents))], lambda own, above: own or above)
    kept = [i for i, line in enumerate(lines) if held[line[3]] and not line[2]]
    if names[region] in ("", "html", "body"):  # no part stands out: what stands in the open, and parts with dense text
        part = list(range(len(parents)))  # of each container, the one right inside the region that holds it
        for i in range(region + 1, len(parents)):
            part[i] = i if parents[i] == region else part[parents[i]]
        kept = [i for i in kept if lines[i][3] == region or weight[part[lines[i][3]]] > 0 or lines[i][4]]
    elif names[region] not in ("article", "main"):  # a title may stand right before the region
        first = kept[0]
        while first and lines[first - 1][4] and not lines[first - 1][2]:
            first -= 1
        kept = [*range(first, kept[0]), *kept]
    return "\n".join(lines[i][0] for i in kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    Pages are independent, so this is one narrow stage without a shuffle. Null
    and empty pages give an empty text; repeated rows and null ids stay; an
    empty table gives no rows.
    """
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            yield pd.Series([main_text(h) for h in htmls], dtype=object)

    found = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), texts(F.col(html_col)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
