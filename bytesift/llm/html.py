"""Main text of web pages: parser events, text-to-tag ratio of lines, Gaussian smoothing, threshold clustering.

The standard library's parser streams events. They build lines, one for each block of text, with the number of characters
and of tags in it. Elements that HTML has for menus, forms, footers and the like hold no lines. The ratios of text to tags
are smoothed over the neighbours and weighed by what the page says of a line: more in an article or main element, less
where class or id speak of adverts, notices, comments and so on. A threshold parts the weighed ratios in two clusters, and
the regions with lines in the upper one are the content, whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesift.llm.common import bounded_batches

# Elements and words of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("script style noscript template head title nav footer aside form button select textarea iframe object svg canvas audio video map menu dialog search datalist label".split())
ARTICLE = frozenset(["article", "main"])
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar tablist".split())
WORDS = frozenset(
    "nav navbar navigation menu menus topbar sidebar sidebars footer breadcrumb breadcrumbs pagination toolbar "
    "ad ads advert adverts advertisement banner sponsor sponsored promo teaser cookie cookies consent notice notices alert popup modal overlay "
    "newsletter subscribe signup login paywall share social related recommended widget comment comments reply replies discussion feedback form search skip".split()
)
#: Words that speak against an element only outside an article, where they name the page's own parts.
OUTER_WORDS = frozenset(["header", "head", "top", "bottom", "logo", "copyright", "legal"])
#: First words of class names that tell what a wrapper has around it, not what it is (has-sidebar, page-header-fixed).
ABOUT = frozenset("has with no without is not js layout page body theme site wrapper".split())
#: Lines over which ratios are smoothed (standard deviation).
SIGMA = 1.5
#: How much more a line counts in an article or main element, and how much less where class or id speak against it.
MARKED, SUSPECT = 4.0, 64.0
#: Share of a line's characters in links from which it is no text, outside articles.
LINKED = 0.6


def _words(value: str | None) -> set[str]:
    """The words of a class attribute or an id, split at signs and at capitals, without names that only tell of a layout."""
    out: set[str] = set()
    for name in (value or "").split():
        own = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", name).lower()) if w]
        if own and (own[0] not in ABOUT or len(own) == 2 and own[0] in ("site", "page")):
            out.update(own)
    return out


class Lines(HTMLParser):
    """Parser events -> lines: (text, characters, tags, region, outermost article or 0, whether class or id speak against it, characters in links)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, bool]] = []  # element, whether it is set aside, is an article, is spoken against
        self.aside = self.articles = self.suspects = self.article = 0
        self.parts: list[str] = []
        self.tags = self.regions = 0
        self.region = [0]
        self.links = self.linked = 0
        self.lines: list[tuple[str, int, int, int, int, bool, int]] = []

    def _is_aside(self, tag: str, own: dict[str, str | None]) -> bool:
        if tag in NEVER or tag == "header" and not self.articles:
            return True
        if tag in ("html", "body", *ARTICLE):
            return False
        return "hidden" in own or (own.get("aria-hidden") or "").lower() == "true" or (own.get("role") or "").lower() in ROLES

    def _is_suspect(self, tag: str, own: dict[str, str | None]) -> bool:
        if tag in ("html", "body", "main"):
            return False
        words = _words(own.get("class")) | _words(own.get("id"))
        return bool(words & WORDS) or not self.articles and bool(words & OUTER_WORDS)

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, len(text), max(1, self.tags), self.region[-1], self.article if self.articles else 0, self.suspects > 0, self.linked))
        self.parts, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK and not self.aside:
            self._flush()
        if tag == "p":  # a paragraph ends the one before it, and what was left open in that
            self._close("p", until=BLOCK - {"p"})
        elif tag in ("li", "dd", "dt", "option", "tr", "td", "th"):
            self._close(tag, until=frozenset(["ul", "ol", "dl", "select", "table", "tbody", "thead", "tfoot", "tr"]) - {tag})
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        own = dict(attrs)
        aside = bool(self.aside) or self._is_aside(tag, own)
        article = tag in ARTICLE or own.get("role") == "main" or own.get("itemprop") == "articleBody"
        suspect = self._is_suspect(tag, own)
        self.stack.append((tag, aside, article, suspect))
        self.aside += aside
        self.article += article and not self.articles
        self.articles += article
        self.suspects += suspect
        self.links += tag == "a"
        if tag in ("body", "div", "section", "article", "main", "td", "center", "blockquote"):
            self.regions += 1
            self.region.append(self.regions)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML ignores the slash but on void elements

    def _pop(self) -> str:
        tag, aside, article, suspect = self.stack.pop()
        self.aside -= aside
        self.articles -= article
        self.suspects -= suspect
        self.links -= tag == "a"
        if tag in ("body", "div", "section", "article", "main", "td", "center", "blockquote"):
            self.region.pop()
        return tag

    def _close(self, tag: str, until: frozenset[str] = frozenset()) -> None:
        """Ends the innermost open element of that name and all in it, unless one of `until` stands between."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                break
            if self.stack[i][0] in until:
                return
        else:
            return
        while len(self.stack) > i:
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK and not self.aside:
            self._flush()
        self.tags += 1
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self.aside:
            self.parts.append(data)
            self.linked += len(data) if self.links else 0

    def close(self) -> None:
        super().close()
        self._flush()


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """ratio under a Gaussian window; at the ends the window is cut and weighed anew."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    same = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    return same(ratio) / same(np.ones(len(ratio)))


def threshold(values: np.ndarray) -> float:
    """Where two clusters part: the mean of their means, moved until it rests. The least value if all are equal."""
    t = float(values.mean())
    for _ in range(100):
        low, high = values[values < t], values[values >= t]
        if not len(low) or not len(high):
            return float(values.min())
        new = float(low.mean() + high.mean()) / 2
        if abs(new - t) < 1e-9:
            break
        t = new
    return t


def upper_cluster(lines: list[tuple], clusters: bool = True) -> np.ndarray:
    """Whether each line lies in the upper cluster, by its weighed ratio smoothed or by itself. Without clusters all do."""
    if not clusters:
        return np.ones(len(lines), bool)
    ratio = np.array([chars / tags for _, chars, tags, *_ in lines])
    weight = np.array([(MARKED if article else 1) / (SUSPECT if suspect else 1) for *_, article, suspect, _ in lines])
    # A dense line is content even where menus beside it lower its smoothed ratio.
    value, alone = smoothed(ratio) * weight, ratio * weight
    return (value >= threshold(value)) | (alone >= threshold(alone))


def main_text(html: str | None, clusters: bool = True) -> str:
    """The article of a page, one block a line; empty if there is none. clusters=False keeps what the clusters would leave out, for comparison."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    lines = parser.lines
    if not lines:
        return ""
    upper = upper_cluster(lines, clusters)
    at = np.flatnonzero(upper)
    regions = {lines[i][3] for i in at}
    articles = {lines[i][4] for i in at} - {0}
    out = []
    for i, (text, chars, _, region, article, suspect, linked) in enumerate(lines):
        # A region with upper lines is content as a whole, and so are an article around them and what lies between them,
        # but for what class or id speak against; outside articles lists of links are none.
        whole = region in regions or not suspect and (article in articles or at[0] <= i <= at[-1])
        if whole and (article or linked <= LINKED * chars):
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for each row of pages.

    Null and empty html, and pages without text outside menus and the like, give an empty text. Broken markup is read as far as it
    goes, as browsers do. Very long pages are read whole. Repeated rows each get a row; null ids and urls pass
    through; other columns are not read; no rows give no rows.
    """
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="html").assign(text=[main_text(h) for h in b["html"]])

    types = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    out = pages.select(F.col("page_id").cast("string").alias("id_"), "url", "html").mapInPandas(run, "id_ string, url string, text string")
    return out.select(F.col("id_").cast(types["page_id"]).alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
