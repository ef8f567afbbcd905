"""Main text of web pages by text-to-tag ratios.

The events of the standard library's HTML parser are turned into lines, one per block of text, as they arrive. A line
knows the length of its text, the tags since the line before it and the part of the page that encloses it. Lines in
something that is never content (navigation, header, footer, aside, script, style, hidden parts) are left out, and so are
those in parts in doubt: forms, and parts whose class, id or role names advert, notice, menu, comments and the like. A part
in doubt that holds an article, a main part or more than half of the text is none, and neither is a section on such a topic
that has a heading of its own; paragraphs, headings and inline parts are not judged by their names.

The ratio of text to tags of each line is smoothed by a Gaussian; lines above the threshold (the standard deviation of
the smoothed ratios, as long as any line is above it) form clusters of content. Short lines between long ones belong to
the text, so clusters are closed up: the content region is the article or main element with the most clustered text, if
one has any; else the page. It narrows to an element inside (an article or main in the first case; in the second, one that
is made to hold blocks and holds several) only where no clustered line is left outside, short neighbours of long lines
apart. All lines of the region but those of excluded parts are the result.

Edge cases: null or empty html, and pages without a content line, give the empty text. Broken, nested or unclosed markup
is read as browsers do in the usual cases: a block closes open paragraphs, an end tag closes what is open inside it, an
end tag without a start is ignored, a cut page ends where it ends. Repeated rows are extracted each. Other columns are
kept; columns named like the result are replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements without content, elements that break a line, elements that are never main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
EXCLUDED = frozenset(
    "aside button canvas datalist dialog embed footer head header iframe input menu nav noscript object script select style "
    "svg template textarea title".split()
)
# Elements that are left out unless they hold the text of the page.
DOUBTFUL = frozenset("fieldset form label".split())
EXCLUDED_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search toolbar".split()
)
# Words of class and id values, cut at anything but letters.
EXCLUDED_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adverts banner banners breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies disclaimer discussion disqus footer gdpr header masthead menu menus modal nav navbar navigation "
    "newsletter notice notices pager pagination popup promo promotion promoted related replies reply respond share sharing "
    "sidebar sidebars signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
# Words beside one of these in a name say how an element is laid out, not what it is.
LAYOUT_WORDS = frozenset("container has have layout no non not page with without wrap wrapper".split())
# Of these, a section with a heading of its own is a part of the text.
TOPICS = frozenset("disclaimer discussion notice notices related share sharing social".split())
# Elements whose names are not looked at: parts of a text.
PARTS = frozenset("a abbr b blockquote body cite code em h1 h2 h3 h4 h5 h6 html i li main p q s small span strong sub sup td u".split())
CONTENT = frozenset(["article", "main"])
#: Blocks that may hold several others; text of one of the rest is never more than a part of the content.
CONTAINERS = frozenset("body center div html section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose unclosed start is ended by one of the same kind.
SELF_CLOSING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"},
                "option": {"select"}}
CLOSES_P = BLOCKS - {"br", "body", "html", "option", "optgroup", "legend", "summary", "title", "td", "th", "tr"}

#: Standard deviation of the Gaussian, in lines.
SIGMA = 1.0

_NOT_LETTERS = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def excluded_words(value: str) -> set[str]:
    """Words of a class or id value that say that an element is no content; each name is judged by itself."""
    found: set[str] = set()
    for name in value.split():
        words = _NOT_LETTERS.split(_CAMEL.sub(" ", name).lower())
        if not LAYOUT_WORDS.intersection(words):
            found |= EXCLUDED_WORDS.intersection(words)
    return found


def exclusion(tag: str, attrs: list[tuple[str, str | None]]) -> str:
    """``hard`` (never content), ``soft`` (unless it holds the text), ``topic`` (unless it is a section with a heading), or none."""
    if tag in EXCLUDED:
        return "hard"
    words: set[str] = set()
    for name, value in attrs:
        if name in ("hidden",) or (name == "aria-hidden" and value == "true"):
            return "hard"
        if not value:
            continue
        if name == "role" and value.strip().lower() in EXCLUDED_ROLES:
            return "soft"
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return "hard"
        if name in ("class", "id") and tag not in PARTS:
            words |= excluded_words(value)
    if words:
        return "topic" if tag == "section" and words <= TOPICS else "soft"
    return "soft" if tag in DOUBTFUL else ""


class Lines(HTMLParser):
    """Collects (text, tags, path of open elements) per block of text outside of parts that are never content."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, tuple[int, ...]]] = []
        self.names: list[str] = []  # of every element met, by number
        self.open: list[int] = []
        self.barred: list[int] = []  # elements that are never content and open
        self.doubted: dict[int, str] = {}  # elements that may be no content, and why
        self.headed: set[int] = set()  # elements with a heading inside
        self.text: list[str] = []
        self.tags = 0

    def end_line(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((text, self.tags, tuple(self.open)))
                self.tags = 0
            self.text = []

    def pop(self, at: int) -> None:
        for number in self.open[at:]:
            if self.barred and self.barred[-1] == number:
                self.barred.pop()
        del self.open[at:]

    def last(self, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> int | None:
        """Place of the innermost open element of these names, not looking beyond those in ``stop``."""
        for i in range(len(self.open) - 1, -1, -1):
            name = self.names[self.open[i]]
            if name in tags:
                return i
            if name in stop:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        at = None
        if tag in CLOSES_P:
            at = self.last({"p"}, CONTENT | {"table", "div", "section", "body", "button"})
        if at is None and tag in SELF_CLOSING:
            at = self.last({tag} | ({"dt", "dd"} if tag in ("dt", "dd") else set()), SELF_CLOSING[tag])
        if tag == "body":
            at = self.last({"head"}, set())
        if at is not None:
            self.pop(at)
        if tag in VOID:
            return
        self.names.append(tag)
        self.open.append(len(self.names) - 1)
        why = exclusion(tag, attrs)
        if why == "hard":
            self.barred.append(len(self.names) - 1)
        elif why:
            self.doubted[len(self.names) - 1] = why
        if tag in HEADINGS:
            self.headed.update(self.open)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        at = self.last({tag}, CONTENT - {tag} if tag in ("p", "div", "span", "b", "li") else frozenset())
        if at is not None:
            self.pop(at)

    def handle_data(self, data: str) -> None:
        if not self.barred:
            self.text.append(data)

    def close(self) -> None:
        super().close()
        self.end_line()

    def content_lines(self) -> list[tuple[str, int, tuple[int, ...]]]:
        """The lines outside of parts in doubt; one that holds an article, a main part or most of the text is in none."""
        if not self.doubted:
            return self.lines
        size: dict[int, int] = defaultdict(int)
        holds: set[int] = set()
        for text, _, path in self.lines:
            for i, number in enumerate(path):
                if number in self.doubted:
                    size[number] += len(text)
                    if any(self.names[n] in CONTENT for n in path[i + 1 :]):
                        holds.add(number)
        total = sum(len(text) for text, _, _ in self.lines)
        gone = {
            n for n, why in self.doubted.items()
            if n not in holds and 2 * size[n] <= total and not (why == "topic" and n in self.headed)
        }
        return [line for line in self.lines if gone.isdisjoint(line[2])]


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    weights = np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]
    return np.convolve(values, kernel)[reach : reach + len(values)] / weights


def extract(html: str | None) -> str:
    """The main text of one page: blocks joined by line ends."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines, names = parser.content_lines(), parser.names
    if not lines:
        return ""
    ratio = smooth(np.array([len(text) / max(1, tags) for text, tags, _ in lines]))
    bar = min(float(ratio.std()), float(ratio.max()))
    chosen = ratio >= bar
    # Lines that are clustered only as neighbours of others (too short to reach the bar even with one tag) tell no region.
    chosen &= np.array([len(text) >= bar for text, _, _ in lines])
    # Clustered text, and lines, per enclosing element.
    weight: dict[int, int] = defaultdict(int)
    held: dict[int, int] = defaultdict(int)
    for (text, _, path), yes in zip(lines, chosen):
        for number in path:
            held[number] += 1
            if yes:
                weight[number] += len(text)
    content = [n for n in weight if names[n] in CONTENT]
    if content:
        heaviest = max(content, key=lambda n: (weight[n], -n))
        inside = {n for _, _, path in lines if heaviest in path for n in path[path.index(heaviest) :]}
        # Elements are numbered as they open: of nested ones with all of the text, the innermost.
        region = max(n for n in content if n in inside and weight[n] == weight[heaviest])
    else:
        total = sum(len(text) for (text, _, _), yes in zip(lines, chosen) if yes)
        whole = (n for n in weight if weight[n] == total and held[n] > 1 and names[n] in CONTAINERS)
        region = max(whole, default=None)
    return "\n".join(text for text, _, path in lines if region is None or region in path)


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, with ``text`` and ``n_chars``."""

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract(value) for value in batch], dtype=object)

    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars", html.lower())]
    found = pages.withColumn("__text", extracted(F.col(html)))
    return found.select(*[F.col(f"`{c}`") for c in kept], F.col("__text").alias("text"),
                        F.length("__text").cast("bigint").alias("n_chars"))
