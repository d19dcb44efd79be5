"""Main text of HTML pages by the distribution of text over line blocks.

A page is read into lines, one per block (paragraph, heading, list item, ...). Elements that never hold the article
(scripts, navigation, forms, ...) are left out with all they hold, and so are those whose class or id says notice, advert,
comments and the like. Text lengths are summed over windows of ``WINDOW`` lines, of every page. Where the sums rise above
next to nothing the text surges, where they fall back it dives, and the lines between are kept, unless they never come near
the page's largest window. Two things weigh on the sums. Lines that are mostly links count as none; and lines outside of
``article`` and ``main`` count for little (``OUTSIDE``), which tells on a page that has text inside, and changes nothing where
all lines are outside. Lines inside count in full, linked or not. Inside a block white space is one space.

A marked comment, reply or teaser is left out also as an ``article``; the header of an article belongs to it; an article
inside a form or header that was opened around it is read. A page that has text in nothing but forms and headers (one form
around all, a header never closed) is read with these. Null and empty pages, and pages without text, give an empty text;
mark-up that is broken off is closed at the end. Work grows with the length of a page, however broken.
"""

from __future__ import annotations

from html.parser import HTMLParser
from itertools import accumulate

import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import add_from, text_of

WINDOW = 3
#: A surge reaches this share of the page's largest window.
SURGE = 0.2
#: Length that a line counts for at most, the share of it outside of a marked article, and the share of the largest window
#: below which there is no text: a full line outside is below it as soon as two are inside.
LINE, OUTSIDE, DIVE = 400, 0.002, 0.001
# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIP = frozenset("script style noscript template iframe object svg canvas nav header footer aside form button select textarea "
                 "dialog menu audio video head title".split())
BLOCK = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html "
                  "li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What an article inside doesn't make readable.
FIRM = tuple(sorted(SKIP - {"form", "header", "footer", "aside", "nav", "dialog"}))
MARKS = frozenset(("article", "main"))
#: What a page without other text is read with.
WRAPS = frozenset(("form", "header"))
#: A whole word in the class of an ``article`` that isn't the page's article.
OTHER = frozenset("ad advert advertisement card comment comments promo related replies reply sponsored teaser".split())
#: Words in a class or id that mark what surrounds an article.
ASIDE = regex.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|header|login|masthead|"
                      r"menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|popup|promo|related|replies|share|sharing|sidebar|"
                      r"signup|social|sponsor|sponsored|subscribe|widget)(?:$|[\s_-])", regex.IGNORECASE)
_SPACE = regex.compile(r"\s+")


class Reader(HTMLParser):
    """Lines of a page: (text, characters in links, inside an article). With ``lenient`` forms and headers are read."""

    def __init__(self, lenient: bool = False):
        super().__init__(convert_charrefs=True)
        self.skip = SKIP - WRAPS if lenient else SKIP
        self.lines: list[tuple[str, int, bool]] = []
        self.part: list[str] = []
        self.linked = 0
        self.open: list[tuple[str, bool, int]] = []  # elements, whether each is left out, and what was left out around it
        self.count: dict[str, int] = {}
        self.skipped = self.links = self.articles = 0
        self.marked = 0  # elements left out by their class, which nothing inside undoes

    def end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.part)).strip()
        if text:
            self.lines.append((text, self.linked, self.articles > 0))
        self.part, self.linked = [], 0

    def left_out(self, tag: str, attrs: list) -> tuple[bool, bool]:
        """Whether the element is left out, and whether that is by its class or id."""
        if tag in ("body", "html"):
            return False, False
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
        if tag in MARKS:
            by_name = not OTHER.isdisjoint(names.lower().split())
        else:
            by_name = bool(names) and bool(ASIDE.search(names))
        return by_name or tag in self.skip and not (tag == "header" and self.articles), by_name

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK or tag in SKIP:
            self.end_line()
        if tag == "br":
            self.part.append(" ")
        if tag in VOID:
            return
        if tag == "p" and any(t == "p" for t, *_ in self.open[-3:]):  # a paragraph ends the one before it
            self.handle_endtag("p")
        out, by_name = self.left_out(tag, attrs)
        before = self.skipped
        if tag in MARKS and not by_name and self.skipped and not self.marked and not any(map(self.count.get, FIRM)):
            self.skipped = 0
        self.open.append((tag, by_name, before))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.skipped += out
        self.marked += by_name
        self.links += tag == "a"
        self.articles += tag in MARKS

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK or tag in SKIP:
            self.end_line()
        if not self.count.get(tag):
            return
        name = ""
        while name != tag:
            name, by_name, self.skipped = self.open.pop()
            self.count[name] -= 1
            self.marked -= by_name
            self.links -= name == "a"
            self.articles -= name in MARKS

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.part.append(data)
            if self.links:
                self.linked += len(data.strip())


def lines_of(html: str) -> list[tuple[str, int, bool]]:
    for lenient in (False, True):
        reader = Reader(lenient)
        reader.feed(html)
        reader.close()
        reader.end_line()
        if reader.lines:
            break
    return reader.lines


def runs(weight: list[float], length: list[int]) -> list[tuple[int, int]]:
    """Where text surges and dives: stretches of lines from the first to the last with text, which no full window without
    text interrupts, and in which some window of lengths reaches the share ``SURGE`` of the page's largest."""
    sums = _windows(weight)
    floor = DIVE * max(sums, default=0)
    plain = _windows([n if w > floor else 0 for n, w in zip(length, weight, strict=True)])
    bar, out, start = SURGE * max(plain, default=0), [], None
    for i, total in enumerate([*sums, 0.0]):
        if total > floor and start is None:
            start = i
        elif total <= floor and start is not None:
            busy = [k for k in range(start, i) if weight[k] > floor]
            if busy and max(plain[start:i]) >= bar:
                out.append((busy[0], busy[-1] + 1))
            start = None
    return out


def _windows(values: list) -> list:
    prefix = list(accumulate(values, initial=0))
    return [prefix[min(i + WINDOW, len(values))] - prefix[i] for i in range(len(values))]


def extract(html: str) -> str:
    """The article's blocks, joined by an empty line."""
    lines = lines_of(html)
    length = [min(len(t), LINE) + 1 for t, *_ in lines]
    plain = [n if inside or 2 * linked <= len(t) else 0 for n, (t, linked, inside) in zip(length, lines, strict=True)]
    if not any(plain):
        plain = length
    weight = [n if inside else n * OUTSIDE for n, (*_, inside) in zip(plain, lines, strict=True)]
    return "\n\n".join(t for a, b in runs(weight, plain) for t, *_ in lines[a:b])


def main_text(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``pages`` (its columns ``keep``, or all) with ``text`` and ``n_chars``, its code points."""

    def make_step():
        def step(htmls) -> dict:
            texts = [extract(h) for h in htmls.to_pylist()]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return step

    return add_from(pages, text_of("html"), make_step, "text string, n_chars long", keep)
