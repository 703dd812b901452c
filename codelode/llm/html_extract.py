"""Main text of HTML pages by two-pass block rules.

Pass one cuts a page into blocks at block-level tags and classifies each by stop-word density,
length and link density; whatever stands in a menu, header, footer, sidebar, notice, advert, form
or comment section, or is hidden, is boilerplate. Short or undecided blocks stay open. Pass two
gives each open block the label of its nearest decided neighbour, looking first inside the same
article element. A page without frequent words of the known languages is judged by length and link
density alone; a form that holds nearly all of a page's text doesn't count as a form; a heading
right before an article goes with it.

A page is read once, from left to right, in time that is linear in its length. A tag ends at the
next > outside quotes that follow an =; a quote that never closes doesn't count. Scripts, styles
and the like that never close run to the end.

Results: text is '' for null, empty or text-free pages; character references are decoded once;
white space inside a block is one space; blocks are joined in page order by one space; pages
that are cut off count as they stand; repeated rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent words of the languages that pages come in.
STOP_WORDS = frozenset(
    "a an and are as at be been but by can for from had has have he her his if in is it its more no not of on one or she so that the their there they this to was we were what when which who will with would you"
    " der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei"
    " le la les de des du et un une en que qui est dans pour pas au sur se ne par avec ce il sont plus elle on mais nous"
    " el los las y que del se por con para una su al lo como más pero sus le ya este si porque esta son entre cuando".split()
)
#: Names of the elements that the rules tell apart.
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr del".split())
CONTAINERS = frozenset("article main section div nav aside header footer form ul ol dl table menu dialog details figure".split())
BOILERPLATE = frozenset("nav aside footer menu dialog".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert form".split())
MARKS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|side|footer|cookies?|consent|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|widget|comments?|comment-?list|replies|reply|disqus|pagination|pager|skip)(?:$|[\s_-])", re.I)
TAG = re.compile(r"<(?:!--|[!?]|(/?)([a-z][^\s/>]*))", re.I)
INSIDE = re.compile(r"(?>[^>\"'=]+|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
#: Elements whose content isn't text of the page; those of the second line need an end tag.
RAW = frozenset("script style noscript template title textarea iframe".split())
SKIPPED = frozenset("select button object svg math canvas".split())
HEADINGS = frozenset("h1 h2 h3".split())
GOOD, BAD, OPEN, SHORT = "good", "bad", "open", "short"


class Block:
    __slots__ = ("text", "linked", "boiler", "form", "article", "heading", "label")

    def __init__(self, text: str, linked: int, boiler: bool, form: bool, article: int, heading: bool):
        self.text, self.linked, self.boiler, self.form, self.article, self.heading, self.label = text, linked, boiler, form, article, heading, OPEN


def _attributes(rest: str) -> bool:
    """Does an element say that it holds boilerplate, or that it isn't shown?"""
    for key, *value in ATTRIBUTE.findall(rest):
        text, key = "".join(value), key.lower()
        if key == "hidden" or key == "aria-hidden" and text.lower() == "true" or key == "role" and text.lower() in ROLES:
            return True
        if key in ("class", "id") and MARKS.search(text) or key == "style" and UNSEEN.search(text):
            return True
    return False


class Ends:
    """Where an end tag follows: each name's last one is looked up once for a page."""

    def __init__(self, page: str):
        self.page, self.last, self.lower = page, {}, None

    def after(self, name: str, at: int) -> int:
        """One past the end tag of `name` that follows `at`, or -1."""
        if name not in self.last:
            if self.lower is None:
                self.lower = self.page.lower() if self.page.isascii() else re.sub(r"[A-Z]+", lambda m: m[0].lower(), self.page)
            self.last[name] = self.lower.rfind("</" + name)
        if self.last[name] < at:
            return -1
        close = self.lower.find("</" + name, at)
        end = self.page.find(">", close)
        return end + 1 if end >= 0 else len(self.page)


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    parts: list[str] = []
    linked, in_link, articles = 0, 0, 0
    stack: list[tuple[str, bool, bool, int]] = []  # element, boilerplate, form, number of its article or 0
    opened: Counter[str] = Counter()  # of the stack
    boiler, form, article = False, False, 0
    marked, heading = False, False  # of the block that is being read
    ends = Ends(page)

    def close() -> None:
        nonlocal linked, marked, heading
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append(Block(text, linked, boiler or marked, form, article, heading))
        parts.clear()
        linked, marked, heading = 0, False, False

    def take(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())

    at, size = 0, len(page)
    while m := TAG.search(page, at):
        take(page[at : m.start()])
        name = m[2]
        if not name:
            finish = page.find("-->", m.end() - 2) if m[0] == "<!--" else page.find(">", m.end())
            at = size if finish < 0 else finish + (3 if m[0] == "<!--" else 1)
            continue
        name, end = name.lower(), bool(m[1])
        inside = INSIDE.match(page, m.end())
        at, rest = min(inside.end() + 1, size), inside[0]
        if not end and name in RAW:
            at = ends.after(name, at)
            at = size if at < 0 else at
        elif not end and name in SKIPPED and (past := ends.after(name, at)) >= 0:
            at = past
        elif name == "a":
            in_link = 0 if end else 1
        elif name in ("br", "hr"):
            parts.append(" ")
        elif name not in INLINE:
            close()
            in_link = 0
            bad = not end and ("=" in rest or "hidden" in rest) and _attributes(rest)
            if name in CONTAINERS or bad and name not in ("p", *HEADINGS):
                if not end and not rest.endswith("/"):
                    inner = article
                    if name in ("article", "main") and not boiler:
                        articles += 1
                        inner = articles
                    stack.append((name, boiler or bad or name in BOILERPLATE or name == "header" and not article, form or name == "form", inner))
                    opened[name] += 1
            else:
                marked, heading = bad, name in HEADINGS and not end
            if end and opened[name]:
                inner = ""
                while inner != name:
                    inner = stack.pop()[0]
                    opened[inner] -= 1
            _, boiler, form, article = stack[-1] if stack else ("", False, False, 0)
    if at < size:
        take(page[at:])
    close()
    return out


def _words(text: str) -> tuple[int, int]:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()*#$%&|") in STOP_WORDS for w in words), len(words)


def classify(blocks: list[Block], short: int = 70, long: int = 200, low: float = 0.10, high: float = 0.20, links: float = 0.33) -> None:
    """Pass one, then pass two; labels end as GOOD or BAD."""
    shown = [b for b in blocks if not b.boiler]
    sizes = [sum(len(b.text) for b in shown if b.form == x) for x in (False, True)]
    forms = sizes[1] <= 4 * sizes[0]  # else the page as a whole is a form
    for b in blocks:
        b.boiler |= b.form and forms
    shown = [b for b in blocks if not b.boiler]
    framed = any(b.article for b in shown)
    for before, after in zip(shown, shown[1:]):
        if before.heading and not before.article and after.article:
            before.article = after.article
    counts = [_words(b.text) for b in blocks]
    total = [sum(c[i] for b, c in zip(blocks, counts) if not b.boiler) for i in (0, 1)]
    known = total[0] >= low / 5 * total[1]  # a language whose frequent words are known
    for b, (stops, words) in zip(blocks, counts):
        density = stops / words
        if b.boiler or b.linked / len(b.text) > links or framed and not b.article:
            b.label = BAD
        elif len(b.text) < (short if known else short // 2):
            b.label = SHORT
        elif density >= high and len(b.text) > long or b.article and density >= low or not known:
            b.label = GOOD
        elif density < low and not b.article:
            b.label = BAD
        else:
            b.label = OPEN
    first = [b.label for b in blocks]
    decided = [i for i, x in enumerate(first) if x in (GOOD, BAD)]
    before, last = [], -1
    for i, x in enumerate(first):
        last = i if x in (GOOD, BAD) else last
        before.append(last)
    after, nxt = [0] * len(first), -1
    for i in range(len(first) - 1, -1, -1):
        nxt = i if first[i] in (GOOD, BAD) else nxt
        after[i] = nxt
    for i, b in enumerate(blocks):
        if first[i] in (GOOD, BAD):
            continue
        near = [j for j in (before[i], after[i]) if j >= 0]
        inside = [j for j in near if b.article and blocks[j].article == b.article and not blocks[j].boiler]
        if inside:
            near = inside
        elif b.article:
            b.label = GOOD  # an article of undecided blocks only
            continue
        best = min(near, key=lambda j: (abs(j - i), first[j] != GOOD), default=-1)
        b.label = first[best] if best >= 0 else (GOOD if not decided else BAD)


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    classify(blocks)
    return " ".join(b.text for b in blocks if b.label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
