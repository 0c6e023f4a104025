"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a sequence of words and tags. Words score positive and tags negative, with weights learned from labelled
pages: the logarithm of how often a kind of word or tag occurs inside and outside the marked main text. One linear scan
finds the contiguous region of the best total.

What is by its element or role a menu, footer, form, script or the like has no part in the sequence, unless it wraps the
article: holds a main element, or half of the page's prose with an article or first heading, or four fifths of it. Such an
element that is never closed ends where the article begins.

The words of a class or id are features with learned weights of the same form, whole names and parts of names apart. So is
the place of a named block, whatever its name: beside the smallest element that holds most of the prose, or in it before,
among or after its plain paragraphs, or one of several alike; and whether its words are links. An element whose features
score below ``NAMED_OUT`` counts as one negative tag, and its text is no article; a wrapper of the article is never cut.

The text of the region: character references decoded, white space inside a block as one space, trimmed, blocks in page
order joined by one space. Nothing else is dropped or cut.

Cases: a null or empty page, one without words, and one of excluded parts only give an empty text; unclosed elements end
with the page or with the element around them; a truncated tag at the end is no text; repeated rows give equal rows; very
long pages are taken whole in one pass; an empty table gives an empty result; columns named as the results, in any case, are
replaced.
"""

from __future__ import annotations

import re
from html import unescape
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuyere.llm.shared import slices, unused

# Fixed values of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q s samp small span strike strong sub sup svg time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title object canvas audio video".split())
LEFT_OUT = frozenset("head nav footer aside form button select option dialog menu fieldset".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Elements that an opening tag of the same name ends.
SIBLINGS = frozenset("li dt dd tr td th option p".split())
#: Words from which a text outside paragraphs is of the kind "long": its weight is learned apart from that of short texts.
LONG = 10
#: Names that score lower are no article; a part of a name counts half as much as a whole name.
NAMED_OUT, PART_OF_NAME = -1.0, 0.5
#: Elements that end at the article if they are never closed; and blocks whose place is a feature.
UNCLOSED = frozenset("nav header aside footer form menu dialog fieldset".split())
PLACED = frozenset("div section article aside ul ol".split())
#: Shares of the prose: of the element around the article, of a wrapper with a heading in it, and of one without.
CONTAINER, WRAPPER, LONE_WRAPPER = 0.6, 0.5, 0.8

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMING = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HEADING = re.compile("h[1-6]")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
TEXT, OPEN, CLOSE, SINGLE = range(4)
CONTAINERS = frozenset("html body main article section div td form".split())


class Page:
    """The events of a page (text, opening, closing and single tags) and the place where each element ends."""

    def __init__(self, html: str) -> None:
        self.events: list[tuple[int, str, str]] = []
        self.ends: dict[int, int] = {}
        self.unclosed: set[int] = set()
        stack: list[tuple[str, int]] = []
        at, search = 0, _TOKEN.search

        def text(upto: int) -> None:
            if upto > at:
                self.events.append((TEXT, html[at:upto], ""))

        def close(depth: int) -> None:
            while len(stack) > depth:
                opened = stack.pop()[1]
                self.ends[opened] = len(self.events)
                self.unclosed.add(opened)

        while found := search(html, at):
            text(found.start())
            at = found.end()
            closing, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not name:
                continue
            name = name.lower()
            if closing:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == name:
                        opened = stack[depth][1]
                        close(depth)
                        self.unclosed.discard(opened)
                        break
                self.events.append((CLOSE, name, ""))
            elif name in VOID or attributes.rstrip().endswith("/") and name not in RAW:
                self.events.append((SINGLE, name, attributes))
            else:
                if stack and (stack[-1][0] == name and name in SIBLINGS or stack[-1][0] == "p" and name not in INLINE):
                    close(len(stack) - 1)
                stack.append((name, len(self.events)))
                self.events.append((OPEN, name, attributes))
                if name in RAW:
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                    at = end.end() if end else len(html)
                    close(len(stack) - 1)
        text(len(html))
        close(0)
        self._count()

    def _count(self) -> None:
        """What stands before each event: words of prose and in links, main elements, articles and first headings; then where
        unclosed elements end, and the element around the article."""
        self.prose, self.words, self.linked, self.mains, self.articles = [0], [0], [0], [0], [0]
        starts: list[int] = []
        paragraph, link, head_until = False, 0, -1
        for k, (op, value, _) in enumerate(self.events):
            n = linked = prose = 0
            if op == TEXT and k >= head_until:
                n = len(value.split())
                linked = n if link else 0
                prose = n if (paragraph or n >= LONG) and not link else 0
            elif op in (OPEN, CLOSE):
                if value == "a":
                    link = int(op == OPEN)
                elif value == "p":
                    paragraph = op == OPEN
                elif value not in INLINE:
                    paragraph = False
                if op == OPEN and (value == "head" or value in RAW):
                    head_until = max(head_until, self.ends[k])
                if op == OPEN and value in ("main", "article", "h1"):
                    starts.append(k)
            for total, x in ((self.prose, prose), (self.words, n), (self.linked, linked), (self.mains, int(op == OPEN and value == "main")), (self.articles, int(op == OPEN and value in ("article", "h1")))):
                total.append(total[-1] + x)
        for k in self.unclosed:
            if self.events[k][1] in UNCLOSED:
                self.ends[k] = next((m for m in starts if k < m < self.ends[k]), self.ends[k])
        whole = self.prose[-1]
        self.container = max((k for k in self.ends if self.events[k][1] in CONTAINERS and self.prose[self.ends[k]] - self.prose[k] >= CONTAINER * whole), default=-1) if whole else -1
        self.first_plain, self.last_plain, named_until, paragraph = -1, -1, -1, False
        self.alike: dict[tuple[str, str], int] = {}
        for k in range(self.container + 1, self.ends.get(self.container, 0)):
            op, value, attributes = self.events[k]
            if op == OPEN and value in PLACED and attributes and k >= named_until:
                self.alike[value, attributes.strip()] = self.alike.get((value, attributes.strip()), 0) + 1
                if naming(attributes):
                    named_until = self.ends[k]
            if k >= named_until and op == OPEN and value == "p":
                self.first_plain, self.last_plain = k if self.first_plain < 0 else self.first_plain, k

    def wraps(self, k: int, by_element: bool = False) -> bool:
        """Whether the element of an event holds the article. by_element: where its element or role speaks against it."""
        end, name = self.ends[k], self.events[k][1]
        if name in ("html", "body", "main") or self.mains[end] > self.mains[k]:
            return True
        share = (self.prose[end] - self.prose[k]) / self.prose[-1] if self.prose[-1] else 0.0
        if by_element and share >= LONE_WRAPPER and name not in ("nav", "menu", "footer", "aside", "dialog"):
            return True
        if self.articles[end] == self.articles[k + 1]:
            return False
        return share >= WRAPPER if by_element else 2 * (self.words[end] - self.words[k]) >= self.words[-1]

    def place(self, k: int) -> list[str]:
        """The features of where a named block stands; none where the page has no plain paragraphs to compare with."""
        name, attributes, end = self.events[k][1], self.events[k][2], self.ends[k]
        if name not in PLACED or self.first_plain < 0 or k <= self.container < end:
            return []
        n = self.words[end] - self.words[k]
        out = ["@links"] if n and 2 * (self.linked[end] - self.linked[k]) > n else []
        if k >= self.ends[self.container] or k < self.container:
            own = self.events[self.container]
            return [*out, "@same" if (name, attributes.strip()) == (own[1], own[2].strip()) else "@after" if k > self.container else "@before"]
        if self.alike.get((name, attributes.strip()), 0) >= 3:
            return [*out, "@alike"]
        return [*out, "@tail" if k > self.last_plain else "@lead" if end <= self.first_plain else "@middle"]


def left_out(name: str, attributes: str, in_article: bool) -> bool:
    """By element or role."""
    if name in LEFT_OUT or name == "header" and not in_article:
        return True
    if "role" not in attributes.lower() or name in ("html", "body", "main"):
        return False
    return any(key.lower() == "role" and (a or b or c).strip().lower() in ROLES for key, a, b, c in _NAMING.findall(attributes))


def naming(attributes: str) -> list[str]:
    """The features of an element's class, id and visibility: whole names as =name, parts of compound names as ~part."""
    out = []
    for key, a, b, c in _NAMING.findall(attributes) if attributes else ():
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and _INVISIBLE.search(value):
            out.append("@hidden")
        elif key in ("class", "id"):
            for token in value.split():
                parts = [x.lower() for x in _PART.findall(token)]
                if parts:
                    out += ["=" + "-".join(parts), *(["~" + x for x in parts] if len(parts) > 1 else [])]
    return out


def names_score(name: str, features: list[str], in_article: bool, weights: dict[str, float]) -> float:
    """The sum of the features' weights, and that of the element itself where it speaks for an article and one of the names is
    known; what has unknown names only is judged by its place."""
    if not features:
        return 0.0
    own = max(0.0, weights.get(f"#{name} inside" if in_article else f"#{name}", 0.0)) if any(x[0] != "@" and x in weights for x in features) else 0.0
    return own + sum(weights.get(x, 0.0) * (PART_OF_NAME if x[0] == "~" else 1.0) for x in features)


def sequence(html: str, weights: dict[str, float]) -> list[tuple[str, str]]:
    """(kind, text) in page order. Kinds of words: link, heading, paragraph, long, other; kinds of tags: their class; each on
    its own, in a main element or in an article. The text of a tag is a space if it separates blocks. What is left out is
    one item: "out", or of the kind "named" where names decide."""
    page = Page(html)
    out: list[tuple[str, str]] = []
    inside = {"main": 0, "article": 0}
    link, heading, paragraph, k = 0, 0, False, 0
    inline_until = -1  # all elements of a formula or drawing are inline
    while k < len(page.events):
        op, name, attributes = page.events[k]
        where = "article " if inside["article"] else "main " if inside["main"] else ""
        if op == TEXT:
            kind = "heading" if heading else "paragraph" if paragraph else "link" if link else "long" if len(name.split()) >= LONG else "other"
            out.append((where + kind, name))
            k += 1
            continue
        if op == OPEN:
            if left_out(name, attributes, bool(where)) and not page.wraps(k, by_element=True):
                out.append(("out", " "))
                k = max(k + 1, page.ends[k])
                continue
            features = naming(attributes)
            if features and names_score(name, features + page.place(k), bool(where), weights) < NAMED_OUT and not page.wraps(k):
                out.append((where + "named", "" if name in INLINE else " "))
                k = max(k + 1, page.ends[k])
                continue
            if name in ("math", "svg"):
                inline_until = max(inline_until, page.ends[k])
        inline = name in INLINE or k <= inline_until
        step = 1 if op == OPEN else -1 if op == CLOSE else 0
        if name in inside:
            inside[name] = max(0, inside[name] + step)
        elif name == "a":
            link = int(op == OPEN)
        elif _HEADING.fullmatch(name):
            heading = int(op == OPEN)
        elif name == "p":
            paragraph = op == OPEN
        elif not inline and name not in VOID:
            paragraph = False
        where = "article " if inside["article"] else "main " if inside["main"] else ""
        if name in ("article", "main", "section", "div", "li", "p", "br", "a"):
            kind = f"<{name}>"
        else:
            kind = "<heading>" if _HEADING.fullmatch(name) else "<inline>" if inline else "<block>"
        out.append((kind if name in inside else where + kind, "" if inline else " "))
        k += 1
    return out


WORD_KINDS = frozenset(place + kind for place in ("", "main ", "article ") for kind in ("link", "heading", "paragraph", "long", "other"))
#: Characters that stand for the marks while a labelled page is read.
_BEGIN, _END = "\ue000", "\ue001"


def learn_names(labelled: list[str]) -> dict[str, float]:
    """Weights of names and of elements that have names. Elements inside the marks, and those around them, speak for an
    article; all others against it."""
    counts: dict[str, list[float]] = {}
    for html in labelled:
        page = Page(html.replace("<!--main-->", _BEGIN).replace("<!--/main-->", _END))
        marks = [next(k for k, e in enumerate(page.events) if e[0] == TEXT and mark in e[1]) for mark in (_BEGIN, _END)]
        article = 0
        for k, (op, name, attributes) in enumerate(page.events):
            if name in ("main", "article") and op in (OPEN, CLOSE):
                article += 1 if op == OPEN else -1
            features = naming(attributes) if op == OPEN else []
            if features:
                features += page.place(k)
                good = marks[0] < k < marks[1] or k < marks[0] and page.ends[k] > marks[1]
                inner = article - (name in ("main", "article")) > 0
                if marks[0] < k < marks[1] and names_against(page, k):
                    good = False
                for x in {*features, f"#{name} inside" if inner else f"#{name}"}:
                    counts.setdefault(x, [0.5, 0.5])[0 if good else 1] += 1
    return {x: max(-4.0, min(1.5 if x[0] == "#" else 4.0, log(a / b))) for x, (a, b) in sorted(counts.items())}


def names_against(page: Page, k: int) -> bool:
    """Whether an element inside the marks is labelled as no article, by the attribute data-not."""
    return "data-not" in page.events[k][2]


def learn(labelled: list[str]) -> dict[str, float]:
    """Weights of all kinds and names from pages whose main text stands between the comments ``main`` and ``/main``;
    elements between them that are no article have the attribute data-not."""
    names = learn_names(labelled)
    inside: dict[str, float] = {}
    outside: dict[str, float] = {}
    for page in labelled:
        counts = outside
        for kind, text in sequence(page.replace("<!--main-->", _BEGIN).replace("<!--/main-->", _END), names):
            if text in (_BEGIN, _END):
                counts = inside if text == _BEGIN else outside
            else:
                counts[kind] = counts.get(kind, 0) + (len(text.split()) if kind in WORD_KINDS else 1)
    weights = dict(names)
    for kind in sorted({*inside, *outside} - {"out"}):
        odds = log((inside.get(kind, 0) + 0.5) / (outside.get(kind, 0) + 0.5))
        weights[kind] = min(3.0, max(0.1, odds)) if kind in WORD_KINDS else max(-6.0, min(-0.1, odds))
    weights["out"] = 0.0  # parts that are left out do not count
    return weights


def best_region(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous part with the largest sum; of equals the first and longest."""
    best, start, total, found = 0.0, 0, 0.0, (0, 0)
    for k, x in enumerate(scores):
        if total < 0:
            start, total = k, 0.0
        total += x
        if total > best or total == best and best > 0 and start == found[0]:
            best, found = total, (start, k + 1)
    return found


def main_text(html: str | None, weights: dict[str, float]) -> str:
    if not html:
        return ""
    items = sequence(html, weights)
    scores = [weights.get(kind, -0.5) * (len(text.split()) if kind in WORD_KINDS else 1) for kind, text in items]
    a, b = best_region(scores)
    while a > 0 and items[a - 1][0].endswith("<inline>"):
        a -= 1
    return " ".join("".join(unescape(text) if kind in WORD_KINDS else text for kind, text in items[a:b]).split())


def extract(df: DataFrame, *, html_col: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """df without its html column and with text and n_chars; columns of these names are replaced. No shuffle."""
    from tuyere.llm.labelled_pages import LABELLED

    learned = weights or learn(LABELLED)
    rest = [c for c in df.columns if c.lower() not in (html_col.lower(), "text", "n_chars")]
    source = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{html_col}`").alias(unused(df, "html")))
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + ["text string", "n_chars long"])

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 200):
            texts = [main_text(x, learned) for x in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*rest, "text", "n_chars"])

    return source.mapInArrow(run, fields)
