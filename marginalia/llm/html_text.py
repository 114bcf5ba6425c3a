"""Main text of HTML pages by tree scoring.

One pass over the markup builds a flat tree of block elements and the text blocks in them. Each paragraph gives points
for its length and its commas to its ancestors, less the farther they are; an element's points are discounted by the
share of its text that stands in links. The best container is kept with those of its siblings that look alike.
Navigation, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments never count. Elements that
only a word of their class or id marks as such are judged by what they hold, see `_judge`.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow

#: Markup names. Fixed values.
RAW = frozenset("script style noscript template iframe object textarea title svg annotation annotation-xml select canvas audio video".split())
#: Raw elements that have no text to skip when they are closed by a slash.
EMPTY = frozenset("svg annotation annotation-xml object canvas audio video".split())
DROPPED = frozenset("nav header footer aside form menu dialog button fieldset head".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
CLOSED_BY = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dd": ("dd", "dt"), "dt": ("dd", "dt")}
SCOPE = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("table",), "th": ("table",), "dd": ("dl",), "dt": ("dl",)}
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar aside comment comments respond replies disqus menu nav navbar navigation breadcrumb "
    "breadcrumbs footer header masthead notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription share sharing social related recommended widget pagination pager toolbar skip login signup search tags".split()
)
UNLIKELY_ROLES = frozenset("navigation banner complementary contentinfo dialog alert alertdialog menu menubar search form toolbar".split())
KEPT_TAGS = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
#: Words that name a part of a page together with an unlikely one; with any other word the unlikely one is a weak sign.
NEUTRAL = frozenset("site page global top bottom left right main primary secondary wrap wrapper container inner outer box bar block area section region list lists item items link links button buttons icon icons post posts entry article articles content body text form widget widgets group row col column unit slot label title this us the and s".split())
#: Unlikely words that layouts put around whole pages too.
LAYOUT = frozenset("header masthead banner nav navbar navigation menu search overlay modal popup toolbar tags social sidebar skip".split())
#: How an element stands: live, unlikely by a word among others, by words of layouts alone, by other words alone, dropped whatever it holds.
LIVE, WEAK, WRAP, STRONG, DROP = range(5)

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)(?:>|\Z)|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in RAW}
#: Characters of a paragraph that scores, and those for a further point (three at most).
LEAST, LENGTH = 25, 100
#: A text of fewer characters is little for a page.
LITTLE = 200
#: Characters of a menu's entry, in the mean, at most.
MENU = 40


def _unlikely(tag: str, attributes: str) -> int:
    if not attributes or tag in KEPT_TAGS:
        return LIVE
    found = LIVE
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            for part in value.split():
                words = [w.lower() for w in WORDS.findall(part)]
                if hits := [w for w in words if w in UNLIKELY]:
                    if any(w not in UNLIKELY and w not in NEUTRAL and not w.isdigit() for w in words):
                        found = max(found, WEAK)
                    else:
                        found = max(found, WRAP if all(w in LAYOUT for w in hits) else STRONG)
        elif (name == "role" and value.lower() in UNLIKELY_ROLES) or name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return DROP
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return DROP
    return found


class _Page:
    """Flat tree: for each node its tag, parent, whether it is dropped, how its words mark it, and the range of blocks inside it."""

    def __init__(self, page: str, lifted: int = LIVE):
        self.lifted = lifted
        self.tag, self.parent, self.drop, self.mark, self.first, self.last = ["#"], [-1], [False], [LIVE], [0], [0]
        self.blocks: list[tuple[int, str, int]] = []
        #: Depths of the open elements of each tag, and under the empty name of the blocks that aren't paragraphs.
        self._places: dict[str, list[int]] = {}
        self._text: list[str] = []
        self._linked = 0
        self._parse(page)

    def _flush(self, node: int) -> None:
        """The pending text becomes a block of `node`, or of the live element around it: dropped ones collect no text."""
        if self._text:
            while self.drop[node]:
                node = self.parent[node]
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((node, text, min(self._linked, len(text))))
            self._text, self._linked = [], 0

    def _open(self, stack: list[int], tag: str, drop: bool, mark: int = LIVE) -> None:
        self.tag.append(tag)
        self.parent.append(stack[-1])
        self.drop.append(drop or self.drop[stack[-1]])
        self.mark.append(mark)
        self.first.append(len(self.blocks))
        self.last.append(0)
        stack.append(len(self.tag) - 1)
        for name in self._names(tag):
            self._places.setdefault(name, []).append(len(stack) - 1)

    @staticmethod
    def _names(tag: str) -> tuple[str, ...]:
        return (tag, "") if tag in BLOCKS and tag != "p" else (tag,)

    def _place(self, *names: str) -> int:
        """Depth of the innermost open element of these tags, 0 if there is none."""
        return max((found[-1] for n in names if (found := self._places.get(n))), default=0)

    def _close(self, stack: list[int], depth: int) -> None:
        if not self.drop[stack[depth]]:
            self._flush(stack[-1])
        while len(stack) > depth:
            node = stack.pop()
            self.last[node] = len(self.blocks)
            if stack:
                for name in self._names(self.tag[node]):
                    self._places[name].pop()

    def _marked(self, tag: str, attributes: str) -> int:
        """The mark of an element, live up to the mark that is lifted."""
        mark = _unlikely(tag, attributes)
        return mark if mark > self.lifted else LIVE

    def _parse(self, page: str) -> None:
        stack, links, at = [0], 0, 0
        find = TOKEN.match
        while m := find(page, at):
            at = m.end()
            tag = m[2]
            if tag is None:
                text = m[0]
                if text[0] != "<" or text == "<":
                    if not self.drop[stack[-1]]:
                        text = html.unescape(text) if "&" in text else text
                        self._text.append(text)
                        if links:
                            self._linked += len(text.strip())
                continue
            tag = tag.lower()
            if m[1]:
                if tag == "a":
                    links = max(0, links - 1)
                if depth := self._place(tag):
                    self._close(stack, depth)
                    if tag in BLOCKS:
                        links = 0
                continue
            if tag == "br":
                if not self.drop[stack[-1]]:
                    self._text.append(" ")
            elif tag == "hr":
                if not self.drop[stack[-1]]:
                    self._flush(stack[-1])
            elif tag == "a":
                links += not m[3].rstrip().endswith("/")
            elif tag in VOID:
                pass
            elif tag in RAW:
                if tag not in EMPTY or not m[3].rstrip().endswith("/"):
                    end = RAW_END[tag].search(page, at)
                    close = page.find(">", end.end()) if end else -1
                    at = close + 1 if close >= 0 else len(page)
            elif tag in BLOCKS:
                if not self.drop[stack[-1]]:
                    self._flush(stack[-1])
                while (depth := self._place("p")) > self._place(""):
                    self._close(stack, depth)
                if tag in CLOSED_BY and (depth := self._place(*CLOSED_BY[tag])) > self._place(*SCOPE[tag]):
                    self._close(stack, depth)
                mark = self._marked(tag, m[3])
                self._open(stack, tag, tag in DROPPED or mark == DROP, mark)
            elif self.drop[stack[-1]] or tag in DROPPED or self._marked(tag, m[3]) > WEAK:
                # an inline element that is dropped: what stands before and after it stays in the block
                if not m[3].rstrip().endswith("/"):
                    self._open(stack, tag, True)
        self._close(stack, 0)


def _points(text: str, link: int) -> float:
    return (1 + text.count(",") + text.count("،") + text.count("、") + min(len(text) // LENGTH, 3)) * (1 - link / len(text))


def _judge(tree: _Page) -> None:
    """Drops the elements that words of their class or id mark, but for those that hold the text of the page.

    An article, an element around the unmarked article or main element with text, and one with at least half of the
    page's points stay, unless its words are those of comments, adverts, notices and the like alone. Where the unlikely
    word is one among others (`related-work`), text that isn't mostly links stays too.
    """
    nodes = len(tree.tag)
    points, prose, linked = [0.0] * nodes, [0] * nodes, [0] * nodes
    for node, text, link in tree.blocks:
        if not tree.drop[node] and tree.tag[node][0] != "h":
            prose[node] += len(text)
            linked[node] += link
            if len(text) >= LEAST and tree.tag[node] != "figcaption":
                points[node] += _points(text, link)
    for n in range(nodes - 1, 0, -1):
        points[tree.parent[n]] += points[n]
        prose[tree.parent[n]] += prose[n]
        linked[tree.parent[n]] += linked[n]
    holds = [False] * nodes
    for n in range(nodes - 1, 0, -1):
        holds[n] = holds[n] or (tree.tag[n] in ("article", "main") and tree.mark[n] < STRONG and not tree.drop[n] and points[n] > 0)
        # what stands among comments or adverts doesn't speak for what is around them
        if holds[n] and tree.mark[n] < STRONG:
            holds[tree.parent[n]] = True
    for n in range(1, nodes):
        if tree.drop[tree.parent[n]]:
            tree.drop[n] = True
        elif WEAK <= tree.mark[n] <= STRONG:
            whole = tree.mark[n] < STRONG and (tree.tag[n] == "article" or holds[n] or (points[n] > 0 and 2 * points[n] >= points[0]))
            tree.drop[n] = tree.drop[n] or not (whole or (tree.mark[n] == WEAK and prose[n] > 0 and linked[n] < 0.25 * prose[n]))


def extract(page: str | None) -> str:
    """Main text of a page: its blocks in page order, joined by line ends.

    Where less than LITTLE characters are left, the page is scored again without a look at words of layouts, and where
    nothing is, without any words of classes and ids.
    """
    if not page:
        return ""
    text = _main_text(page, LIVE)
    if len(text) < LITTLE and any(w in UNLIKELY for w in WORDS.findall(page.lower())):
        again = _main_text(page, WRAP)
        if len(again) >= 4 * len(text):
            text = again
    return text or _main_text(page, STRONG)


def _main_text(page: str, lifted: int) -> str:
    tree = _Page(page, lifted)
    _judge(tree)
    nodes = len(tree.tag)
    live = [not tree.drop[n] for n, _, _ in tree.blocks]
    score, length, linked = [0.0] * nodes, [0] * nodes, [0] * nodes
    for ok, (node, text, link) in zip(live, tree.blocks, strict=True):
        if not ok:
            continue
        length[node] += len(text)
        linked[node] += link
        if len(text) >= LEAST and tree.tag[node][0] != "h" and tree.tag[node] != "figcaption":
            points = _points(text, link)
            # a paragraph's points go to what holds it; a container with text of its own holds it itself
            up = tree.parent[node] if tree.tag[node] in ("p", "pre", "td", "li", "blockquote", "dd") and tree.parent[node] >= 0 else node
            for level in range(5):
                if up < 0:
                    break
                score[up] += points / (1, 2, 6, 9, 12)[level]
                up = tree.parent[up]
    for n in range(nodes - 1, 0, -1):
        length[tree.parent[n]] += length[n]
        linked[tree.parent[n]] += linked[n]
    total = [s * (1 - k / max(t, 1)) + (25 if g in ("article", "main") and s else 0) for s, t, k, g in zip(score, length, linked, tree.tag, strict=True)]
    best = max(range(nodes), key=lambda n: (total[n], -n)) if any(total) else None
    if best is None:  # no paragraph scores: an article or main element, else the page
        best = max((n for n in range(nodes) if tree.tag[n] in ("article", "main") and not tree.drop[n] and length[n]), key=lambda n: (length[n], -n), default=0)
    up = best
    while up > 0:  # parts of one article belong together
        if tree.tag[up] == "article":
            best = up
            break
        up = tree.parent[up]
    chosen = {best}
    if tree.tag[best] not in ("article", "main", "body", "html", "#"):
        bar = max(10.0, 0.2 * total[best])
        for n in range(nodes):
            if tree.parent[n] == tree.parent[best] and n != best and not tree.drop[n] and length[n]:
                density = linked[n] / length[n]
                if total[n] >= bar or (tree.tag[n] == "p" and density < 0.25 and length[n] > 80):
                    chosen.add(n)
    # lists of short links are menus, but for those in an article, where only marks and nav elements tell
    inside = [False] * nodes
    for n in range(1, nodes):
        inside[n] = inside[tree.parent[n]] or tree.tag[n] == "article"
    menu = [False] * nodes
    for n in range(nodes):
        if n not in chosen:
            parts = tree.last[n] - tree.first[n]
            short = tree.tag[n] in ("ul", "ol", "table", "dl") and not inside[n] and parts >= 3 and linked[n] > 0.6 * length[n] and length[n] <= MENU * parts
            menu[n] = short or (n > 0 and menu[tree.parent[n]])
    out = []
    for n in sorted(chosen, key=lambda n: tree.first[n]):
        out += [tree.blocks[b][1] for b in range(tree.first[n], tree.last[n]) if live[b] and not menu[tree.blocks[b][0]]]
    return "\n".join(out)


def extract_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages`, from its whole html.

    A null or empty page has an empty text. Markup without an end runs to the page's end; text without any markup is
    one block. Repeated rows get equal texts; other columns are ignored; an empty table gives an empty result.
    """
    docs = pages.select("page_id", "url", "html")
    id_type = docs.schema["page_id"].dataType.simpleString()

    def make(batch):
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            texts = [extract(p.as_py()) for p in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(docs, make, f"page_id {id_type}, url string, text string, n_chars long")
