"""Main-text extraction from HTML by two-pass block rules.

Elements that are page furniture by their tag, role or class words are taken off as markup. Of the other
blocks pass 1 decides by link density (bad above MAX_LINK_DENSITY), length (shorter than MIN_WORDS stays
open) and stop-word density (good from MIN_STOP_DENSITY on); a long block of few stop words, such as a table or a list, is
good within an article element and bad outside one. Pass 2 lets each open block inherit
the label of the nearest decided block of its region. The per-page helper reads tags
with one regular expression; Spark deals pages to tasks, and blocks come back as a column.

Class words count by themselves: those of layout ("layout has-sidebar", "nav-wrapper") or of state ("comments-open") say nothing of what is
inside, a header within an article is part of it, and a main element is never furniture. A form is furniture only if it is a part of
the page: not where it holds an article, a heading of the first rank, other furniture, or more than half of the page's words. An element that is never closed, as an
aside before the article, doesn't reach into an article, main element or article's body after it.

Densities overrule markup where markup alone would leave nothing: class words count no more if the text that they took off is most of the page's stop
words, SPARED_WORDS words or more; then forms and asides likewise; and of a page of short blocks alone, which has none decided to inherit from, paragraphs and headings are taken.
Where the open blocks are in a language whose stop words aren't listed (under UNKNOWN_DENSITY over all of them), long blocks are good if they have few links
and a sentence's end. Han, kana and hangul characters count as half a word each, as they stand without blanks.

Defined cases: null or empty html has no blocks and the text is empty. Quotes count only after an equals sign, so a stray
one ends with its tag. Time grows with the page's length, not with its depth. Very long pages are read whole. Unclosed tags, comments,
scripts and truncated pages are read to the end of the page. Repeated rows and null
keys pass through row by row. Other columns stay; those named text and n_chars are replaced.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import without

# Frequent function words of the languages of the corpus.
STOP_WORDS = frozenset(
    """
    a about all also an and are as at be been but by can for from had has have he her his i if in into is it its me my
    no not of on one or our out she so that the their them then there they this to up was we were what when which who
    will with would you your
    aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich
    ihr im in ist kein man mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war was
    wenn werden wie wir zu zum zur
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus
    pour qu que qui sa se ses son sont sur un une vous y à été
    al como con de del desde el ella en entre era es esta este ha la las lo los más me mi muy no o para pero por que se
    ser si sin sobre son su sus también un una y ya yo
    """.split()
)
SKIP = "script|style|noscript|template|svg|math|iframe|object|textarea|select|title|canvas|audio|video"
FURNITURE = frozenset("nav footer aside form menu dialog button fieldset head label input".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th
    thead tr ul button label""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an element of the same kind ends, and the containers within which it does.
AGAIN = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "p": "", "tr": "table", "td": "table tr", "th": "table tr", "option": "select"}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id attributes that mark page furniture.
HINT = re.compile(
    r"ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer\w*|header|masthead|"
    r"cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe\w*|signup|login|share\w*|sharing|social\w*|"
    r"related\w*|recommend\w*|comments?|commentlist|replies|respond|disqus\w*|widget\w*|toolbar|pagination|pager|copyright|legal|hidden"
)
#: Words that make a class name one of layout: it tells of a page's parts, not what an element is.
LAYOUT = frozenset("has have no not with without is are show hide js layout wrapper wrap container page outer inner row grid site main content body open opened closed enabled disabled allowed ready active on off count".split())
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story)[_-]?(?:body|content|text)(?=$|[\s_-])")
ATTRS = r"""(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*"""  # a quote without "=" before it is a character like others
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?P<skip>{SKIP})\b(?>{ATTRS})(?:(?<=/)>|>.*?(?:</(?P=skip)\s*>|\Z)|\Z)|"
    rf"<(?P<close>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?>{ATTRS}))(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTR = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

MIN_WORDS = 12
MIN_STOP_DENSITY = 0.15
MAX_LINK_DENSITY = 0.5
SPARED_WORDS = 60
UNKNOWN_DENSITY = 0.10
#: Characters of scripts without blanks between words, and the ends of sentences.
DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af]")
SENTENCE = re.compile(r"[.!?…。！？]")
#: Blocks that hold text of their own, however short.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
SCHEMA = "array<struct<text:string,label:string,words:int,stop_density:double,link_density:double,region:string,rule:string>>"


def hinted(names: str, in_article: bool) -> bool:
    """Whether class and id names mark page furniture."""
    for name in names.split():
        words = [w for w in re.split(r"[_-]+", name) if w]
        if LAYOUT.isdisjoint(words) and any(HINT.fullmatch(w) and not (in_article and w in ("header", "masthead")) for w in words):
            return True
    return False


@dataclass
class Mark:
    """An element that may be furniture or an article."""

    parent: int
    tag: str
    reason: str  # why it may be furniture
    article: bool
    closed: bool = False
    words: int = 0
    stops: int = 0
    holds: set[str] = field(default_factory=set)  # article, h1, furniture


def mark_of(tag: str, attrs: str, parent: int) -> Mark | None:
    """What an element may be by its tag and attributes; null if it says nothing."""
    found = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in ATTR.finditer(attrs)} if attrs.strip() else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    article = tag in ("article", "main") or role == "main" or found.get("itemprop") == "articleBody" or bool(ARTICLE.search(names))
    if tag in ("form", "aside"):
        reason = tag
    elif tag in FURNITURE or role in ROLES or hidden:
        reason = "tag"
    elif tag == "header":
        reason = "header"
    elif tag == "main" or role == "main" or tag in ("html", "body") or not hinted(names, False):
        reason = ""
    else:
        reason = "class" if hinted(names, True) else "header class"
    return Mark(parent, "main" if role == "main" else tag, reason, article) if reason or article else None


def regions_of(marks: list[Mark], words: int, ignored: frozenset[str]) -> list[str]:
    """The region of each marked element, parents first; reasons that are ignored don't count."""
    out: list[str] = []
    for m in marks:
        outer = out[m.parent] if m.parent >= 0 else "page"
        reason = m.reason if m.reason not in ignored else ""
        if outer == "boilerplate":
            free = m.tag == "main" or (m.article and reason == "" and not marks[m.parent].closed and marks[m.parent].reason in ("aside", "tag", "form"))
            out.append("article" if free else outer)
        elif reason == "form":
            wraps = m.holds or 2 * m.words > words
            out.append(outer if wraps else "boilerplate")
        elif reason in ("tag", "aside", "class") or (reason in ("header", "header class") and outer != "article"):
            out.append("boilerplate")
        else:
            out.append("article" if m.article else outer)
    return out


def read(page: str) -> tuple[list[dict], list[Mark]]:
    """Text blocks in page order with word count, stop-word and link density, and the nearest marked element."""
    out: list[dict] = []
    marks: list[Mark] = []
    stack: list[tuple[str, int, int]] = []  # (tag, nearest mark, own mark)
    parts: list[str] = []
    linked = 0
    opened: Counter[str] = Counter()  # open elements by tag, so that no token searches the stack in vain

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            words = text.lower().split()
            stops = sum(w.strip(".,;:!?\"'()[]#*$%&|«»") in STOP_WORDS for w in words)
            n = len(words) + len(DENSE.findall(text)) // 2
            at = stack[-1][1] if stack else -1
            out.append({"text": text, "words": n, "stops": stops, "stop_density": stops / n, "link_density": min(1.0, linked / len(text)), "at": at, "tag": stack[-1][0] if stack else ""})
            if at >= 0:
                marks[at].words += n
                marks[at].stops += stops
        parts.clear()
        linked = 0

    def close(at: int, own: bool) -> None:
        if any(t in BLOCKS for t, _, _ in stack[at:]):
            flush()
        if own and stack[at][2] >= 0:
            marks[stack[at][2]].closed = True
        opened.subtract(t for t, _, _ in stack[at:])
        del stack[at:]

    for m in TOKEN.finditer(page):
        text = m["text"] if m["text"] is not None else m["cdata"]
        if text is not None:
            text = html.unescape(text) if m["cdata"] is None else text
            parts.append(text)
            if opened["a"]:
                linked += len(" ".join(text.split()))
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None) if opened[tag] else None
            if at is not None:
                close(at, True)
            elif tag in BLOCKS:
                flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            for kind in (k for k in {"p", tag} & AGAIN.keys() if opened[k]):  # a block ends an open paragraph; an item ends the item before
                walls = AGAIN[kind].split() or ["td", "th", "li", "div", "section", "article", "blockquote", "body", "main", "aside", "nav", "footer", "header", "form"]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == kind:
                        close(i, True)
                        break
                    if stack[i][0] in walls:
                        break
        opened[tag] += 1
        near = stack[-1][1] if stack else -1
        mark = mark_of(tag, m["attrs"], near)
        if mark:
            marks.append(mark)
        if tag == "h1" and near >= 0:
            marks[near].holds.add("h1")
        stack.append((tag, len(marks) - 1 if mark else near, len(marks) - 1 if mark else -1))
    flush()
    for i in range(len(marks) - 1, -1, -1):  # what an element holds, its parent holds too
        m = marks[i]
        if m.parent >= 0:
            up = marks[m.parent]
            up.words, up.stops = up.words + m.words, up.stops + m.stops
            up.holds |= m.holds | ({"article"} if m.article and m.reason == "" else set()) | ({"furniture"} if m.tag in ("nav", "header", "footer", "aside") else set())
    return out, marks


def blocks_of(page: str, ignored: frozenset[str] = frozenset()) -> list[dict]:
    """The blocks with their region."""
    blocks, marks = read(page)
    return placed(blocks, marks, ignored)


def placed(blocks: list[dict], marks: list[Mark], ignored: frozenset[str]) -> list[dict]:
    region = regions_of(marks, sum(b["words"] for b in blocks), ignored)
    return [b | {"region": region[b["at"]] if b["at"] >= 0 else "page"} for b in blocks]


def first_pass(b: dict, known: bool = True) -> tuple[str, str]:
    """Label and rule; known: the page's language is one whose stop words are listed."""
    if b["region"] == "boilerplate":
        return "bad", "furniture"
    if b["link_density"] > MAX_LINK_DENSITY:
        return "bad", "links"
    if b["words"] < MIN_WORDS:
        return "", "short"
    if b["stop_density"] >= MIN_STOP_DENSITY:
        return "good", "stop words"
    if not known and SENTENCE.search(b["text"]):
        return "good", "sentences"
    return ("good", "article") if b["region"] == "article" else ("bad", "few stop words")


def classify(blocks: list[dict]) -> list[dict]:
    """Both passes; adds label and rule."""
    open_blocks = [b for b in blocks if b["region"] != "boilerplate" and b["link_density"] <= MAX_LINK_DENSITY and b["words"] >= MIN_WORDS]
    known = sum(b["stops"] for b in open_blocks) >= UNKNOWN_DENSITY * sum(b["words"] for b in open_blocks)
    for b in blocks:
        b["label"], b["rule"] = first_pass(b, known)
    decided = {}  # by region: places of decided blocks
    for i, b in enumerate(blocks):
        if b["label"]:
            decided.setdefault(b["region"], []).append(i)
    for i, b in enumerate(blocks):
        if not b["label"]:
            near = decided.get(b["region"], [])
            if near:
                at = bisect(near, i)
                sides = near[max(0, at - 1) : at + 1]
                gap = min(abs(i - j) for j in sides)
                labels = {blocks[j]["label"] for j in sides if abs(i - j) == gap}
                b["inherit"] = "good" if "good" in labels else "bad"
            else:
                b["inherit"] = "good" if b["region"] == "article" else "bad"
    for b in blocks:
        b["label"] = b["label"] or b.pop("inherit")
    return blocks


def labelled(page: str) -> list[dict]:
    """The page's blocks, judged by markup and densities, and by densities against markup where that leaves nothing."""
    blocks, marks = read(page)
    first = classify(placed(blocks, marks, frozenset()))
    if any(b["label"] == "good" for b in first):
        return first
    stops = sum(b["stops"] for b in blocks if b["link_density"] <= MAX_LINK_DENSITY)
    for ignored in (frozenset({"class", "header class"}), frozenset({"class", "header class", "form", "aside"})):
        again = classify(placed(blocks, marks, ignored))
        good = [b for b in again if b["label"] == "good"]
        if sum(b["words"] for b in good) >= SPARED_WORDS and 2 * sum(b["stops"] for b in good) >= stops:
            return again
    short = [b for b in first if b["region"] != "boilerplate" and b["rule"] == "short" and b["tag"] in TEXT_TAGS and b["link_density"] <= MAX_LINK_DENSITY]
    for b in short if any(b["tag"] == "p" for b in short) else []:
        b["label"], b["rule"] = "good", "text element"
    return first


def with_blocks(pages: DataFrame, column: str = "blocks") -> DataFrame:
    """The pages with their labelled blocks, in page order."""

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda page: labelled(page or ""))

    return pages.withColumn(column, run("html"))


def extract(pages: DataFrame) -> DataFrame:
    """The pages' columns with text (good blocks, one per line) and n_chars."""
    rows = with_blocks(without(pages, "text", "n_chars", "__dl_blocks"), "__dl_blocks")
    good = F.filter("__dl_blocks", lambda b: b["label"] == "good")
    text = F.array_join(F.transform(good, lambda b: b["text"]), "\n")
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).drop("__dl_blocks")
