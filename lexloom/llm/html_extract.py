"""Main-text extraction by two-pass block rules.

A page is cut into blocks at block-level tags. Parts whose markup says what they
are (navigation, footers, forms, comments and so on, by tag, role, class or id)
are left out. The first pass calls each other block good, bad, near-good or short
by its length, link density and stop-word density; the second gives undecided
blocks the label of their nearest decided neighbours. Article marks are a weight in
the first pass: inside one, blocks need less length and density and may hold more links.
Where the running text inside outweighs that outside, blocks outside without a content
mark start as bad. In languages without stop words here length decides alone. If the names of classes leave nothing of a page, it is
read again without them.

A page is one row and its work stays in its task: no shuffle, no state. The scan
over the tags is linear in the length of the page.
"""
from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset("""
the of and to in a is that for it was on with as be by at are this from or an not but have had has
he she they we you i his her their its were been which who will would can could there what when all
der die das und in zu den von mit ist im nicht ein eine einer eines dem des auf für sich als auch es
an werden aus er hat dass sie nach wird bei noch wie über so zum war haben nur oder aber vor zur
le la les de des du et en un une est que qui dans pour pas au aux sur par plus ce il elle se ne son
sa ses avec sont ou mais nous vous leur cette ces
el los las del y que una se por con no su para al lo como más pero sus o este ha sí porque esta
entre cuando muy sin sobre también me hasta hay donde
""".split())
SKIP_TAGS = frozenset("script style noscript template svg math iframe object embed canvas audio video head "
                      "nav footer aside form button select option textarea input label fieldset dialog menu "
                      "map title".split())
#: Skipped parts whose text is data to the end tag, not markup.
RAW_TAGS = frozenset("script style noscript template svg math iframe textarea title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset "
                       "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav "
                       "ol optgroup option p pre section summary table tbody td tfoot th thead tr ul "
                       "caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id or role that mark a part as not the article.
BOILER = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar "
    "navigation menu breadcrumb breadcrumbs footer foot masthead topbar sitehead siteheader sidebar side aside "
    "widget cookie cookies consent gdpr notice notices notification alert popup modal overlay subscribe "
    "subscription newsletter signup login share sharing social related recommended comment comments commentlist "
    "disqus respond replies discussion pagination pager tags toolbar search form skip hidden complementary "
    "contentinfo dialog toc".split())
#: Running text: here a name counts as a whole only, since its parts may speak of the text.
TEXT_TAGS = frozenset("p li blockquote".split()) | HEADINGS
HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
READERS = re.compile(r"(?:^|[\s_-])(?:comment|comments|reply|replies)(?:$|[\s_-])", re.I)
#: "has-sidebar" and the like say something of the parts around it.
ABOUT_OTHERS = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without|show|is)[-_]\S*", re.I)
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|articlebody|post|entry|story|content|main|maincontent|text|body)"
                     r"(?:$|[\s_-])", re.I)
WHOLE_TAGS = frozenset("html body main".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)"
                   r"|<[!?][^>]*(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMED = frozenset("class id role itemprop".split())
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
SPACE = re.compile(r"\s+")

#: Pass 1: words of a short and of a long block, link and stop-word densities.
SHORT, LONG, LINKS, STOP_LOW, STOP_HIGH = 6, 20, 0.33, 0.12, 0.25
#: Signs of scripts that set no spaces between words; two count as a word.
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
#: A heading stays with a good block at most this many blocks further on.
HEADING_REACH = 3


def names_boiler(marks: str, tag: str) -> bool:
    """Whether a word of class, id or role, or its first or last part, rules a part out."""
    for word in marks.lower().split():
        if word in BOILER:
            return True
        if tag not in TEXT_TAGS:
            parts = [x for x in re.split("[-_]", word) if x]
            if parts and (parts[0] in BOILER or parts[-1] in BOILER):
                return True
    return False


def attributes_of(text: str) -> tuple[str, bool]:
    """(values of the naming attributes, whether the element is hidden)."""
    marks, hidden = [], False
    for name, a, b, c in ATTRIBUTE.findall(text):
        name, value = name.lower(), a or b or c
        if name in NAMED:
            marks.append(value)
        elif name == "hidden":
            hidden = hidden or value.lower() != "false"
        elif name == "aria-hidden":
            hidden = hidden or value.strip().lower() == "true"
        elif name == "style":
            hidden = hidden or bool(NOT_SHOWN.search(value))
    return " ".join(marks), hidden


def blocks(page: str, by_names: bool = True) -> list[dict]:
    """Text blocks in page order, without the parts that markup rules out: text, link
    (share of characters in links), article (2 in an article, 1 in the main part or in
    an element whose name says so, 0 elsewhere), heading."""
    out: list[dict] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, int]] = []          # tag, skipped, article
    where: dict[str, list[int]] = defaultdict(list)  # places of each tag in the stack
    walls: list[int] = []                            # places of blocks in the stack
    ends: list[int] = []                             # and of those that are no headings
    skipped = links = headings = 0
    article = [0, 0, 0]                              # open elements of each degree
    at, end = 0, len(page)

    def cut(place: int):
        """Close the elements from a place of the stack on."""
        nonlocal skipped, links, headings
        while len(stack) > place:
            tag, skip, degree = stack.pop()
            where[tag].pop()
            if tag in BLOCK_TAGS:
                walls.pop()
                if tag not in HEADINGS:
                    ends.pop()
            skipped -= skip
            article[degree] -= 1
            links -= tag == "a"
            headings -= tag in HEADINGS

    def flush():
        nonlocal parts
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(t for t, _ in parts))).strip()
            if text:
                linked = sum(len(t) for t, is_link in parts if is_link)
                out.append({"text": text, "link": linked / max(1, sum(len(t) for t, _ in parts)),
                            "article": 2 if article[2] else int(article[1] > 0), "heading": headings > 0})
            parts = []

    while at < end:
        token = TOKEN.search(page, at)
        stop = token.start() if token else end
        if stop > at and not skipped:
            parts.append((page[at:stop], links > 0))
        if not token:
            break
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if token[1]:                                                 # end tag
            if tag in BLOCK_TAGS:
                flush()
            # A stray inline end tag does not close blocks around it.
            place = where[tag][-1] if where[tag] else -1
            if place >= 0 and (tag in BLOCK_TAGS or not walls or place > walls[-1]):
                cut(place)
            continue
        if tag in BLOCK_TAGS:
            flush()
        elif tag == "br" and not skipped:
            parts.append((" ", links > 0))
        if tag in VOID_TAGS:
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and ends and stack[ends[-1]][0] == tag:
            cut(ends[-1])        # these end an open one of their kind, and what is open inside it
        attributes = token[3] or ""
        marks, hidden = attributes_of(attributes)
        marks = ABOUT_OTHERS.sub(" ", marks) if by_names else ""
        inside = article[1] + article[2] > 0
        skip = (tag in SKIP_TAGS or tag == "header" and not inside
                or tag == "article" and bool(READERS.search(marks))
                or tag not in WHOLE_TAGS and tag != "article" and bool(
                    names_boiler(marks, tag) or not inside and HEADER.search(marks))
                or hidden)
        degree = 0
        if not skip and tag not in ("html", "body"):
            if tag == "article" or "articlebody" in marks.lower():
                degree = 2
            elif tag == "main" or ARTICLE.search(marks):
                degree = 1
        if tag in RAW_TAGS:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if attributes.rstrip().endswith("/") and tag not in BLOCK_TAGS:
            continue
        where[tag].append(len(stack))
        if tag in BLOCK_TAGS:
            walls.append(len(stack))
            if tag not in HEADINGS:
                ends.append(len(stack))
        stack.append((tag, skip, degree))
        skipped += skip
        article[degree] += 1
        links += tag == "a"
        headings += tag in HEADINGS
    flush()
    return out


def classify(found: list[dict]) -> list[bool]:
    """Which blocks are main text."""
    counts, stops = [], []
    for b in found:
        words = [w.strip(".,;:!?()\"'").lower() for w in b["text"].split()]
        counts.append(len(words) + len(UNSPACED.findall(b["text"])) // 2)
        stops.append(sum(w in STOP_WORDS for w in words))
    running = [b["link"] <= LINKS and n >= LONG for b, n in zip(found, counts)]
    # Text in a language without stop words here is as dense as its length allows.
    known = (sum(k for k, x in zip(stops, running) if x)
             >= STOP_LOW * sum(n for n, x in zip(counts, running) if x))
    density = [k / max(1, n) if known else STOP_HIGH if n >= LONG else STOP_LOW for k, n in zip(stops, counts)]
    dense = [n if x and d >= STOP_LOW else 0 for n, x, d in zip(counts, running, density)]
    inside = sum(n for n, b in zip(dense, found) if b["article"] == 2)
    outweighs = any(b["article"] == 2 for b in found) and inside >= sum(dense) - inside
    labels = []
    for b, n, d in zip(found, counts, density):
        if b["link"] > LINKS and n > 0 and not (b["article"] == 2 and b["link"] < 0.8):
            label = "bad"
        elif outweighs and not b["article"]:
            label = "bad"                     # most of the text is in the marked article
        elif n < SHORT:
            label = "near" if b["article"] == 2 else "short"
        elif d >= STOP_HIGH or b["article"] and n >= LONG:
            label = "good" if n >= LONG or b["article"] else "near"
        elif d >= STOP_LOW:
            label = "good" if b["article"] == 2 else "near"
        else:                                 # in an article it goes by its neighbours
            label = "near" if b["article"] == 2 else "bad"
        labels.append(label)
    decided = list(labels)
    n = len(found)
    before, last = [], "bad"
    for label in labels:
        before.append(last)
        last = label if label in ("good", "bad") else last
    after, last = [""] * n, "bad"
    for i in range(n - 1, -1, -1):
        after[i] = last
        last = labels[i] if labels[i] in ("good", "bad") else last
    for i, label in enumerate(labels):
        if label == "near":                   # one good neighbour is enough
            decided[i] = "good" if "good" in (before[i], after[i]) else "bad"
        elif label == "short":                # both, or a heading above a good block
            near = found[i]["heading"] and any(x == "good" for x in labels[i + 1:i + 1 + HEADING_REACH])
            decided[i] = "good" if near or before[i] == after[i] == "good" else "bad"
    if "good" not in decided and "near" in labels:
        # Nothing was long enough to decide: the running text itself is the article.
        decided = ["good" if x == "near" else d for x, d in zip(labels, decided)]
    elif "good" not in decided:
        # Nor is there running text: short blocks are all that a page may have.
        decided = ["good" if x == "short" else d for x, d in zip(labels, decided)]
    return [d == "good" for d in decided]


def main_text(page: str | None) -> str:
    kept: list[str] = []
    for by_names in (True, False):
        found = blocks(page or "", by_names)
        kept = kept or [b["text"] for b, keep in zip(found, classify(found)) if keep]
        if kept:
            break
    return "\n".join(kept)


def _extract(batches):
    for batch in batches:
        texts = [main_text(p) for p in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row for each page. Null and empty pages
    and pages without main text give an empty text. Repeated rows are kept; null
    ids and URLs pass through. Other columns, whatever their names, are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        F.col(html_col).alias("html"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.mapInArrow(_extract, f"page_id {types['page_id']}, url {types['url']}, "
                                    "text string, n_chars long")
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
