"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags.  A block has its text (character
references decoded, white space turned into single spaces), its share of
characters inside links, its share of stop words and its place: inside an
element that never holds the article (navigation, header, footer, sidebar, form,
a hidden element, or one whose class, id or role is a hint), inside ``article`` or
``main``, or neither.

A hint is a whole name of a class or id (``sidebar``, ``cookie-notice``; not
``has-sidebar``).  Names of layout parts give way to an article or main below
them, they and names of teasers to a main or a block below them that is long, no link and
rich in stop words.  Names of adverts, comments and cookie notices give way only
where the page has no text without them.

Pass 1 decides a block on its own: boilerplate if it is excluded or most of it is
links; content if it is long enough and rich in stop words; long blocks without
stop words are boilerplate outside an article; everything else is ambiguous.  On a
page with an ``article`` or ``main``, blocks outside are boilerplate unless their
content by these rules has more characters than all long blocks inside that are no
links; then blocks of an article or main without content are (teasers by a body).
Stop words are those of English, French, German and Spanish: on a page where few
words are such, they say nothing, and long blocks that are no links are content.

Pass 2 gives every ambiguous block the label of its nearest decided neighbours
(content where two at the same distance differ, or, with no neighbour decided,
where it lies in the article or is a heading of a page with nothing else).

Defined cases: null, empty or unreadable markup gives an empty text; an unclosed
comment, script or tag ends with the page; null and repeated page_ids keep their
rows; an empty table gives an empty result; extra columns are not read.  Pages
are read whole; memory is bounded by the largest page of a slice.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

LONG = 70  # characters: shorter blocks without a clear sign are ambiguous
STOP_LOW, STOP_HIGH = 0.15, 0.30
FOREIGN = 0.20  # prose of the languages served has more; Italian or Dutch have about 0.15, others down to none
LINKS = 0.5

# Frequent function words of the languages served.
STOP_WORDS = frozenset("""
a all an and are as at be been but by can for from had has have he her his i if in is it its not of on one or our she so that
the their there they this to was we were what when which who will with would you your
au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que
qui sa se ses son sont sur un une vous
aber als am an auch auf aus bei bin das dass dem den der des die doch du durch ein eine einem einen einer er es für hat ich ihr
im in ist ja mit nach nicht noch nur oder sich sie sind so über um und uns vom von vor war was wie wir wird zu zum zur
al como con del desde donde el ella ellos en entre era es esta este esto fue ha hasta la las lo los más me mi muy no nos o para
pero por porque que se ser si sin sobre su sus también te todo un una y ya
""".split())

# Tags of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp
small span strike strong sub sup time tt u var wbr""".split())
NEVER = frozenset("""nav header footer aside form menu dialog button select option textarea noscript template iframe object
svg math canvas audio video map fieldset datalist""".split())
PLACES = frozenset(("article", "main"))
# Names by what they give way to: an article or most of the page's rich text; a main; a main.
LAYOUT, FIRM, REMARK = 1, 2, 3
HINTS = (
    (REMARK, re.compile(r"ad|ads|advert[a-z]*|adbox|sponsor[a-z]*|cookies?|consent|comments?|commentlist|disqus|replies|reply")),
    (FIRM, re.compile(r"""(?x) promo[a-z]*|related|recommend[a-z]*|footer|notices?|alert[a-z]*|popup|modal|newsletter|subscribe|
contentinfo|copyright|legal|disclaimer""")),
    (LAYOUT, re.compile(r"""(?x) banner|menu[a-z]*|nav|navbar|navigation|breadcrumbs?|sidebar|side|widget[a-z]*|header|masthead|
share|sharing|social|login|signup|search|pagination|pager|complementary""")))
FRAME = frozenset("area bar block box container item items links list main site user wrapper".split())  # parts of a name that change nothing
OF_REMARK = frozenset("body content div section text thread".split())  # the same, beside a name of comments
ONE_DOES = re.compile(r"ad|ads|advert[a-z]*|adbox|sponsor[a-z]*|comments?|commentlist|disqus|replies")  # adverts and comments whatever else the name says
GUARD = frozenset("no not non has with without free open closed count allow allowed enable enabled disable disabled".split())  # but for these
TOKEN = re.compile(r"""(?isx)
    <!--.*?(?:-->|\Z) | <!\[CDATA\[.*?(?:\]\]>|\Z) | <[!?][^>]*(?:>|\Z)
  | <(?P<raw>script|style|title|xmp|noembed|noframes)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)
  | <(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+)>
  | <(?P<close2>/?)(?P<tag2>[a-z][a-z0-9:-]*)[^>]*(?:>|\Z)""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
NO_DISPLAY = re.compile(r"(?i)display\s*:\s*none")
PART = re.compile(r"[-_]+")
WORD = re.compile(r"[^\W\d_]+")
BOILERPLATE, CONTENT, OPEN = 0, 1, 2


def stop_words(text: str) -> tuple[int, int]:
    seen = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in seen), len(seen)


def hint_of(names: str) -> int:
    """The strongest hint among the names of an element, 0 for none."""
    best = 0
    for name in names.lower().split():
        parts = [x for x in PART.split(name) if x]
        kinds = [next((k for k, words in HINTS if words.fullmatch(x)), 0) for x in parts]
        strongest = max(kinds, default=0)
        if strongest <= best:
            continue
        whole = all(k or x in FRAME or strongest == REMARK and (x in OF_REMARK or x.isdigit()) for k, x in zip(kinds, parts, strict=True))
        if whole or any(ONE_DOES.fullmatch(x) for x in parts) and GUARD.isdisjoint(parts):
            best = strongest
    return best


def attributes(rest: str) -> tuple[bool, int]:
    """Whether an element is hidden, and the hint of its names."""
    found = {}
    for name, value in ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), value.strip("\"'"))
    hidden = ("hidden" in found or found.get("aria-hidden", "").strip().lower() == "true"
              or bool(NO_DISPLAY.search(found.get("style", ""))))
    return hidden, hint_of(" ".join(found.get(x, "") for x in ("class", "id", "role")))


def blocks(page: str) -> list[tuple[str, int, bool, int, bool]]:
    """(text, link characters, excluded, place, heading) of all blocks with text, in page order.

    The place is the number of the outermost article or main, 0 outside.  A name excludes what stands below it, unless it
    gives way: names of the layout to an article inside, or, outside any article or main, where they hold more than half of
    the page's rich text (that outside footers, notices, related teasers, adverts and comments); all of them to a main inside."""
    out, stack, words, link = [], [], [], []
    excluded = placed = places = links = heads = 0
    at, hint = 0, -1
    parent, kind, passed, inner = [], [], [], []  # of each hint: the hint around it, its kind, the strongest that it has given way to, its place
    rich = []  # (hint, characters) of the blocks that read like prose

    def give_way(h, strength):
        while h >= 0 and kind[h] <= strength and passed[h] < strength:
            passed[h] = strength
            h = parent[h]

    def flush():
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            if text:
                inside = len(" ".join(html.unescape("".join(link)).split()))
                out.append((text, inside, excluded > 0, places if placed else 0, heads > 0, hint))
                if not excluded and len(text) >= LONG and inside <= LINKS * len(text):
                    rich.append((hint, text))
            words.clear()
            link.clear()

    def leave(entry):
        nonlocal excluded, placed, links, heads, hint
        _, out_of, place, is_link, head, hinted = entry
        hint = parent[hint] if hinted else hint
        excluded, placed, links, heads = excluded - out_of, placed - place, links - is_link, heads - head

    def put(text):
        words.append(text)
        if links:
            link.append(text)

    for m in TOKEN.finditer(page):
        if m.start() > at:
            put(page[at:m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        elif tag == "br":
            put(" ")
        if m["close"] or m["close2"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    for entry in stack[k:]:
                        leave(entry)
                    del stack[k:]
                    break
            continue
        rest = m["rest"] or ""
        if tag in VOID or rest.endswith("/") and tag in ("svg", "iframe"):
            continue
        if tag in ("p", "li", "option", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == tag:
            leave(stack.pop())
        hidden, name = attributes(rest) if rest else (False, 0)
        out_of = tag in NEVER and not (tag == "header" and placed) or hidden
        hinted = name > 0 and tag not in ("html", "body", "main") and (tag != "article" or name >= FIRM)
        place = tag in PLACES and not (hinted and name == REMARK)
        places += place and not placed
        if place and not hinted and not out_of and not excluded:
            give_way(hint, REMARK if tag == "main" else LAYOUT)
        if hinted:
            parent.append(hint)
            kind.append(name)
            passed.append(0)
            inner.append(placed > 0)
            hint = len(kind) - 1
        entry = (tag, int(out_of), int(place), int(tag == "a"), int(tag in ("h1", "h2", "h3", "h4", "h5", "h6")), hinted)
        stack.append(entry)
        excluded, placed, links, heads = excluded + entry[1], placed + entry[2], links + entry[3], heads + entry[4]
    if at < len(page):
        put(page[at:])
    flush()
    holds = [p < k for p, k in zip(passed, kind, strict=True)]
    if any(holds):
        firm = [h and k >= FIRM for h, k in zip(holds, kind, strict=True)]
        for h, around in enumerate(parent):  # a hint stands after the hint around it
            firm[h] = firm[h] or around >= 0 and firm[around]
        total, own = 0, [0] * len(kind)
        for h, text in rich:
            stops, seen = stop_words(text)
            if stops >= STOP_HIGH * max(1, seen) and not (h >= 0 and firm[h]):
                total += len(text)
                while h >= 0:
                    own[h] += len(text)
                    h = parent[h]
        for h, around in enumerate(parent):
            holds[h] = holds[h] and not (kind[h] == LAYOUT and not inner[h] and 2 * own[h] > total) or around >= 0 and holds[around]
    return [(text, inside, out_of or h >= 0 and holds[h], place, head) for text, inside, out_of, place, head, h in out]


def first_pass(found: list[tuple[str, int, bool, int, bool]]) -> list[int]:
    counts = [None if out or inside > LINKS * len(text) else stop_words(text) for text, inside, out, _, _ in found]
    known, total = map(sum, zip((0, 0), *filter(None, counts), strict=True))
    foreign = known < FOREIGN * total
    labels = []
    for (text, _, _, placed, heading), count in zip(found, counts, strict=True):
        if count is None:
            labels.append(BOILERPLATE)
            continue
        stops = count[0] / max(1, count[1])
        if len(text) >= LONG and (foreign and not heading or stops >= (STOP_LOW if placed else STOP_HIGH)):
            labels.append(CONTENT)
        elif len(text) >= 3 * LONG and stops < STOP_LOW and not placed and not heading:
            labels.append(BOILERPLATE)
        else:
            labels.append(OPEN)
    if any(f[3] and not f[2] for f in found):
        outside = sum(len(f[0]) for f, x in zip(found, labels, strict=True) if x == CONTENT and not f[3])
        within = sum(len(f[0]) for f in found if f[3] and not f[2] and len(f[0]) >= LONG and f[1] <= LINKS * len(f[0]))
        kept = {f[3] for f, x in zip(found, labels, strict=True) if x == CONTENT} if outside > within else {f[3] for f in found} - {0}
        labels = [x if f[3] in kept else BOILERPLATE for f, x in zip(found, labels, strict=True)]
    return labels


def second_pass(found: list[tuple[str, int, bool, int, bool]], labels: list[int]) -> list[int]:
    """Ambiguous blocks take the label of the nearest decided blocks; places that never hold the article do not count."""
    n = len(labels)
    usable = [x != OPEN and not f[2] for x, f in zip(labels, found, strict=True)]
    before, after = [None] * n, [None] * n
    last = None
    for k in range(n):
        last = k if usable[k] else last
        before[k] = last
    last = None
    for k in range(n - 1, -1, -1):
        last = k if usable[k] else last
        after[k] = last
    out = list(labels)
    for k in range(n):
        if labels[k] != OPEN:
            continue
        if found[k][3]:  # inside the article only neighbours inside it count
            near = [j for j in (before[k], after[k]) if j is not None and found[j][3]]
        else:
            near = [j for j in (before[k], after[k]) if j is not None]
        if not near:
            out[k] = CONTENT if found[k][3] or CONTENT not in labels else BOILERPLATE
            continue
        least = min(abs(j - k) for j in near)
        out[k] = max(labels[j] for j in near if abs(j - k) == least)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(f[0] for f, x in zip(found, second_pass(found, first_pass(found)), strict=True) if x == CONTENT)


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                          F.col("html").cast("string").alias("html"))

    def make():
        def work(rows: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(x) for x in rows.column("html").to_pylist()]
            return pa.RecordBatch.from_arrays(
                [rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return work

    return map_slices(narrow, "html", "page_id long, url string, text string, n_chars long", make)
