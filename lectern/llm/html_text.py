"""Main text of web pages by consensus paths of their hosts.

Every page is cut into containers, each with the generalised path of its tags and classes
(digits in classes don't count). A container scores by the text it holds directly in
blocks, less what stands in links; the pages of a host vote for the path of their best
container, in Spark. They also vote on containers whose class may or may not mean page
furniture (related, form, search and the like, or a furniture word beside a word of another
kind, as in menu-planning): for leaving it out where half of its text stands in links. Pages
are then read again by their host's votes: a page takes the path of most votes under which it
has text (ties: the first in path order), and leaves out what most pages of the host want
left out. Where that path holds less than a fifth of what the page's own best container
does, the page takes its own, unless most pages that have such a container chose another.

Navigation, forms, scripts and the like are left out wherever they stand, by tag or role, and
so are elements whose class or id is made of furniture words alone, or of these and words
for parts of pages (promo-content, modal-body). The header of an article is no furniture
by its tag, so headlines stay. Character references are decoded, white space (no-break
spaces too, but not U+200B) inside a block becomes one space, blocks are joined by one space.

Null, empty or unparsable html gives the empty text; html that ends early is read to its
end. A page whose url names no host votes in a group of its own, with null urls. Repeated
rows each get a row and a vote; an empty table gives none. Other columns are ignored,
whatever their names. Work is linear in the length of a page, also in its nesting.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.groups import join_groups
from lectern.session import bounded_batches, materialise

#: Voted paths that are sent along with a host's pages; pages of hosts with more look their
#: paths up by a join, with the same results.
PATHS_IN_ROW = 64

# Elements without content, elements that are dropped whole, block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "script style noscript template svg math head title nav header footer aside form button select option textarea input"
    " iframe object canvas audio video dialog menu fieldset label".split()
)
BLOCK = frozenset(
    "address article aside blockquote body br center dd details div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr html"
    " li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset(["script", "style", "noscript", "template", "textarea", "title", "iframe"])
#: Elements that a text block of theirs may be counted for.
CONTAINER = frozenset("article main section div body td html".split())
#: Words for page furniture in class, id or role.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsors sponsored sponsorship promo promos promotion promotions banner banners cookie cookies consent gdpr"
    " notice notices popup popups modal newsletter newsletters subscribe subscription subscriptions nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars"
    " aside widget widgets comment comments commentlist reply replies respond disqus header masthead footer copyright contentinfo complementary toolbar hidden".split()
)
#: Furniture that no other class makes an article of.
OTHERS_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos comment comments commentlist reply replies".split())
#: Words for the article, and for parts and places of pages: beside furniture they don't make another meaning.
ARTICLE_WORDS = frozenset("article post entry story main content body text".split())
PART_WORDS = ARTICLE_WORDS | frozenset(
    "wrapper wrap container box block area section inner outer item items list row col column slot unit group panel holder bar top bottom left right center first last primary secondary title"
    " heading message label info inline fixed sticky mobile desktop small large page site global module component image link links script style overlay dialog form button region zone".split()
)
#: What tells that a page or element has or allows furniture, not that it is some.
STATE_WORDS = frozenset("open closed on off allowed enabled disabled has with no without not is".split())
#: Words that may mean page furniture or the article's own subject: the host's pages decide.
DOUBTFUL = re.compile(
    r"(?:^|[\s_-])(?:related|recommend\w*|share|sharing|social|search|form|login|signup|legal|foot|skip\w*|tags?|alert|overlay|more|popular|links?)(?:$|[\s_-])", re.I
)
#: Words that overrule these in the class of an element that holds the article.
WANTED = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main|content|body|text)(?:$|[\s_-])", re.I)
#: A page takes its own best container where the voted one holds less than this part of it.
LEAST_SHARE = 0.2

# After an equals sign a quote opens a value; elsewhere it is a sign like others.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|\Z)", re.S
)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_KNOWN = frozenset("class id role hidden aria-hidden style itemprop itemtype".split())
_BLANK = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")


class Place:
    """A container path: its last step, and the path above it; ``doubtful`` where the host decides.

    Pages know a path by ``key``, a 64-bit hash of its steps, so that work doesn't grow with nesting.
    """

    __slots__ = ("above", "step", "below", "number", "doubtful", "key")

    def __init__(self, above: Place | None, step: str, number: int, doubtful: bool):
        self.above, self.step, self.number, self.doubtful, self.below = above, step, number, doubtful, {}
        self.key = xxhash.xxh3_64_intdigest(above.key.to_bytes(8, "little", signed=True) + step.encode()) - (1 << 63) if above else 0

    def path(self) -> str:
        steps, at = [], self
        while at.above is not None:
            steps.append(at.step)
            at = at.above
        return "/".join(reversed(steps))


class _Open:
    __slots__ = ("tag", "place", "dropped", "link", "article")

    def __init__(self, tag, place, dropped, link, article):
        self.tag, self.place, self.dropped, self.link, self.article = tag, place, dropped, link, article


def _attributes(raw: str) -> dict[str, str]:
    if not raw or not raw.strip():
        return {}
    found = {}
    for m in _ATTR.finditer(raw):
        if (name := m[1].lower()) in _KNOWN:
            found.setdefault(name, html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _step(tag: str, attrs: dict[str, str]) -> str:
    classes = sorted({_DIGITS.sub("", c).strip("-_").replace("/", "") for c in attrs.get("class", "").lower().split()} - {""})
    return ".".join([tag, *classes])


def _words(attrs: dict[str, str]) -> str:
    return " ".join((attrs.get("class", ""), attrs.get("id", ""), attrs.get("role", "")))


_PARTS = re.compile(r"[^\W\d_]+")
_KEEP, _ASK, _DROP = 0, 1, 2


def _token_kind(token: str) -> tuple[int, bool]:
    """Whether a class or id is furniture, may be, or isn't, and whether nothing overrules that."""
    parts = [x for x in _PARTS.findall(token.lower()) if len(x) > 1]
    found = [x for x in parts if x in FURNITURE]
    if not found or any(x in STATE_WORDS for x in parts):
        return _KEEP, False
    if any(x not in FURNITURE and x not in PART_WORDS for x in parts) or set(found) == {"header"} and any(x in ARTICLE_WORDS for x in parts):
        return _ASK, False
    return _DROP, any(x in OTHERS_WORDS for x in found)


def _kind(tag: str, attrs: dict[str, str], in_article: bool) -> int:
    """Whether an element is left out, kept, or left to the votes of its host."""
    if tag in DROPPED and not (tag == "header" and in_article):
        return _DROP
    if tag in ("html", "body"):
        return _KEEP
    words = _words(attrs) if attrs else ""
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return _DROP
    if "comment" in attrs.get("itemprop", "").lower() or attrs.get("itemtype", "").lower().rstrip("/").endswith("comment"):
        return _DROP
    kinds = [_token_kind(t) for t in words.split()]
    if tag in ("article", "main"):
        return _DROP if (_DROP, True) in kinds else _KEEP
    most = max(kinds, default=(_KEEP, False))
    names_article = any(k == _KEEP and (p := _PARTS.findall(t.lower())) and all(x in PART_WORDS for x in p) and not ARTICLE_WORDS.isdisjoint(p) for t, (k, _) in zip(words.split(), kinds, strict=True))
    if most[0] == _DROP:
        return _ASK if names_article and not most[1] else _DROP
    if most[0] == _ASK or tag == "header":
        return _ASK
    return _ASK if DOUBTFUL.search(words) and not WANTED.search(words) else _KEEP


def blocks(page: str) -> tuple[list[Place], list[tuple[Place, str, int]]]:
    """The container places of a page, and (place, text, characters in links) of each block of text, in page order.

    A place comes after the one above it; all text of elements that are dropped is missing.
    """
    root = Place(None, "", 0, False)
    places = [root]
    stack: list[_Open] = [_Open("", root, False, False, False)]
    parts: list[str] = []
    links = 0
    at = 0
    out = []

    def flush():
        nonlocal parts, links
        if parts:
            text = _BLANK.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((stack[-1].place, text, links))
        parts, links = [], 0

    def add(raw):
        nonlocal links
        top = stack[-1]
        if raw and not top.dropped:
            parts.append(raw)
            if top.link:
                links += len(raw.strip())

    def close(tag):
        if not open_tags.get(tag):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                if any(x.tag in BLOCK for x in stack[i:]) or stack[i].place is not stack[i - 1].place:
                    flush()
                cut(i)
                return
            if stack[i].tag in ("article", "main", "body", "html", "table") and tag not in BLOCK:
                return

    open_tags: dict[str, int] = {}

    def cut(i):
        for x in stack[i:]:
            open_tags[x.tag] -= 1
        del stack[i:]

    def imply(tags, limit):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in limit:
                return
            if stack[i].tag in tags:
                cut(i)
                return

    size, find = len(page), _TAG.search
    while at < size:
        m = find(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            close(tag)
            continue
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        # Elements whose end tag may be missing.
        if tag == "li":
            imply(("li",), ("ul", "ol"))
        elif tag in ("td", "th", "tr"):
            imply(("td", "th") if tag != "tr" else ("td", "th", "tr"), ("table",))
        elif tag in ("dt", "dd"):
            imply(("dt", "dd"), ("dl",))
        if tag in BLOCK and open_tags.get("p"):
            while stack[-1].tag == "p" or (stack[-1].tag not in BLOCK and _in_p(stack)):
                cut(len(stack) - 1)
        top = stack[-1]
        attrs = _attributes(m[3])
        kind = _DROP if top.dropped else _kind(tag, attrs, top.article)
        place, dropped, doubtful = top.place, kind == _DROP, kind == _ASK and tag in BLOCK
        if tag in CONTAINER or doubtful:
            step = _step(tag, attrs)
            place = place.below.get((step, doubtful))
            if place is None:
                place = top.place.below[step, doubtful] = Place(top.place, step, len(places), doubtful)
                places.append(place)
        if m[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}\\b", re.I).search(page, at)
            at = end.start() if end else size
        if place is not top.place:
            flush()
        stack.append(_Open(tag, place, dropped, top.link or tag == "a", top.article or tag in ("article", "main")))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return places, out


def _in_p(stack) -> bool:
    for x in reversed(stack):
        if x.tag == "p":
            return True
        if x.tag in BLOCK:
            return False
    return False


def _sums(places: list[Place], own: list[float]) -> list[float]:
    """Each place's value and all those below it."""
    total = list(own)
    for p in reversed(places):
        if p.above is not None:
            total[p.above.number] += total[p.number]
    return total


def best_place(places: list[Place], found) -> Place | None:
    """The container with the most text of its own, links counted against it.

    A container also answers for what stands in containers inside it, at a discount.
    """
    own, holds = [0.0] * len(places), [False] * len(places)
    for place, text, links in found:
        own[place.number] += len(text) - 2 * links
        holds[place.number] = True
    below = _sums(places, own)
    best, most = None, (0.0, 0)
    depth = [0] * len(places)
    for p in places[1:]:
        depth[p.number] = depth[p.above.number] + 1
        names_article = p.step.split(".")[0] in ("article", "main")
        if not (holds[p.number] or names_article):
            continue
        total = own[p.number] + 0.8 * (below[p.number] - own[p.number])
        rank = (total + 50 * names_article, -depth[p.number])
        if total > 0 and (best is None or rank > most):
            best, most = p, rank
    return best


def ballot(page: str) -> list[tuple[str, int, int, int]]:
    """(path key, 1 for the best container, 1 or -1 for leaving a doubtful container out or not, 1 for having text) of a page's containers with text."""
    places, found = blocks(page)
    chars, links = [0] * len(places), [0] * len(places)
    for place, text, linked in found:
        chars[place.number] += len(text)
        links[place.number] += linked
    chars, links = _sums(places, chars), _sums(places, links)
    best = best_place(places, found)
    side = lambda p: (1 if 2 * links[p.number] >= chars[p.number] else -1) if p.doubtful else 0
    return [(p.key, int(p is best), side(p), 1) for p in places[1:] if chars[p.number]]


def main_text(page: str, votes: list[tuple[str, int, int, int]]) -> str:
    """Text of the blocks inside the most voted path under which the page has text, or inside its own best.

    ``votes`` has (path key, pages that found it best, pages for less pages against leaving it
    out, pages that have text there).
    """
    places, found = blocks(page)
    counts = {key: x for key, *x in votes}
    told, gone = [(0, 0, 0)] * len(places), [False] * len(places)
    for p in places[1:]:
        told[p.number] = counts.get(p.key, (0, 0, 0))
        gone[p.number] = gone[p.above.number] or told[p.number][1] > 0
    chars = [0] * len(places)
    for place, text, _ in found:
        chars[place.number] += 0 if gone[place.number] else len(text)
    chars = _sums(places, chars)
    target, most = None, 0
    for p in places[1:]:
        main = told[p.number][0]
        if chars[p.number] and (main > most or (main and main == most and p.path() < target.path())):
            target, most = p, main
    own = best_place(places, found)
    if target is None:
        target = own
    elif own is not None and chars[target.number] < LEAST_SHARE * chars[own.number]:
        main, _, seen = told[own.number]
        target = own if 2 * main >= seen else target
    inside = [target is None] + [False] * (len(places) - 1)
    for p in places[1:]:
        inside[p.number] = inside[p.above.number] or p is target or (target is not None and p.step == target.step and p.above is target.above)
    return " ".join(t for p, t, _ in found if inside[p.number] and not gone[p.number])


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def host_votes(pages: DataFrame) -> DataFrame:
    """host, key (of a path), main (pages that found it best), side (pages for leaving it out, less those against) and seen (pages with text there).

    Only paths that some page found best or that most want left out are told.
    """
    bounded_batches(pages.sparkSession, 500)

    def vote(batches):
        for batch in batches:
            rows = [(h, *v) for h, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if x for v in ballot(x)]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = [pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "key", "main", "side", "seen"])

    votes = pages.select(host_of().alias("host"), "html").mapInArrow(vote, "host string, key long, main long, side long, seen long")
    return votes.groupBy("host", "key").agg(*[F.sum(c).alias(c) for c in ("main", "side", "seen")]).where("main > 0 or side > 0")


_TEXT = "page_id long, url string, text string, n_chars long"


def _read(batches):
    """Text of rows with page_id, url, html and votes."""
    for batch in batches:
        rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        text = [main_text(h, [(v["key"], v["main"], v["side"], v["seen"]) for v in votes or []]) if h else "" for h, votes in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame, paths_in_row: int = PATHS_IN_ROW) -> DataFrame:
    """Per row: page_id, url, text and n_chars."""
    votes = materialise(host_votes(pages))
    bounded_batches(pages.sparkSession, 500)
    whole = pages.select(F.col("page_id").cast("long"), "url", "html", host_of().alias("host"))
    per_host = votes.groupBy("host").agg(F.count("*").alias("paths"))
    few = votes.join(per_host.where(F.col("paths") <= paths_in_row), "host", "left_semi")
    vote = F.collect_list(F.struct("key", "main", "side", "seen")).alias("votes")
    many = per_host.where(F.col("paths") > paths_in_row).select("host")
    # Hosts with a thousandth of all pages or more are few: their paths are sent to every task, and no key of the join is hot.
    hosts = whole.groupBy("host").agg(F.count("*").alias("host_rows")).join(few.groupBy("host").agg(vote), "host", "left")
    plain = join_groups(whole, hosts.join(many, "host", "left_anti"), ["host"], "host_rows")
    text = plain.select("page_id", "url", "html", "votes").mapInArrow(_read, _TEXT)
    if many.isEmpty():
        return text
    # Pages of hosts with many paths ask for the votes on their own paths only.
    rows = materialise(whole.join(many, "host", "left_semi").withColumn("row", F.monotonically_increasing_id()))

    def own_paths(batches):
        for batch in batches:
            out = [(row, host, p) for row, host, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) if x for p in {p.key for p in blocks(x)[0][1:]}]
            columns = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.string(), pa.int64()], strict=True)], names=["row", "host", "key"])

    asked = rows.select("row", "host", "html").mapInArrow(own_paths, "row long, host string, key long")
    told = asked.join(votes, ["host", "key"]).groupBy("row").agg(vote)
    crowded = rows.join(told, "row", "left").select("page_id", "url", "html", "votes").mapInArrow(_read, _TEXT)
    return text.unionByName(crowded)
