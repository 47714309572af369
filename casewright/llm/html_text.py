"""Main text of web pages by composite text density (operator 7)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import sub_batches

# Element kinds of HTML, and the words that name page furniture in class and id attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("html body caption option optgroup legend tbody td tfoot th thead tr".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
UNREAD_TAGS = frozenset("head script style noscript template iframe svg canvas audio video datalist annotation annotation-xml".split())
FURNITURE_TAGS = frozenset("nav footer aside dialog menu".split())
CONTROLS = frozenset(("button", "textarea", "select"))  # text of an article, furniture elsewhere
FURNITURE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus "
    "footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion replies responses sidebar sponsor "
    "sponsored subscribe".split()
)
#: These name furniture but for an element of an article that holds paragraphs and few links.
LINK_WORDS = frozenset("related share sharing skip social toolbar topbar widget".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
#: Words of a class that say that something is absent or elsewhere, or a state; and words behind the one that names the thing.
STATES = frozenset("no not non without with has have is hide hides hidden show shows disable disabled enable enabled".split())
PLACES = frozenset(
    "left right top bottom main primary secondary first last inner outer wrap wrapper container content box area block section row col column list item items "
    "links icons buttons posts articles entries body header title bar panel form signup slot unit small large mobile desktop sticky fixed global".split()
)
CONTENT = frozenset(("article", "main", "h1"))
MARKED = frozenset(("article", "main"))
WORDS = re.compile(r"[a-z]+")
COMMENT_END = re.compile("--!?>")
#: Of these, what others write into an article, in its own boxes; other names may be of a box of the article itself.
OTHERS_WORDS = frozenset("ad ads adbox advert adverts advertisement advertising comment comments disqus replies responses sponsor sponsored".split())
#: What an element's names say: nothing, that it may be furniture (see LINK_WORDS, FURNITURE_WORDS, OTHERS_WORDS; judged
#: inside an article by :func:`own_parts`), or that it is (its role, or hidden).
PLAIN, LINKS, NAMED, OTHERS, FURNITURE = 0, 1, 2, 3, 4
#: Elements that an article's own prose may be in, whatever they are called; and what is in threads and boxes but not in prose.
PROSE_TAGS, BOX_TAGS = frozenset(("p", "blockquote", "section", "div")), frozenset("div article li time header footer cite form input button textarea select iframe".split())
#: A paragraph of an article is at least so long, as a part of its mean paragraph; a div of its own has at least so much of its text.
PARAGRAPH, SHARE = 1 / 2, 1 / 4
#: Share of linked characters from which an element named by LINK_WORDS is furniture.
LINKED = 1 / 3


def names_furniture(token: str) -> int:
    """What a class or id as a whole names: by its last word but for PLACES, and nothing if it has one of STATES."""
    words = [w for w in WORDS.findall(token) if len(w) > 1]
    if not STATES.isdisjoint(words):
        return PLAIN
    while len(words) > 1 and words[-1] in PLACES and words[-1] not in FURNITURE_WORDS:
        words.pop()
    return PLAIN if not words else OTHERS if words[-1] in OTHERS_WORDS else NAMED if words[-1] in FURNITURE_WORDS else LINKS if words[-1] in LINK_WORDS else PLAIN


class Tree(HTMLParser):
    """The elements of a page in document order, as lists, and its texts, each with its element; None where a block begins or ends."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.noise = ["#root"], [-1], [PLAIN]
        self.texts: list[tuple[int, str | None]] = []
        self.open, self.held = [0], {"#root": 1}
        self.feed(html)
        self.close()

    def shut(self, depth: int) -> None:
        for node in reversed(self.open[depth:]):
            self.held[self.tag[node]] -= 1
            if self.tag[node] in BLOCK:
                self.texts.append((node, None))
        del self.open[depth:]

    def shut_tag(self, tags: tuple[str, ...], barrier: tuple[str, ...]) -> None:
        if not any(self.held.get(t) for t in tags):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            t = self.tag[self.open[depth]]
            if t in tags:
                self.shut(depth)
                return
            if t in barrier:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and self.held.get(tag):
            return
        if tag == "body":
            self.shut_tag(("head",), ())
        if tag in CLOSES_P:
            self.shut_tag(("p",), ("button", "td", "th", "table", "caption", "object"))
        if tag in SAME:
            self.shut_tag(SAME[tag], ("ul", "ol", "dl", "select", "table", "menu"))
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.noise.append(self.named_noise(tag, dict(attrs)) if attrs else PLAIN)
        if tag in BLOCK:
            self.texts.append((len(self.tag) - 1, None))
        if tag not in VOID:
            self.open.append(len(self.tag) - 1)
            self.held[tag] = self.held.get(tag, 0) + 1
        elif tag == "br":
            self.texts.append((self.open[-1], "\n"))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not self.held.get("p"):  # an empty paragraph
            self.texts.append((self.open[-1], None))
        elif tag not in ("html", "body"):
            self.shut_tag((tag,), () if tag in BLOCK else tuple(BLOCK))

    def handle_data(self, data: str) -> None:
        self.texts.append((self.open[-1], data))

    # Whatever is malformed reaches as far as browsers take it: to the next >, a comment to its end, all to the end of the page.

    def parse_comment(self, i: int, report: int = 1) -> int:
        end = COMMENT_END.search(self.rawdata, i + 2)
        return end.end() if end else len(self.rawdata)

    def parse_bogus_comment(self, i: int, report: int = 1) -> int:
        return self.rawdata.find(">", i + 2) + 1 or len(self.rawdata)

    parse_html_declaration = parse_pi = parse_bogus_comment

    def parse_starttag(self, i: int) -> int:
        end = super().parse_starttag(i)
        return end if end >= 0 else len(self.rawdata)

    def parse_endtag(self, i: int) -> int:
        end = super().parse_endtag(i)
        return end if end >= 0 or self.cdata_elem else len(self.rawdata)

    @staticmethod
    def named_noise(tag: str, attrs: dict[str, str | None]) -> int:
        if tag in ("html", "body", "main"):
            return PLAIN
        if (attrs.get("role") or "").lower() in FURNITURE_ROLES or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
            return FURNITURE
        return max(map(names_furniture, f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split()), default=PLAIN)


def density(c: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density: characters per tag, times the logarithm of (characters / link characters) * (tags / link tags)
    to a base that grows with the element's links and with ``share``, the page's share of link characters.
    """
    t, lc, lt = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(c / max(c - link_chars, 1) * link_chars + share * c + math.e)
    return c / t * math.log(max(c / lc * t / lt, 1.0)) / max(math.log(base), 0.1)  # without any link the base is 1


def densities(tree: Tree, drop: list[bool]) -> tuple[list[float], list[float], list[bool], float]:
    """Density of every element, the sum over its children (its own where it has none), what is linked, and the page's share of link characters."""
    n = len(tree.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    linked = [False] * n
    for i in range(1, n):
        linked[i] = tree.tag[i] == "a" or linked[tree.parent[i]]
    for i, t in tree.texts:
        if t and not drop[i]:
            size = len(" ".join(t.split()))
            chars[i] += size
            link_chars[i] += size * linked[i]
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        if not drop[i]:
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (tree.tag[i] == "a")
    share = link_chars[0] / max(chars[0], 1)
    own, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if chars[i] and not drop[i]:
            own[i] = density(chars[i], tags[i], link_chars[i], link_tags[i], share)
            if not tags[i]:
                total[i] = own[i]
        if i and not drop[i]:
            total[tree.parent[i]] += own[i]
    return own, total, linked, share


def run_density(run: list[tuple[int, str]], above: set[int], tree: Tree, linked: list[bool], share: float) -> float:
    """Density of a stretch of text between two block borders that stands directly in an ancestor, with the inline elements in it."""
    inline: set[int] = set()
    chars = link_chars = 0
    for i, t in run:
        size = len(" ".join(t.split()))
        chars += size
        link_chars += size * linked[i]
        while i not in above and i >= 0 and i not in inline:
            inline.add(i)
            i = tree.parent[i]
    return density(chars, len(inline), link_chars, sum(tree.tag[i] == "a" for i in inline), share) if chars else 0.0


def most_of_text(tree: Tree, marks: list[int]) -> list[bool]:
    """Whether an element has over half of the page's characters outside links, and no article or main stands outside it."""
    n = len(tree.tag)
    chars, passed = [0] * n, [False] * n
    for i in range(1, n):
        passed[i] = passed[tree.parent[i]] or tree.tag[i] == "a" or tree.tag[i] in UNREAD_TAGS
    for i, t in tree.texts:
        if t and not passed[i]:
            chars[i] += len(" ".join(t.split()))
    for i in range(n - 1, 0, -1):
        chars[tree.parent[i]] += chars[i]
    return [2 * chars[i] > chars[0] and marks[i] == marks[0] for i in range(n)]


def own_parts(tree: Tree) -> list[bool]:
    """Which named elements of an article (article or main) are its own text, judged by what is in them.

    Less than LINKED of their characters are in links.  Named by LINK_WORDS they hold a paragraph.  Others are prose: they
    hold no controls, no boxes as a comment thread or an advert has, and nothing that is named itself; a paragraph or the
    mean one of a section is at least PARAGRAPH of the article's mean one; a div that no OTHERS_WORDS name has SHARE of the
    article's text; and of paragraphs called by OTHERS_WORDS there is one among brothers, for several are a thread.
    """
    n = len(tree.tag)
    chars, links, linked, holds = [0] * n, [0] * n, [False] * n, [0] * n
    said, mark, plain, boxed, voices = [0] * n, [0] * n, [True] * n, [False] * n, [0] * n
    for i in range(1, n):
        p, tag = tree.parent[i], tree.tag[i]
        linked[i] = linked[p] or tag == "a"
        mark[i] = i if tag in MARKED else mark[p]
        plain[i] = tag in MARKED or plain[p] and tree.noise[i] == PLAIN and tag not in FURNITURE_TAGS
        voices[p] += tag == "p" and tree.noise[i] == OTHERS
    for i, t in tree.texts:
        if t and tree.tag[i] not in UNREAD_TAGS:
            size = len(" ".join(t.split()))
            chars[i] += size
            links[i] += size * linked[i]
    count, length = [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        p, tag = tree.parent[i], tree.tag[i]
        chars[p] += chars[i]
        links[p] += links[i]
        if tag == "p" and chars[i]:
            holds[i] += 1
            said[i] += chars[i]
            if plain[i]:
                count[mark[i]] += 1
                length[mark[i]] += chars[i]
        holds[p] += holds[i]
        said[p] += said[i]
        boxed[p] = boxed[p] or boxed[i] or tag in BOX_TAGS or tree.noise[i] != PLAIN

    def own(i: int) -> bool:
        if not mark[i] or links[i] >= LINKED * chars[i]:
            return False
        if tree.noise[i] == LINKS:
            return holds[i] > 0
        if tree.tag[i] not in PROSE_TAGS or boxed[i] or not chars[i]:
            return False
        if tree.tag[i] == "div":
            return tree.noise[i] == NAMED and holds[i] > 0 and chars[i] >= SHARE * chars[mark[i]]
        mean = length[mark[i]] / count[mark[i]] if count[mark[i]] else 0
        if tree.tag[i] == "section":
            return holds[i] > 0 and said[i] / holds[i] >= PARAGRAPH * mean
        return chars[i] >= PARAGRAPH * mean and not (tree.noise[i] == OTHERS and voices[tree.parent[i]] > 1)

    return [PLAIN < tree.noise[i] < FURNITURE and own(i) for i in range(n)]


def dropped(tree: Tree) -> list[bool]:
    """Which elements are furniture or hold no text to read, with all that is below them."""
    n = len(tree.tag)
    holds, inside, marks = [False] * n, [False] * n, [0] * n
    for i in range(n - 1, 0, -1):
        marks[i] += tree.tag[i] in MARKED
        marks[tree.parent[i]] += marks[i]
        if tree.tag[i] in CONTENT or holds[i]:
            holds[tree.parent[i]] = True
    most = most_of_text(tree, marks) if any(tree.noise[i] or tree.tag[i] == "form" for i in range(1, n)) else [False] * n
    own = own_parts(tree) if any(PLAIN < x < FURNITURE for x in tree.noise) else [False] * n
    drop, within = [False] * n, [False] * n  # within: in a named wrapper or an article
    for i in range(1, n):
        p, tag = tree.parent[i], tree.tag[i]
        inside[i] = inside[p] or tag in MARKED
        within[i] = within[p] or tree.noise[i] != PLAIN or tag == "article"
        kept = holds[i] or most[i] or tag == "article" and not within[p]
        noise = tree.noise[i] != PLAIN and not (inside[p] and own[i])
        named = tag in UNREAD_TAGS or tag in FURNITURE_TAGS or tag in CONTROLS and not inside[p] or (noise or tag == "form") and not kept
        drop[i] = drop[p] or named or tag == "header" and not inside[p]
    return drop


def marked_below(tree: Tree, drop: list[bool], total: list[float], best: int) -> int:
    """The article or main of the greatest sum below the subtree, if such hold over half of its characters; else the subtree."""
    n = len(tree.tag)
    inside, marked = [False] * n, [0] * n
    inside[best] = True
    for i in range(best + 1, n):
        p = tree.parent[i]
        inside[i] = inside[p]
        marked[i] = marked[p] or (i if inside[i] and tree.tag[i] in MARKED and not drop[i] else 0)
    if not any(marked):
        return best
    all_chars = marked_chars = 0
    for i, t in tree.texts:
        if t and inside[i] and not drop[i]:
            size = len(" ".join(t.split()))
            all_chars += size
            marked_chars += size * bool(marked[i])
    return max({m for m in marked if m}, key=lambda i: (total[i], -i)) if 2 * marked_chars > all_chars else best


def headline(tree: Tree, drop: list[bool], linked: list[bool], best: int) -> int | None:
    """The last h1 before the subtree that holds none itself; what is a link is the name of the site."""
    own, links = [False] * len(tree.tag), {tree.parent[i] for i, t in enumerate(tree.tag) if t == "a"}
    own[best] = True
    last = None
    for i in range(1, len(tree.tag)):
        own[i] = own[i] or own[tree.parent[i]]
        if tree.tag[i] == "h1" and not drop[i]:
            if own[i]:
                return None
            if i < best and not linked[i] and i not in links:
                last = i
    return last


def main_text(html: str | None) -> str:
    """The main text of a page: its blocks in page order, an empty line between them; empty if there is none."""
    if not html:
        return ""
    tree = Tree(html)
    n = len(tree.tag)
    drop = dropped(tree)
    own, total, linked, share = densities(tree, drop)
    body = next((i for i in range(1, n) if tree.tag[i] == "body"), 0)
    best = max((i for i in range(n) if not drop[i]), key=lambda i: (total[i], -i))
    if not total[best]:
        best = body
    best = marked_below(tree, drop, total, best)
    path, threshold, i = [best], own[best], best
    while i not in (body, 0):
        i = tree.parent[i]
        path.append(i)
        threshold = min(threshold, own[i])
    best = next((i for i in reversed(path) if tree.tag[i] in MARKED), best)  # a marked article around it is taken whole
    above = set(path[path.index(best) + 1 :])
    title, headed = headline(tree, drop, linked, best), [False] * n
    for i in range(n - 1, 0, -1):
        headed[i] = headed[i] or tree.tag[i] == "h1"
        headed[tree.parent[i]] = headed[tree.parent[i]] or headed[i]
    sure = headed[best] or tree.tag[best] in MARKED  # then what has a headline beside it is no part of it, but may be an article
    taken = [False] * n
    for i in range(n):
        p = tree.parent[i]
        beside = p in above and i not in above and own[i] >= threshold > 0 and total[i] >= threshold and not (headed[i] and sure and tree.tag[i] not in MARKED)
        taken[i] = not drop[i] and (i == best or p >= 0 and taken[p] or beside or i == title)
    blocks, now, direct = [], [], False
    for i, t in [*tree.texts, (0, None)]:
        if t is None:
            whole = direct and run_density(now, above, tree, linked, share) >= threshold > 0
            blocks.append(" ".join("".join(t for i, t in now if whole or taken[i]).split()))
            now, direct = [], False
        elif not drop[i]:
            now.append((i, t))
            direct = direct or i in above and not t.isspace()
    return "\n\n".join(b for b in blocks if b)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page's main text.

    Null or empty html gives an empty text; broken markup is read as far as it goes; repeated rows and null ids stay;
    other columns are ignored.  There is no shuffle, and nothing of a page is dropped for its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches, "html"):
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
