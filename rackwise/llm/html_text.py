"""Main text of web pages: element subtrees that recur over a site's pages are its template and go."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from hashlib import blake2b

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rackwise.llm.common import add_columns, any_names, stored, without
from rackwise.llm.url_filters import url_host

# Element names of HTML and the words that sites put into class and id.
RAW = "script|style|noscript|template|textarea|iframe|svg|canvas|object|select|title"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption header footer nav aside form fieldset address details summary hr dialog menu center".split()
)
FURNITURE = frozenset("head nav footer aside form dialog menu button fieldset".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement sponsored promo cookie cookies consent notice notices nav navbar navigation menu sidebar "
    "comment comments disqus share sharing social related newsletter subscribe signup login popup modal breadcrumb breadcrumbs "
    "pagination toolbar widget widgets".split()
)
OUTER_MARKS = MARKS | frozenset("header footer masthead banner copyright".split())
FORMS = frozenset("form fieldset".split())
ELEMENTS = FURNITURE - FORMS
MIN_SHARE, LINE_SHARE = 0.1, 0.3  # of a host's distinct pages, that hold a block or a line of its template
OF_ELEMENT, OF_LINE = 1, 2
LINES = frozenset("html body head p li tr td th h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)"
    r"(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</?[a-z][^>]*\Z",
    re.IGNORECASE | re.DOTALL,
)
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z0-9]+")
_NUMBER = re.compile(r"\d+")


@dataclass(slots=True)
class Element:
    tag: str
    names: str
    above: int
    pieces: list = field(default_factory=list)  # texts, child numbers
    hidden: bool = False
    wraps: bool = False


def parse(page: str) -> list[Element]:
    """The page's block elements; element 0 is the whole page. A missing end tag ends with its parent, a stray one is skipped."""
    found = [Element("", "", -1)]
    stack, at = [0], 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            found[stack[-1]].pieces.append(page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            found[stack[-1]].pieces.append(" ")
        if tag in VOID and tag != "hr" or tag not in BLOCKS and tag not in FURNITURE:
            continue
        if m["end"]:
            for depth in range(len(stack) - 1, 0, -1):
                if found[stack[depth]].tag == tag:
                    del stack[depth:]
                    break
            continue
        top = found[stack[-1]].tag
        if top == "p" or top == tag in ("li", "dt", "dd", "tr", "td", "th"):  # their end tags may be left out
            stack.pop()
        rest, names, hidden = m["rest"], "", False
        if rest:
            for name, value in _NAMED.findall(rest):
                name, value = name.lower(), value.strip("\"'").lower()
                if name in ("class", "id", "role"):
                    names += f" {value}"
                elif name == "hidden" or name == "aria-hidden" and value == "true" or re.search(r"display\s*:\s*none", value):
                    hidden = True
        found.append(Element(tag, names, stack[-1], hidden=hidden))
        found[stack[-1]].pieces.append(len(found) - 1)
        if tag != "hr":
            stack.append(len(found) - 1)
    if at < len(page):
        found[stack[-1]].pieces.append(page[at:])
    _find_wraps(found)
    return found


def _marked(e: Element, inside: bool) -> bool:
    words = set(_WORDS.findall(e.names)) if e.names else ()
    return bool(e.hidden or e.tag in FURNITURE and not e.wraps or e.tag == "header" and not inside or words and (MARKS if inside else OUTER_MARKS).intersection(words))


def _find_wraps(found: list[Element]) -> None:
    """Mark the forms that hold an article, a main or half of the page's text: they are the page's wrapper."""
    if not any(e.tag in FORMS for e in found):
        return
    size, holds = [0] * len(found), [False] * len(found)
    for i in range(len(found) - 1, -1, -1):
        e = found[i]
        if e.hidden:
            continue
        size[i] = sum(size[c] if isinstance(c, int) else len("".join(c.split())) for c in e.pieces)
        holds[i] = e.tag in ("article", "main") or any(holds[c] for c in e.pieces if isinstance(c, int))
    for i, e in enumerate(found):
        e.wraps = e.tag in FORMS and (holds[i] or 0 < size[0] <= 2 * size[i])


def _mains(found: list[Element]) -> set[int]:
    """Elements that the page itself names as its article, or the ``main`` that holds such; empty if it names none."""
    for tag in ("article", "main"):
        mains, shut = set(), {-1: False}
        for i, e in enumerate(found):
            inside = e.above in mains or shut.get(e.above) is None
            is_main = (e.tag == tag or tag == "main" and " main" in e.names and e.tag not in ("", "html", "body")) and not _marked(e, False)
            if shut.get(e.above):
                shut[i] = True
            elif inside:
                shut[i] = None
            elif is_main:
                mains.add(i)
                shut[i] = None
            else:
                shut[i] = _marked(e, False) and e.tag not in ("html", "body", "")
        if mains:
            return {_outer(found, i) for i in mains}
    return set()


def _outer(found: list[Element], i: int) -> int:
    """The outermost ``main`` that holds element ``i``, or ``i`` itself."""
    outer = i
    while i >= 0:
        if found[i].tag == "main":
            outer = i
        i = found[i].above
    return outer


_EVERY = 0  # stands for the page itself


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _above(found: list[Element], mains: set[int]) -> set[int]:
    """The elements that hold one of ``mains``, and these."""
    holds = set()
    for i in mains:
        while i >= 0 and i not in holds:
            holds.add(i)
            i = found[i].above
    return holds


def template_hashes(found: list[Element], mains: set[int]) -> dict[int, list[int]]:
    """The hashes of every subtree that may be template: all but the page's article and what holds it.

    One hash is of the elements and all their text; lines of the article have none. Subtrees outside the article, and
    those named as furniture, have another of their place and shape (names of the elements without
    numbers, equal neighbours taken once, no text), which also recurs where a menu differs from page
    to page. The last two bits tell lines, and elements that HTML itself names as furniture. Element 0 has the
    hash that tells the page's content: pages that differ in other attributes, scripts or comments share it.
    """
    holds, inner, place = _above(found, mains), set(mains), {-1: 0}
    for i, e in enumerate(found):
        if e.above in inner:
            inner.add(i)
        place[i] = _digest(f"{place[e.above]}/{e.tag}")
    whole, shape, out = {}, {}, {}
    for i in range(len(found) - 1, -1, -1):
        e = found[i]
        shapes = [shape[c] for c in e.pieces if isinstance(c, int)]
        shape[i] = _digest(f"<{e.tag}{_NUMBER.sub('0', e.names)}>{[s for k, s in enumerate(shapes) if not k or s != shapes[k - 1]]}")
        whole[i] = _digest(f"<{e.tag}{e.names}>" + "".join(f"<{whole[c]}>" if isinstance(c, int) else " ".join(c.split()) for c in e.pieces))
        if not i:
            out[i] = [whole[i]]
        if not i or i in holds or e.tag in ("html", "body"):
            continue
        line = e.tag in LINES
        each = [] if line and i in inner else [whole[i] & ~3 | (OF_LINE if line else 0)]
        marked = _marked(e, i in inner)
        if marked or mains and i not in inner and not line:
            each.append(_digest(f"{place[e.above]}|{shape[i]}") & ~3 | (OF_ELEMENT if e.tag in ELEMENTS else 0))
        if each:
            out[i] = each
    return out


def page_text(page: str | None, template: frozenset[int] = frozenset(), small: bool = True) -> str:
    """The text that is left of a page, a line per block; ``template`` holds the hashes of its site's template.

    What goes: subtrees with a hash in ``template``; hidden elements; scripts, styles, comments; text
    that is loose in what holds the page's article. On a ``small`` site, whose pages are too few to
    tell its template, also furniture (by element or by the words of class and id) and, if the page
    names an article, all else.
    """
    if not page:
        return ""
    found = parse(page)
    mains = _mains(found)
    gone = {i for i, each in template_hashes(found, mains).items() if i and not template.isdisjoint(each)} if template else set()
    holds = _above(found, mains)
    lines: list[str] = []
    block: list[str] = []

    def close() -> None:
        line = " ".join(html.unescape("".join(block)).split())
        block.clear()
        if line:
            lines.append(line)

    # Own stack: pages can be nested deeper than Python's.
    todo: list[tuple[int, int, bool]] = [(0, 0, not mains)]
    while todo:
        i, k, inside = todo.pop()
        e = found[i]
        if k == 0:
            named = e.tag not in ("", "html", "body") and i not in mains and (_marked(e, bool(mains) and inside) if small else e.hidden)
            if i in gone or named:
                continue
            if i in mains or not small and i not in holds:
                inside = True
            close()
        while k < len(e.pieces):
            piece = e.pieces[k]
            k += 1
            if isinstance(piece, int):
                todo.append((i, k, inside))
                todo.append((piece, 0, inside))
                break
            if inside:
                block.append(piece)
        else:
            close()
            continue
        close()
    close()
    return "\n".join(lines)


def page_hashes(pages: DataFrame, host: str, page: str, key: str) -> DataFrame:
    """``host``, ``key``, the page's ``content``, and its subtree ``hashes`` behind ``_EVERY``, a row per page."""

    def hashes(texts: list) -> list:
        contents, each = [], []
        for text in texts:
            found = parse(text) if text else [Element("", "", -1)]
            own = template_hashes(found, _mains(found))
            contents.append(own.pop(0)[0])
            each.append([_EVERY, *sorted({h for some in own.values() for h in some})])
        return [contents, each]

    fields = [T.StructField("content", T.LongType()), T.StructField("hashes", T.ArrayType(T.LongType()))]
    return add_columns(pages.select(host, key, page), lambda: hashes, [page], fields, [page])


def site_templates(listed: DataFrame, host: str, min_pages: int, min_share: float) -> DataFrame:
    """``host``, ``hash``, ``pages``: a row for each subtree hash that enough of the host's distinct pages hold.

    ``pages`` is on how many of them it is. Enough are ``min_pages`` and ``min_share`` of them, for lines ``LINE_SHARE`` if that is more; for
    elements that HTML names as furniture ``min_pages``. ``_EVERY`` stands for the page itself, so its row
    tells the host's number of distinct pages. Hosts of fewer pages have no row.
    """
    held = listed.select(host, "content", F.explode("hashes").alias("hash")).distinct()
    counts = stored(held.groupBy(host, "hash").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages), "page-blocks")
    sizes = counts.where(F.col("hash") == _EVERY).select(host, F.col("pages").alias("of"))
    kind = F.col("hash").bitwiseAND(3)
    share = F.when(kind == OF_ELEMENT, 0.0).when(kind == OF_LINE, F.greatest(F.lit(LINE_SHARE), F.lit(min_share))).otherwise(min_share)
    enough = (F.col("hash") == _EVERY) | (F.col("pages") >= share * F.col("of"))
    return counts.join(sizes, host).where(enough).select(host, "hash", "pages")


def gone_subtrees(listed: DataFrame, template: DataFrame, host: str, key: str) -> DataFrame:
    """Of each page (``host``, ``key``) the hashes it shares with its host's template (``_template``), and the host's distinct ``_pages``.

    A page's own hashes meet the template as rows, so a row never holds more than its page does. Hosts without a template
    have no row.
    """
    own = listed.select(host, key, F.explode("hashes").alias("hash"))
    of_page = F.col("hash") == _EVERY
    return own.join(template, [host, "hash"]).groupBy(host, key).agg(
        F.max(F.when(of_page, F.col("pages"))).alias("_pages"), F.collect_set(F.when(~of_page, F.col("hash"))).alias("_template"))


@any_names("url", "page")
def extract_text(pages: DataFrame, url: str = "url", page: str = "html", min_pages: int = 5, min_share: float = MIN_SHARE) -> DataFrame:
    """Add ``text``, the main text, and ``n_chars``, its code points, to every page.

    Every block subtree of the page is hashed with its text, inside the page's article too; what lies
    outside the article, or is named as furniture by element, class or id, also by its place and
    shape. Spark counts on how many pages of distinct content of a host each hash occurs; subtrees whose
    hash recurs on ``min_pages`` of them or more, and on ``min_share`` of them unless HTML names the
    element as furniture, are the site's template and are deleted, all others stay. Single lines
    (``LINES``) need ``LINE_SHARE``; those of an article are never deleted because they recur. On hosts of fewer than twice ``min_pages``
    distinct pages names decide as well: furniture by element, class and id goes, and of a page that
    names an article only that, or the ``main`` around it, stays. A form that holds an article or half
    of the page's text is no furniture. The pages' hashes and the hosts' templates are written to the shared folder and
    joined row by row; a page gets back only those of its own hashes that are template. Spark's size check decides how. Character references are decoded, white space
    inside a block becomes one space, blocks are joined by a line break; ``br`` counts as white space.

    A null or empty page has an empty text. Pages without a host are one site of their own. Repeated
    rows keep their number and count as one page. Broken markup: a tag cut off at the end is
    dropped, a missing end tag ends with its parent. Empty table: no rows. Columns named ``text`` and
    ``n_chars`` are replaced, all others kept.
    """
    kept = without(pages, ["text", "n_chars"])
    keyed = kept.withColumn("_host", url_host(F.col(url).cast("string")))
    body, copied = page, []
    if kept.schema[page].dataType != T.StringType():  # else no second copy goes through the shuffle
        body, copied = "_page", ["_page"]
        keyed = keyed.withColumn(body, F.col(page).cast("string"))
    keyed = keyed.withColumn("_key", F.unhex(F.md5(F.coalesce(body, F.lit("")))))
    listed = stored(page_hashes(keyed, "_host", body, "_key"), "page-hashes")
    template = stored(site_templates(listed, "_host", min_pages, min_share), "page-templates")
    gone = stored(gone_subtrees(listed, template, "_host", "_key"), "page-gone")
    rows = keyed.join(gone, ["_host", "_key"], "left").drop("_host", "_key")

    def texts(bodies: list, counts: list, templates: list) -> list:
        out = [page_text(p, frozenset(t or ()), (n or 0) < 2 * min_pages) for p, n, t in zip(bodies, counts, templates, strict=True)]
        return [out, [len(t) for t in out]]

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return add_columns(rows, lambda: texts, [body, "_pages", "_template"], fields, [*copied, "_pages", "_template"])
