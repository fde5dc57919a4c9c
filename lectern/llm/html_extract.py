"""Main text of web pages by differencing each page against its nearest neighbour by URL.

Pages are cut into text lines (a line per block of markup). Pages of a host lie in the order of
their URL paths; a page is paired with the one of its two neighbours whose path shares the longer
beginning (the one before, if both do), the lines of the pair are aligned by a longest common subsequence (LCS), and shared
lines are the site's template: they are deleted.

Differencing alone is wrong in two cases, so markup takes part:

* Copies of an article on one host share all its lines. A neighbour with which a page shares
  `COPY` of the characters that markup leaves is a copy and not its mate, and lines within an
  `article` or `main` element (or one named as the article's body) are kept if shared.
* Lines that differ from page to page may still be no article: adverts that rotate, comments of
  readers, menus of pages alone on their host. Elements that are so by their kind (`nav`, `footer`,
  `aside`, `form`, ...), role or the words of their class and id are left out.

Where a page marks its article, its lines are the text; elsewhere all lines that neither markup
nor the neighbour takes away are. README tells how many lines either rule decides.

Pages are sorted by host and path over the whole table, in ranges (`ranges.py`), by digests of
their lines alone: 13 bytes a line. The whole html is moved once, to meet its page's verdict.

Defined results: null html gives an empty text; a null url is a host of its own without a path;
an element left open ends with the one around it; pages repeated in full are one page for the
pairing and keep a row each; an empty table gives no rows; further columns are ignored. A page
of any length is read in linear time but for the LCS, whose bits are a product of the lines that
both pages hold, cut in halves where they would take more than `LCS_BITS`.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record_batches, table, written
from .ranges import in_ranges, with_neighbours

COPY = 0.8
LCS_BITS = 1 << 27

# Elements of HTML by their kind.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes iframe".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead "
    "title tr ul".split()
)
LEFT_OUT = set("nav footer aside form head menu button select dialog template noscript svg canvas object audio video map datalist fieldset search".split()) | RAW
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist status".split())
# Words of classes and ids that name what is no article.
NAMED_OUT = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsors sponsored promo promos promotion banner banners "
    "sidebar sidebars rail menu menus submenu nav navbar navi navigation breadcrumb breadcrumbs header masthead topbar footer copyright cookie cookies consent gdpr "
    "notice notices notification notifications announcement alert popup modal overlay newsletter subscribe subscription signup signin login register paywall "
    "share sharing social follow related recommended recommendations teaser teasers comment comments commentlist respond reply replies disqus discussion "
    "feedback pagination pager toolbar widget widgets form search skip hidden".split()
)
NOTES = set("comment comments reply replies respond related recommended teaser promo sponsored advert ad".split())
ABOUT = set("has have with without no is not hide show".split())
ARTICLE_WORDS, BODY_WORDS = set("article post entry story".split()), set("body content text main".split())
WHOLE_NAMES = set("content main article post story entry".split())

_OPEN = re.compile(r"<(?:(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*)|(?P<note>!--)|[!?/])")
_REST = re.compile(r"""(?:[^'">]|"[^"]*"|'[^']*')*+>""")
_ATTR = re.compile(r"""([^\s=/'"<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_ENDS = {t: re.compile(f"</{t}(?=[\\s/>])[^>]*>", re.I) for t in RAW}


class _Element:
    __slots__ = ("tag", "above", "hard", "soft", "core", "filled")

    def __init__(self, tag, above, hard=False, soft=False, core=0):
        self.tag, self.above, self.hard, self.soft, self.core, self.filled = tag, above, hard, soft, core, False


def _element(tag: str, attributes: str, above: _Element | None) -> _Element:
    """An element and what its kind and names say: left out for sure, by name, or the article."""
    hard = tag in LEFT_OUT
    core = 3 if tag == "article" else 2 if tag == "main" else 0
    if tag == "header":
        e = above
        while e is not None and e.core < 2:
            e = e.above
        hard = e is None
    if not attributes.strip(" /"):
        return _Element(tag, above, hard, False, core)
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attributes)}
    style = got.get("style", "").replace(" ", "").lower()
    hard |= "hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    role = got.get("role", "").lower()
    hard |= role in ROLES
    core = core or {"main": 2, "article": 3}.get(role, 0)
    names = f"{got.get('class', '')} {got.get('id', '')}"
    words: set[str] = set()
    for name in names.split():  # names such as "has-sidebar" speak of something around or within
        own = [w.lower() for w in _WORD.findall(name)]
        words.update(own if own and own[0] not in ABOUT else ())
    soft = False
    if tag not in ("html", "body", "main"):
        out = words & (NOTES if core == 3 else NAMED_OUT)
        if out <= {"header"} and words & ARTICLE_WORDS:
            out = set()
        soft = bool(out)
    if not core and not soft:
        whole = {n.lower() for n in names.split()}
        if got.get("itemprop", "").lower() == "articlebody" or words & ARTICLE_WORDS and words & BODY_WORDS or whole & WHOLE_NAMES:
            core = 1
    return _Element(tag, above, hard, soft, core)


def page_lines(html: str) -> tuple[list[str], list[int]]:
    """The page's lines and, for each, 0: left out by markup, 1: within the marked article,
    2: open. Lines without letters or signs are none."""
    stack: list[_Element | None] = [None]
    lines: list[str] = []
    homes: list[_Element | None] = []
    cores: list[_Element] = []
    held: list[str] = []
    where = None
    at, size, quoted = 0, len(html), True

    def flush():
        nonlocal where
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                lines.append(text)
                homes.append(where)
                e = where
                while e is not None and not e.filled:
                    e.filled = True
                    e = e.above
            held.clear()
        where = None

    def said(text: str):
        nonlocal where
        if text:
            if where is None and not text.isspace():
                where = stack[-1]
            held.append(text)

    while at < size:
        m = _OPEN.search(html, at)
        if m is None:
            said(html[at:])
            break
        said(html[at : m.start()])
        if m["note"]:
            end = html.find("-->", m.end())
            at = size if end < 0 else end + 3
            continue
        rest = _REST.match(html, m.end()) if quoted else None
        if rest is not None:
            stop = rest.end()
        else:  # a quote never closed: from here on the next > ends a tag
            quoted = False
            stop = html.find(">", m.end()) + 1
            if not stop:
                said(html[m.start() :])
                break
        at = stop
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in BLOCK or tag in LEFT_OUT:
            flush()
        if m["close"]:
            for k in range(len(stack) - 1, max(0, len(stack) - 64), -1):
                if stack[k].tag == tag:
                    if any(e.hard or e.soft for e in stack[k:]):
                        flush()
                    del stack[k:]
                    break
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            end = _ENDS[tag].search(html, at)
            at = size if end is None else end.end()
            continue
        attributes = html[m.end() : stop - 1]
        if attributes.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack[-1] is not None and stack[-1].tag == tag:
            stack.pop()
        e = _element(tag, attributes, stack[-1])
        if e.hard or e.soft:
            flush()
        stack.append(e)
        if e.core:
            cores.append(e)
    flush()
    return lines, _zones(homes, cores)


def _zones(homes: list[_Element | None], cores: list[_Element]) -> list[int]:
    memo: dict[tuple, object] = {}

    def climb(e: _Element | None, kind: str, own) -> bool:
        """Whether the element or one around it has the property `own`."""
        seen = []
        found = False
        while e is not None:
            if (known := memo.get((kind, e))) is not None:
                found = known
                break
            seen.append(e)
            if own(e):
                found = True
                break
            e = e.above
        for x in seen:
            memo[kind, x] = found
        return found

    hard = lambda e: climb(e, "hard", lambda x: x.hard)
    out = lambda e: climb(e, "out", lambda x: x.hard or x.soft)
    inside, gone = None, out
    for level in (3, 2):
        for test in (out, hard):  # an article only within elements left out by name: these are wrappers
            found = {e for e in cores if e.core == level and e.filled and not test(e)}
            if found and inside is None:
                inside = found
                if test is hard:
                    wrappers = {x for e in found for x in _around(e)}
                    gone = lambda e, w=wrappers: climb(e, "wrapped", lambda x: x.hard or x.soft and x not in w)
    if inside is None:
        inside = {e for e in cores if e.core == 1 and e.filled and not out(e)} or None
    if inside is None:
        return [0 if gone(e) else 2 for e in homes]
    return [1 if not gone(e) and climb(e, "core", inside.__contains__) else 0 if gone(e) else 2 for e in homes]


def _around(e: _Element):
    while e is not None:
        yield e
        e = e.above


def shared_lines(a, b) -> list[int]:
    """Places in `a` of a longest common subsequence of `a` and `b`."""
    n, m, head = len(a), len(b), 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    while n > head and m > head and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    both = set(a[head:n]) & set(b[head:m])
    at = [i for i in range(head, n) if a[i] in both]
    other = [x for x in b[head:m] if x in both]
    inner = _align([a[i] for i in at], other)
    return [*range(head), *(at[i] for i in inner), *range(n, len(a))]


def _rows(a, b):
    """For each element of `a`, bits over `b`: a bit is 0 where the LCS of all of `a` so far grows."""
    mask: dict = {}
    for j, x in enumerate(b):
        mask[x] = mask.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & mask.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _growth(a, b):
    """Length of the LCS of `a` with every beginning of `b`."""
    import numpy as np

    v = (1 << len(b)) - 1
    for v in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _align(a, b) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > LCS_BITS and len(a) > 1:
        half = len(a) // 2
        cut = int((_growth(a[:half], b) + _growth(a[half:][::-1], b[::-1])[::-1]).argmax())
        return _align(a[:half], b[:cut]) + [half + i for i in _align(a[half:], b[cut:])]
    rows = list(_rows(a, b))
    found, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                found.append(i)
                j -= 1
    return found[::-1]


_URL = re.compile(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)")


def url_place(url: str | None) -> tuple[str, str]:
    """(host, path) without user, query, fragment and a slash at the end."""
    m = _URL.match(url or "")
    host, path = (m[1], m[2]) if m else ("", (url or "").split("#")[0].split("?")[0])
    return host.rpartition("@")[2].lower(), path.rstrip("/")


def _digests(batches):
    """Host, path and the lines of pages as 8-byte digests, 4-byte lengths and 1-byte zones."""
    from hashlib import blake2b

    import numpy as np
    import pyarrow as pa

    def rows():
        for b in batches:
            for row, url, html in zip(*[b.column(c).to_pylist() for c in ("row", "url", "html")]):
                lines, zones = page_lines(html or "")
                coded = b"".join(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest() for x in lines)
                yield (row, *url_place(url), coded, np.array([len(x) for x in lines], "<i4").tobytes(), bytes(zones))

    yield from record_batches(rows(), ["row", "host", "path", "lines", "sizes", "zones"], [pa.binary(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.binary()], 1024)


class _Page:
    def __init__(self, row, host, path, lines, sizes, zones):
        import numpy as np

        self.row, self.host, self.path = row, host, path
        self.lines = np.frombuffer(lines, "<u8").tolist()
        self.sizes, self.zones = np.frombuffer(sizes, "<i4"), np.frombuffer(zones, "u1")
        self.left = int(self.sizes[self.zones > 0].sum())

    def near(self, other: _Page) -> int:
        """How long a beginning the paths share."""
        k = 0
        for a, b in zip(self.path, other.path):
            if a != b:
                break
            k += 1
        return k

    def against(self, mates: list[_Page | None]) -> list[int] | None:
        """Places of the lines shared with the nearest neighbour that is no copy."""
        import numpy as np

        for mate in sorted((m for m in mates if m is not None and m.host == self.host), key=lambda m: -self.near(m)):
            shared = np.array(shared_lines(self.lines, mate.lines), np.int64)
            same = int(self.sizes[shared][self.zones[shared] > 0].sum())
            if same < COPY * max(1, min(self.left, mate.left)):
                return shared.tolist()
        return None


def _compare(batches):
    """(row, paired, shared): for each page whether it found a mate, and the shared lines' places."""
    import numpy as np
    import pyarrow as pa

    def verdict(before, page, after):
        shared = page.against([before, after])
        return page.row, shared is not None, np.array(shared or [], "<i4").tobytes()

    def rows():
        part = before = now = None
        real = False
        for b in batches:
            for p, ghost, *rest in zip(*[b.column(c).to_pylist() for c in ("part", "ghost", "row", "host", "path", "lines", "sizes", "zones")]):
                page = _Page(*rest)
                if p != part:
                    if real:
                        yield verdict(before, now, None)
                    part, before, now, real = p, None, None, False
                if real:
                    yield verdict(before, now, page)
                before, now, real = now, page, not ghost
        if real:
            yield verdict(before, now, None)

    yield from record_batches(rows(), ["row", "paired", "shared"], [pa.binary(), pa.bool_(), pa.binary()])


OUT = "text string, n_chars long, n_lines long, n_marked long, n_shared long, n_deleted long, paired boolean"


def _text(batches):
    import numpy as np
    import pyarrow as pa

    names = [x.split()[0] for x in OUT.split(", ")]
    types = [pa.string(), *[pa.int64()] * 5, pa.bool_()]
    for b in batches:
        out = []
        for html, paired, shared in zip(*[b.column(c).to_pylist() for c in ("html", "paired", "shared")]):
            lines, zones = page_lines(html or "")
            places = np.frombuffer(shared or b"", "<i4").tolist()
            deleted = {i for i in places if zones[i] == 2}
            own = 1 if 1 in zones else 2
            kept = [x for i, (x, z) in enumerate(zip(lines, zones)) if z == own and i not in deleted]
            text = " ".join(kept)
            out.append((text, len(text), len(lines), zones.count(0), len(places), len(deleted), bool(paired)))
        new = [pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *new], names=["page_id", "url", *names])


def extract(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """page_id, url and OUT of every row: the text; its characters; the page's lines, those left
    out by markup, those shared with the mate, and the open ones among these, which are deleted."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    row = F.unhex(F.md5(F.concat_ws("\n", part("page_id"), part("url"), part("html"))))
    rows = pages.select("page_id", "url", "html", row.alias("row"))
    kind = "row binary, host string, path string, lines binary, sizes binary, zones binary"
    digests = rows.select("row", "url", "html").mapInArrow(_digests, kind).dropDuplicates(["row"])
    keys = ["host", "path", "row"]
    ranged = in_ranges(digests, keys, "lines", parts)
    found = written(with_neighbours(ranged, keys, parts).mapInArrow(_compare, "row binary, paired boolean, shared binary"), "shared-lines")
    # verdicts are as many as pages: never sent to all tasks, however few they are here
    met = rows.join(found.hint("merge"), "row", "left").select("page_id", "url", "html", "paired", "shared")
    id_kind = pages.schema["page_id"].dataType.simpleString()
    return met.mapInArrow(_text, f"page_id {id_kind}, url string, {OUT}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
