"""Main text of web pages by a site style tree.

All pages of a host are merged into one tree. A node is a path of block elements, each named by tag, class and id; paragraphs, headings,
lists and tables without class and id belong to the element around them, whose text and child sequence they are part of. A node has a presentation
importance, the entropy of its child sequences over the host's pages, and a content importance, the entropy of its texts, both divided
by the logarithm of the number of pages, so that what every page repeats is near 0 and what differs is near 1; the composite of both is
lowered by the share of linked text. A branch whose composite is low against the host's best is removed from each page, wherever it is: in
an article as in a body without any telling tag. Pages of a host whose text outside of named boilerplate is the same count as one page, so that
a site's copies of an article are no template.

Names come before the tree: an element whose tag, role, class or id names a menu, header, footer, sidebar, notice, advert, form or comments
has importance 0, and so has what is outside of a page's articles (else main, else an element named as content, else body).
Everything else is judged by the tree where its node is on MIN_PAGES pages or more, and stays where it is on fewer.

Blocks are joined by line ends; white space in a block becomes one space; character references are decoded; nothing is cut. Null, empty
and textless pages have text ''. Null URLs share the host ''. Repeated pages have a row each. Columns of pages named text or n_chars are replaced by the computed ones; other
extra columns are kept, or those in `keep`. An empty table gives no rows."""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binweave.llm._common import attach, bound_batches, free_name, shared_dir, slices, stored, texts

#: A node needs so many pages before entropies count; share of the host's best importance below which a branch goes; weight of content.
MIN_PAGES, LOW, CONTENT_WEIGHT = 4, 0.3, 0.8
#: Hosts a task remembers; with more than MANY_HOSTS hosts of low paths, which pages then move to, a host's pages are dealt out to SALTS tasks.
HOSTS, MANY_HOSTS, SALTS = 10_000, 200_000, 16

# Element names and the words that name boilerplate.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption colgroup hgroup search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset("nav header footer aside form script style noscript template button select option textarea iframe svg math dialog menu head title object canvas audio video search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs topbar footer header masthead cookie cookies consent notice notices gdpr popup modal overlay"
    " newsletter subscribe subscription signup login social share sharing related recommended recommendations widget widgets comments comment commentlist disqus replies reply respond toolbar pagination pager paging copyright disclaimer skip hidden alert announcement toast adsbygoogle adslot adbox adbanner tooltip".split()
)
#: Of NAMES, those that also hold for article, main, headings and inline elements; and those of a header, whose headings an article keeps.
STRONG = frozenset("ad ads advert adverts advertisement adsbygoogle adslot adbox adbanner sponsor sponsored promo comment comments reply replies related recommended widget".split())
TITLES = frozenset("header masthead banner".split())
CONTENT = frozenset("article articlebody content maincontent post postbody entry entrycontent story storybody".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd blockquote pre table caption colgroup tbody thead tfoot tr td th figure figcaption hr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Start tags that end an open element of these names (not beyond a scope's border).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
BORDER = frozenset("ul ol dl table article main section div body html".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_SHORT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@lru_cache(maxsize=20_000)
def _label(tag: str, attributes: str) -> tuple[str, str, bool, bool]:
    """Name of a node, whether it is boilerplate ('', 'header' or 'drop'), whether it names content, and whether it belongs to the element
    around it."""
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    classes = (found.get("class", "") + " " + found.get("id", "")).split()
    parts = {w.lower() for c in classes for w in _WORDS.findall(c)}
    role = found.get("role", "").lower()
    content = role == "main" or found.get("itemprop", "").lower() == "articlebody" or any(re.sub(r"[^a-z]", "", c.lower()) in CONTENT for c in classes)
    names = parts & (STRONG if tag in HEADINGS or tag in ("article", "main") or tag not in BLOCK else NAMES) if not content and tag not in ("body", "html") else frozenset()
    if tag in DROPPED - {"header"} or role in ROLES - {"banner"} or "hidden" in found or found.get("aria-hidden") == "true" or names - TITLES:
        drop = "drop"
    else:
        drop = "header" if tag == "header" or role == "banner" or names else ""
    return f"{tag}.{'.'.join(re.sub(r'[0-9]+', '#', c) for c in classes)}", drop, content, tag in FLOW and not classes


class Page:
    """blocks: (path, text, area, dropped, linked characters) in page order; children: path -> child names.

    area: 0 body, 1 named as content, 2 main, 3 article. dropped: None in an article's header, where only headings are kept."""

    def __init__(self, source: str):
        self.blocks: list[tuple] = []
        self.children: dict[int, list[str]] = {}
        self._open: list[tuple] = []  # tag, block, path, area, dropped
        self._text: list[str] = []
        self._linked = self._links = 0
        self._read(source)
        self._flush()

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                top = next((x for x in reversed(self._open) if x[1]), ("", True, 0, 0, False))
                self.blocks.append((top[2], text, top[3], top[4], min(self._linked, len(text))))
            self._text, self._linked = [], 0

    def _pop(self, n: int) -> None:
        for tag, *_ in self._open[n:]:
            self._links -= tag == "a"
        del self._open[n:]

    def _start(self, tag: str, attributes: str) -> None:
        block = tag in BLOCK
        if block:
            self._flush()
            for k in range(len(self._open) - 1, -1, -1):
                if self._open[k][0] == "p" and tag not in ("html", "body"):
                    self._pop(k)
                    break
                if self._open[k][0] in BORDER:
                    break
        if stops := CLOSES.get(tag):
            k = len(self._open) - 1
            while k >= 0 and self._open[k][0] not in BORDER or k >= 0 and self._open[k][0] in stops:
                if self._open[k][0] in stops:
                    self._pop(k)
                k -= 1
        if tag in VOID or attributes.endswith("/") and not block:
            if tag in ("br", "hr", "img"):
                self._text.append(" ")
            return
        up = self._open[-1] if self._open else ("", True, 0, 0, False)
        label, drop, content, part = _label(tag, attributes)
        path, area = up[2], up[3]
        dropped = True if up[4] is True or drop == "drop" or drop and not area else None if drop or up[4] is None else False
        if dropped is None and tag in HEADINGS:
            dropped = False
        if block:
            self.children.setdefault(up[2], []).append(label)
            if not part:
                path = xxhash.xxh3_64_intdigest(label, seed=up[2] & 0xFFFFFFFF) >> 1
            own = 3 if tag == "article" else 2 if tag == "main" else int(content)
            area = 0 if dropped is True else max(area, own)
        self._open.append((tag, block, path, area, dropped))
        self._links += tag == "a"

    def _end(self, tag: str) -> None:
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == tag:
                if tag in BLOCK:
                    self._flush()
                self._pop(k)
                return
            if tag not in BLOCK and self._open[k][1]:
                return  # an inline end tag reaches no further than its block
        if tag == "br":
            self._text.append(" ")

    def _say(self, raw: str) -> None:
        if not raw or self._open and self._open[-1][4] is True:
            return
        text = html.unescape(raw) if "&" in raw else raw
        self._text.append(text)
        if self._links > 0:
            self._linked += len(text.strip())

    def _read(self, s: str) -> None:
        at, n = 0, len(s)
        while at < n:
            k = s.find("<", at)
            if k < 0:
                self._say(s[at:])
                return
            after = s[k + 1 : k + 2]
            if not (after.isalpha() and after.isascii()) and after not in ("/", "!", "?"):
                self._say(s[at : k + 1])
                at = k + 1
                continue
            self._say(s[at:k])
            if s.startswith("<!--", k):
                e = s.find("-->", k + 4)
                at = e + 3 if e >= 0 else n
            elif after in "!?":
                e = s.find(">", k)
                at = e + 1 if e >= 0 else n
            elif m := _TAG.match(s, k) or _SHORT.match(s, k):
                tag, at = m[2].lower(), m.end()
                if m[1]:
                    self._end(tag)
                    continue
                if tag in RAW:  # its content is no markup, and never main text
                    e = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(s, at)
                    e = e.start() if e else n
                    close = s.find(">", e)
                    at = close + 1 if close >= 0 else n
                    continue
                self._start(tag, m[3].strip())
            elif after == "/" and not s[k + 2 : k + 3].isalpha():
                e = s.find(">", k)
                at = e + 1 if e >= 0 else n
            else:
                return  # a tag that the page's end cuts off

    def neutral(self) -> list[tuple]:
        """(path, text, linked characters) of the blocks that no name speaks against."""
        kept = [b for b in self.blocks if b[3] is False]
        area = max((b[2] for b in kept), default=0)
        return [(b[0], b[1], b[4]) for b in kept if b[2] == area]

    def main(self, low: frozenset[int] = frozenset()) -> list[str]:
        """Blocks that neither their names nor the host's tree (its low paths) remove."""
        return [text for path, text, _ in self.neutral() if path not in low]


def parse(raw: bytes) -> Page:
    return Page(raw.decode("utf-8", "replace"))


def host_of(url) -> F.Column:
    """Host and port of a URL column in small letters, '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def page_nodes(page: Page) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """The hash of a page's neutral text, and (path, style, content, characters, linked) of each of its nodes that has text."""
    own: dict[int, list] = {}
    whole = xxhash.xxh3_64()
    for path, text, linked in page.neutral():
        x = own.setdefault(path, [xxhash.xxh3_64(), 0, 0])
        x[0].update(text + "\n")
        whole.update(text + "\n")
        x[1] += len(text)
        x[2] += linked
    out = []
    for path, (digest, size, linked) in own.items():
        names = page.children.get(path, [])
        style = xxhash.xxh3_64_intdigest("\n".join(n for k, n in enumerate(names) if not k or names[k - 1] != n)) >> 1
        out.append((path, style, digest.intdigest() >> 1, size, linked))
    return whole.intdigest() >> 1, out


NODE = "host string, main long, path long, style long, content long, chars long, linked long"


def nodes(pages: DataFrame, host: str, source: str) -> DataFrame:
    """NODE: of each host and neutral text (main) its nodes, once."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, source):
                rows: dict[tuple, tuple] = {}
                for where, raw in zip(part.column(host).to_pylist(), texts(part.column(source)), strict=True):
                    main, found = page_nodes(parse(raw))
                    for path, style, content, chars, linked in found:
                        key, value = (where, main, path), (content, style, chars, linked)
                        rows[key] = min(value, rows.get(key, value))
                columns = [[*k, v[1], v[0], *v[2:]] for k, v in rows.items()]
                yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in columns], pa.int64() if i else pa.string()) for i in range(7)], names=["host", "main", "path", "style", "content", "chars", "linked"])

    found = pages.select(host, source).mapInArrow(run, NODE)
    one = found.groupBy("host", "main", "path").agg(F.min(F.struct("content", "style", "chars", "linked")).alias("n"))
    return one.select("host", "main", "path", "n.style", "n.content", "n.chars", "n.linked")


def importance(found: DataFrame) -> DataFrame:
    """(host, path, pages, presentation, content, composite) of nodes: entropies over their pages' styles and texts, divided by
    the logarithm of the pages; composite is lowered by the share of linked text."""

    def entropy(kind: str) -> DataFrame:
        c = found.groupBy("host", "path", kind).agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("c"), F.sum("linked").alias("l"))
        all_ = c.groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"), F.sum("c").alias("chars"), F.sum("l").alias("linked"))
        value = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0)
        return all_.select("host", "path", F.round(F.greatest(value, F.lit(0.0)), 9).alias(kind), "m", "chars", "linked")

    both = entropy("content").join(entropy("style").select("host", "path", "style"), ["host", "path"])
    mixed = F.when(F.col("m") >= MIN_PAGES, F.col("content") * CONTENT_WEIGHT + F.col("style") * (1 - CONTENT_WEIGHT)).otherwise(1.0)
    composite = mixed * (1 - F.col("linked") / F.greatest("chars", F.lit(1)))
    return both.select("host", "path", F.col("m").alias("pages"), F.col("style").alias("presentation"), "content", F.round(composite, 9).alias("composite"))


def low_branches(tree: DataFrame) -> DataFrame:
    """(host, low): paths of MIN_PAGES pages or more whose composite importance is below LOW of their host's best; a host's paths of so many pages are as many as
    its templates'."""
    best = tree.groupBy("host").agg(F.max("composite").alias("best"))
    poor = tree.where(F.col("pages") >= MIN_PAGES).join(best, "host").where(F.col("composite") < F.lit(LOW) * F.col("best"))
    return poor.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("low"))


def extract(pages: DataFrame, url: str = "url", source: str = "html", keep: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """pages (or the columns keep) with text and n_chars."""
    bound_batches(pages.sparkSession)
    folder = folder or shared_dir(pages.sparkSession, "style-tree")
    host = free_name(pages, "_host")
    with_host = pages.withColumn(host, host_of(F.col(url)))
    low = stored(low_branches(importance(stored(nodes(with_host, host, source), f"{folder}/nodes"))), f"{folder}/low")
    name, salt = free_name(with_host, "_low"), free_name(with_host, "_salt")
    hosts = low.count()
    if not hosts:
        joined = with_host.withColumn(name, F.lit(None).cast("array<bigint>"))
    elif hosts <= MANY_HOSTS:
        joined = with_host.join(low.select(F.col("host").alias(host), F.col("low").alias(name)), host, "left")
    else:  # pages may move: a host's go to several tasks
        each = low.select(F.col("host").alias(host), F.col("low").alias(name), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
        joined = with_host.withColumn(salt, F.pmod(F.xxhash64(source, url), F.lit(SALTS)).cast("int")).join(each, [host, salt], "left").drop(salt)

    def make():
        known: dict[str, frozenset] = {}

        def work(part):
            out = []
            hosts = part.column(host).to_pylist()
            lows = part.column(name)
            for i, raw in enumerate(texts(part.column(source))):
                if (h := hosts[i]) not in known:
                    if len(known) >= HOSTS:
                        known.clear()
                    known[h] = frozenset(lows[i].as_py() or ())
                out.append("\n".join(parse(raw).main(known[h])) if raw else "")
            return [pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())]

        return work

    keep = [c for c in (keep if keep is not None else pages.columns) if c not in (host, name)]
    return attach(joined, source, [("text", T.StringType()), ("n_chars", T.LongType())], make, keep)
