"""Main text of web pages by a template deduced from equivalence classes of tokens on the pages of a host.

Tokens are the opening tags of containers, told apart by their path, and the texts of blocks, told apart by path and words. A
token's occurrence vector says how often each page has it; tokens with one vector make a class. A class is valid if it holds
a tag, is on half of a host's pages and on five at least, and if these are not one page over and over. A text in a valid class on
nearly all pages is the template's, and so is a container if nearly all words in it are such texts; classes nest by the paths of their
tokens. What remains are the slots. Those of menus, adverts, forms and the like, whose text varies, are known by name; the
main one is the article by name, or else holds the running text that is not the template's.

A passage that only some pages share, or one that stands between others that vary, is content. A host all of whose running text is
the same on all pages has no slots; there the tags alone decide. Vectors are never kept: a token has the sums of hashes of (page,
count) over its pages, 93 bits together, and these are equal for equal vectors.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm.common import materialise, read
from opsframe.llm.url_filter import split_url

#: Elements whose whole content is no text.
_RAW = ("script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "audio", "video", "textarea", "select", "title")
#: Attributes of a tag; a quote means something only right after a ``=``.
_REST = r"(?:=\s*+\"[^\"]*\"|=\s*+'[^']*'|[^>])*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(_RAW) + r")\b" + _REST + r">.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>" + _REST + r")(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_NAMES = frozenset(("class", "id", "role"))
#: Numbers in a class name that count something, as in ``post-17``; ``c7`` is a name.
_COUNTER = re.compile(r"(?<=[-_])\d+|\d{3,}")
#: Containers; they make up paths.
_BOX = frozenset(
    "html head body div section article main aside nav header footer form fieldset ul ol li dl dt dd table thead tbody tfoot tr td th"
    " blockquote figure figcaption details summary dialog menu center button label address".split())
#: Elements that begin and end a block of text without being a container.
_BREAK = frozenset("p h1 h2 h3 h4 h5 h6 pre hr caption legend option".split())
#: An open element that a following one of the same list ends.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_SIDE_TAGS = frozenset("head nav aside footer form fieldset button label menu dialog".split())
_SIDE_WORDS = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|notice|alert"
    r"|popup|modal|overlay|newsletter|subscribe|signup|login|sidebar|side|aside|widget|menu|nav|navbar|navigation|breadcrumb|breadcrumbs"
    r"|pagination|pager|toolbar|share|sharing|social|related|recommended|comment|comments|reply|replies|response|responses|thread|discussion|reactions|disqus|footer|masthead|topbar|search|copyright|tags)"
    r"(?:$|[-_ ])", re.I)
_MAIN_WORDS = re.compile(r"(?:^|[-_ ])(?:article|post|entry|content|story|main|body-text|text)(?:$|[-_ ])", re.I)
#: Names of readers' comments, which are sometimes articles by their tag.
_READERS = frozenset(("comment", "comments", "reply", "replies", "response", "responses"))
#: Share of a host's pages that a template token must be on.
FREQUENT = 0.5
#: Share of a host's pages that a template text must be on, and of a container's words that such texts must make up.
CONSTANT = 0.9
#: Pages that a class needs; on fewer, equal words prove nothing.
SUPPORT = 5
#: Parts that the tokens of one host and number of digits are dealt into.
DEALS = 8
#: The host of a url in SQL, as ``split_url`` gives it.
HOST = (
    "case when instr(url, '://') > 0 then translate(regexp_extract(substring(url, instr(url, '://') + 3), '^[^/?#]*', 0),"
    " 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end"
)


#: Kinds of side containers: for sure, and by a word within a class name only, which the layout of a page may refute.
SIDE, PERHAPS = 2, 1


def _is_side(tag: str, names: str, inside: bool) -> int:
    """Menus, notices, adverts and so on; a header is one unless it stands inside the article, an article never is.

    A class name that is a side word as a whole says so for sure; one that holds such a word (``with-sidebar``) may only describe
    the container, and says nothing beside a name that is a main word as a whole.
    """
    if tag == "article" and not _READERS.isdisjoint(names.lower().split()):
        return SIDE
    if tag in ("html", "body", "article", "main"):
        return 0
    if tag in _SIDE_TAGS or (tag == "header" and not inside):
        return SIDE
    if not (names and _SIDE_WORDS.search(names)):
        return 0
    own = names.split()
    if any(len(m[0]) == len(x) for x in own if (m := _SIDE_WORDS.match(x))):
        return SIDE
    return 0 if any(len(m[0]) == len(x) for x in own if (m := _MAIN_WORDS.match(x))) else PERHAPS


def _rank(tag: str, names: str) -> int:
    """How surely a container is the article by its name: 3 to 0."""
    if tag == "article":
        return 3
    if tag == "main" or "main" in names.split():
        return 2
    return 1 if tag in ("div", "section", "td") and _MAIN_WORDS.search(names) else 0


@lru_cache(maxsize=20_000)
def _token(path: int, tag: str, rest: str, inside: bool) -> tuple[int, str, int, int]:
    """(path, tag and names, side, rank) of an opening tag below ``path``; numbers that count pages or posts don't tell names apart."""
    found = ((k[1].lower(), x) for k in _ATTRIBUTE.finditer(rest) for x in (k[2] or k[3] or k[4] or "").split())
    own = " ".join(sorted(re.sub(r"\d+" if k == "id" else _COUNTER, "", x) for k, x in found if k in _NAMES))
    label = f"{tag} {own}"
    return xxhash.xxh64_intdigest(f"{path} {label}".encode()) >> 1, label, _is_side(tag, own, inside), _rank(tag, own)


def _words(path: int, text: str) -> int:
    """The token of a block's text below ``path``."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), seed=path & 0xFFFFFFFF) >> 1


class Page:
    """One pass over a page: its containers and the blocks of text in them."""

    def __init__(self, source: str):
        #: number of a container: (path, parent's number, tag and names, side, rank)
        self.boxes: list[tuple[int, int, str, bool, int]] = [(0, -1, "", 0, 0)]
        #: (container, text, words, words in links)
        self.blocks: list[tuple[int, str, int, int]] = []
        self._read(source)
        self._settle()

    def _settle(self) -> None:
        """Makes side a truth value for each container and what it holds; the box of most text is none by a word within its names."""
        sure = [False] * len(self.boxes)
        for k, (_, parent, _, side, _) in enumerate(self.boxes):
            sure[k] = side == SIDE or (parent >= 0 and sure[parent])
        below = [0] * len(self.boxes)
        for k, _, words, links in self.blocks:
            below[k] += 0 if sure[k] else words - links
        for k in range(len(self.boxes) - 1, 0, -1):
            below[self.boxes[k][1]] += below[k]
        #: whether a container is a side one by itself
        self.own = [side == SIDE or (side == PERHAPS and 2 * below[k] <= below[0]) for k, (_, _, _, side, _) in enumerate(self.boxes)]
        for k, (path, parent, label, _, rank) in enumerate(self.boxes):
            self.boxes[k] = (path, parent, label, self.own[k] or (parent >= 0 and self.boxes[parent][3]), rank)

    def _read(self, source: str) -> None:
        stack, names = [0], [""]
        held: list[str] = []
        linked: list[str] = []
        in_link = muted = False

        def flush() -> None:
            if held:
                words = "".join(held).split()
                if words and not muted:
                    self.blocks.append((stack[-1], " ".join(words), len(words), len("".join(linked).split())))
                held.clear()
                linked.clear()

        def put(text: str) -> None:
            text = entities.unescape(text) if "&" in text else text
            held.append(text)
            if in_link:
                linked.append(text)

        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                put(source[at : m.start()])
            at = m.end()
            tag = (m["name"] or "").lower()
            if not tag:
                continue
            if tag == "a":
                in_link = not m["close"]
            elif tag == "br":
                put(" ")
            elif tag in _BREAK:
                flush()
                in_link = False
                muted = not m["close"] and tag != "hr" and _token(0, tag, m["rest"], True)[2] == SIDE
            elif tag in _BOX:
                flush()
                in_link = muted = False
                if m["close"]:
                    if tag in names:
                        while names.pop() != tag:
                            stack.pop()
                        stack.pop()
                    continue
                while names[-1] in _ENDS.get(tag, ()):
                    names.pop()
                    stack.pop()
                if m["rest"].endswith("/"):
                    continue
                path, label, side, rank = _token(self.boxes[stack[-1]][0], tag, m["rest"], any(self.boxes[s][4] for s in stack))
                self.boxes.append((path, stack[-1], label, side, rank))
                stack.append(len(self.boxes) - 1)
                names.append(tag)
        if at < len(source):
            put(source[at:])
        flush()

    def text(self, wanted: frozenset[int], fixed: frozenset[int]) -> str:
        """The blocks below containers with a wanted path, without side containers; a wanted one is none, whatever this page says.

        The template's texts, ``fixed``, are left out.
        """
        take, side = [False] * len(self.boxes), [False] * len(self.boxes)
        for k, (path, parent, _, _, _) in enumerate(self.boxes):
            side[k] = (self.own[k] and path not in wanted) or (parent >= 0 and side[parent])
            take[k] = not side[k] and (path in wanted or (parent >= 0 and take[parent]))
        return "\n".join(t for k, t, _, _ in self.blocks if take[k] and not (fixed and _words(self.boxes[k][0], t) in fixed))

    def paths(self) -> dict[int, list]:
        """For each path: parent path, tag and names, side, rank, words outside of links, all words, how often it occurs."""
        out: dict[int, list] = {}
        for path, parent, label, side, rank in self.boxes:
            out.setdefault(path, [self.boxes[parent][0] if parent >= 0 else -1, label, side, rank, 0, 0, 0])[6] += 1
        for k, _, words, links in self.blocks:
            row = out[self.boxes[k][0]]
            row[4] += words - links
            row[5] += words
        return out

    def texts(self) -> dict[int, list]:
        """For each text of a block outside of side containers: as ``paths``, with the path it stands at as its parent."""
        out: dict[int, list] = {}
        for k, text, words, links in self.blocks:
            path, _, _, side, _ = self.boxes[k]
            if not side:
                row = out.setdefault(_words(path, text), [path, None, False, 0, 0, 0, 0])
                row[4] += words - links
                row[5] += words
                row[6] += 1
        return out


#: A tag of a template: parent, side, rank, running words.
Tag = tuple[int, bool, int, int]


def _below(up: dict[int, int], own: dict[int, int]) -> dict[int, int]:
    """The sum of ``own`` over each path and all paths below it."""
    out: dict[int, int] = defaultdict(int)
    for path, n in own.items():
        at, seen = path, set()
        while n and at in up and at not in seen:
            seen.add(at)
            out[at] += n
            at = up[at]
    return out


def main_paths(tokens: dict[int, Tag]) -> frozenset[int]:
    """The main slots of a template.

    All articles (tag or role of the main part), if any holds running text; else all containers with the name of one, if together
    they hold half of it; else the lowest container that holds all running text.
    """
    up = {p: t[0] for p, t in tokens.items()}
    below = _below(up, {p: 0 if t[1] else t[3] for p, t in tokens.items()})
    open_ = {p: t for p, t in tokens.items() if not t[1] and below[p] > 0}
    if not open_:
        return frozenset()
    best = max(t[2] for t in open_.values())
    whole = max(below.values())
    if best:
        named = {p for p, t in open_.items() if t[2] == best}
        if best > 1:
            return frozenset(named)
        held = 0
        for p in named:
            at, seen = tokens[p][0], {p}
            while at in tokens and at not in named and at not in seen:
                seen.add(at)
                at = tokens[at][0]
            held += 0 if at in named else below[p]
        if 2 * held >= whole:
            return frozenset(named)
    above = {t[0] for p, t in open_.items() if below[p] == whole}
    return frozenset(p for p in open_ if below[p] == whole and p not in above)


def extract(source: str | None, wanted: frozenset[int], fixed: frozenset[int] = frozenset()) -> str:
    """A page's main text; a page without text in the template's slots is its own template."""
    if not source:
        return ""
    page = Page(source)
    text = page.text(wanted, fixed)
    if not text:
        own = page.paths()
        text = page.text(main_paths({p: (r[0], r[2], r[3], r[4]) for p, r in own.items()}), fixed)
    return text


_KINDS = {"host": pa.string(), "token": pa.int64(), "up": pa.int64(), "label": pa.string(), "rank": pa.int32()}
_SUMS = ("side", "pages", "words", "size", "v1", "v2", "v3")
_ENDS_OF = ("low", "high")


def _batch(rows: dict[tuple, list]) -> pa.RecordBatch:
    cols = list(zip(*((*k, *v) for k, v in rows.items()))) or [()] * (len(_KINDS) + len(_SUMS) + 2)
    kinds = [*_KINDS.values(), *[pa.int64()] * (len(_SUMS) + 2)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [*_KINDS, *_SUMS, *_ENDS_OF])


def occurrences(pages: DataFrame) -> DataFrame:
    """Per host and token: pages, those on which it is a side container, words, and its occurrence vector as sums of hashes.

    ``low`` and ``high`` are the smallest and the largest digest of a page with the token; ``label`` is null for texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple, list] = {}
            for url, source in zip(b.column("url"), b.column("html")):
                host, source = split_url(url.as_py())[0], source.as_py() or ""
                digest = xxhash.xxh3_64_intdigest(source.encode("utf-8", "replace"))
                page = Page(source)
                hashes: dict[int, int] = {}
                for token, (up, label, side, rank, words, size, n) in [*page.paths().items(), *page.texts().items()]:
                    if n not in hashes:
                        hashes[n] = xxhash.xxh3_128_intdigest(n.to_bytes(8, "big"), seed=digest)
                    h = hashes[n]
                    row = sums.setdefault((host, token, up, label, rank), [0] * 7 + [digest >> 1] * 2)
                    for k, x in enumerate((side, 1, words, size, h & 0x7FFFFFFF, h >> 31 & 0x7FFFFFFF, h >> 62 & 0x7FFFFFFF)):
                        row[k] += x
                    row[7], row[8] = min(row[7], digest >> 1), max(row[8], digest >> 1)
            yield _batch(sums)

    columns = ", ".join(["host string, token long, up long, label string, rank int", *[f"{c} long" for c in (*_SUMS, *_ENDS_OF)]])
    sums = [F.sum(c).alias(c) for c in _SUMS] + [F.min("low").alias("low"), F.max("high").alias("high")]
    return pages.select("url", "html").mapInArrow(run, columns).groupBy(*_KINDS).agg(*sums)


def deduce(rows: list[dict]) -> tuple[frozenset[int], frozenset[int]]:
    """A host's main slots and its template's texts, from its frequent tokens (``occurrences`` with ``all``, the host's pages)."""
    tags = {r["token"]: r for r in rows if r["label"] is not None}
    classes: dict[tuple, list[dict]] = defaultdict(list)
    for r in rows:
        classes[r["v1"], r["v2"], r["v3"], r["pages"]].append(r)
    fixed = []
    for members in classes.values():
        one = members[0]
        if one["pages"] >= max(SUPPORT, CONSTANT * one["all"]) and any(r["label"] is not None for r in members):
            if any(r["low"] != r["high"] for r in members):
                fixed += [r for r in members if r["label"] is None and r["up"] in tags]
    up = {p: r["up"] for p, r in tags.items()}
    held, running = defaultdict(int), defaultdict(int)
    for r in fixed:
        held[r["up"]] += r["size"]
        running[r["up"]] += r["words"]
    side = {p: 2 * r["side"] > r["pages"] for p, r in tags.items()}
    whole = _below(up, {p: 0 if side[p] else r["size"] for p, r in tags.items()})
    constant = {p for p, n in _below(up, held).items() if n >= CONSTANT * whole[p]}
    inside = {p for p in tags if p in constant}
    for p in tags:  # a container of the template makes all that it holds the template's
        at, way = p, []
        while at in tags and at not in inside and at not in way:
            way.append(at)
            at = up[at]
        if at in inside:
            inside.update(way)
    data = {p: (r["up"], side[p], r["rank"], r["words"] - (running[p] if p in inside else 0)) for p, r in tags.items()}
    if any(not side and words for _, side, _, words in data.values()):
        return main_paths(data), frozenset(r["token"] for r in fixed if r["up"] in inside)
    return main_paths({p: (r["up"], side[p], r["rank"], r["words"]) for p, r in tags.items()}), frozenset()


def _nest(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.astype({"label": object}).where(rows.notna(), None)
    slots, fixed = deduce(rows.to_dict("records"))
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "slots": [sorted(slots)], "fixed": [sorted(fixed)]})


def templates(pages: DataFrame) -> DataFrame:
    """(host, slots, fixed): the paths of each host's main slots and the texts of its template.

    A token on at least half of a host's pages is frequent, so a host has no more of them than twice the tokens of an average page.
    """
    seen, _ = materialise(occurrences(pages), "occurrences")
    # a frequent token's pages have as many binary digits as its host's, or one less; so the rare tokens of a large host, which
    # are nearly all of them, meet in no task: they are dealt by digits and by themselves
    digits = F.floor(F.log2("pages"))
    hosts = seen.where("token = 0 and label is not null").select(
        "host", F.col("pages").alias("all"), F.explode(F.array(digits, digits - 1)).alias("digits"),
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal"))
    dealt = seen.withColumns({"digits": digits, "deal": F.pmod("token", F.lit(DEALS)).cast("int")})
    frequent = dealt.join(hosts, ["host", "digits", "deal"]).where(F.col("pages") >= FREQUENT * F.col("all"))
    # texts of hosts with few pages can't be the template's
    frequent = frequent.where(F.col("label").isNotNull() | (F.col("pages") >= F.greatest(F.lit(float(SUPPORT)), CONSTANT * F.col("all"))))
    return frequent.groupBy("host").applyInPandas(_nest, "host string, slots array<long>, fixed array<long>")


def page_texts(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Null and empty pages have an empty text. A null url, or one without ``://``, counts to the host "". Unclosed comments and raw elements
    reach to the end. Pages of any length are read whole; equal rows get equal texts. Character references are decoded, white
    space within a block becomes one blank, blocks are joined by a line feed. Other columns are not read,
    whatever their names; a table without rows gives none. Repeated rows and ids count as pages of their own.
    """
    found, _ = materialise(templates(pages), "templates")
    found = found.withColumnRenamed("host", "site")
    held = pages.select("page_id", "url", "html").withColumn("host", F.expr(HOST))
    both = held.join(found, F.col("host") == F.col("site"), "left").select("page_id", "url", "html", "slots", "fixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h.as_py(), frozenset(s.as_py() or ()), frozenset(f.as_py() or ()))
                     for h, s, f in zip(b.column("html"), b.column("slots"), b.column("fixed"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return both.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return page_texts(read(spark, sf_dir, "pages", "page_id", "url", "html"))
