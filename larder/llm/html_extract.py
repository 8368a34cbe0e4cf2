"""HTML extraction by equivalence-class template deduction.

Pages of one host come from a few templates. Every page is cut into tokens: a tag with its
path of enclosing elements, or a text with its path. The occurrence vector of a token over
the host's pages is carried as two order-free sums of hashes of (page, count), so tokens
are grouped by equal vectors with ordinary aggregations and no host's pages ever meet in
one task. Classes of LOW_SUPPORT of the pages or more are nested by their paths. One with
texts is valid if it has a tag, MIN_CLASS tokens or a support of SUPPORT; on each page its
tokens must all be there, and those out of template order do not count. The texts of valid
classes are template text; the region whose slots, the rest, hold most text becomes the
content region (its article or main element if there is one). Extraction keeps the slots of
the content region. Within an article only texts of classes with a tag outside articles go,
and headings stay: what a few or many articles share without such a tag is theirs.

Hosts with fewer than MIN_PAGES pages use the template deduced over all hosts. Templates
are a row per host and are broadcast only after their number is checked.

Words of class, id and role mark boilerplate (NOT_WORDS) on elements other than html, body,
main, article and those that enclose the page's article, unless the mark has another word
that names something else.

Defined results: null or empty html gives an empty text; a page without any content region
gives all its text outside boilerplate elements; pages of any length are read whole; a null
url is a host of its own; of regions with equal text the first by label is taken; repeated
rows each come back; an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import durable, small_side, table

MIN_PAGES = 3
#: Share of a host's pages that a token of one of its templates has; alone, without a class.
LOW_SUPPORT = 0.1
SUPPORT = 0.6
#: Tokens of a class without a tag.
MIN_CLASS = 3
ANY_HOST = "*"
MAX_TEMPLATES = 20_000

#: HTML element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp template".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption details summary hgroup".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
CLOSES_P = TEXT_BLOCKS | set("address article aside div fieldset footer form header hr main nav section".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl table article section div body main nav aside header footer form blockquote td th".split())
#: Elements, and words of class, id and role, that are not the article.
NOT_TEXT = RAW | set("head nav aside footer form button select option input dialog svg canvas menu object".split())
NOT_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "footer sidebar aside widget widgets related recommended share sharing social comment comments commentlist discussion replies reactions responses respond disqus cookie cookies notice "
    "notices consent gdpr popup modal overlay newsletter subscribe subscription login signup search pagination pager skip hidden toolbar masthead complementary contentinfo".split()
)
#: Words beside those that only say which part of it an element is; any other names something else, as in share-price.
PART_WORDS = set(
    "box bar block list item items area wrap wrapper container inner outer section head header title body content main left right top bottom primary secondary "
    "link links button buttons icon icons post posts stories news form panel slot unit text label count small large mobile desktop fixed sticky site page global js 0".split()
)
OUTSIDE_ONLY = {"header", "banner"}
ARTICLE = {"article", "main"}
#: Elements whose own marks say nothing about the article.
NO_WORDS = ARTICLE | {"html", "body"}

_TAG = re.compile(r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>", re.S)
_NUMBER = re.compile(r"\b(?=[a-f]*\d)[0-9a-f]{8,}\b|\d+")
#: Small numbers of classes are of the layout, as in col-6, unless they count pages.
_LONG_NUMBER = re.compile(r"\d{3,}|(?<=post-)\d+|(?<=postid-)\d+|(?<=entry-)\d+|(?<=node-)\d+|(?<=item-)\d+|(?<=page-id-)\d+|(?<=article-)\d+")
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """``("open"|"close"|"text", element name or text, role)`` in page order."""
    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            break
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            yield "close", name, ""
            continue
        marks = sorted({(k[0].lower() == "id", x) for k in _MARKS.findall(m[3]) for x in (k[1] or k[2] or k[3]).lower().split()}) if m[3] else ()
        yield "open", name, ".".join([name, *dict.fromkeys(mark for is_id, x in marks if (mark := _steady(name, is_id, x)))])
        if name in RAW:
            close = re.compile(rf"</{name}", re.I).search(page, at)
            at = close.start() if close else end
    if at < end:
        yield "text", page[at:], ""


@lru_cache(8192)
def _steady(name: str, is_id: bool, mark: str) -> str:
    """The mark without what varies by page: numbers, and ids of articles or of many words.

    Words that mark boilerplate stay.
    """
    words = re.split(r"[^a-z0-9]+", mark)
    if is_id and (name in ARTICLE or len(words) > 3):
        return "-".join(sorted({w for w in words if w in NOT_WORDS})) if name not in NO_WORDS else ""
    return _NUMBER.sub("0", mark) if is_id else _LONG_NUMBER.sub("0", mark)


@lru_cache(8192)
def _rules(role: str) -> tuple[bool, bool, bool, bool]:
    """Whether the role's element, or a word of its marks, is never content; whether either is none outside an article."""
    name, _, marks = role.partition(".")
    words: set[str] = set()
    for mark in marks.split(".") if name not in NO_WORDS else ():
        found = {w for w in re.split(r"[^a-z0-9]+", mark) if w and not w.isdigit()}
        if found <= NOT_WORDS | PART_WORDS | OUTSIDE_ONLY:
            words |= found
    return name in NOT_TEXT, bool(words & (NOT_WORDS - OUTSIDE_ONLY)), name in OUTSIDE_ONLY, bool(words & OUTSIDE_ONLY)


class Element:
    """An open element; inline elements have the label of the block around them."""

    __slots__ = ("name", "role", "parent", "label", "region", "inside", "encloses", "barred", "boilerplate")

    def __init__(self, name: str, role: str, parent: Element | None):
        self.name, self.role, self.parent, self.encloses = name, role, parent, False
        self.label = self.region = ""
        self.inside = self.barred = self.boilerplate = False
        if parent:
            self.label = parent.label if name in INLINE else f"{parent.label}/{role}" if parent.label else role
            # The label cut at the article or main element, else at the container of the text.
            self.region = parent.region if parent.inside or name in INLINE or name in TEXT_BLOCKS else self.label
            self.inside = parent.inside or name in ARTICLE
            self.judge()

    def judge(self) -> None:
        """Set whether it is boilerplate, and barred: that by element names alone."""
        never, words, outside, outside_words = _rules(self.role)
        free, up = not self.parent.inside, self.parent
        self.barred = up.barred or (never and not (self.encloses and self.name == "form")) or (outside and free)
        self.boilerplate = self.barred or up.boilerplate or (not self.encloses and (words or (outside_words and free)))


def walk(page: str) -> list[tuple[str, str, Element]]:
    """``(kind, text, element)`` in page order: kind is tag, text or break."""
    root = Element("", "", None)
    stack, made, items = [root], [], []

    def close(names: set[str], scope: set[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                del stack[i:]
                return
            if stack[i].name in scope:
                return

    for kind, name, role in events(page):
        if kind == "text":
            items.append(("text", name, stack[-1]))
            continue
        if name not in INLINE or name == "br":
            items.append(("break", "", root))
        if kind == "close":
            close({name}, SCOPES - {name} if name in ("p", "li") else frozenset())
            continue
        if name in CLOSES_P:
            close({"p"}, SCOPES)
        if name in SIBLINGS:
            close(SIBLINGS[name], SCOPES - SIBLINGS[name])
        element = Element(name, role, stack[-1])
        made.append(element)
        if name not in INLINE:
            items.append(("tag", "", element))
        if name not in VOID:
            stack.append(element)
    while _free_article(items, made):
        pass
    return items


def _free_article(items: list[tuple[str, str, Element]], made: list[Element]) -> bool:
    """Lift the keyword rule from what encloses the page's article; whether there was such.

    An article within a marked element (related stories, comments) is the page's own only
    if it has over twice the text of all articles outside such elements.
    """
    hidden = {id(e): 0 for e in made if e.name in ARTICLE and e.parent.boilerplate and not _barred(e)}
    if not hidden:
        return False
    plain = 0
    for kind, text, e in items:
        if kind == "text" and e.inside:
            n = len("".join(text.split()))
            if not e.boilerplate:
                plain += n
            while n and e:
                if id(e) in hidden:
                    hidden[id(e)] += n
                elif e.name in NOT_TEXT and e.name != "form":
                    break
                e = e.parent
    best = max((e for e in made if id(e) in hidden), key=lambda e: hidden[id(e)])
    if hidden[id(best)] <= 2 * plain:
        return False
    e = best.parent
    while e.parent:
        e.encloses, e = True, e.parent
    for e in made:
        e.judge()
    return True


def _barred(element: Element) -> bool:
    """Whether an element around it, other than a form, is no content by its name."""
    e = element.parent
    while e.parent:
        if (e.name in NOT_TEXT and e.name != "form") or (e.name in OUTSIDE_ONLY and not e.parent.inside):
            return True
        e = e.parent
    return False


def _text_token(label: str, text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(label + "\n" + text, 1)


def page_tokens(page: str) -> tuple[dict[int, list], dict[str, int]]:
    """Token to [count, first place, label, characters of content, enclosing tag, region]; region to its characters of content text."""
    from xxhash import xxh64_intdigest

    found: dict[int, list] = {}
    chars: dict[str, int] = {}
    place = 0
    for kind, text, element in walk(page):
        if kind == "tag":
            token, row = xxh64_intdigest(element.label), [0, 0, element.label, 0, 0, 0]
        elif kind == "text" and (text := " ".join(text.split())):
            n = 0 if element.boilerplate else len(text)
            if n:
                chars[element.region] = chars.get(element.region, 0) + n
            token, row = _text_token(element.label, text), [0, 0, None, 0, _signed(xxh64_intdigest(element.label)), _signed(xxh64_intdigest(element.region, 2))]
        else:
            continue
        place += 1
        if token not in found:
            found[token] = row
            row[1] = place
        found[token][0] += 1
        if kind == "text":
            found[token][3] += n
    return found, chars


def _signed(token: int) -> int:
    return token - (1 << 64) if token >> 63 else token


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


_STATS = "host string, token long, label string, pages long, v1 long, v2 long, least long, most long, place double, chars long, within long, region long"


def token_stats(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """Per host and token: pages, occurrence vector sums, counts, mean place; token 0 counts
    pages, and a label without vector carries the characters of a region."""
    src = pages.select(host_of(F.col(url_col)).alias("host"), F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    names = [f.split(" ")[0] for f in _STATS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 5, pa.float64(), *[pa.int64()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        sums: dict[tuple, list] = {}

        def out() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in sums.items()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            signed = [pa.array(np.array(cols[1], np.uint64).view(np.int64))] if rows else [pa.array([], pa.int64())]
            arrays = [pa.array(cols[0], kinds[0]), *signed, *[pa.array(c, k) for c, k in zip(cols[2:], kinds[2:], strict=True)]]
            sums.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for host, page_id, page in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                found, chars = page_tokens(page)
                for token, (n, place, label, size, within, region) in [*found.items(), (0, (1, 0, None, 0, 0, 0))]:
                    s = sums.setdefault((host, token, label), [0, 0, 0, n, n, 0.0, 0, within, region])
                    h = xxh64_intdigest(f"{page_id}\n{n}")
                    s[0] += 1
                    s[1] += h & 0x7FFFFFFF
                    s[2] += h >> 33
                    s[3], s[4], s[5], s[6] = min(s[3], n), max(s[4], n), s[5] + place / (1 + len(found)), s[6] + size
                for label, n in chars.items():
                    sums.setdefault((host, xxh64_intdigest(label, 2), label), [0, 0, 0, 0, 0, 0.0, 0, 0, 0])[6] += n
                if len(sums) > 100_000:
                    yield out()
        yield out()

    total = [F.sum(c).alias(c) for c in ("pages", "v1", "v2")] + [F.min("least").alias("least"), F.max("most").alias("most"), F.sum("place").alias("place"), F.sum("chars").alias("chars")]
    total += [F.max(c).alias(c) for c in ("within", "region")]
    return src.mapInArrow(run, _STATS).groupBy("host", "token").agg(F.first("label", ignorenulls=True).alias("label"), *total)


_TEMPLATE = "host string, pages long, tokens array<long>, class array<int>, strong array<boolean>, framed array<boolean>, gone array<struct<region:long,chars:long>>, classes string"


def _deduce(host: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One host's template from its frequent tokens, at most a page's tokens over LOW_SUPPORT.

    ``tokens`` has the tokens of each valid class that holds texts, in template order.
    """
    n, vectors = int(rows["n"].max()), rows[rows["token"] != 0]
    groups, members = [], []
    for (support, _, _), g in vectors.groupby(["pages", "v1", "v2"], sort=True):
        g = g.sort_values(["place", "token"])
        labels = [x for x in g["label"] if isinstance(x, str)]
        texts = g[g["label"].isna()]
        strong = support >= n * SUPPORT
        framed = any(not _within_article(x) for x in labels)
        groups.append({"support": int(support), "steady": bool((g["least"] == g["most"]).all()), "tags": labels, "texts": [int(t) for t in texts["token"]]})
        groups[-1]["valid"] = bool(len(texts)) and bool(strong or labels or len(g) >= MIN_CLASS)
        members.append((g, texts, bool(strong), framed))
    # A class nests in the class of the nearest tag around its outermost tag, or around its texts if it has none.
    owner = {label: i for i, c in enumerate(groups) for label in c["tags"]}
    label_of = {int(t): x for t, x in zip(vectors["token"], vectors["label"], strict=True) if isinstance(x, str)}
    for i, c in enumerate(groups):
        inner = [label_of.get(int(t), "") + "/" for t in members[i][1]["within"]]
        outer = min(c["tags"] or inner, key=len, default="")
        c["parent"] = None
        while "/" in outer:
            outer = outer.rpartition("/")[0]
            if owner.get(outer, i) != i:
                c["parent"] = owner[outer]
                break
        # Texts whose enclosing tags are no class of the host are in no template.
        c["valid"] = c["valid"] and all(int(t) in label_of for t in members[i][1]["within"])
    order, kinds, strongs, frames, gone = [], [], [], [], []
    for i, (g, texts, strong, framed) in enumerate(members):
        if groups[i]["valid"]:
            order += [int(t) for t in g["token"]]
            kinds += [i] * len(g)
            strongs += [strong] * len(g)
            frames += [framed] * len(g)
            gone += [{"region": int(r), "chars": int(k)} for r, k in zip(texts["region"], texts["chars"], strict=True) if k]
    return pd.DataFrame({"host": [host[0]], "pages": [n], "tokens": [order], "class": [kinds], "strong": [strongs], "framed": [frames], "gone": [gone], "classes": [json.dumps(groups)]})


def _within_article(label: str) -> bool:
    return any(role.partition(".")[0] in ARTICLE for role in label.split("/"))


def templates(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """``(host, pages, region, texts, classes)``; host ``*`` stands for all hosts.

    ``classes`` is a JSON list of the nested equivalence classes with their tags.
    """
    stats = durable(token_stats(pages, id_col, url_col, html_col), "tokens")
    merged = stats.groupBy("token").agg(
        F.lit(ANY_HOST).alias("host"),
        F.first("label", ignorenulls=True).alias("label"),
        *[F.sum(c).alias(c) for c in ("pages", "v1", "v2")],
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        *[F.sum(c).alias(c) for c in ("place", "chars")],
        *[F.max(c).alias(c) for c in ("within", "region")],
    )
    stats = stats.unionByName(merged)
    hosts = stats.where("token = 0").select("host", F.col("pages").alias("n")).where((F.col("n") >= MIN_PAGES) | (F.col("host") == ANY_HOST))
    # The row of token 0 is kept, so that a host without a frequent token has its region.
    enough = F.least(F.col("n") * SUPPORT, F.greatest(F.col("n") * LOW_SUPPORT, F.lit(float(MIN_PAGES))))
    frequent = stats.where("pages > 0").join(small_side(hosts, MAX_TEMPLATES), "host").where(F.col("pages") >= enough)
    found = durable(frequent.groupBy("host").applyInPandas(_deduce, _TEMPLATE), "classes")
    # The region whose slots hold most text, one row a host, combined before the shuffle.
    gone = found.select("host", F.explode("gone").alias("g")).groupBy("host", F.col("g.region").alias("token")).agg(F.sum("g.chars").alias("gone"))
    regions = stats.where("pages = 0 AND chars > 0").select("host", "token", "label", "chars").join(gone, ["host", "token"], "left")
    slots = F.col("chars") - F.coalesce("gone", F.lit(0))
    best = regions.groupBy("host").agg(F.min_by("label", F.struct(-slots, -F.col("chars"), F.col("label"))).alias("region"))
    best = durable(best.join(small_side(hosts, MAX_TEMPLATES), "host").select("host", "region"), "regions")
    return found.join(small_side(best, MAX_TEMPLATES), "host", "left").select("host", "pages", "region", "tokens", "class", "strong", "framed", "classes")


def _longest_rise(ranks: list[int]) -> set[int]:
    """The most ranks that stand in rising order."""
    tops, at, before = [], [], []
    for i, r in enumerate(ranks):
        k = bisect_left(tops, r)
        before.append(at[k - 1] if k else -1)
        tops[k:], at[k:] = [r, *tops[k + 1 :]], [i, *at[k + 1 :]]
    kept, i = set(), at[-1] if at else -1
    while i >= 0:
        kept.add(ranks[i])
        i = before[i]
    return kept


Template = dict[int, tuple[int, int, bool, bool]]


def as_template(tokens: list[int], classes: list[int], strong: list[bool], framed: list[bool]) -> Template:
    """Token to (class, place in the template, whether its support is SUPPORT or more, whether
    the class has a tag outside articles)."""
    return {t & (1 << 64) - 1: (c, i, s, f) for i, (t, c, s, f) in enumerate(zip(tokens, classes, strong, framed, strict=True))}


def template_texts(items: list[tuple[str, str, Element]], template: Template) -> dict[int, tuple[bool, bool]]:
    """The text tokens that the page's valid classes hold, and whether each is strong and framed.

    On a page a class is valid with all its tokens, as far as they stand in template order.
    """
    from xxhash import xxh64_intdigest

    seen: dict[int, list[int]] = {}
    texts: dict[int, int] = {}
    for token, is_text in dict.fromkeys((xxh64_intdigest(e.label), False) if kind == "tag" else (_text_token(e.label, " ".join(text.split())), True) for kind, text, e in items if kind != "break"):
        if known := template.get(token):
            seen.setdefault(known[0], []).append(known[1])
            if is_text:
                texts[token] = known[1]
    sizes = Counter(c for c, *_ in template.values())
    good = {r for c, ranks in seen.items() if len(ranks) == sizes[c] for r in (ranks if ranks == sorted(ranks) else _longest_rise(ranks))}
    return {t: template[t][2:] for t, r in texts.items() if r in good}


def main_text(page: str, content: str | None, template: Template) -> str:
    """The page's text in ``content``, or in its own article, without template text.

    An article loses only the texts of classes that have a tag outside articles, so those of
    the page's template and not what some articles share, and never a heading. Where the
    template has half or more of an article's text, the pages are copies of each other and it
    tells nothing: the article stays whole.
    """
    items = walk(page)
    fixed = template_texts(items, template) if template else {}
    texts = [(" ".join(text.split()), e) if kind == "text" and not e.boilerplate else None for kind, text, e in items]
    tokens = [_text_token(x[1].label, x[0]) if x and fixed else 0 for x in texts]
    framed = {t for t, (_, f) in fixed.items() if f}
    article = [(t in framed, len(x[0])) for t, x in zip(tokens, texts, strict=True) if x and x[1].inside]
    around = [(fixed[t][0] if t in fixed else None, len(x[0])) for t, x in zip(tokens, texts, strict=True) if x and not x[1].inside]
    clear_article = 2 * sum(n for gone, n in article if gone) < sum(n for _, n in article)
    clear_around = 2 * sum(n for strong, n in around if strong is False) < sum(n for strong, n in around if not strong)
    inside, own, loose = [], [], []
    for (kind, text, element), token in zip(items, tokens, strict=True):
        if kind == "break":
            for part in (inside, own, loose):
                part.append(" ")
        elif kind == "text" and not element.boilerplate:
            where = element.label
            if token in fixed and (token in framed and clear_article and not _in_heading(element) if element.inside else fixed[token][0] or clear_around):
                continue
            text = entities.unescape(text)
            loose.append(text)
            if content and (where == content or where.startswith(content + "/")):
                inside.append(text)
            if element.inside:
                own.append(text)
    for part in (inside, own, loose):
        if found := " ".join("".join(part).split()):
            return found
    # Copies of one page share all their texts, which are then no template.
    return main_text(page, content, {}) if template else ""


def _in_heading(element: Element) -> bool:
    while element.parent and element.name not in HEADINGS:
        element = element.parent
    return element.name in HEADINGS


def extract(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """``(id, url, text)`` for every page."""
    found = durable(templates(pages, id_col, url_col, html_col).select("host", "region", "tokens", "class", "strong", "framed"), "templates")
    every = found.where(F.col("host") == ANY_HOST).first()
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = src.join(small_side(found.where(F.col("host") != ANY_HOST), MAX_TEMPLATES), "host", "left").select("id", "url", "html", "host", "region", "tokens", "class", "strong", "framed")
    any_region, shared = (every["region"], as_template(every["tokens"], every["class"], every["strong"], every["framed"])) if every else (None, {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template] = {}
        for batch in batches:
            out = []
            pages, hosts, regions = [batch.column(i).to_pylist() for i in (2, 3, 4)]
            for i, (page, host, content) in enumerate(zip(pages, hosts, regions, strict=True)):
                own = batch.column(5)[i].is_valid
                if own and host not in known:
                    if len(known) > 256:
                        known.clear()
                    known[host] = as_template(*[batch.column(k)[i].as_py() for k in (5, 6, 7, 8)])
                out.append(main_text(page, content, known[host]) if own else main_text(page, any_region, shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["id", "url", "text"])

    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("url", src.schema["url"].dataType), T.StructField("text", T.StringType())])
    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
