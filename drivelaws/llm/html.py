"""Main text of web pages by consensus host paths.

Every page scores its containers by the share of its running text they hold. Paths of tags and
classes, with numbers taken out, are voted on per host in Spark; the winning path of a host then
says, on each of its pages, which containers are the article. Without an article element that is the
deepest path that leaves practically nothing outside.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, bounded, settle, text_of

# Fixed values of HTML: elements that open a block, containers that have a place in a path,
# elements without content, elements whose content is no markup.
CONTAINERS = frozenset("html body main article section div td th tr table tbody ul ol dl aside nav header footer form "
                       "figure details dialog fieldset blockquote center template noscript".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address caption figcaption summary legend option thead tfoot".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
# Elements that are never part of an article.
NO_ARTICLE = frozenset("head nav footer aside form template noscript dialog button select svg canvas object video audio menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in classes and ids (the whole or its leading part), roles, that mark what is around an article.
NO_ARTICLE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar "
    "header masthead topbar footer sidebar aside rail widget "
    "cookie cookies consent gdpr notice notices alert popup modal overlay paywall "
    "comment comments disqus replies respond reader-comments "
    "share sharing social related recommended recommendations newsletter subscribe signup login search "
    "copyright disclaimer skip".split())
# Elements whose classes say what a page or an article has beside its text, not what they are.
UNMARKED = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
NO_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu form".split())
WINNING_SHARE = 0.6
# A container holds a page if no running text is beside it in the containers around it and of the page's
# no first heading and no more than this share in other containers; it may win a host if it holds most
# pages that have it.
LEFT_OUT = 0.01
HELD_PAGES = 0.8
# A mark by words is overruled where it would discard more than this share of a page's running text, on
# a host where it would on more than this share of the pages that have it.
MOST = 0.5

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)", re.S)
_PLAIN = re.compile(r"[^'\"<>]*+")
_ATTRIBUTE = re.compile(r"""([^\s=/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[A-Za-z]+(?:[-_]?[A-Za-z]+)*")
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


def _tag_end(html: str, at: int, failed: set[int]) -> int:
    """Where the tag whose attributes begin at ``at`` has its closing >, or -1 if it has none.

    A quote mark opens a value only after =, and is one character if it is never closed. ``failed``
    holds the quotes at which a value was opened in vain, so that none is followed twice.
    """
    opened = []
    while True:
        at = _PLAIN.match(html, at).end()
        if at == len(html) or html[at] == "<" or at in failed:
            failed.update(opened)
            return -1
        if html[at] == ">":
            return at
        before = at - 1
        while html[before].isspace():
            before -= 1
        if html[before] == "=":
            opened.append(at)
            end = html.find(html[at], at + 1)
            at = end if end >= 0 else at
        at += 1


def _marks(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """What a tag adds to a path, whether it can't be within an article, and whether words say that it isn't."""
    if not attributes or not attributes.strip():
        return "", False, False
    named, out, said = "", False, False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "role":
            out |= value.lower() in NO_ARTICLE_ROLES
        elif name == "style":
            out |= "display:none" in value.replace(" ", "").lower()
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            out |= name == "aria-hidden" or value.lower() in ("", "hidden", "true")
        elif value and name in ("class", "id"):
            words = value.lower().split()
            said |= tag not in UNMARKED and any(w in NO_ARTICLE_WORDS or re.split(r"[-_\d]+", w)[0] in NO_ARTICLE_WORDS for w in words)
            kept = sorted({"".join(c for c in w if not c.isdigit()).strip("-_") for w in words} - {""})
            named += "".join(("." if name == "class" else "#") + w for w in kept)
    return named, out, said


def read_page(html: str) -> list[tuple[tuple[str, ...], str, int, tuple[str, ...] | None, bool]]:
    """Blocks of a page in order: path of containers, text, characters within links, marks, an h1 or not.

    Marks are the paths of the elements around a block whose words say that they are in no article, and
    None within elements that can't be in one.
    """
    blocks: list[tuple[tuple[str, ...], str, int, tuple[str, ...] | None, bool]] = []
    stack: list[tuple[str, str, bool, str]] = []  # tag, step of the path, outside of any article, path if marked by words
    path: tuple[str, ...] = ()
    marks: tuple[str, ...] = ()
    parts: list[str] = []
    linked, link_depth, skipped, at, n = 0, 0, 0, 0, len(html)
    title = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append((path, text, linked, None if skipped else marks, title))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        parts.append(text)
        if link_depth:
            linked += len(text.strip())

    failed: set[int] = set()
    while at < n:
        found, end = _TAG.search(html, at), -1
        while found and found[2] and (end := _tag_end(html, found.end(), failed)) < 0:
            found = _TAG.search(html, found.end())
        if not found:
            say(html[at:])
            break
        if found.start() > at:
            say(html[at:found.start()])
        name = found[2]
        if name is None:
            at = found.end()
            continue
        attributes, at = html[found.end():end], end + 1
        name, closing = name.lower(), found[1]
        if name == "a":
            link_depth = max(0, link_depth + (-1 if closing else 1))
        elif name == "br":
            parts.append(" ")
        if name in BLOCKS or name in NO_ARTICLE:
            flush()
            title = name == "h1" and not closing
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    skipped -= sum(s[2] for s in stack[i:])
                    del stack[i:]
                    path, marks = tuple(s[1] for s in stack if s[1]), tuple(s[3] for s in stack if s[3])
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        step, out, said = _marks(name, attributes)
        inside = any(s[0] in ("article", "main") for s in stack)
        out |= name in NO_ARTICLE or (name == "header" and not inside)
        if name in CONTAINERS or out or said:
            # what begins a page part ends open links
            if name in ("body", "main", "article"):
                link_depth = 0
                if name == "body":
                    skipped -= sum(s[2] for s in stack)
                    stack.clear()
            path = tuple(s[1] for s in stack if s[1])
            stack.append((name, name + step if name in CONTAINERS else "", out, ">".join((*path, name + step)) if said else ""))
            skipped += out
            path, marks = tuple(s[1] for s in stack if s[1]), tuple(s[3] for s in stack if s[3])
    flush()
    return blocks


def _weight(text: str, linked: int) -> int:
    """Characters of running text."""
    return max(0, len(text) - 2 * linked)


def mark_shares(blocks: list[tuple]) -> dict[str, float]:
    """The share of a page's running text that each mark would discard; of its article's, if it has one and that is less."""
    held: dict[str, list[float]] = {}
    totals = [0.0, 0.0]
    for path, text, linked, marks, _ in blocks:
        weight = _weight(text, linked) if marks is not None else 0
        inside = weight if any(re.match(r"[a-z]+", step)[0] in ("article", "main") for step in path) else 0
        totals = [totals[0] + weight, totals[1] + inside]
        for mark in set(marks or ()) if weight else ():
            of = held.setdefault(mark, [0.0, 0.0])
            of[0] += weight
            of[1] += inside
    return {mark: min(w / t for w, t in zip(of, totals) if t) for mark, of in held.items()}


def overruled(blocks: list[tuple]) -> set[str]:
    """The marks that one page alone would overrule: those that would discard most of its running text."""
    return {mark for mark, share in mark_shares(blocks).items() if share > MOST}


def container_shares(blocks: list[tuple], free: Collection[str]) -> list[tuple[str, float, int, bool, bool]]:
    """(path, share of the page's running text, depth, is an outermost article or main, holds the page) of every container.

    The page itself is the empty path. ``free`` are the marks that don't count.
    """
    held: dict[tuple[str, ...], float] = {}
    direct: set[tuple[str, ...]] = set()
    titles: set[tuple[str, ...]] = set()
    total = 0.0
    for path, text, linked, marks, title in blocks:
        weight = _weight(text, linked) if marks is not None and all(m in free for m in marks) else 0
        if weight:
            total += weight
            direct.add(path)
            if title:
                titles.add(path)
            for depth in range(len(path) + 1):
                held[path[:depth]] = held.get(path[:depth], 0.0) + weight
    found = []
    for path, weight in held.items():
        kinds = [re.match(r"[a-z]+", step)[0] in ("article", "main") for step in path]
        whole = weight >= (1 - LEFT_OUT) * total and not any(path[:depth] in direct for depth in range(len(path)))
        whole &= all(t[:len(path)] == path for t in titles)
        found.append((">".join(path), weight / total, len(path), bool(kinds) and kinds[-1] and not any(kinds[:-1]), whole))
    return found


def best_path(found: list[tuple[str, float, int, bool, bool]]) -> str | None:
    """The path that one page alone would choose, by the rule that hosts use."""
    fit = [f for f in found if f[4] or (f[3] and f[1] >= WINNING_SHARE)]
    return max(fit, key=lambda f: (f[3], f[2], f[1], f[0]))[0] if fit else None


def main_text(html: str, winner: str | None, free: Collection[str] = ()) -> str:
    """The blocks below the winning path; where the page has no such container, below its own best one."""
    blocks = read_page(html)
    for chosen in (winner, None):
        if chosen is None:
            free = overruled(blocks)
            chosen = best_path(container_shares(blocks, free))
        steps = tuple(chosen.split(">")) if chosen else ()
        texts = [text for path, text, _, marks, _ in blocks
                 if marks is not None and all(m in free for m in marks) and path[:len(steps)] == steps]
        if texts:
            return "\n".join(texts)
    return ""


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(text_of(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``(host, path, free)``: the path that wins each host's vote, and the marks that its pages overrule.

    Every page votes with the shares of its containers. An outermost article or main with
    ``WINNING_SHARE`` of all votes wins, else the deepest path that holds so many of the host's pages
    and ``HELD_PAGES`` of those that have it, in the end the page itself; ties go to more votes, then by name.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "html"):
            rows = []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                blocks = read_page(page)
                rows += [(host, False, *v) for v in container_shares(blocks, overruled(blocks))]
                rows += [(host, True, mark, share, 0, False, share > MOST) for mark, share in mark_shares(blocks).items()]
            columns = list(zip(*rows)) or [[]] * 7
            kinds = (pa.string(), pa.bool_(), pa.string(), pa.float64(), pa.int32(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "mark", "path", "share", "depth", "whole", "holds"])

    rows = pages.select(host_of(F.col(f"`{url}`")).alias("host"), text_of(F.col(f"`{html}`")).alias("html"))
    each = rows.mapInArrow(run, "host string, mark boolean, path string, share double, depth int, whole boolean, holds boolean")
    # votes as whole numbers, so that their sum does not depend on the order of rows
    vote = F.sum(F.round(F.col("share") * 1_000_000).cast("long")).alias("votes")
    votes = settle(each.groupBy("host", "mark", "path").agg(
        vote, F.max("depth").alias("depth"), F.max("whole").alias("whole"), F.count(F.lit(1)).alias("pages"), F.count_if("holds").alias("held")))
    paths = votes.filter("not mark")
    top = paths.filter("depth = 0").select("host", F.col("votes").alias("top"), F.col("pages").alias("all_pages"))
    article = F.col("whole") & (F.col("votes") >= WINNING_SHARE * F.col("top"))
    held = (F.col("held") >= WINNING_SHARE * F.col("all_pages")) & (F.col("held") >= HELD_PAGES * F.col("pages"))
    fit = paths.join(top, "host").filter(article | held).withColumn("whole", article)
    won = fit.groupBy("host").agg(F.max_by("path", F.struct("whole", "depth", "votes", "path")).alias("path"))
    free = votes.filter(F.col("mark") & (F.col("held") > MOST * F.col("pages"))).groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("free"))
    none = F.array().cast("array<string>")
    return settle(won.join(free, "host", "left").withColumn("free", F.coalesce("free", none)))


def extract(pages: DataFrame, html: str = "html", url: str = "url", text: str = "text") -> DataFrame:
    """The rows of ``pages`` without their html and with ``text``: the main text, empty if there is none.

    Null html is empty, a null url is a host of its own; repeated rows stay repeated. A column already
    called ``text`` is replaced.
    """
    columns = [c for c in pages.columns if c not in (html, text)]
    winners = host_paths(pages, html, url)
    rows = pages.select(
        F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__row"), text_of(F.col(f"`{html}`")).alias("html"),
        host_of(F.col(f"`{url}`")).alias("host"))
    # hosts without any text have no winner; a left join would keep them, so they get a row of their own
    named = rows.join(winners.select("host"), "host", "left_anti").select("host").distinct().select(
        "host", F.lit(None).cast("string").alias("path"), F.array().cast("array<string>").alias("free"))
    joined = attach(rows, settle(winners.unionByName(named)), ["host"])
    row_type = rows.schema["__row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "html"):
            texts = [main_text(*page) for page in zip(*(batch.column(c).to_pylist() for c in ("html", "path", "free")))]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(texts, pa.string())], ["__row", "__text"])

    done = joined.select("__row", "html", "path", "free").mapInArrow(run, f"__row {row_type}, __text string")
    return done.select(*(F.col("__row")[c].alias(c) for c in columns), F.col("__text").alias(text))
