"""Main text of web pages by a wrapper of each host, a union-free regular expression that its pages match.

Inference: a page's skeleton are its tags and texts, each text by its path of open tags (with a bang for words of class
and id that matter); equal neighbouring groups fold into one repeated group. The skeletons of a host are aligned one
after another, the most frequent first: equal stretches stay, what only one side has becomes an optional group, a group
beside its repetition a repeated one. Those that the wrapper covers already change nothing. A host's wrapper is inferred
from all its pages: about TOGETHER skeletons become a wrapper in one task, then so many wrappers one, until one is left.

Matching: a page's tags and texts run through the positions of its host's wrapper, which gives each text a slot. Strings
of a slot are compared over the host's pages: where they mismatch it is a text slot, where the n-th string of a slot is
the same on all pages that have it, it is template. Spark counts the strings, so no task holds a host. A page that its
wrapper does not match or that has no host is kept without template.

The matched slots of a page are main text or not by the regions they lie in: navigation, headers, footers, asides, forms,
notices, adverts and comments are not, and an article or main region, where the page has one, excludes what is outside
it. Pages give the text of their main slots, without template; what stands in an article or main region is never template.

Defined results: a null or empty page has an empty text; a page without tags is all text; a url without a host belongs
to the host of the empty name; repeated pages are pages of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, short_batches, stored, with_columns

#: Skeletons, or wrappers, of a host that one task aligns, and most bytes of wrappers that are broadcast.
TOGETHER, SMALL_BYTES = 64, 64 << 20
#: Skeletons of a host that its wrapper is inferred from, the most frequent ones; None: all.
LEARNT: int | None = None
#: Pairs of items up to which two sides are compared item by item; longer ones are first cut at items that both have once.
PAIRS = 4_000_000
#: Steps after which a wrapper counts as not covering a skeleton, so that they are aligned.
STEPS = 100_000
#: Different pages of a host that must agree on a string before it is template.
LEAST_PAGES = 3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template noscript iframe svg xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr del".split())
BLOCKS_OF_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
OUTSIDE = frozenset("nav footer aside form head button select menu dialog figure-ad".split()) | RAW
#: Words of class, id and role that mark a region as no part of the article. A token counts as a whole: such words with
#: known words of place before them and of form after them, so that "has-sidebar" or "entry-header" mark nothing.
_WORDS = (
    r"(?:ad|ads|advert\w*|adbox|banner|sponsor\w*|promo\w*|cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|nav|navbar|navigation|menu|menubar|breadcrumbs?|sidebar|side|aside|header|masthead|"
    r"footer|comments?|replies|reply|disqus|discussion|respond|share|social|related|recommended|widgets?|pagination|pager|toolbar|login|signup|search|searchbox|complementary|contentinfo)"
)
_BEFORE = r"(?:site|page|main|global|top|bottom|left|right|primary|secondary|mobile|desktop|sub|blog|post|user|wp|js|l|c|g)"
_AFTER = r"(?:box|block|wrap|wrapper|container|area|section|list|bar|panel|inner|outer|content|links?|buttons?|icons?|posts?|articles?|items?|form|unit|slot|thread|title|left|right|top|bottom|main|primary|secondary|\d+)"
MARKS = re.compile(rf"(?:{_BEFORE}[_-]+)*{_WORDS}(?:[_-]+(?:{_WORDS}|{_AFTER}))*", re.I)
#: Tokens that mark a header, which is outside before the main region begins and content in it.
_HEADER = re.compile(rf"(?:{_BEFORE}[_-]+)*(?:header|masthead)(?:[_-]+{_AFTER})*", re.I)
#: What is outside even where nothing else is left.
HIDDEN = frozenset("nav footer head button select menu".split()) | RAW
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_MARKED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """("open", label), ("close", tag), and ("text", raw text); a label has a bang where class, id or role mark it, and
    two where they mark it as a header alone."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            yield "text", page[at:]
            return
        if m.start() > at:
            yield "text", page[at : m.start()]
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if m[1]:
                yield "close", tag
                continue
            words = [w for x in _MARKED.finditer(m[3]) for w in x[1].strip("\"'").split() if MARKS.fullmatch(w)] if "=" in m[3] else []
            yield "open", tag + ("" if not words else "!!" if all(map(_HEADER.fullmatch, words)) else "!")
            if tag in RAW and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s>/])", re.I).search(page, at)
                at = end.start() if end else n


def walk(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, label, text) of a page: tags as they open and close, and texts with the path of tags round them."""
    stack: list[str] = []
    names: list[str] = []
    for kind, value in tokens(page):
        if kind == "text":
            yield "text", "/".join(stack), value
            continue
        tag = value.rstrip("!")
        if kind == "open":
            if tag in BLOCKS_OF_P and "p" in names:
                p = len(names) - 1 - names[::-1].index("p")
                if not set(names[p:]) & {"article", "section", "div", "li", "td"}:
                    del names[p:], stack[p:]
            if tag in ("li", "td", "tr", "dt", "dd", "option") and names and names[-1] == tag:
                names.pop(), stack.pop()
            yield "open", value, ""
            if tag not in VOID:
                names.append(tag)
                stack.append(value)
        else:
            if tag in names:
                at = len(names) - 1 - names[::-1].index(tag)
                del names[at:], stack[at:]
            yield "close", tag, ""


def folded(items: list) -> list:
    """Neighbouring equal groups of up to 24 items as one repeated group ["+", ...], shorter groups first."""
    size = 1
    while size <= min(24, len(items) // 2):
        out, at = [], 0
        while at < len(items):
            unit, end = items[at : at + size], at + size
            while len(unit) == size and items[end : end + size] == unit:
                end += size
            if end > at + size:
                out.append(unit[0] if size == 1 and isinstance(unit[0], list) and unit[0][0] == "+" else ["+", *unit])
                at = end
            else:
                out.append(items[at])
                at += 1
        items = out
        size += 1
    return items


def read(page: str) -> tuple[list[str], list[list[tuple[str, str, int]]]]:
    """The tokens of a page, "<tag", ">tag" and "#path", and its blocks of text in order: the (path, decoded text, number
    of the token or -1) pieces of each. White space is no token."""
    out: list[str] = []
    found: list[list[tuple[str, str, int]]] = []
    own: list[tuple[str, str, int]] = []

    def close() -> None:
        if any(t.strip() for _, t, _ in own):
            found.append(own.copy())
        own.clear()

    for kind, label, text in walk(page):
        if kind == "text":
            solid = bool(text.strip())
            own.append((label, html.unescape(text), len(out) if solid else -1))
            if solid:
                out.append(f"#{label}")
            continue
        out.append(("<" if kind == "open" else ">") + label)
        if label.rstrip("!") not in INLINE:
            close()
    close()
    return out, found


def bare(item: object) -> str:
    """What an item is matched by: an optional or repeated group of one item as that item."""
    while isinstance(item, list) and len(item) == 2 and item[0] in ("?", "+"):
        item = item[1]
    if isinstance(item, list) and item[0] == "?":
        item = ["+", *item[1:]]
    return json.dumps(item)


def joined(a: object, b: object) -> object:
    """Two matching items as one: optional or repeated where either is."""
    if a == b:
        return a
    kinds, core = set(), a
    for core in (b, a):
        while isinstance(core, list) and core[0] in ("?", "+") and len(core) == 2:
            kinds.add(core[0])
            core = core[1]
        kinds |= {core[0]} if isinstance(core, list) else set()
    group = core[1:] if isinstance(core, list) else [core]
    out: object = ["+", *group] if "+" in kinds else group[0] if len(group) == 1 else ["+", *group]
    return ["?", out] if "?" in kinds else out


def opcodes(a: list[str], b: list[str]) -> Iterator[tuple[str, int, int, int, int]]:
    """How a becomes b, as SequenceMatcher has it. Where that would take more than PAIRS comparisons, both are cut at their
    equal ends and at the items that each has once and in the same order; what is between is compared for itself, and
    without such an item replaced."""
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, x, y = todo.pop()
        if (j - i) * (y - x) <= max(PAIRS, 1):
            for op, *at in SequenceMatcher(None, a[i:j], b[x:y], autojunk=False).get_opcodes():
                yield op, at[0] + i, at[1] + i, at[2] + x, at[3] + x
            continue
        same = [(i - 1, x - 1)]
        while same[-1][0] + 1 < j and same[-1][1] + 1 < y and a[same[-1][0] + 1] == b[same[-1][1] + 1]:
            same.append((same[-1][0] + 1, same[-1][1] + 1))
        end = 0
        while j - end - 1 > same[-1][0] and y - end - 1 > same[-1][1] and a[j - end - 1] == b[y - end - 1]:
            end += 1
        first, second = Counter(a[i:j]), Counter(b[x:y])
        where = {t: n for n, t in enumerate(b[x : y - end], x) if n > same[-1][1] and first[t] == second[t] == 1}
        same += increasing([(n, where[a[n]]) for n in range(same[-1][0] + 1, j - end) if a[n] in where])
        same += [(j - n, y - n) for n in range(end, 0, -1)]
        if len(same) == 1:
            yield "replace", i, j, x, y
            continue
        cuts: list = []
        for (n, m), (to, other) in zip(same, [*same[1:], (j, y)], strict=True):
            if n >= i:
                cuts.append((n, n + 1, m, m + 1))
            if n + 1 < to or m + 1 < other:
                cuts.append((n + 1, to, m + 1, other))
        todo += cuts[::-1]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs in the order of their first numbers, as many as can be with rising second ones."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for n, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        back.append(ends[at - 1] if at else -1)
        tops[at:], ends[at:] = [y, *tops[at + 1 :]], [n, *ends[at + 1 :]]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def aligned(a: list, b: list) -> list:
    """A wrapper that both a and b match: stretches that only one of them has are optional groups."""
    if a == b:
        return a
    out: list = []
    for op, i, j, x, y in opcodes([bare(t) for t in a], [bare(t) for t in b]):
        if op == "equal":
            out += [joined(p, q) for p, q in zip(a[i:j], b[x:y], strict=True)]
            continue
        for part in (a[i:j], b[x:y]):
            if part:
                out += part if all(isinstance(t, list) and t[0] == "?" for t in part) else [["?", *part]]
    return folded(out)


class Matcher:
    """The positions of a wrapper's tokens, and which may follow each."""

    def __init__(self, wrapper: list):
        self.token: list[str | None] = []  # None where the way only parts
        self.ways: list[list[int]] = []
        self.follow: dict[int, dict[str | None, list[int]]] = {}
        self._add(wrapper)
        self.ways.append([])
        self.token.append(None)

    def _add(self, items: list) -> None:
        for t in items:
            at = len(self.token)
            if isinstance(t, str):
                self.token.append(t)
                self.ways.append([at + 1])
                continue
            if t[0] == "?":
                self.token.append(None)
                self.ways.append([at + 1])
            self._add(t[1:])
            if t[0] == "?":
                self.ways[at].append(len(self.token))
            else:
                self.token.append(None)
                self.ways.append([at, len(self.token)])

    def after(self, at: int) -> dict[str | None, list[int]]:
        """The positions that may come after one (-1: at first) by their token, and the end under None."""
        if at not in self.follow:
            known: dict[str | None, list[int]] = {}
            seen, todo = set(), [0] if at < 0 else self.ways[at][::-1]
            while todo:
                x = todo.pop()
                if x in seen:
                    continue
                seen.add(x)
                if self.token[x] is not None or not self.ways[x]:
                    known.setdefault(self.token[x], []).append(x)
                else:
                    todo += self.ways[x][::-1]
            self.follow[at] = known
        return self.follow[at]

    def match(self, tokens: list[str]) -> list[int] | None:
        """The position of each token, the earliest way first where there are several; None if there is no way."""
        live, came = [-1], []
        for token in tokens:
            step: dict[int, int] = {}
            for at in live:
                for to in self.after(at).get(token, ()):
                    step.setdefault(to, at)
            if not step:
                return None
            came.append(step)
            live = list(step)
        at = next((x for x in live if None in self.after(x)), None)
        if at is None:
            return None
        out = []
        for step in reversed(came):
            out.append(at)
            at = step[at]
        return out[::-1]


    def covers(self, other: Matcher) -> bool:
        """Whether all that the other one matches is matched, as far as STEPS steps show it."""
        todo: list[tuple[int, frozenset[int]]] = [(-1, frozenset([-1]))]
        seen = set(todo)
        while todo:
            at, own = todo.pop()
            for token, after in other.after(at).items():
                step = frozenset(to for x in own for to in self.after(x).get(token, ()))
                if not step or len(seen) > STEPS:
                    return False
                new = {(to, step) for to in after if token is not None} - seen
                seen |= new
                todo += new
        return True


def merged(wrappers: Iterable[list]) -> list:
    """A wrapper that matches what one of these matches."""
    out: list | None = None
    for other in wrappers:
        if out is None:
            out, known = other, Matcher(other)
        elif not known.covers(Matcher(other)):
            out = aligned(out, other)
            known = Matcher(out)
    return out or []


def outside(path: list[str], marks: bool, tags: frozenset[str]) -> bool:
    """Whether one of the tags, or a mark where marks count, puts a path outside; in a main region headers are content."""
    inside = False
    for label in path:
        tag = label.rstrip("!")
        header = tag == "header" and tags is OUTSIDE or marks and label.endswith("!!")
        mark = marks and label.endswith("!") and not label.endswith("!!")
        if tag in tags or (mark and tag not in ("html", "body", "main")) or (header and tag not in ("html", "body", "main") and not inside):
            return True
        inside = inside or tag in ("article", "main")
    return False


def region(paths: Iterable[str]) -> frozenset[str]:
    """Of the paths of slots those that hold main text: in an article where there is one, else in main, else all inside.

    Marks on what is round an article or main region do not exclude it, unless another one is free of them. Where
    nothing is left, marks do not count, and then only navigation and what is not shown as text is outside."""
    parts = {p: p.split("/") for p in paths}
    kept = [p for p in parts if not outside(parts[p], True, OUTSIDE)]
    for tag in ("article", "main"):
        inside = [p for p in kept if tag in parts[p]]
        if inside:
            return frozenset(inside)
    for tag in ("article", "main"):
        inside = [p for p in parts if tag in parts[p] and not outside(parts[p], False, OUTSIDE) and not outside(parts[p][parts[p].index(tag) :], True, OUTSIDE)]
        if inside:
            return frozenset(inside)
    return frozenset(kept or [p for p in parts if not outside(parts[p], False, OUTSIDE)] or [p for p in parts if not outside(parts[p], False, HIDDEN)])


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def inferred(pages: DataFrame, url: str = "url", text: str = "html") -> DataFrame:
    """(host, wrapper): the wrapper of each host as JSON. Pages without a host have none in common."""

    def skeletons(texts: pa.Array) -> dict:
        return {"skeleton": pa.array([json.dumps(folded(read(t or "")[0])) for t in texts.to_pylist()], pa.string())}

    hosts = pages.select(host_of(F.col(url)).alias("host"), F.col(text).alias("_page")).filter("host <> '' AND _page <> ''")
    seen = with_columns(hosts, [("skeleton", "string")], lambda: skeletons, "_page")
    learnt = stored(seen.groupBy("host", "skeleton").count(), "skeletons")
    if LEARNT is not None:
        nth = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("count"), "skeleton"))
        learnt = learnt.withColumn("nth", nth).filter(F.col("nth") <= LEARNT).drop("nth")

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        own = part.sort_values(["turn", "wrapper"])["wrapper"]
        return pd.DataFrame({"host": part["host"].iloc[:1], "chunk": part["chunk"].iloc[:1], "wrapper": [json.dumps(merged(map(json.loads, own)))]})

    sizes = learnt.groupBy("host").agg(F.ceil(F.count("*") / TOGETHER).alias("chunks"))
    chunk = F.pmod(F.xxhash64("skeleton"), F.col("chunks")).alias("chunk")
    rows = learnt.join(sizes, "host").select("host", chunk, (-F.col("count")).alias("turn"), F.col("skeleton").alias("wrapper"))
    chunks = sizes.agg(F.max("chunks")).first()[0] or 1  # one number
    while True:
        found = rows.groupBy("host", "chunk").applyInPandas(merge, "host string, chunk long, wrapper string")
        if chunks == 1:
            return found.select("host", "wrapper")
        rows = stored(found, "wrappers").select("host", F.floor(F.col("chunk") / TOGETHER).alias("chunk"), F.col("chunk").alias("turn"), "wrapper")
        chunks = -(-chunks // TOGETHER)


def spoken(pieces: list[tuple[str, str]]) -> str:
    return " ".join("".join(t for _, t in pieces).split())


def places(slots: list[tuple[int, ...]]) -> list[tuple[str, str]]:
    """Two places of each block by the slots of its texts: these with the block's number among those of the same slots,
    from the first and from the last on."""
    totals, seen = Counter(slots), Counter()
    out = []
    for own in slots:
        name = "-".join(map(str, own))
        out.append((f"{name} {seen[own]}", f"{name} {seen[own] - totals[own]}"))
        seen[own] += 1
    return out


def main_blocks(page: str, matcher: Matcher | None) -> list[tuple[str, str | None, str | None]]:
    """(text, two places) of the blocks in the page's main slots; places are null where a block is never template: in an
    article or main region, or on a page that is not matched."""
    tokens, found = read(page)
    slots = matcher.match(tokens) if matcher else None
    chosen = region(p for pieces in found for p, _, n in pieces if n >= 0)
    where = places([tuple(slots[n] for _, _, n in pieces if n >= 0) for pieces in found]) if slots else [(None, None)] * len(found)
    out = []
    for pieces, at in zip(found, where, strict=True):
        said = spoken([(p, t) for p, t, _ in pieces if p in chosen])
        if said:
            path = next(p for p, _, n in pieces if n >= 0)
            own = not {"article", "main"} & {x.rstrip("!") for x in path.split("/")}
            out.append((said, *(at if own else (None, None))))
    return out


BLOCKS = "array<struct<said: string, first: string, last: string>>"


def matched(pages: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The columns to keep, `_host`, `_name` (a hash of the page) and `_blocks`, of pages with `_host` and `_wrapper`."""
    rows = pages.select(*keep, "_host", F.xxhash64(text).alias("_name"), F.col("_wrapper"), F.col(text).alias("_page"))
    schema = T.StructType([*(rows.schema[c] for c in [*keep, "_host", "_name"]), T.StructField("_blocks", T._parse_datatype_string(BLOCKS))])
    kind = pa.list_(pa.struct([("said", pa.string()), ("first", pa.string()), ("last", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Matcher] = {}
        for batch in batches:
            *others, wrappers, texts = batch.columns
            found = []
            for wrapper, page in zip(wrappers.to_pylist(), texts.to_pylist(), strict=True):
                if wrapper is not None and wrapper not in known:
                    if len(known) > 1_000:
                        known.clear()
                    known[wrapper] = Matcher(json.loads(wrapper))
                found.append([dict(zip(("said", "first", "last"), b, strict=True)) for b in main_blocks(page or "", known.get(wrapper))])
            yield pa.RecordBatch.from_arrays([*others, pa.array(found, kind)], names=schema.names)

    return short_batches(rows).mapInArrow(released(run), schema)


def template_places(rows: DataFrame) -> DataFrame:
    """(host, template): of matched rows, the places of a host's slots where strings never mismatch, on LEAST_PAGES and
    half of its different pages at least."""
    different = rows.filter("_host <> ''").select(F.col("_host").alias("host"), F.col("_name").alias("page"), F.filter("_blocks", lambda b: b["first"].isNotNull()).alias("own"))
    different = different.dropDuplicates(["host", "page"])
    sizes = different.groupBy("host").agg(F.count("*").alias("pages"))
    each = different.select("host", F.explode("own").alias("b")).select("host", F.explode(F.array("b.first", "b.last")).alias("place"), F.xxhash64("b.said").alias("string"))
    constant = each.groupBy("host", "place").agg(F.min("string").alias("a"), F.max("string").alias("b"), F.count("*").alias("n")).filter(f"a = b AND n >= {LEAST_PAGES}")
    return constant.join(sizes, "host").filter("2 * n >= pages").groupBy("host").agg(F.sort_array(F.collect_list("place")).alias("template"))


def by_host(rows: DataFrame, of_hosts: DataFrame, column: str) -> DataFrame:
    """rows with `_<column>` of their host, which is broadcast unless there is too much of it."""
    size = of_hosts.agg(F.sum(F.length("host") + F.length(F.col(column).cast("string")))).first()[0] or 0
    named = of_hosts.select(F.col("host").alias("_host"), F.col(column).alias(f"_{column}"))
    return rows.join(F.broadcast(named) if size <= SMALL_BYTES else named, "_host", "left")


def extract(pages: DataFrame, url: str = "url", text: str = "html") -> DataFrame:
    """pages with `text`, the main text of every whole page, and n_chars."""
    keep = [c for c in pages.columns if c not in ("text", "n_chars", "_host", "_name", "_wrapper", "_template", "_blocks", text)]
    wrappers = stored(inferred(pages, url, text), "wrappers")
    hosted = pages.select(*keep, F.col(text), host_of(F.col(url)).alias("_host"))
    rows = stored(matched(by_host(hosted, wrappers, "wrapper"), keep, text), "blocks")
    both = by_host(rows, stored(template_places(rows), "templates"), "template")
    fixed = lambda b: F.coalesce(F.array_contains("_template", b["first"]) | F.array_contains("_template", b["last"]), F.lit(False))
    own = F.filter("_blocks", lambda b: ~fixed(b))
    said = F.array_join(F.transform(F.when(F.size(own) > 0, own).otherwise(F.col("_blocks")), lambda b: b["said"]), " ")
    return both.select(*keep, said.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
