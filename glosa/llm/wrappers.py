"""HTML extraction (operator 12): wrappers by union-free regular-expression inference.

A page is a stream of tags and texts, nested as its tags nest.  A wrapper is a regular expression
without unions over such streams: elements in order, each once, optional (``?``), repeated
(``+``) or both (``*``), with constant texts and text slots.  Inference aligns the pages of a host one
after the other with the wrapper so far:

* two unequal texts become a slot;
* where tags differ, the nearest place where both go on alike is sought; what lies between is optional;
* neighbours of one tag, and tandem sequences of up to ``PERIOD`` tags, become one repeated group.

Alignment starts where the pages are read (one wrapper a host and task goes on), is continued by
host and salt, then by host, so a host with a third of all pages is spread over all tasks and only
wrappers are shuffled, no pages.  A wrapper says where a host's pages keep their article: in the
``article`` (or ``main``) element whose slots hold the most text; where a host has none, in the container
that holds the slots' text outside links.  It also says which single blocks inside are the same on
all of at least ``LEAST_PAGES`` pages, headings excepted: notices, not prose.  Hosts' choices go to the
pages by a join (a broadcast if few).  A page that its host's choice doesn't fit, or of no host, is a wrapper of its own.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments inside
the article are told by their tags, roles, and class and id names (``SKIPPED``, ``SKIPPED_ROLES``, ``SKIPPED_WORDS``);
of a header inside the article its headings stay.

Defined results: null html has an empty text; unclosed elements end with the page; repeated rows each have a
result; an empty table gives an empty result; other columns are left alone.  A line break is white space;
white space is what ``str.split`` takes for it.  Wrappers follow at most ``DEPTH`` levels and ``WIDTH`` different
neighbours; texts beyond are extracted all the same.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosa.llm.common import BROADCAST_ROWS, written

DEPTH, WIDTH, PERIOD = 48, 256, 4
LEAST_PAGES = 8
SALTS = 64
HELD_HOSTS = 4000
BROADCAST_BYTES = 16 << 20

#: Fixed values of HTML: elements without content, with raw content, that are blocks, and what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th
thead tr ul""".split())
CLOSES_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hgroup hr main menu nav ol p pre search section summary table ul""".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
             "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"},
          "tbody": {"table"}, "tfoot": {"table"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body div section td tr tbody table center main article form span".split())

#: What isn't article text: tags, ARIA roles, and first or last words of class and id names.
SKIPPED = frozenset("""script style noscript template head title nav footer aside form button select textarea input iframe object svg canvas menu dialog
noembed noframes""".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SKIPPED_WORDS = frozenset("""ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent
gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu menus breadcrumb breadcrumbs sidebar
footer masthead topbar toolbar social share sharing related recommended recommendations comment comments reply replies disqus respond pagination pager widget
widgets copyright commentlist""".split())
HEADER_WORDS = frozenset(["header"])
NOT_A_PART = frozenset("has with no without is page single layout theme".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Element:
    """``sig``: tag, class and id names with longer numbers made alike; ``skip``: no article text; ``kids``: elements and texts."""

    __slots__ = ("tag", "sig", "skip", "kids")

    def __init__(self, tag: str, sig: str, skip: str):
        self.tag, self.sig, self.skip, self.kids = tag, sig, skip, []


def described(tag: str, attributes: str) -> tuple[str, str]:
    return _described(tag, attributes) if len(attributes) < 500 else _described.__wrapped__(tag, attributes)


@lru_cache(1 << 14)
def _described(tag: str, attributes: str) -> tuple[str, str]:
    """(sig, skip): skip is "all", "header" (only headings stay) or ""."""
    found = {k.lower(): (v or "").strip("\"'") for k, v in reversed(_ATTRIBUTE.findall(attributes))}
    names = entities.unescape(f"{found.get('class', '')} {found.get('id', '')}").split()
    sig = tag + "".join("." + re.sub(r"\d{2,}", "0", n) for n in names)
    skip = "all" if tag in SKIPPED else "header" if tag == "header" else ""
    unseen = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    if unseen or found.get("role", "").lower() in SKIPPED_ROLES:
        skip = "all"
    if tag not in ("html", "body", "main"):
        for n in names:
            words = [w.lower() for w in _WORD.findall(n)]
            if not words or words[0] in NOT_A_PART:
                continue
            ends = {words[0], words[-1], "".join(words)}
            if ends & SKIPPED_WORDS and (tag != "article" or ends & {"comment", "comments", "reply", "replies"}):
                skip = "all"
            elif words[-1] in HEADER_WORDS and not skip:
                skip = "header"
    return sig, skip


def parsed(page: str) -> Element:
    """The page as a tree.  Linear: a page whose quotes don't close is read on without them."""
    root = Element("", "", "")
    stack, at, tags = [root], 0, _TAG
    open_: Counter = Counter()  # what is on the stack
    last = page.rfind(">")

    def text(s: str) -> None:
        if s:
            stack[-1].kids.append(s)

    def close(i: int) -> None:
        open_.subtract(e.tag for e in stack[i:])
        del stack[i:]

    while True:
        lt = page.find("<", at)
        if lt < 0 or lt > last and not page.startswith("<!--", lt):  # no tag ends behind it
            text(page[at:])
            return root
        if page.startswith("<!--", lt):
            text(page[at:lt])
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page[lt + 1: lt + 2] in ("!", "?"):
            text(page[at:lt])
            end = page.find(">", lt)
            at = len(page) if end < 0 else end + 1
            continue
        m = tags.match(page, lt)
        if m is None and tags is _TAG and page[lt + 1: lt + 3].strip("/")[:1].isalpha():
            tags = _LOOSE
            m = tags.match(page, lt)
        if m is None:
            text(page[at: lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if open_[tag] > 0 else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:
                    break  # an inline end tag doesn't close blocks
                if stack[i].tag in SCOPES.get(tag, ()) or stack[i].tag in ("td", "th") and tag not in ("tr", "tbody", "thead", "tfoot", "table", "body", "html"):
                    break
            continue
        if tag in CLOSES_P and open_["p"] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in ("table", "td", "th", "caption", "button", "object", "template"):
                    break
        if tag in CLOSED_BY and any(open_[t] > 0 for t in CLOSED_BY[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SCOPES[tag]:
                    break
                if stack[i].tag in CLOSED_BY[tag]:
                    close(i)
        own = Element(tag, *described(tag, m[3]))
        stack[-1].kids.append(own)
        if tag in RAW:
            raw = re.compile(rf"</{tag}\b", re.I).search(page, at)
            end = raw.start() if raw else len(page)
            own.kids.append(page[at:end])
            at = page.find(">", end) + 1 if raw and page.find(">", end) >= 0 else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(own)
            open_[tag] += 1


def plain(s: str) -> str:
    return " ".join(entities.unescape(s).split())


# --- wrappers -------------------------------------------------------------------------------
# An item is a list [key, times, kids, text, chars, pages]: key is an element's sig, "#" for a text or "(a b)" for
# a group; times one of "", "?", "+", "*"; text is a constant text's hash, or None for a slot;
# chars all texts' length; pages how many pages have it.

KEY, TIMES, KIDS, TEXT, CHARS, PAGES = range(6)


def text_hash(s: str) -> str:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _times(a: str, b: str) -> str:
    more, less = "+" in a + b or "*" in a + b, "?" in a + b or "*" in a + b
    return "*" if more and less else "+" if more else "?" if less else ""


def page_wrapper(root: Element) -> list:
    """A page as a wrapper of its own, its repeats folded."""
    def items(e: Element, depth: int) -> list:
        out = []
        for k in e.kids:
            if isinstance(k, str):
                s = plain(k)
                if s:
                    out.append(["#", "", [], text_hash(s), len(s), 1])
            elif k.skip != "all":
                if depth < DEPTH:
                    out.append([k.sig, "", items(k, depth + 1), None, 0, 1])
        return folded(out)

    return ["", "", items(root, 0), None, 0, 1]


def _repeat(a: list, b: list) -> list:
    """A neighbour taken into a repeat."""
    out = aligned_item(a, b)
    out[TIMES] = "+" if {a[TIMES], b[TIMES]} & {"", "+"} else "*"
    out[PAGES] = max(a[PAGES], b[PAGES])
    return out


def folded(items: list) -> list:
    """Neighbours of one key as one repeated item; then tandem sequences as repeated groups."""
    out: list = []
    for it in items:
        if out and out[-1][KEY] == it[KEY]:
            out[-1] = _repeat(out[-1], it)
        else:
            out.append(it)
    for period in range(2, PERIOD + 1):
        i = 0
        while i + 2 * period <= len(out):
            keys = [x[KEY] for x in out[i: i + period]]
            n = 1
            while [x[KEY] for x in out[i + n * period: i + (n + 1) * period]] == keys:
                n += 1
            if n > 1 and len(set(keys)) > 1:
                body = out[i: i + period]
                for j in range(1, n):
                    body = [aligned_item(a, b) for a, b in zip(body, out[i + j * period: i + (j + 1) * period])]
                out[i: i + n * period] = [["(" + " ".join(keys) + ")", "+", body, None, 0, max(b[PAGES] for b in body)]]
            i += 1
    return out[:WIDTH]


def aligned_item(a: list, b: list) -> list:
    return [a[KEY], _times(a[TIMES], b[TIMES]), aligned(a[KIDS], b[KIDS]), a[TEXT] if a[TEXT] == b[TEXT] else None, a[CHARS] + b[CHARS], a[PAGES] + b[PAGES]]


def _optional(a: list) -> list:
    return [a[KEY], _times(a[TIMES], "?"), *a[KIDS:]]


def _in_group(group: list, items: list, at: int) -> int:
    """How many items from ``at`` are one more turn of the group."""
    keys = [x[KEY] for x in group[KIDS]]
    return len(keys) if [x[KEY] for x in items[at: at + len(keys)]] == keys else 0


def aligned(a: list, b: list) -> list:
    """One wrapper for both sequences."""
    if not a or not b:
        return [_optional(x) for x in a or b]
    places: tuple[dict, dict] = ({}, {})
    for p, items in zip(places, (a, b)):
        for i, x in enumerate(items):
            p.setdefault(x[KEY], []).append(i)

    def after(p: dict, key: str, i: int) -> int | None:
        own = p.get(key, ())
        k = bisect_left(own, i)
        return own[k] if k < len(own) else None

    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i][KEY] == b[j][KEY]:
            out.append(aligned_item(a[i], b[j]))
            i, j = i + 1, j + 1
            continue
        for x, y, k in ((a[i], b, j), (b[j], a, i)):  # turns of a group that stand alone on the other side
            n = _in_group(x, y, k) if x[KEY].startswith("(") else 0
            if n:
                x = [*x]
                while n:
                    x[KIDS] = [aligned_item(p, q) for p, q in zip(x[KIDS], y[k: k + n])]
                    k += n
                    n = _in_group(x, y, k)
                out.append(x)
                i, j = (i + 1, k) if y is b else (k, j + 1)
                break
        else:
            in_b, in_a = after(places[1], a[i][KEY], j), after(places[0], b[j][KEY], i)
            if in_b is not None and (in_a is None or in_b - j <= in_a - i):
                out += [_optional(x) for x in b[j:in_b]]
                j = in_b
            elif in_a is not None:
                out += [_optional(x) for x in a[i:in_a]]
                i = in_a
            else:
                out += [_optional(a[i]), _optional(b[j])]
                i, j = i + 1, j + 1
    return folded(out + [_optional(x) for x in a[i:] + b[j:]])


def _tag(key: str) -> str:
    return key.split(".")[0]


def _prose(item: list, pages: int) -> int:
    """Length of the texts outside links that differ between pages (all texts, of one page)."""
    if _tag(item[KEY]) == "a":
        return 0
    own = item[CHARS] if item[KEY] == "#" and (item[TEXT] is None or pages < 2) else 0
    return own + sum(_prose(k, pages) for k in item[KIDS])


def _walk(item: list, path: tuple, single: bool) -> Iterator[tuple[tuple, list, bool]]:
    """(path, item, on every page once) below an item; groups leave no trace in paths."""
    for k in item[KIDS]:
        own = path if k[KEY].startswith("(") else (*path, k[KEY])
        once = single and not k[TIMES] and k[PAGES] == item[PAGES]
        yield own, k, once
        yield from _walk(k, own, once)


def choice(wrapper: list) -> dict:
    """Where the wrapper's pages keep their article ("path"), and the hashes of path and text
    of the blocks inside that all pages share ("drop")."""
    pages = wrapper[PAGES]
    elements = [(path, k) for path, k, _ in _walk(wrapper, (), True) if k[KEY] != "#" and not k[KEY].startswith("(")]
    best = None
    for wanted in ("article", "main"):
        own: dict[tuple, int] = {}
        for path, k in elements:
            if _tag(k[KEY]) == wanted:
                own[path] = own.get(path, 0) + _prose(k, 1)
        if own:
            best = min(own, key=lambda p: (-own[p], len(p), p))
            break
    if best is None:
        best, at = (), wrapper
        while True:
            kids = [k for k in at[KIDS] if k[KEY] != "#"]
            sizes = [_prose(k, pages) for k in kids]
            total = _prose(at, pages)
            top = max(range(len(kids)), key=lambda i: sizes[i], default=None)
            if top is None or _tag(kids[top][KEY]) not in CONTAINERS or 10 * sizes[top] < (9 if pages > 1 else 5) * total:
                break
            if any(_tag(x[KEY]) in HEADINGS or any(_tag(y[KEY]) in HEADINGS for _, y, _ in _walk(x, (), True)) for i, x in enumerate(kids) if i != top and sizes[i]):
                break  # the article's heading stands beside it
            at = kids[top]
            best = (*best, at[KEY])
    drop: set[str] = set()
    inside = [(path, k, once) for path, k, once in _walk(wrapper, (), True) if path[: len(best)] == best]
    if pages >= LEAST_PAGES and any(k[KEY] == "#" and k[TEXT] is None for _, k, _ in inside):
        for path, k, once in inside:
            texts = [(p, t, o) for p, t, o in _walk(k, path, once) if t[KEY] == "#"]
            whole = once and texts and _tag(k[KEY]) in BLOCKS and all(o and t[TEXT] for _, t, o in texts)
            if whole and not any(_tag(x) in HEADINGS for p, _, _ in texts for x in p):
                drop |= {text_hash("/".join(p) + "\n" + t[TEXT]) for p, t, _ in texts}
    return {"path": list(best), "drop": sorted(drop)}


# --- extraction -----------------------------------------------------------------------------


def regions(root: Element, path: list[str]) -> list[Element]:
    """The elements at a path of sigs, in page order."""
    found = [root]
    for sig in path:
        found = [k for e in found for k in e.kids if isinstance(k, Element) and k.sig == sig and k.skip != "all"]
    return found


def article_text(root: Element, wanted: dict) -> str:
    """The blocks of the wanted regions, joined by empty lines."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        s = plain("".join(line))
        line.clear()
        if s:
            blocks.append(s)

    drop = set(wanted["drop"])
    for region in regions(root, wanted["path"]):
        # (element or text, path, inside a header without a heading yet); None ends a block
        todo: list = [(region, tuple(wanted["path"]), region.skip == "header")]
        while todo:
            e, path, header = todo.pop()
            if e is None:
                flush()
            elif isinstance(e, str):
                if not header and not (drop and text_hash("/".join((*path, "#")) + "\n" + text_hash(plain(e))) in drop):
                    line.append(e)
            elif e.skip == "all":
                if e.tag in BLOCKS:
                    flush()
            else:
                if e.tag == "br":
                    line.append("\n")
                if e.tag in BLOCKS:
                    flush()
                    todo.append((None, (), False))
                header = (header or e.skip == "header") and e.tag not in HEADINGS
                for k in reversed(e.kids):
                    todo.append((k, path if isinstance(k, str) else (*path, k.sig) if drop else (), header))
        flush()
    return "\n\n".join(blocks)


@lru_cache(1 << 12)
def _read(wanted: str) -> dict:
    return json.loads(wanted)


def extracted(page: str | None, wanted: str | None) -> str:
    if not page:
        return ""
    root = parsed(page)
    plan = _read(wanted) if wanted else None
    if plan is None or not regions(root, plan["path"]):
        plan = choice(page_wrapper(root))
    return article_text(root, plan)


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) -> (host, wrapper): a wrapper for each host and task, or some more."""
    held: dict[str, list] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())], ["host", "wrapper"])

    for batch in batches:
        for host, page in zip(*(c.to_pylist() for c in batch.columns)):
            own = page_wrapper(parsed(page))
            held[host] = aligned_item(held[host], own) if host in held else own
            if len(held) >= HELD_HOSTS:
                yield out()
                held = {}
    if held:
        yield out()


def _unite(last: bool):
    """Wrappers by host -> one wrapper for each host, or what it says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, done = None, None, []

        def out() -> pa.RecordBatch:
            made = [(h, json.dumps(choice(w) if last else w)) for h, w in done]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*made)], ["host", "wrapper"])

        for batch in batches:
            for host, wrapper in zip(*(c.to_pylist() for c in batch.columns)):
                w = json.loads(wrapper)
                if own is not None and host == now:
                    own = aligned_item(own, w)
                else:
                    if own is not None:
                        done.append((now, own))
                    now, own = host, w
            if done:
                yield out()
                done = []
        if own is not None:
            done = [(now, own)]
            yield out()

    return run


def host_of(url: str | Column) -> Column:
    """Lower-cased (A-Z) from the first ``://`` to ``/``, ``?``, ``#`` or the end; null where there is none."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]+)", 1)
    return F.when(rest != "", F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def host_choices(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper): each host's choice as JSON, from all its pages."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).where(F.col("host").isNotNull() & (F.length("html") > 0))
    found = rows.mapInArrow(_infer, "host string, wrapper string")
    salt = F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))
    found = found.withColumn("salt", salt).repartition("host", "salt").sortWithinPartitions("host", "wrapper").drop("salt")
    found = found.mapInArrow(_unite(False), "host string, wrapper string").repartition("host").sortWithinPartitions("host", "wrapper")
    return written(found.mapInArrow(_unite(True), "host string, wrapper string"), "wrappers")


@F.arrow_udf(T.StringType())
def _extract(pages: pa.Array, wanted: pa.Array) -> pa.Array:
    return pa.array([extracted(p, w) for p, w in zip(pages.to_pylist(), wanted.to_pylist())], pa.string())


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages``."""
    choices = host_choices(pages, url, html).select(F.col("host").alias("__host"), F.col("wrapper").alias("__wanted"))
    size = choices.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("__host") + F.length("__wanted")), F.lit(0)).alias("b")).first()
    if size["n"] <= BROADCAST_ROWS and size["b"] <= BROADCAST_BYTES:
        choices = F.broadcast(choices)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("__html"), host_of(F.col(url)).alias("__h"))
    rows = rows.join(choices, F.col("__h") == F.col("__host"), "left")
    rows = rows.select("page_id", "url", _extract.asNondeterministic()(F.coalesce("__html", F.lit("")), F.col("__wanted")).alias("text"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
