"""Main text of pages by union-free wrappers inferred for each host.

A page's token stream (block tags and texts) is read as a tree.  Siblings of one
key fold into a repeated group; where other siblings lie between them, all of
that stretch is one repeated group of optional members, as a union-free
expression has no alternatives.  The trees of a host's pages are then aligned one
after another: tags that match are merged, those that one side lacks become
optional, those in another order a repeated group, and texts that differ become
slots; what stays the same on all pages remains fixed text.  The result is a
regular expression without unions, the host's wrapper.  Alignment is associative
enough to be done in parts: each task infers wrappers from its own pages, and
those are aligned in two more steps by host.

The wrapper decides what the article is.  Every node has a weight, the text that
its slots hold on a page, without links and fixed texts.  From the root, the node
is followed that holds most of that; it is the article where a repeated group or
a text has the most.  <article>, <main> and containers named so are believed if
they hold half of the weight.  Within the article, what markup names a menu, an
advert and so on is left out, as are groups of links that are the same on all
pages; names that content may have as well count only where the wrapper confirms
them.  Fixed texts go at the article's edges, before its first slot and after its
last: those between are headings and the like that the host's articles share.
Groups of links that differ by page stay within a container, as lists of
references do; where only the weight tells the article they go at its edges.

A wrapper has a node for every different path of keys of a host, however many
pages have it; that, not the number of pages, is what one task holds of a host.
Names that only one page has are folded into one key where they are many.
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import in_batches, stash

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: Elements without text of the page; skipped to their end tag.
RAW = {"script", "style", "template", "iframe", "textarea", "title", "select", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Tags that an opening of the key ends, up to the nearest of the stops.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
BOILER_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "button", "fieldset", "search"}
BOILER_NAMES = set(
    "nav navbar navigation menu submenu masthead topbar footer colophon sidebar aside ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "breadcrumb breadcrumbs pagination pager comment comments disqus respond toolbar hidden adsbygoogle".split()
)
#: Parts of a name that say where or what kind of box it is; with them, a boilerplate word still names the box.
BOX_PARTS = set(
    "site page global main primary secondary left right top bottom upper lower mobile desktop sticky fixed default wp google article post entry story blog single "
    "box bar wrapper wrap container inner outer area block section list item items link links slot unit panel strip row col column content body title text form icon button btn close message policy tabs".split()
)
#: Names that content may have as well.
MAYBE_NAMES = set("header foot rail share sharing social related recommended widget widgets toc skip".split())
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form", "menu"}
CONTENT_NAMES = set("article content main post entry story body-text post-content article-body entry-content main-content".split())
#: Names of an <article> that is not the page's own.
NO_ARTICLE = set("comment comments reply related teaser promo ad ads advert sponsored".split())
#: What may hold a list of links.
_LISTS = {"ul", "ol", "dl", "menu", "div", "section", "table", "header"}


def _boilerplate(name: str) -> bool:
    """Whether a name as a whole is of boilerplate: site-footer is, hidden-gems and notice-board are not."""
    parts = [p for p in re.split(r"[-_]+", name) if p]
    return name in BOILER_NAMES or bool(BOILER_NAMES & set(parts)) and all(p in BOILER_NAMES or p in BOX_PARTS or re.fullmatch(r"\d+(x\d+)?", p) for p in parts)


def bare(key: str) -> str:
    """The key without its names."""
    return key[: key.index(".")] + ".~" + key[len(key.rstrip("!?*")) :] if "." in key else key


@lru_cache(maxsize=1 << 14)
def _key(tag: str, attributes: str) -> str:
    """Key of an element: tag and names, then ! for boilerplate by markup, ? if its names may be of boilerplate, * for a content container."""
    found: dict[str, str] = {}
    for k, v in _ATTR.findall(attributes):
        found.setdefault(k.lower(), v.strip("\"'").lower())
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    # has-sidebar is no sidebar
    own = [n for n in names if not re.match(r"(has|with|no|without|is)[-_]", n)]
    parts = {p for n in own for p in (n, *re.split(r"[-_]+", n))}
    content = tag in ("article", "main") or found.get("role") in ("main", "article") or (tag in ("div", "section") and bool(CONTENT_NAMES & set(names)))
    boiler = tag in BOILER_TAGS or "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in BOILER_ROLES or "display:none" in found.get("style", "").replace(" ", "")
    boiler = (boiler or bool((NO_ARTICLE & set(names)) if content else any(map(_boilerplate, own)))) and tag not in ("html", "body")
    maybe = not boiler and not content and (tag == "header" or bool((MAYBE_NAMES | BOILER_NAMES) & parts)) and tag not in ("html", "body")
    return "".join((tag, *("." + n for n in sorted(re.sub(r"\d{3,}", "#", n) for n in names)[:4]), "!" * boiler, "?" * maybe, "*" * (content and not boiler)))


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


class Wrapper:
    """A tree of paths of keys; parents come before their children.

    Of node i: parent, key, kids (key -> node), order (entries [key, optional,
    repeated, joined to the one before] of its children), n (pages that have it)
    and, of texts (key #), chars, those within links, and fixed: the digests and
    lengths of the texts that all of those pages have.
    """

    def __init__(self) -> None:
        self.parent, self.key, self.kids, self.order, self.n, self.chars, self.links, self.fixed = ([] for _ in range(8))
        self.node(-1, "")

    def node(self, parent: int, key: str) -> int:
        """The child of parent with that key, a new one if it has none."""
        if parent >= 0 and (found := self.kids[parent].get(key)) is not None:
            return found
        i = len(self.key)
        for column, value in ((self.parent, parent), (self.key, key), (self.kids, {}), (self.order, None), (self.n, 1), (self.chars, 0), (self.links, 0), (self.fixed, {})):
            column.append(value)
        if parent >= 0:
            self.kids[parent][key] = i
        return i

    def dumps(self) -> str:
        return json.dumps([self.parent, self.key, self.order, self.n, self.chars, self.links, self.fixed])

    @staticmethod
    def loads(text: str) -> Wrapper:
        out = Wrapper()
        out.parent, out.key, out.order, out.n, out.chars, out.links, out.fixed = json.loads(text)
        out.kids = [{} for _ in out.key]
        for i, (p, k) in enumerate(zip(out.parent, out.key)):
            if p >= 0:
                out.kids[p][k] = i
        return out

    def align(self, other: Wrapper) -> Wrapper:
        """self, with other's pages aligned to it."""
        todo = [(0, 0)]
        while todo:
            i, j = todo.pop()
            self.n[i] += other.n[j]
            self.chars[i] += other.chars[j]
            self.links[i] += other.links[j]
            if self.fixed[i]:
                self.fixed[i] = {k: v for k, v in self.fixed[i].items() if k in other.fixed[j]}
            self.order[i] = aligned(self.order[i] or [], other.order[j] or [])
            for key, theirs in other.kids[j].items():
                if key in self.kids[i]:
                    todo.append((self.kids[i][key], theirs))
                else:
                    self._graft(i, other, theirs)
        return self

    def _graft(self, parent: int, other: Wrapper, root: int) -> None:
        todo = [(parent, root)]
        while todo:
            at, j = todo.pop()
            i = self.node(at, other.key[j])
            self.order[i], self.n[i], self.chars[i], self.links[i], self.fixed[i] = other.order[j], other.n[j], other.chars[j], other.links[j], other.fixed[j]
            todo += [(i, k) for k in other.kids[j].values()]

    def lean(self, most: int = 64) -> Wrapper:
        """The wrapper with names folded that one page only has, where an element has more than `most` of them with one tag."""
        out, todo = Wrapper(), [([0], 0)]
        while todo:
            sources, at = todo.pop()  # nodes that become one
            out.n[at], out.chars[at], out.links[at] = (sum(column[i] for i in sources) for column in (self.n, self.chars, self.links))
            out.fixed[at] = {k: v for k, v in self.fixed[sources[0]].items() if all(k in self.fixed[i] for i in sources)}
            kids = [(key, k) for i in sources for key, k in self.kids[i].items()]
            seen: dict[str, int] = {}
            for key, k in kids:
                seen[key] = seen.get(key, 0) + self.n[k]
            rare = Counter(bare(key) for key, n in seen.items() if n == 1)
            to = {key: bare(key) if n == 1 and rare[bare(key)] > most else key for key, n in seen.items()}
            order: list[list] | None = None
            for i in sources:
                entries: dict[str, list] = {}
                for key, *flags in self.order[i] or []:
                    if to[key] in entries:
                        entries[to[key]][1:3] = [1, 1]
                    else:
                        entries[to[key]] = [to[key], *flags]
                order = list(entries.values()) if order is None else aligned(order, list(entries.values()))
            out.order[at] = order
            groups: dict[str, list[int]] = {}
            for key, k in kids:
                groups.setdefault(to[key], []).append(k)
            todo += [(nodes, out.node(at, key)) for key, nodes in groups.items()]
        return out

    def expression(self) -> str:
        """The wrapper as text: tags, slots (#) and fixed texts (=), ? for optional, + for repeated and * for both."""
        inner = [""] * len(self.key)
        for i in range(len(self.key) - 1, -1, -1):
            groups: list[list[tuple[str, bool, bool]]] = []
            for key, o, m, g in self.order[i] or []:
                own = ("=" if self.fixed[self.kids[i][key]] else "#") if key == "#" else f"<{key}>{inner[self.kids[i][key]]}</>"
                if not (g and groups):
                    groups.append([])
                groups[-1].append((own, bool(o), bool(m)))
            for group in groups:
                if len(group) == 1:
                    own, o, m = group[0]
                    mark = ("*" if o else "+") if m else "?" if o else ""
                    inner[i] += f"({own}){mark}" if mark else own
                else:
                    inner[i] += "(" + "".join(f"({own})?" if o else own for own, o, _ in group) + ")+"
        return inner[0]


def folded(seen: list[str]) -> list[list]:
    """Entries of the children of one element, given their keys in order: repeated ones once, mixed stretches as one group."""
    many = Counter(seen)
    if len(many) == len(seen):
        return [[k, 0, 0, 0] for k in seen]
    last = {k: i for i, k in enumerate(seen)}
    out: list[list] = []
    end, begin = -1, 0
    for i, k in enumerate(seen):
        if i > end:  # a new stretch
            begin, end = len(out), i
        end = max(end, last[k])
        if not any(e[0] == k for e in out[begin:]):
            out.append([k, 0, int(many[k] > 1), int(len(out) > begin)])
    begin = 0
    for i in range(1, len(out) + 1):
        if i == len(out) or not out[i][3]:
            if i - begin > 1:
                most = max(many[e[0]] for e in out[begin:i])
                for e in out[begin:i]:
                    e[1], e[2] = int(many[e[0]] < most), 1
            begin = i
    return out


def aligned(a: list[list], b: list[list]) -> list[list]:
    """Alignment of two lists of entries, each key once: the longest common order stays, the rest is optional or, if only moved, repeated."""
    if [e[0] for e in a] == [e[0] for e in b]:
        return [[x[0], x[1] | y[1], x[2] | y[2], x[3] | y[3]] for x, y in zip(a, b)]
    place = {e[0]: j for j, e in enumerate(b)}
    own = {e[0] for e in a}
    tails: list[int] = []  # of the increasing runs of places, by length
    ends: list[int] = []
    back: dict[int, int] = {}
    for i, e in enumerate(a):
        if (j := place.get(e[0])) is None:
            continue
        at = bisect_left(tails, j)
        tails[at : at + 1], ends[at : at + 1] = [j], [i]
        back[i] = ends[at - 1] if at else -1
    keep, i = [], ends[-1] if ends else -1
    while i >= 0:
        keep.append(i)
        i = back[i]
    out, i, j, joins = [], 0, 0, False
    for stop in [*reversed(keep), len(a)]:
        for e in a[i:stop]:
            moved = e[0] in place  # one repeated group with what follows
            out.append([e[0], int(e[1] or not moved), int(e[2] or moved), int(e[3] or joins)])
            joins = moved
        until = place[a[stop][0]] if stop < len(a) else len(b)
        out += [[e[0], 1, e[2], e[3]] for e in b[j:until] if e[0] not in own]
        if stop < len(a):
            x, y = a[stop], b[until]
            out.append([x[0], x[1] | y[1], int(x[2] or y[2] or joins), int(x[3] or y[3] or joins)])
            joins = False
        i, j = stop + 1, until + 1
    return out


def parse(page: str) -> tuple[Wrapper, list[tuple[int, str]]]:
    """The wrapper of one page, and its blocks of text in order, each with its text node.  Time is linear in the page."""
    w = Wrapper()
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int, list[str]]] = [("", 0, [])]  # tag, node, keys of its children
    opened: Counter = Counter()
    held: list[str] = []
    link, linked, pos, size = 0, 0, 0, len(page)
    last = {q: page.rfind(q) for q in "\"'"}

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                node, seen = stack[-1][1], stack[-1][2]
                at = w.node(node, "#")
                seen.append("#")
                w.chars[at] += len(text)
                w.links[at] += min(linked, len(text))
                w.fixed[at][_digest(text)] = len(text)
                out.append((at, text))
            held.clear()
        linked = 0

    def open_(tag: str, key: str) -> None:
        flush()
        stack[-1][2].append(key)
        stack.append((tag, w.node(stack[-1][1], key), []))
        opened[tag] += 1

    def close(index: int) -> None:
        flush()
        while len(stack) > index:
            tag, node, seen = stack.pop()
            opened[tag] -= 1
            entries = folded(seen)
            w.order[node] = entries if w.order[node] is None else aligned(w.order[node], entries)

    def tag_end(at: int) -> int:
        """Where the tag that begins before `at` ends; a quote that is never closed counts for nothing."""
        while True:
            end = page.find(">", at)
            if end < 0:
                return size
            quotes = [q for q in (page.find('"', at, end), page.find("'", at, end)) if q >= 0]
            if not quotes or (first := min(quotes)) >= last[page[first]]:
                return end
            at = page.index(page[first], first + 1) + 1

    while pos < size:
        less = page.find("<", pos)
        less = size if less < 0 else less
        if less > pos:
            piece = page[pos:less]
            held.append(piece)
            linked += len(piece.strip()) if link else 0
            pos = less
            continue
        ahead = page[pos + 1 : pos + 2]
        if page.startswith("<!--", pos):
            end = page.find("-->", pos + 4)
            pos = size if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", pos) and (end := page.find("]]>", pos)) >= 0:
            held.append(entities.escape(page[pos + 9 : end]))
            pos = end + 3
            continue
        if ahead in ("!", "?"):
            end = page.find(">", pos)
            pos = size if end < 0 else end + 1
            continue
        ending = ahead == "/"
        named = _NAME.match(page, pos + 1 + ending)
        if not named:
            held.append("<")
            pos += 1
            continue
        name, end = named[0].lower(), tag_end(named.end())
        attributes = page[named.end() : end]
        pos = end + 1
        if ending:
            if name == "a":
                link = max(0, link - 1)
            if opened[name]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            elif name in BLOCK:
                flush()
            continue
        alone = attributes.endswith("/")
        if name in RAW:
            if not alone:
                done = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, pos)
                pos = size if not done else page.find(">", done.end()) + 1 or size
                held.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                held.append(" ")
            continue
        if name == "a" and not alone:
            link += 1
        if name in BLOCK:
            ends, stops = _CLOSES.get(name, ((), ()))
            if any(opened[t] for t in ends):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in stops:
                        break
                    if stack[i][0] in ends:
                        close(i)
                        break
            if opened["p"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        close(i)
                        break
                    if stack[i][0] in ("td", "th", "li", "div", "article", "section", "body"):
                        break
            link = 0 if name != "li" else link
            open_(name, _key(name, attributes))
        elif (name in BOILER_TAGS or attributes.strip()) and not alone and (key := _key(name, attributes))[-1] == "!":
            open_(name, key)  # an inline element that is boilerplate by its markup
    close(0)
    return w, out


def decisions(w: Wrapper) -> list[list]:
    """[parent, key, weight, fixed chars, kind, fixed digests] of every node; kind 1: never text of the page, 2: content container, 3: links that differ by page."""
    size = len(w.key)
    told = any(w.chars[i] - w.n[i] * sum(w.fixed[i].values()) > 0 for i in range(size) if w.n[i] >= 3)  # else nothing tells a template from copies
    weight, fixed, chars, links, kind = [0.0] * size, [0.0] * size, list(w.chars), list(w.links), [0] * size
    alike = [0.0] * size  # characters of fixed texts on all pages together
    repeated = {(i, e[0]) for i in range(size) for e in w.order[i] or [] if e[2]}
    for i in range(size - 1, -1, -1):
        p, key = w.parent[i], w.key[i]
        if key == "#":
            fixed[i] = float(sum(w.fixed[i].values())) if told and w.n[i] >= 3 else 0.0
            alike[i] = fixed[i] * w.n[i]
            weight[i] = max(0.0, w.chars[i] / w.n[i] - fixed[i]) * (1 - w.links[i] / max(1, w.chars[i]))
        else:
            tag = re.split(r"[.!?*]", key)[0]
            listed = tag in _LISTS and ((p, key) in repeated or any((i, k) in repeated for k in w.kids[i]))
            of_links = listed and links[i] > 0.8 * chars[i]
            if of_links and alike[i] < 0.5 * chars[i] and not key.endswith(("!", "?")):
                kind[i], weight[i], fixed[i] = 3, 0.0, 0.0
            elif key.endswith("!") or of_links or key.endswith("?") and (links[i] > 0.5 * chars[i] or fixed[i] > weight[i]):
                kind[i], weight[i], fixed[i] = 1, 0.0, 0.0
            elif key.endswith("*"):
                kind[i] = 2
        if p >= 0:
            share = w.n[i] / w.n[p]
            weight[p] += weight[i] * share
            fixed[p] += fixed[i] * share
            alike[p] += alike[i]
            chars[p] += chars[i]
            links[p] += links[i]
    return [[w.parent[i], w.key[i], round(weight[i], 3), round(fixed[i], 3), kind[i], sorted(w.fixed[i]) if fixed[i] else []] for i in range(size)]


class Decider:
    """Applies a host's decisions to its pages."""

    def __init__(self, rows: list[list]):
        self.rows = rows
        self.child = {(r[0], r[1]): i for i, r in enumerate(rows)}
        self.fixed = {i: set(r[5]) for i, r in enumerate(rows) if r[5]}

    def text(self, page: str) -> str:
        """The article's texts, one block to a line."""
        w, blocks = parse(page)
        rows, size = self.rows, len(w.key)
        at, gone = [0] * size, [False] * size
        told = [rows[0]] * size
        linked = [False] * size
        for i in range(1, size):
            above, key = at[w.parent[i]], w.key[i]
            at[i] = self.child.get((above, key), self.child.get((above, bare(key)), -1))
            # a name that was folded elsewhere has no decisions of its own
            told[i] = rows[at[i]] if at[i] >= 0 else [above, key, 0.0, 0.0, 1 if key.endswith("!") else 2 if key.endswith("*") else 0, []]
            gone[i] = gone[w.parent[i]] or told[i][4] == 1
            linked[i] = linked[w.parent[i]] or told[i][4] == 3
        weight = lambda i: told[i][2]
        inside = [False] * size
        boxes = []
        boxed = [False] * size  # below a content container
        for i in range(1, size):
            boxed[i] = boxed[w.parent[i]] or told[w.parent[i]][4] == 2
            if told[i][4] == 2 and not gone[i] and not boxed[i]:
                boxes.append(i)
        of_page = sum(weight(i) for i in range(size) if w.key[i] == "#" and not gone[i])
        of_boxes = sum(weight(i) for i in range(size) if w.key[i] == "#" and not gone[i] and (boxed[i] or w.parent[i] in boxes))
        contained = bool(boxes) and of_boxes >= 0.5 * of_page
        if contained:
            for i in boxes:
                inside[i] = True
        else:
            inside[self._most(w, weight, gone)] = True
        for i in range(1, size):
            inside[i] = inside[i] or inside[w.parent[i]]
        texts = [i for i in range(size) if w.key[i] == "#" and inside[i] and not gone[i]]
        # where more stays the same than differs, the pages are copies of each other and not a template
        template = sum(weight(i) for i in texts) >= sum(told[i][3] for i in texts)
        found = [(i, text) for i, text in blocks if inside[i] and not gone[i]]
        edge = [linked[i] and not contained or template and at[i] in self.fixed and _digest(text) in self.fixed[at[i]] for i, text in found]
        first = next((k for k, e in enumerate(edge) if not e), len(edge))
        last = next((k for k in range(len(edge) - 1, -1, -1) if not edge[k]), -1)
        return "\n".join(text for _, text in found[first : last + 1])

    @staticmethod
    def _most(w: Wrapper, weight, gone: list[bool]) -> int:
        """The node to which the weight leads: two thirds of its parent's, unless it is a text, bears one or is repeated."""
        i = 0
        while True:
            kids = [k for k in w.kids[i].values() if not gone[k]]
            whole = sum(map(weight, kids))
            best = max(kids, key=weight, default=None)
            if best is None or whole <= 0 or weight(best) < whole * 2 / 3 or w.key[best] == "#" or "#" in w.kids[best]:
                return i
            if any(e[0] == w.key[best] and e[2] for e in w.order[i] or []):
                return i
            i = best


def _host():
    url = F.coalesce(F.col("url"), F.lit(""))
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#]*)", 1))


def _folding(batches: Iterator[pa.RecordBatch], pages: bool) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host of the task, from its pages or its wrappers."""
    held: dict[str, Wrapper] = {}
    bound: dict[str, int] = {}
    for batch in batches:
        for host, source in zip(batch.column("host").to_pylist(), batch.column("source").to_pylist()):
            own = parse(source)[0] if pages else Wrapper.loads(source)
            held[host] = held[host].align(own) if host in held else own
            if len(held[host].key) > bound.get(host, 2000):
                held[host] = held[host].lean()
                bound[host] = max(2000, 2 * len(held[host].key))
    for host, w in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([w.dumps()])], ["host", "source"])


def wrappers(pages: DataFrame) -> DataFrame:
    """host, source: the wrapper (JSON) of every host of pages; one row for each host."""
    shape = "host string, source string"
    near = in_batches(pages).select(_host().alias("host"), F.coalesce("html", F.lit("")).alias("source")).mapInArrow(lambda b: _folding(textscan.slices(b, "source"), True), shape)
    # Every task has at most one wrapper for a host; they are aligned in two steps so that none takes all of a large host's.
    salted = near.repartition("host", F.pmod(F.xxhash64("source"), F.lit(16))).mapInArrow(lambda b: _folding(b, False), shape)
    return salted.repartition("host").mapInArrow(lambda b: _folding(b, False), shape)


def main_texts(pages: DataFrame, most: int = 16 << 20, salts: int = 32) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    A null or empty html has an empty text; pages with a null url share a host.
    Repeated rows and null page_ids are rows like any other.  No text is cut.  A
    text is fixed if three pages or more have its place and all of them have it.
    Decisions of up to `most` bytes are broadcast, more are joined by host and one
    of `salts` numbers, each of which has all decisions.
    """

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [json.dumps(decisions(Wrapper.loads(w))) for w in batch.column("source").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(told, pa.string())], ["host", "told"])

    decided = stash(wrappers(pages).mapInArrow(decide, "host string, told string"))
    # A host's decisions are some kilobytes; while those of all hosts are small, no page is moved.
    size = decided.agg(F.sum(F.length("host") + F.length("told"))).first()[0] or 0
    rows = in_batches(pages).select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), _host().alias("_host"))
    own = decided.withColumnRenamed("host", "_h")
    if size <= most:
        rows = rows.join(F.broadcast(own), F.col("_host") == F.col("_h"))
    else:
        salted = own.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salt = F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(salts)).cast("int")
        rows = rows.withColumn("_salt", salt).join(salted, (F.col("_host") == F.col("_h")) & (F.col("_salt") == F.col("_s")))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Decider] = {}
        for batch in textscan.slices(batches, "html"):
            texts = []
            for page, host, told in zip(batch.column("html").to_pylist(), batch.column("_host").to_pylist(), batch.column("told")):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = Decider(json.loads(told.as_py()))
                texts.append(known[host].text(page))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    wanted = rows.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "_host", "told")
    return wanted.mapInArrow(apply, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
