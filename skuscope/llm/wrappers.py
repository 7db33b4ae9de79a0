"""Main text of HTML pages by wrapper induction over the pages of a host.

A page's tree of block elements is folded (equal neighbours are one node). The
most frequent folded tree of a host is its pivot; the host's other trees are
aligned with it by simple tree matching. What stands at a pivot node on the
host's different pages says what it is:

- the same text on all of them: template;
- short texts outside of articles that nearly always stand on other pages of
  the host or on other hosts too (adverts, menus, notices that rotate): template;
- anything else: a slot, whose text is content.

Where a host has too few pages to say so, and for parts that differ page by page
(a reader's comments), element, role or class decide: such a part is no content,
unless it holds the page's articles or most of its slot text. All work on trees
goes by loops, so depth costs no stack.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|[="'])*+)(?:>|\Z)""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
# How elements are treated.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = set("script style title textarea iframe noscript noembed noframes xmp".split())  # no elements within
SKIPPED = set("template object svg canvas select button audio video annotation annotation-xml".split())  # left out with all that is in them
PHRASES = set("button select svg annotation annotation-xml".split())  # of these, those that hold no blocks
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
REJECTED = set("nav footer aside form menu dialog fieldset".split())
ASIDE = set("nav footer aside header menu".split())  # of these, none holds a page but by its articles
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_WORD = r"(?:ads?|adverts?|advertisements?|advertising|banners?|promos?|promotions?|sponsor(?:ed|s)?|cookies?|consent|gdpr|newsletters?|subscribe|sidebars?|menus?|nav(?:bar|igation)?|breadcrumbs?|footers?|masthead|comments?|disqus|replies|related|recommended|share|sharing|social|popups?|modals?|overlay|notices?|disclaimer|paywall|pagination|pager|login|signup|search)"
_PLACE = r"(?:box|wrap|wrapper|container|list|links?|section|area|block|widget|bar|inner|outer|site|page|top|bottom|left|right|primary|secondary)"
# Whole class names and ids only: a word of no content, alone or with words that say where or how it stands.
NO_CONTENT = re.compile(rf"(?:^|\s)(?:{_PLACE}[_-]+)*{_WORD}(?:[_-]+(?:{_WORD}|{_PLACE}))*[_-]*(?:$|\s)")
# An element ends the open ones of these kinds (up to the nearest holder).
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
HOLDERS = set("ul ol dl table tbody thead tfoot article section div main body html nav aside header footer form td th blockquote".split())
CELLS = set("table tbody thead tfoot tr td th caption".split())
FENCES = set("table td th caption object template".split())  # an end tag within doesn't end what is open outside


class Page:
    """The block elements of a page in page order (parents before children), and its runs of text by element."""

    def __init__(self):
        self.tag, self.label, self.role, self.hidden, self.parent, self.link = ["html"], [""], [""], [False], [-1], [0]
        self.runs: list[tuple[int, str]] = []  # element, text between two block boundaries

    def add(self, tag: str, label: str, role: str, hidden: bool, parent: int) -> int:
        for column, value in ((self.tag, tag), (self.label, label), (self.role, role), (self.hidden, hidden), (self.parent, parent), (self.link, 0)):
            column.append(value)
        return len(self.tag) - 1


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(raw)} if raw and ("=" in raw or "hidden" in raw) else {}


def parse(source: str | None) -> Page:
    """The block elements of a page with their texts. Inline elements leave no trace; scripts, styles,
    comments and what is in SKIPPED go. What isn't closed ends with its parent or the page; an element
    of SKIPPED or RAW that is never closed ends at once (SKIPPED and RAW but code) or with the page (code)."""
    source = source or ""
    lowered = source.lower()
    if len(lowered) != len(source):  # a few letters grow when lower-cased
        lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), source)
    page, stack, opened = Page(), [("html", 0)], Counter()  # (tag, element or -1 where it is skipped)
    buffer: list[str] = []
    unclosed: set[str] = set()
    in_link = False
    at = 0

    def boundary() -> None:
        if buffer:
            if stack[-1][1] >= 0 and (text := " ".join("".join(buffer).split())):
                page.runs.append((stack[-1][1], text))
            buffer.clear()

    def characters(raw: str) -> None:
        if stack[-1][1] >= 0:
            buffer.append(entities.unescape(raw) if "&" in raw else raw)
            if in_link:
                page.link[stack[-1][1]] += len(raw.strip())

    def close(k: int) -> None:
        boundary()
        opened.subtract(x for x, _ in stack[k:])
        del stack[k:]

    def later(tag: str, start: int) -> int:
        found = -1 if tag in unclosed else lowered.find(f"</{tag}", start)
        if found < 0:
            unclosed.add(tag)
        return found

    while at < len(source):
        begin = source.find("<", at)
        if begin < 0:
            characters(source[at:])
            break
        m = _TAG.match(source, begin)
        if not m:
            if source.startswith("<!--", begin):
                end = source.find("-->", begin + 2)
                end = len(source) if end < 0 else end + 3
            elif source[begin + 1 : begin + 2] in ("!", "?", "/") and source[begin + 1 : begin + 2]:
                end = source.find(">", begin)
                end = len(source) if end < 0 else end + 1
            else:  # a bare < is text
                characters(source[at : begin + 1])
                at = begin + 1
                continue
            if begin > at:
                characters(source[at:begin])
            at = end
            continue
        if begin > at:
            characters(source[at:begin])
        at, closing, tag, raw = m.end(), m[1], m[2].lower(), m[3]
        if tag in RAW:
            if not closing:
                end = later(tag, at)
                if end >= 0 or tag in ("script", "style"):
                    at = len(source) if end < 0 else (source.find(">", end) + 1 or len(source))
        elif tag in SKIPPED:
            if closing:
                if opened[tag]:
                    close(max(k for k in range(len(stack)) if stack[k][0] == tag))
            elif not raw.endswith("/"):
                if tag == "button" and opened[tag]:
                    close(max(k for k in range(len(stack)) if stack[k][0] == tag))
                if later(tag, at) >= 0 or tag in PHRASES:
                    boundary()
                    stack.append((tag, -1))
                    opened[tag] += 1
        elif tag == "a":
            in_link = not closing
        elif tag in ("br", "hr"):
            characters(" ")
        elif tag in BLOCKS and tag != "html":
            in_link = False
            while stack[-1][0] in PHRASES and stack[-1][0] in unclosed:
                close(len(stack) - 1)
            boundary()
            if closing:
                if opened[tag]:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            close(k)
                            break
                        if stack[k][0] in FENCES and (tag not in CELLS or stack[k][0] == "table"):
                            break
                continue
            ended = ENDS.get(tag, {"p"})
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ended or stack[k][0] in HEADINGS and tag in HEADINGS:
                    close(k)
                    if tag not in ("tr", "td", "th"):
                        break
                elif stack[k][0] in HOLDERS:
                    break
            if stack[-1][1] < 0:
                stack.append((tag, -1))
            elif tag == "body" and opened[tag]:  # a second body tag opens nothing
                continue
            else:
                found = _attributes(raw)
                label = " ".join(re.sub(r"\d+", "", f"{found.get('class', '')} {found.get('id', '')}".lower()).split())
                hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
                stack.append((tag, page.add(tag, label, found.get("role", "").lower(), hidden, stack[-1][1])))
            opened[tag] += 1
    boundary()
    return page


def fold(page: Page) -> tuple[list[tuple[int, str, str]], list[int], list[str]]:
    """The folded tree in page order as (depth, element, label), each element's place in it, and the texts
    of its nodes. Siblings of equal shape that stand together are one node; so are theirs, one by one."""
    n = len(page.tag)
    kids: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        kids[page.parent[i]].append(i)
    ids: dict[tuple, int] = {}
    shape = [0] * n
    for i in reversed(range(n)):
        found = [shape[k] for k in kids[i]]
        found = [s for k, s in enumerate(found) if not k or s != found[k - 1]]
        shape[i] = ids.setdefault((page.tag[i], page.label[i], tuple(found)), len(ids))
    tree: list[tuple[int, str, str]] = []
    place = [0] * n
    stack = [([0], 0)]
    while stack:
        members, depth = stack.pop()
        for i in members:
            place[i] = len(tree)
        tree.append((depth, page.tag[members[0]], page.label[members[0]]))
        groups: list[list[int]] = []
        for i in members:
            k, last = -1, -1
            for kid in kids[i]:
                if shape[kid] != last:
                    k, last = k + 1, shape[kid]
                    if k == len(groups):
                        groups.append([])
                groups[k].append(kid)
        stack += [(g, depth + 1) for g in reversed(groups)]
    texts: list[list[str]] = [[] for _ in tree]
    for i, text in page.runs:
        texts[place[i]].append(text)
    return tree, place, [" ".join(x) for x in texts]


class _Shapes:
    """Different subtrees of two folded trees as numbers, in ascending order of height along every path."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.kids: list[tuple[int, ...]] = []
        self.key: list[tuple[str, str]] = []
        self.size: list[int] = []

    def add(self, tree: list) -> int:
        stack: list[list] = []
        done: list[int] = []
        for depth, tag, label in [*tree, (0, "", "")]:
            while len(stack) > depth:
                tag_, label_, kids = stack.pop()
                key = (tag_, label_, tuple(kids))
                if key not in self.known:
                    self.known[key] = len(self.kids)
                    self.kids.append(key[2])
                    self.key.append(key[:2])
                    self.size.append(1 + sum(self.size[k] for k in kids))
                (stack[-1][2] if stack else done).append(self.known[key])
            stack.append([tag, label, []])
        return done[0]


def _trimmed(a: tuple, b: tuple) -> tuple[int, int]:
    """How many equal subtrees two rows of siblings begin and end with: a best match pairs these."""
    least = min(len(a), len(b))
    head = next((k for k in range(least) if a[k] != b[k]), least)
    tail = next((k for k in range(least - head) if a[-1 - k] != b[-1 - k]), least - head)
    return head, tail


_PAIRS = 10_000  # of differently shaped siblings that are compared one by one; more are compared by rows


class _Matcher:
    """Simple tree matching: the score of two nodes of one kind is one more than the best order-keeping match of their children."""

    def __init__(self, shapes: _Shapes):
        self.shapes = shapes
        self.scores: dict[int, dict[int, int]] = {}
        self.rows: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}  # of shapes with very many partners: these, sorted, and the scores

    def _score(self, u: int, v: int) -> int:
        if u == v:
            return self.shapes.size[u]
        found = self.scores.get(u, {}).get(v)
        if found is None:
            found = max((int(scores[k]) for others, scores in self.rows.get(u, ()) if (k := int(np.searchsorted(others, v))) < len(others) and others[k] == v), default=0)
        return found

    def weights(self, a: tuple, b: tuple) -> np.ndarray:
        rows, row = np.unique(np.array(a, np.int64), return_inverse=True)
        columns, column = np.unique(np.array(b, np.int64), return_inverse=True)
        at = {v: k for k, v in enumerate(columns.tolist())}
        small = np.zeros((len(rows), len(columns)), np.int64)
        for k, u in enumerate(rows.tolist()):
            for v, score in self.scores.get(u, {}).items():
                if v in at:
                    small[k, at[v]] = score
            for others, scores in self.rows.get(u, ()):
                held = np.isin(columns, others, assume_unique=True)
                small[k, held] = scores[np.searchsorted(others, columns[held])]
            if u in at:
                small[k, at[u]] = self.shapes.size[u]
        return small[row][:, column]

    @staticmethod
    def _next(row: np.ndarray, weight: np.ndarray) -> np.ndarray:
        out = np.zeros_like(row)
        out[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weight))
        return out

    def _few(self, a: tuple, b: tuple) -> list[list[int]]:
        """The rows of scores of a few siblings, for which arrays don't pay."""
        rows = [[0] * (len(b) + 1)]
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(max(row[j], rows[-1][j + 1], rows[-1][j] + self._score(x, y)))
            rows.append(row)
        return rows

    def total(self, a: tuple, b: tuple) -> np.ndarray:
        """Best scores of a against each beginning of b."""
        if len(a) * len(b) <= 64:
            return np.array(self._few(a, b)[-1])
        row = np.zeros(len(b) + 1, np.int64)
        for at in range(0, len(a) if b else 0, 1024):
            for weight in self.weights(a[at : at + 1024], b):
                row = self._next(row, weight)
        return row

    def best(self, a: tuple, b: tuple) -> list[tuple[int, int]]:
        """The pairs of a best match; long rows are halved, so memory stays linear."""
        if not a or not b:
            return []
        if len(a) > 1 and len(a) * len(b) > 1 << 22:
            half = len(a) // 2
            cut = int(np.argmax(self.total(a[:half], b) + self.total(a[half:][::-1], b[::-1])[::-1]))
            return self.best(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in self.best(a[half:], b[cut:])]
        rows: list = [np.zeros(len(b) + 1, np.int64)]
        if len(a) * len(b) <= 64:
            rows = self._few(a, b)
        else:
            for weight in self.weights(a, b):
                rows.append(self._next(rows[-1], weight))
        found, i, j = [], len(a), len(b)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((i, j))
        return found[::-1]

    def _compare_all(self, a: set[int], b: set[int]) -> None:
        """Scores of all pairs of a and b: level by level from the lowest, each shape of one side with all of the
        other side's at once. Of the levels below only one is held."""
        kids, key = self.shapes.kids, self.shapes.key
        levels = [(sorted(a), sorted(b))]
        while all(levels[-1]):
            levels.append(tuple(sorted({k for x in side for k in kids[x]}) for side in levels[-1]))
        scores = np.zeros([len(levels[-1][0]), len(levels[-1][1]) + 1], np.int32)  # the last column is that of no node
        for (rows, columns), (lower_rows, lower_columns) in zip(levels[-2::-1], levels[:0:-1]):
            row_at, column_at = ({x: k for k, x in enumerate(side)} for side in (lower_rows, lower_columns))
            alike: dict[tuple, list[int]] = {}
            for k, y in enumerate(columns):
                alike.setdefault((key[y], len(kids[y]).bit_length()), []).append(k)
            parts: dict[tuple, list[tuple[list[int], np.ndarray]]] = {}
            for (kind, bits), members in alike.items():
                for at in range(0, len(members), step := max(1, (1 << 20) >> bits)):
                    part = members[at : at + step]
                    places = np.full((len(part), max(len(kids[columns[k]]) for k in part)), len(lower_columns))
                    for line, k in zip(places, part):
                        line[: len(kids[columns[k]])] = [column_at[y] for y in kids[columns[k]]]
                    parts.setdefault(kind, []).append((part, places))
            below, scores = scores, np.zeros((len(rows), len(columns) + 1), np.int32)
            useful = below.any(axis=1)
            for k, x in enumerate(rows):
                for part, places in parts.get(key[x], ()):
                    best = np.zeros((len(part), places.shape[1] + 1), np.int32)
                    for y in (y for y in kids[x] if useful[row_at[y]]):
                        best[:, 1:] = np.maximum.accumulate(np.maximum(best[:, 1:], best[:, :-1] + below[row_at[y]][places]), axis=1)
                    scores[k, part] = 1 + best[:, -1]
        for k, x in enumerate(levels[0][0]):
            met = np.flatnonzero(scores[k, :-1])
            self.rows.setdefault(x, []).append((np.array(levels[0][1], np.int64)[met], scores[k, met]))

    def solve(self, root_u: int, root_v: int) -> None:
        """Scores of what a best match of the children of two nodes depends on."""
        kids, key, size = self.shapes.kids, self.shapes.key, self.shapes.size
        wanted, open_pairs = {(root_u, root_v)}, [(root_u, root_v)]
        while open_pairs:
            u, v = open_pairs.pop()
            if u == v:
                continue
            head, tail = _trimmed(kids[u], kids[v])
            a, b = set(kids[u][head : len(kids[u]) - tail]), set(kids[v][head : len(kids[v]) - tail])
            if len(a) * len(b) > _PAIRS:
                self._compare_all(a, b)
                continue
            for pair in ((x, y) for x in a for y in b if key[x] == key[y]):
                if pair not in wanted and pair[1] not in self.scores.get(pair[0], ()):
                    wanted.add(pair)
                    open_pairs.append(pair)
        for u, v in sorted(wanted):  # a subtree has a larger number than those in it
            if u != v:
                head, tail = _trimmed(kids[u], kids[v])
                middle = self.total(kids[u][head : len(kids[u]) - tail], kids[v][head : len(kids[v]) - tail])[-1]
                self.scores.setdefault(u, {})[v] = 1 + sum(size[k] for k in kids[u][:head]) + sum(size[k] for k in kids[u][len(kids[u]) - tail :]) + int(middle)

    def match(self, root_a: int, root_b: int) -> list[tuple[int, int]]:
        """Places of matched nodes, in page order of both trees."""
        kids, key, size = self.shapes.kids, self.shapes.key, self.shapes.size
        if key[root_a] != key[root_b]:
            return []
        found, stack = [], [(root_a, 0, root_b, 0)]
        while stack:
            u, at_u, v, at_v = stack.pop()
            if u == v:
                found += [(at_u + k, at_v + k) for k in range(size[u])]
                continue
            found.append((at_u, at_v))
            if v not in self.scores.get(u, ()):
                self.solve(u, v)
            head, tail = _trimmed(kids[u], kids[v])
            middle = self.best(kids[u][head : len(kids[u]) - tail], kids[v][head : len(kids[v]) - tail])
            pairs = [(k, k) for k in range(head)] + [(i + head, j + head) for i, j in middle] + [(len(kids[u]) - k, len(kids[v]) - k) for k in range(tail, 0, -1)]
            starts = [list(accumulate((size[k] for k in kids[x]), initial=at + 1)) for x, at in ((u, at_u), (v, at_v))]
            stack += [(kids[u][i], starts[0][i], kids[v][j], starts[1][j]) for i, j in reversed(pairs)]
        return found


@lru_cache(maxsize=1024)
def aligned(a: str, b: str) -> dict[int, int]:
    """Simple tree matching of two folded trees (as JSON): places in a -> places in b of a largest
    order-keeping match of nodes with equal element and label under matched parents."""
    shapes = _Shapes()
    left, right = (shapes.add(json.loads(x)) for x in (a, b))
    return dict(_Matcher(shapes).match(left, right))


def _as_json(tree: list) -> str:
    return json.dumps(tree, separators=(",", ":"))


def _fingerprint(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


_SHAPE = pa.schema([("host", pa.string()), ("shape", pa.binary()), ("tree", pa.string()), ("prints", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("page", pa.binary())])
_SHAPE_DDL = "host string, shape binary, tree string, prints array<long>, sizes array<int>, page binary"


def _shape_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page: its folded tree's digest (and the tree itself where the batch first has it for
    the host), its nodes' texts as fingerprints with their sizes, and a digest of tree and texts."""
    for batch in batches:
        out: dict[str, list] = {n: [] for n in _SHAPE.names}
        seen: set[tuple] = set()
        for host, source in zip(*(c.to_pylist() for c in batch.columns)):
            tree, _, texts = fold(parse(source))
            text = _as_json(tree)
            shape = _digest(text)
            for n, v in zip(out, (host, shape, None if (host, shape) in seen else text, [_fingerprint(x) for x in texts], list(map(len, texts)), _digest(text + "\n".join(texts)))):
                out[n].append(v)
            seen.add((host, shape))
        yield pa.RecordBatch.from_pydict(out, _SHAPE)


def _alignments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each tree: its places that match the pivot's, and the pivot's places outside of its articles."""
    for batch in batches:
        out: dict[str, list] = {"host": [], "shape": [], "pos": [], "pivot_pos": [], "outside": []}
        for host, shape, tree, pivot in zip(*(c.to_pylist() for c in batch.columns)):
            outside = _outside(pivot)
            for x, y in aligned(tree, pivot).items():
                for n, v in zip(out, (host, shape, x, y, outside[y])):
                    out[n].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out["host"], pa.string()), pa.array(out["shape"], pa.binary()), pa.array(out["pos"], pa.int32()), pa.array(out["pivot_pos"], pa.int32()), pa.array(out["outside"], pa.bool_())], names=list(out))


@lru_cache(maxsize=1024)
def _outside(tree: str) -> list[bool]:
    """Of a folded tree's places, whether they are outside of articles."""
    found, path = [], []
    for depth, tag, _ in json.loads(tree):
        del path[depth:]
        path.append(tag)
        found.append(not {"article", "main"} & set(path))
    return found


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL, empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _sent(df: DataFrame, column: str, most_bytes: int) -> DataFrame | None:
    """df for a broadcast, if what `column` (a string or an array of integers) holds is small enough."""
    kind = df.schema[column].dataType.simpleString()
    size = F.length(column) if kind in ("string", "binary") else 4 * F.size(column)
    held = df.agg(F.sum(F.lit(128) + size)).first()[0] or 0
    return F.broadcast(df) if held <= most_bytes else None


def _judged(pages: DataFrame, least_pages: int, least_share: float, shared: float, short: float, most_bytes: int, salts: int = 32, few_texts: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """pages(host, html) -> pivots (host, pivot, pages, rows) and template nodes (host, shape, pos, pivot_pos)."""
    shapes = written(pages.select("host", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(_shape_rows, _SHAPE_DDL), "shapes")
    # Pages with the same tree and texts count once, however many rows have them.
    once = written(shapes.groupBy("host", "shape", "page").agg(F.count("*").alias("rows"), F.first("prints").alias("prints"), F.first("sizes").alias("sizes")), "different-pages")
    different = once.groupBy("host", "shape").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("chars"))
    trees = shapes.filter("tree is not null").groupBy("host", "shape").agg(F.first("tree").alias("tree")).join(different, ["host", "shape"])
    trees = written(trees, "trees")
    pivots = trees.groupBy("host").agg(F.max(F.struct("n", "tree"))["tree"].alias("pivot"), F.sum("n").alias("pages"), F.sum("rows").alias("rows"), F.sum("chars").alias("chars"))
    pivots = written(pivots, "pivots")
    # How often each text stands at a place of a tree, and whether other hosts have it.
    nodes = once.select("host", "shape", F.posexplode(F.arrays_zip("prints", "sizes")).alias("pos", "node")).filter("node.sizes > 0")
    texts = written(nodes.groupBy("host", "shape", "pos", F.col("node.prints").alias("print")).agg(F.count("*").alias("n"), F.max("node.sizes").alias("size")), "node-texts")
    far = written(texts.groupBy("print").agg(F.min("host").alias("a"), F.max("host").alias("b")).filter("a < b").select("print", F.lit(True).alias("far")), "far-texts")
    alone = texts.filter("n = 1")
    if far.count() <= few_texts:
        alone = alone.join(F.broadcast(far), "print", "left")
    else:  # a text that very many hosts have is dealt to several tasks
        salted = far.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
        alone = alone.withColumn("salt", F.pmod(F.xxhash64("host", "shape"), F.lit(salts)).cast("int")).join(salted, ["print", "salt"], "left")
    counted = alone.select("host", "shape", "pos", "print", "n", "size", F.coalesce("far", F.lit(False)).alias("met")).unionByName(texts.filter("n > 1").withColumn("met", F.lit(True)))
    places = counted.groupBy("host", "shape", "pos").agg(F.min("print").alias("lo"), F.max("print").alias("hi"), F.sum("n").alias("n"), F.sum(F.when(F.col("met"), F.col("n")).otherwise(0)).alias("met"), F.sum(F.col("size") * F.col("n")).alias("chars"))
    small = _sent(pivots.select("host", "pivot"), "pivot", most_bytes)
    if small is not None:
        sides = trees.select("host", "shape", "tree").join(small, "host")
    else:  # a host with many trees is dealt to several tasks
        dealt = trees.select("host", "shape", "tree", F.pmod(F.xxhash64("shape"), F.lit(salts)).cast("int").alias("salt"))
        sides = dealt.join(pivots.select("host", "pivot", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")), ["host", "salt"])
    pairs = written(sides.select("host", "shape", "tree", "pivot").mapInArrow(_alignments, "host string, shape binary, pos int, pivot_pos int, outside boolean"), "alignments")
    slots = places.join(pairs, ["host", "shape", "pos"]).groupBy("host", "pivot_pos", "outside").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.sum(c).alias(c) for c in ("n", "met", "chars")])
    slots = slots.join(pivots.select("host", "pages", F.col("chars").alias("whole")), "host").filter((F.col("n") >= least_pages) & (F.col("n") >= least_share * F.col("pages")))
    # A share of the page's text: chars / n against whole / pages.
    rotates = F.col("outside") & (F.col("met") >= shared * F.col("n")) & (F.col("chars") * F.col("pages") <= short * F.col("whole") * F.col("n"))
    template = slots.filter((F.col("lo") == F.col("hi")) | rotates).select("host", "pivot_pos")
    return pivots, written(pairs.join(template, ["host", "pivot_pos"]).select("host", "shape", "pos", "pivot_pos"), "template-nodes")


#: What the judgement of nodes goes by: at least so many different pages of a host, and so large a share of its different
#: pages, have the node; a rotating node's texts stand elsewhere too on so large a share of its pages, and make up no more of them.
LEAST_PAGES, LEAST_SHARE, SHARED, SHORT = 5, 0.5, 0.8, 0.25


def induce_wrappers(pages: DataFrame, *, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, shared: float = SHARED, short: float = SHORT, most_bytes: int = 32 << 20) -> DataFrame:
    """pages(host, html) -> a row a host: pivot (its most frequent folded tree), template (its places that are
    template: see this module's docstring) and rows (of the host).

    Texts of all pages count, as fingerprints by host, tree and place, with
    partial counts, so a large host is no large group; whether other hosts
    have a text is looked up for those that stand once at their place (the
    fingerprints that several hosts have are broadcast up to 500,000, and joined
    by salted keys beyond); trees are aligned one by one with their host's pivot, which
    is broadcast up to `most_bytes` of pivots and joined by salted hosts beyond.
    """
    pivots, nodes = _judged(pages, least_pages, least_share, shared, short, most_bytes)
    template = nodes.groupBy("host").agg(F.sort_array(F.collect_set("pivot_pos")).alias("template"))
    return pivots.join(template, "host", "left").select("host", "pivot", F.coalesce("template", F.array().cast("array<int>")).alias("template"), "rows")


def _is_article(tag: str, role: str) -> bool:
    return tag in ("article", "main") or role in ("main", "article")


def _is_rejected(tag: str, role: str, label: str, hidden: bool, in_article: bool) -> bool:
    """Whether an element looks like no content. Class words never speak against the page, or an article, as a whole."""
    if tag == "body":
        return False
    if hidden or role in ROLES or tag in REJECTED or tag == "header" and not in_article:
        return True
    return not _is_article(tag, role) and bool(label and NO_CONTENT.search(label))


def extract(source: str | None, pivot: str | None, template: list[int]) -> str:
    """The main text of one page under its host's wrapper (none: by elements and classes alone)."""
    page = parse(source)
    if not pivot or not template:
        return _content(page, [False] * len(page.tag))
    tree, place, _ = fold(page)
    held = set(template)
    constant = {x for x, y in aligned(_as_json(tree), pivot).items() if y in held}
    return _content(page, [p in constant for p in place])


def _content(page: Page, fixed: list[bool], by_class: bool = True) -> str:
    """The text of a page's slots; fixed: of its elements, which are template. by_class: whether elements, roles and classes count."""
    n = len(page.tag)
    size = [0] * n
    for i, text in page.runs:
        size[i] += len(text)
    article, rejected, barred = [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        up = page.parent[i]
        article[i] = article[up] or _is_article(page.tag[i], page.role[i])
        rejected[i] = by_class and _is_rejected(page.tag[i], page.role[i], page.label[i], page.hidden[i], article[up])
        barred[i] = barred[up] or rejected[i]
    slot = [0 if fixed[i] else size[i] for i in range(n)]
    within = [[x, x * article[i], min(x, page.link[i])] for i, x in enumerate(slot)]  # slot text, of it in articles, of it in links
    for i in range(n - 1, 0, -1):
        for k, x in enumerate(within[i]):
            within[page.parent[i]][k] += x
    everything, free = within[0][0], sum(slot[i] for i in range(n) if article[i] and not barred[i])
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[page.parent[i]]
        if kept[i] and rejected[i]:  # it stays if it holds the page's articles, or most of its slot text beside small articles
            text, articles, links = within[i]
            most = page.tag[i] not in ASIDE and 2 * text > everything and 4 * free < text
            kept[i] = not page.hidden[i] and 2 * links < text and (articles > 0 and free == 0 or most)
    menu = [by_class and page.tag[i] == "li" and not article[i] and page.link[i] > 0.8 * size[i] for i in range(n)]
    found = [(text, fixed[i]) for i, text in page.runs if kept[i] and not menu[i]]
    chosen = [text for text, constant in found if not constant] or [text for text, _ in found]
    return " ".join(chosen)


def _with_shape(at: int):
    """Adds the digest of the page's folded tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_digest(_as_json(fold(parse(x))[0])) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "shape"])

    return run


def extract_main_text(pages: DataFrame, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", broadcast_hosts: int = 20_000, most_bytes: int = 32 << 20, by_class: bool = True) -> DataFrame:
    """id, url, text (of each whole page; empty if none) and n_chars (code points).

    Null or empty pages have empty texts; pages without a host share one
    wrapper; repeated rows have a row each and count as one page for the
    wrapper; pages of any length and depth are parsed whole, without recursion;
    an empty table gives an empty result; other columns are not read. Of the
    alignments made in the induction, the template places of each host's trees
    go to the pages: broadcast for up to `broadcast_hosts` trees and
    `most_bytes`, joined by a shuffle beyond, by salted keys. A node that would
    leave a page without any text is kept even if it is template. by_class=False
    leaves elements, roles and classes out, so that the wrapper alone decides.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), host_of(F.col(url_column)).alias("host"), F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("html"))
    _, nodes = _judged(rows, LEAST_PAGES, LEAST_SHARE, SHARED, SHORT, most_bytes)
    templates = written(nodes.groupBy("host", "shape").agg(F.collect_set("pos").alias("template")), "templates")
    few = templates.count() <= broadcast_hosts and _sent(templates, "template", most_bytes) is not None
    if few:
        held = spark.sparkContext.broadcast({(r.host, bytes(r.shape)): frozenset(r.template) for r in templates.collect()})
        joined = rows.select("id", "url", "html", "host", F.lit(None).cast("array<int>").alias("template"))
    else:
        held = None
        salted = lambda df, salt: df.withColumn("salt", salt)
        salts = 32
        shaped = rows.mapInArrow(_with_shape(3), T.StructType([*rows.schema.fields, T.StructField("shape", T.BinaryType())]))
        sides = salted(shaped, F.pmod(F.xxhash64("html", "id"), F.lit(salts)).cast("int"))
        joined = sides.join(salted(templates, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["host", "shape", "salt"], "left").select("id", "url", "html", "host", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value if held else {}
        hosts = {host for host, _ in known}

        def text_of(source: str, host: str, template: list[int] | None) -> str:
            page = parse(source)
            if not template and host not in hosts:
                return _content(page, [False] * len(page.tag), by_class)
            tree, place, _ = fold(page)
            fixed = set(template) if template else known.get((host, _digest(_as_json(tree))), ())
            return _content(page, [p in fixed for p in place], by_class)

        for batch in batches:
            texts = [text_of(*x) for x in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    kind = joined.schema
    out = joined.mapInArrow(run, f"id {kind['id'].dataType.simpleString()}, url {kind['url'].dataType.simpleString()}, text string")
    return out.select(F.col("id").alias(id_column), F.col("url").alias(url_column), "text", F.char_length("text").cast("long").alias("n_chars"))
