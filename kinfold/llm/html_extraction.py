"""HTML extraction by wrapper induction: DOM trees of same-host pages are aligned by simple tree matching.

Method: of each host's pages five are drawn by hash, and the one whose DOM agrees best with the others is the host's
reference.  A page's DOM is folded: neighbouring paragraphs, list items and the like of one kind (tag and class) become one
iterator node.  Every page, in whatever task it is read, is matched to its host's reference by simple tree matching (the
largest order-preserving match of equal nodes; equal subtrees match at once), which names the slot of each node; a node the
reference lacks gets a slot by its parent's slot and its kind.  Digests of the texts of all slots are counted by host over
all its pages.  A text that at least 80 % (three at least) of the independent pages with a slot have there is *template*, all
else is what the slot varies in.  Pages are copies, not independent, if the longest text of theirs that isn't on most of the
host's pages is the same.  Elements named by tag, class or id as menu, header, footer, sidebar, notice, advert, form, dialog or
comments carry no content, whatever they hold, and take no part; inside marked content a class does so only if all its words
say it, and an id doesn't.  Where pages mark their content (article, main), the text
inside it that isn't template is content, or all of it if there is no other; other pages keep all text that isn't template.

Text: character references are decoded; white space (of HTML) inside a block becomes one space and is trimmed; blocks are
joined in page order by one line feed.

Defined cases: null and empty html give an empty text; a page without a usable url is aligned with others like it; a host
with fewer than three independent pages has no template; broken markup is read as browsers read it (open elements are closed at the end,
stray end tags are ignored); rows without a page_id keep a null id; repeated rows give repeated results; extra columns are
ignored.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm._base import sized, stored
from kinfold.llm._words import record_batch

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that repeat within a slot; neighbours of one kind are one iterator.
REPEATED = frozenset("a b br code dd dt em h1 h2 h3 h4 h5 h6 hr i img li option p span strong td th tr".split())
#: Elements that a page doesn't show: text runs on past them.
UNSEEN = frozenset("script style template noscript title svg math".split())
#: Elements and class words that hold no content.
DROPPED = frozenset("head title script style noscript template iframe object svg math nav footer aside form button select option textarea input dialog menu xmp noembed noframes".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer form gdpr menu modal nav navbar navigation newsletter notice notices notification overlay popup promo promoted related share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget".split())
#: Class words that say where or in what frame something stands.
FRAMES = frozenset("area bar block bottom box button buttons col column container content frame group inline inner item items left link links list main outer panel region right row section slot title top unit wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
#: A start tag of the key closes an open paragraph; li, dt/dd, options and table cells close their like.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody"}, "tfoot": {"thead", "tbody"}}
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}

P_BARRIER = ("button", "table", "td", "th", "object", "template")

#: Tables of children up to this size are filled number by number, larger ones row by row with numpy: the same numbers.
SMALL = 1_000
#: Sizes of matches that are remembered; beyond, they are worked out again.
KEPT = 1 << 20

_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACES = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("tag", "kind", "kids", "out", "main", "constant")

    def __init__(self, tag: str, kind: str, out: bool, main: bool) -> None:
        self.tag, self.kind, self.out, self.main = tag, kind, out, main
        self.kids: list[Node | str] = []
        self.constant = False


def _named(found: dict[str, str], inside: bool) -> bool:
    """Whether class or id name boilerplate.  Inside marked content the whole class must: a "share price" is no share button,
    and an id is an anchor there."""
    names = set(re.findall("[a-z]+", found.get("class", "").lower()))
    if inside:
        return bool(names & WORDS) and names <= WORDS | FRAMES
    return bool((names | set(re.findall("[a-z]+", found.get("id", "").lower()))) & WORDS)


def _read_tag(tag: str, attributes: str, inside: Node) -> Node:
    if not attributes.strip():
        out = tag in DROPPED or (tag == "header" and not inside.main)
        return Node(tag, tag, inside.out or out, inside.main or tag in ("article", "main"))
    found: dict[str, str] = {}
    for m in _ATTR.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")  # of repeated attributes the first counts
    role = found.get("role", "").lower()
    out = tag in DROPPED or (tag == "header" and not inside.main) or _named(found, inside.main) or role in ROLES or "hidden" in found
    main = inside.main or tag in ("article", "main") or role in ("main", "article")
    return Node(tag, f"{tag}.{re.sub('[0-9]+', '', found.get('class', ''))}", inside.out or out, main)


def parse(page: str) -> Node:
    """The DOM of a page; texts are decoded."""
    root = Node("", "", False, False)
    stack = [root]
    places: dict[str, list[int]] = {}  # of every open element, by tag: nesting of any depth costs no search

    def close(k: int) -> None:
        for node in stack[k:]:
            places[node.tag].pop()
        del stack[k:]

    def innermost(tags: Iterable[str]) -> int:
        return max((p[-1] for t in tags if (p := places.get(t))), default=0)

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            stack[-1].kids.append(html.unescape(page[at:lt]))
        if lt == n:
            break
        m = _TOKEN.match(page, lt)
        if not m:
            rest = page[lt : lt + 3]
            if re.match(r"</?[a-zA-Z]", rest):  # a tag cut off by the end of the page
                break
            stack[-1].kids.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[1]:
            if k := innermost((m[1].lower(),)):
                close(k)
        elif m[2]:
            tag = m[2].lower()
            if tag in CLOSES_P:
                if (k := innermost(("p",))) > innermost(P_BARRIER):
                    close(k)
            elif tag in LIKE and (k := innermost(LIKE[tag])) > innermost(BARRIER[tag]):
                close(k)
            node = _read_tag(tag, m[3] or "", stack[-1])
            stack[-1].kids.append(node)
            if tag in RAW:
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                stop = page.find(">", end.start()) if end else -1
                at = stop + 1 if stop >= 0 else n
            elif tag not in VOID:
                places.setdefault(tag, []).append(len(stack))
                stack.append(node)
    return root


class Fold:
    """A node of the folded tree: neighbouring siblings of one kind.  ``sign`` and ``count`` are the subtree's; see ``seal``."""

    __slots__ = ("kind", "members", "kids", "sign", "count", "slot")

    def __init__(self, kind: str, members: list[Node]) -> None:
        self.kind, self.members, self.slot = kind, members, 0
        self.kids: list[Fold] = []

    def seal(self) -> None:
        """Once its kids are sealed."""
        self.count = 1 + sum(k.count for k in self.kids)
        self.sign = hash((self.kind, *(k.sign for k in self.kids)))


def fold(tree: Node) -> Fold:
    """The folded tree, of any depth."""
    top = Fold("", [tree])
    done, todo = [], [top]
    while todo:
        x = todo.pop()
        done.append(x)
        runs: list[list[Node]] = []
        for k in (k for m in x.members if not m.out for k in m.kids if not isinstance(k, str)):
            if runs and runs[-1][0].kind == k.kind and k.tag in REPEATED:
                runs[-1].append(k)
            else:
                runs.append([k])
        x.kids = [Fold(r[0].kind, r) for r in runs]
        todo += x.kids
    for x in reversed(done):
        x.seal()
    return top


def _number(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def pack_fold(top: Fold) -> bytes:
    """A folded tree without its texts: kinds and numbers of children in preorder."""
    out, todo = [], [top]
    while todo:
        x = todo.pop()
        out.append((x.kind, len(x.kids)))
        todo += reversed(x.kids)
    return zlib.compress(json.dumps(out).encode(), 6)


def unpack_fold(packed: bytes) -> Fold:
    """The tree again; slots are places in preorder."""
    rows = json.loads(zlib.decompress(packed))
    folds = [Fold(kind, []) for kind, _ in rows]
    done: list[Fold] = []
    for i in range(len(rows) - 1, -1, -1):
        x, n = folds[i], rows[i][1]
        x.slot = i
        x.kids = done[len(done) - n :][::-1] if n else []
        del done[len(done) - n :]
        x.seal()
        done.append(x)
    return folds[0]


class _Table:
    """The children of two nodes of one kind, and how to match most below them in order.

    Equal last children are matched at once, which no best match beats.  Of the rest a table has the best of each two beginnings;
    one row in about sqrt(rows) is kept, those between are worked out again on the way back.
    """

    def __init__(self, a: Fold, b: Fold) -> None:
        self.m, self.n, self.tail, self.end = len(a.kids), len(b.kids), 0, (len(a.kids), len(b.kids))
        while self.m and self.n and a.kids[self.m - 1].sign == b.kids[self.n - 1].sign:
            self.m, self.n = self.m - 1, self.n - 1
            self.tail += a.kids[self.m].count
        self.a, self.b = a.kids[: self.m], b.kids[: self.n]
        self.small = self.m * self.n <= SMALL
        self.rows: dict[int, list[int] | np.ndarray] = {}  # by a child's sign: sizes of its matches with the distinct others of its kind
        self.kinds: dict[str, tuple[dict[int, Fold], list[int], list[int]]] = {}  # distinct children, places, and which of them is there

    def ask(self) -> Iterator[tuple[Fold, Fold]]:
        """Yields the pairs of children whose sizes take tables of their own, and is sent the sizes."""
        number: dict[int, int] = {}
        wanted = {x.kind for x in self.a}
        for j, y in enumerate(self.b):
            if y.kind in wanted:
                distinct, places, which = self.kinds.setdefault(y.kind, ({}, [], []))
                if y.sign not in distinct:
                    number[y.sign], distinct[y.sign] = len(distinct), y
                places.append(j)
                which.append(number[y.sign])
        if not self.small:
            self.kinds = {k: (d, np.array(p), np.array(w)) for k, (d, p, w) in self.kinds.items()}
        for x in self.a:
            if x.sign not in self.rows and x.kind in self.kinds:
                row = []
                for y in self.kinds[x.kind][0].values():
                    row.append(x.count if x.sign == y.sign else 1 if not (x.kids and y.kids) else (yield x, y))
                self.rows[x.sign] = row if self.small else np.array(row, np.int32)

    def weights(self, i: int) -> list[int] | np.ndarray:
        """Of child i with each of the others; 0 where kinds differ."""
        x = self.a[i]
        out = [0] * self.n if self.small else np.zeros(self.n, np.int32)
        if x.kind in self.kinds:
            _, places, which = self.kinds[x.kind]
            row = self.rows[x.sign]
            if self.small:
                for j, k in zip(places, which, strict=True):
                    out[j] = row[k]
            else:
                out[places] = row[which]
        return out

    def begin(self) -> list[int] | np.ndarray:
        return [0] * (self.n + 1) if self.small else np.zeros(self.n + 1, np.int32)

    def next(self, above: list[int] | np.ndarray, i: int) -> list[int] | np.ndarray:
        w = self.weights(i)
        if self.small:
            best, out = 0, [0]
            for j, v in enumerate(w):
                best = max(best, above[j + 1], above[j] + v)
                out.append(best)
            return out
        out = np.zeros(self.n + 1, np.int32)
        np.maximum.accumulate(np.maximum(above[1:], above[:-1] + w), out=out[1:])
        return out

    def size(self) -> int:
        row = self.begin()
        for i in range(self.m if self.n else 0):
            row = self.next(row, i)
        return 1 + self.tail + int(row[-1])

    def steps(self) -> list[tuple[int, int]]:
        """Places of the children that the largest match pairs."""
        out = [(self.end[0] - k, self.end[1] - k) for k in range(1, self.end[0] - self.m + 1)]
        if not self.kinds:
            return out
        each = isqrt(self.m) + 1
        row = self.begin()
        kept = [row]
        for i in range(self.m):
            row = self.next(row, i)
            if (i + 1) % each == 0:
                kept.append(row)
        i, j, low, block = self.m, self.n, self.m, []
        seen, w = -1, []
        while i and j:
            if i <= low:  # rows low to i
                low = (i - 1) // each * each
                block = [kept[low // each]]
                for r in range(low, i):
                    block.append(self.next(block[-1], r))
            if seen != i:
                seen, w = i, self.weights(i - 1)
            here, above = block[i - low], block[i - 1 - low]
            if w[j - 1] and here[j] == above[j - 1] + w[j - 1]:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif here[j] == above[j]:
                i -= 1
            else:
                j -= 1
        return out


def _filled(a: Fold, b: Fold, sizes: dict[tuple[int, int], int]) -> _Table:
    """The table of two nodes; those below are filled first, without recursion."""
    top = _Table(a, b)
    todo = [((a.sign, b.sign), top, top.ask())]
    size = None
    while True:
        key, table, asking = todo[-1]
        try:
            x, y = asking.send(size)
        except StopIteration:
            todo.pop()
            if not todo:
                return table
            size = table.size()
            if len(sizes) >= KEPT:
                sizes.clear()
            sizes[key] = size
            continue
        size = sizes.get((x.sign, y.sign))
        if size is None:
            below = _Table(x, y)
            todo.append(((x.sign, y.sign), below, below.ask()))


def match(a: Fold, b: Fold) -> tuple[int, list[tuple[Fold, Fold]]]:
    """Simple tree matching of two folded trees, of any width and depth: size and pairs of the largest match."""
    if a.kind != b.kind:
        return 0, []
    sizes: dict[tuple[int, int], int] = {}
    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        if x.sign == y.sign:
            todo += zip(x.kids, y.kids, strict=True)
        elif x.kids and y.kids:
            todo += [(x.kids[i], y.kids[j]) for i, j in _filled(x, y, sizes).steps()]
    return len(pairs), pairs


def align(tree: Node, reference: Fold | None) -> list[tuple[int, int, int, Node]]:
    """Slot, digest, length and element of each text of a page that may be content."""
    top = fold(tree)
    found = {id(y): x.slot for x, y in match(reference, top)[1]} if reference else {}
    out, todo = [], [(top, -1)]
    while todo:
        x, above = todo.pop()
        slot = found.get(id(x))
        x.slot = _number(f"{above} {x.kind}") if slot is None else slot
        for m in x.members:
            if not m.out:
                text = " ".join([t for k in m.kids if isinstance(k, str) and (t := _SPACES.sub(" ", k).strip())])
                if text:
                    out.append((x.slot, _number(text), len(text), m))
        todo += [(k, x.slot) for k in x.kids]
    return out


def choose(pages: list[str]) -> Fold:
    """The page whose tree agrees best with the others'."""
    folds = [fold(parse(p)) for p in pages]
    sizes = [f.count for f in folds]
    agree = [sum(2 * match(f, g)[0] / (m + n) for g, n in zip(folds, sizes, strict=True)) for f, m in zip(folds, sizes, strict=True)]
    return folds[max(range(len(folds)), key=lambda i: (agree[i], sizes[i]))]


def _has_main(node: Node) -> tuple[bool, bool]:
    """Whether a page marks content, and whether text inside it isn't template."""
    marked, todo = False, [node]
    while todo:
        x = todo.pop()
        if x.main and not x.out:
            marked = True
            if not x.constant and any(isinstance(k, str) and _SPACES.sub("", k) for k in x.kids):
                return True, True
        todo += [k for k in x.kids if not isinstance(k, str)]
    return marked, False


def content(root: Node) -> str:
    """The text of a page's content slots."""
    marked, varies = _has_main(root)
    drop = varies or not marked  # an article of template texts alone is content by its mark
    blocks: list[list[str]] = [[]]
    todo: list = [root]
    while todo:
        x = todo.pop()
        if x is None:
            blocks.append([])
            continue
        if isinstance(x, tuple):
            blocks[-1].append(x[0])
            continue
        if x.out:
            if x.tag not in INLINE and x.tag not in UNSEEN:
                blocks.append([])
            continue
        use = (x.main or not marked) and not (x.constant and drop)
        if x.tag not in INLINE:
            blocks.append([])
            todo.append(None)
        elif x.tag == "br":
            blocks[-1].append(" ")
        for k in reversed(x.kids):
            if not isinstance(k, str):
                todo.append(k)
            elif use:
                todo.append((k,))
    lines = (_SPACES.sub(" ", "".join(b)).strip(" ") for b in blocks)
    return "\n".join(x for x in lines if x)


class _References:
    """References and templates of hosts, unpacked once for rows that follow each other."""

    def __init__(self, most: int = 200) -> None:
        self.most, self.held = most, {}

    def __call__(self, host: int, packed: bytes | None, template: bytes | None) -> tuple[Fold | None, frozenset[tuple[int, int]]]:
        if host not in self.held:
            if len(self.held) >= self.most:
                self.held.clear()
            pairs = np.frombuffer(zlib.decompress(template), "<i8").reshape(-1, 2).tolist() if template else []
            self.held[host] = unpack_fold(packed) if packed else None, frozenset(map(tuple, pairs))
        return self.held[host]


def _choose(t: pa.Table) -> pa.Table:
    t = t.sort_by("draw")
    return pa.table({"host": t["host"][:1], "reference": pa.array([pack_fold(choose(t["html"].to_pylist()))], pa.binary())})


def _pack_template(t: pa.Table) -> pa.Table:
    pairs = np.stack([t["slot"].to_numpy(), t["digest"].to_numpy()], 1).astype("<i8")
    return pa.table({"host": t["host"][:1], "template": pa.array([zlib.compress(pairs.tobytes(), 1)], pa.binary())})


_ITEMS = "host long, page long, slot long, digest long, size int"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's texts by slot, once."""
    schema = pa.schema([("host", pa.int64()), ("page", pa.int64()), ("slot", pa.int64()), ("digest", pa.int64()), ("size", pa.int32())])
    references = _References()
    for b in batches:
        out: list[tuple] = []
        for host, page, text, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
            reference, _ = references(host, packed, None)
            out += {(host, page, *x[:3]) for x in align(parse(text), reference)}
        yield record_batch(schema, **{f.name: [x[i] for x in out] for i, f in enumerate(schema)})


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    references = _References()
    for b in batches:
        out = []
        for host, page, packed, template in zip(*(b.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
            tree = parse(page or "")
            if template:
                reference, constant = references(host, packed, template)
                for slot, digest, _, node in align(tree, reference):
                    node.constant = (slot, digest) in constant
            out.append(content(tree))
        yield record_batch(schema, page_id=b.column(1), url=b.column(2), text=out)


def induce(pages: DataFrame, share: float = 0.8, least: int = 3, drawn: int = 5, most: int = 1 << 20) -> DataFrame:
    """Per host: its reference and its template.  Pages of more than ``most`` characters are drawn only for lack of others."""
    full = pages.where("length(html) > 0").withColumn("page", F.xxhash64("html"))
    many = pages.count()
    small = lambda df: sized(df, many, 2_000)
    marks = full.select("host", F.pmod("page", F.lit(drawn)).alias("deal"), F.struct((F.length("html") > most).alias("long"), "page").alias("draw"))
    draws = stored(small(marks.groupBy("host", "deal").agg(F.min("draw").alias("draw")).select("host", F.col("draw.page").alias("page"))), "draws")
    chosen = full.join(draws, ["host", "page"]).dropDuplicates(["host", "page"]).select("host", F.col("page").alias("draw"), "html")
    references = stored(small(chosen.groupBy("host").applyInArrow(_choose, "host long, reference binary")), "references")
    items = stored(small(full.select("host", "page", "html").join(references, "host").mapInArrow(_items, _ITEMS)), "items")
    n_pages = items.groupBy("host").agg(F.countDistinct("page").alias("pages"))
    shared = items.groupBy("host", "slot", "digest").agg(F.countDistinct("page").alias("n")).where(F.col("n") >= least)
    shared = stored(small(shared.join(n_pages, "host").withColumn("most", 2 * F.col("n") > F.col("pages"))), "shared")
    own = items.join(shared.where("most").select("host", "slot", "digest"), ["host", "slot", "digest"], "left_anti")
    keys = own.groupBy("host", "page").agg(F.max(F.struct("size", "digest"))["digest"].alias("key"))
    maybe = items.join(shared.select("host", "slot").distinct(), ["host", "slot"], "left_semi")
    keyed = maybe.join(keys, ["host", "page"], "left").select("host", "slot", "digest", F.coalesce("key", F.lit(0)).alias("key"))
    pairs = keyed.distinct()
    counts = pairs.groupBy("host", "slot", "digest").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    seen = pairs.select("host", "slot", "key").distinct().groupBy("host", "slot").agg(F.count("*").alias("seen"))
    template = counts.join(seen, ["host", "slot"]).where(F.col("n") >= share * F.col("seen")).select("host", "slot", "digest")
    return small(references.join(template.groupBy("host").applyInArrow(_pack_template, "host long, template binary"), "host", "left"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    rows = pages.select(F.xxhash64(host).alias("host"), F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    wrappers = stored(induce(rows.select("host", "html")), "wrappers")
    out = rows.join(wrappers, "host", "left").select("host", "page_id", "url", "html", "reference", "template").mapInArrow(_contents, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
