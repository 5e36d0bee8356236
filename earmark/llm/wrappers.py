"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of the same host.

A page is a stream of tokens: block tags, opening and closing, and text between them (inline tags are markup inside a text).
A wrapper is a union-free expression over such tokens: a tag with an expression inside, a text that is always the same, a text
slot, an optional group or a repeated group. It starts as one page and is aligned with all others.
Neighbours of one tag are first folded into a repeated group whose inside is their alignment; then the two streams are
aligned tag by tag: a tag that both have is aligned inside, one that only one side has becomes optional, texts that differ
become a slot.

The wrapper decides which of its parts hold the main text: parts named by their tag, class, id or role as menus, headers,
footers, sidebars, notices, adverts, forms or comments never do. Of the rest, the parts under an article or main element do if
there are any, else the whole body without texts that are the same on all pages that teach the wrapper and without lists of links.

Inside the article, whatever its names, alignment decides too, if ``LEAST_PAGES`` pages share less than half their words: a block
whose texts are all the same on every page is the template's, not the article's (headings, items and cells are kept unless a block
around them is such a block; paragraphs without a name are kept, too). Where every page has one article element at one place, article elements that repeat at
another place are teasers or comments; inside the article they are only if a name says so, too.
Pages are matched with their host's wrapper; what a page has beyond it is judged by names.

All pages of a host teach, each one whole. Those with an article or main element make one wrapper, those without make another, as different
rules hold for them. Each page becomes an expression where it lies; expressions are united two by two along the binary trie of the pages'
hashes, so the result depends neither on the partitions nor on the order of the rows, and parts of the trie of a large host are united in tasks of
their own. A part that some page lacks stays optional whatever follows; nothing in it can be the same on every page, so of such parts
only those with article elements that repeat are kept while pages are united, and an expression stays about as large as a page.

Defined results: null or empty html gives an empty text; a null url or one without a host belongs to one nameless host;
repeated rows give the same text; very long pages are read whole, however deep they are nested; equal pages of a host teach
once (they are told apart by 64-bit hashes, words by 32 bits); an empty table gives no rows; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import html
import itertools
import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earmark.llm.common import keyed, keyed_texts, pieces, pin

#: A host with more pages is split by hash, so that tasks unite about as many of it.
TOGETHER = 256
#: At most so many hosts are split, into larger parts if need be; each step unites two to the power of STEP parts of one at most.
SPLIT_HOSTS = 10_000
STEP = 10
#: Pages whose hashes a task keeps so as to pass on equal ones once.
MOST_SEEN = 1 << 17
#: Longer texts are known by their hash.
LONG_TEXT = 40
#: Pages without which nothing follows from what they have in common.
LEAST_PAGES = 3
#: Deepest nesting that a page's tree keeps; what is nested deeper is joined to the level above.
DEPTH = 120
#: Cells of the table by which two sequences of blocks are aligned; beyond it they are aligned in linear time.
MOST_CELLS = 1 << 20
# Fixed values of HTML: elements by kind.
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = "script style noscript template iframe svg math object canvas textarea select audio video"
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
_BREAKS_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CHROME = set("nav footer aside form button dialog menu".split())
_CHROME_NAMES = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription share sharing "
    "social sidebar rail widget nav navbar navigation menu breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments disqus reply replies respond discussion related recommended "
    "recommendations pagination pager login signup search skip hidden navigation contentinfo complementary".split())
#: A name such as has-sidebar or no-comments says what the element has, not what it is.
_NEGATIONS = set("has no with without".split())
#: Blocks that may say the same on every page and still belong to the article.
_LABELS = set("h1 h2 h3 h4 h5 h6 li dt dd th td tr caption figcaption thead tbody table ul ol dl blockquote pre".split())
_MAIN_NAMES = set("article content main post entry story".split())
# A head ends at its end tag, or, as HTML lets that out, before whatever can't stand in a head.
_HEAD = r"<head\b[^>]*>(?:\s+|<!--.*?-->|<(?P<within>title|" + _RAW.replace(" ", "|") + r")\b[^>]*>.*?</(?P=within)\s*>|<(?:meta|link|base)\b[^>]*>|<[!?][^>]*>)*+(?:</head\s*>)?"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|" + _HEAD + r"|<(?P<raw>" + _RAW.replace(" ", "|") + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S | re.I)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Node:
    """A block of a page: its key, and texts and blocks inside in order. ``links``: characters of text inside links."""

    key: str
    children: list = field(default_factory=list)
    links: int = 0

    @property
    def tag(self) -> str:
        return self.key.partition(" ")[0]


@dataclass
class Part:
    """A part of a wrapper. kind: tag, text (always the same) or slot; times: 1, ? (optional), + (repeated) or * (both).
    ``unlike``, of a whole wrapper: the pages whose texts share less than half their words with each other."""

    kind: str
    key: str = ""
    times: str = "1"
    inside: list = field(default_factory=list)
    links: float = 0.0
    unlike: int = 0

    @property
    def tag(self) -> str:
        return self.key.partition(" ")[0]


def _key(name: str, rest: str) -> str:
    named = " ".join(sorted({w for m in _NAMED.finditer(rest) for w in (m[2] or m[3] or m[4] or "").split()})) if "=" in rest else ""
    return f"{name} {named}" if named else name


def parse(page: str) -> Node:
    """The page's blocks as a tree; end tags that HTML lets out are supplied."""
    root = Node("root")
    stack, text, in_link = [root], [], 0
    deeper: list[str] = []  # open elements below the deepest level that is kept

    def end_text() -> None:
        if text:
            body = " ".join(html.unescape("".join(text)).split())
            if body:
                stack[-1].children.append(body)
            text.clear()

    def close(depth: int) -> None:
        end_text()
        del stack[depth:]
        deeper.clear()

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            chunk = page[at : m.start()]
            text.append(chunk)
            if in_link:
                stack[-1].links += len(chunk.strip())
        at = m.end()
        name = m["name"]
        if not name:
            if m["raw"] or m[0][:5].lower() == "<head":
                end_text()
            continue
        name = name.lower()
        if name in _INLINE:
            if name == "a":
                in_link = 0 if m["close"] else 1
            continue
        if name in _VOID:
            if name in ("br", "hr"):
                end_text()
            continue
        if m["close"]:
            if name in deeper:
                end_text()
                del deeper[len(deeper) - 1 - deeper[::-1].index(name) :]
                in_link = 0
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == name:
                    close(depth)
                    break
            else:
                end_text()
            in_link = 0
            continue
        end_text()
        over = _CLOSES.get(name, set()) | ({"p"} if name in _BREAKS_P else set())
        limit = _SCOPE.get(name, set())
        depth = len(stack) - 1
        found = None
        while depth > 0 and stack[depth].tag not in limit and (limit or stack[depth].tag in over):
            if stack[depth].tag in over:
                found = depth
            elif not limit:
                break
            depth -= 1
        if found is not None:
            close(found)
        node = Node(_key(name, m["rest"]))
        stack[-1].children.append(node)
        if len(stack) < DEPTH:
            stack.append(node)
        else:
            deeper.append(name)
    if at < len(page):
        text.append(page[at:])
    end_text()
    return root


def _known_by(text: str) -> str:
    """The text, or for a long one its hash."""
    return text if len(text) <= LONG_TEXT else "\0" + xxhash.xxh3_128_hexdigest(text)


def _part(child) -> Part:
    """The expression of one page's block; neighbours of one key are folded into a repeated group."""
    if isinstance(child, str):
        return Part("text", _known_by(child))
    inside: list[Part] = []
    for c in child.children:
        p = _part(c)
        if inside and inside[-1].kind != "tag" and p.kind != "tag":
            inside[-1] = Part("slot", times="+")
        elif inside and p.kind == "tag" and inside[-1].kind == "tag" and inside[-1].key == p.key:
            inside[-1] = _unite(inside[-1], p)
            inside[-1].times = "+"
        else:
            inside.append(p)
    return Part("tag", child.key, "1", inside, child.links)


def _times(a: str, b: str) -> str:
    optional, repeated = a in "?*" or b in "?*", a in "+*" or b in "+*"
    return "*" if optional and repeated else "?" if optional else "+" if repeated else "1"


def _unite(a: Part, b: Part) -> Part:
    """The least expression of this form that matches what either matches."""
    times = _times(a.times, b.times)
    if a.kind != "tag":
        same = a.kind == b.kind == "text" and a.key == b.key
        return Part("text" if same else "slot", a.key if same else "", times)
    return Part("tag", a.key, times, _align(a.inside, b.inside), max(a.links, b.links))


def _same(a: Part, b: Part) -> bool:
    return a.key == b.key if a.kind == "tag" and b.kind == "tag" else a.kind != "tag" and b.kind != "tag"


def _first_matches(a: list[Part], b: list[Part]) -> list[tuple[int, int]]:
    """Places of a common subsequence: each part of ``a`` with the next part of ``b`` that is the same."""
    at: dict[str | None, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        at.setdefault(b[j].key if b[j].kind == "tag" else None, []).append(j)
    out, last = [], -1
    for i, part in enumerate(a):
        places = at.get(part.key if part.kind == "tag" else None, [])
        while places and places[-1] <= last:
            places.pop()
        # A match far ahead would leave out all that stands between.
        if places and places[-1] - last <= 64:
            last = places.pop()
            out.append((i, last))
    return out


def _optional(part: Part) -> Part:
    return Part(part.kind, part.key, _times(part.times, "?"), part.inside, part.links)


def _align(a: list[Part], b: list[Part]) -> list[Part]:
    """Aligns two sequences along a longest common subsequence; the rest becomes optional. Very long ones along the first matches."""
    out: list[Part] = []
    same = 0
    while same < len(a) and same < len(b) and _same(a[same], b[same]):
        out.append(_unite(a[same], b[same]))
        same += 1
    a, b = a[same:], b[same:]
    n, m = len(a), len(b)
    if n * m > MOST_CELLS:
        i = j = 0
        for x, y in [*_first_matches(a, b), (n, m)]:
            out += [_optional(p) for p in (*a[i:x], *b[j:y])]
            if x < n:
                out.append(_unite(a[x], b[y]))
            i, j = x + 1, y + 1
        return out
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if _same(a[i], b[j]) else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and _same(a[i], b[j]):
            out.append(_unite(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append(Part(a[i].kind, a[i].key, _times(a[i].times, "?"), a[i].inside, a[i].links))
            i += 1
        else:
            out.append(Part(b[j].kind, b[j].key, _times(b[j].times, "?"), b[j].inside, b[j].links))
            j += 1
    return out


def infer(pages: list[str]) -> tuple[Part, int]:
    """The wrapper of the pages, aligned one after another, and the number of different pages it was made of."""
    made = None
    different = sorted(set(pages))
    for page in different:
        part = _part(parse(page))
        made = part if made is None else _unite(made, part)
    made = made or Part("tag", "root")
    made.unlike = _unlike(different)
    return made, len(different)


def _words(root: Node) -> np.ndarray:
    """Hashes of the different words of the main text by names alone."""
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, _text(root, NO_RULES).split()), np.uint64).astype(np.uint32))


def _apart(counted: list[np.ndarray], words: np.ndarray) -> bool:
    """Whether a page has words and shares less than half of them with each one counted before."""
    return len(words) > 0 and all(2 * len(np.intersect1d(words, c, True)) < min(len(words), len(c)) for c in counted)


def _unlike(pages: list[str]) -> int:
    """How many of the pages share less than half their words with each one counted before; copies of one text tell nothing of a template."""
    counted: list[np.ndarray] = []
    for words in map(_words, map(parse, pages)):
        if _apart(counted, words):
            counted.append(words)
    return len(counted)


def _holds_main(block: Node | Part) -> bool:
    inside = block.children if isinstance(block, Node) else block.inside
    return any(c.key.partition(" ")[0] in ("article", "main") or _holds_main(c) for c in inside if not isinstance(c, str) and (isinstance(c, Node) or c.kind == "tag"))


def _named_chrome(names: str) -> bool:
    last = {p[-1].lower() for name in names.split() if (p := _PARTS.findall(name)) and not {x.lower() for x in p[:-1]} & _NEGATIONS}
    whole = {"".join(_PARTS.findall(name)).lower() for name in names.split()}
    return bool((last | whole) & _CHROME_NAMES)


def is_chrome(block: Node | Part, in_main: bool) -> bool:
    """By the tag, or by a name or its last part; a name never drops an article or main element, nor what holds one."""
    tag, _, names = block.key.partition(" ")
    if tag in _CHROME or tag == "header" and not in_main:
        return True
    if tag in ("article", "main", "body", "html", "root") or not names:
        return False
    return _named_chrome(names) and not _holds_main(block)


def is_main(key: str) -> bool:
    tag, _, names = key.partition(" ")
    return tag in ("article", "main") or "main" in names.split() or bool({n.lower() for n in names.split()} & {f"{m}{x}" for m in _MAIN_NAMES for x in ("", "-body", "-content", "-text")})


def _articles(part: Part, path: tuple[str, ...] = (), times: str = "1") -> Iterator[tuple[tuple[str, ...], str]]:
    """Path of each article element and how often it is on a page, by its own times and those of the parts around it."""
    for p in part.inside:
        if p.kind != "tag" or is_chrome(p, False):
            continue
        own, often = (*path, p.key), _times(times, p.times)
        if p.tag == "article":
            yield own, often
        yield from _articles(p, own, often)


def _always(part: Part) -> bool:
    """Whether the part is on every page, and never with another text."""
    return part.times in "1+" and (part.kind == "text" or part.kind == "tag" and all(map(_always, part.inside)))


def _is_label(key: str) -> bool:
    return key == "p" or key.partition(" ")[0] in _LABELS


def _has_text(part: Part) -> bool:
    return part.kind != "tag" or any(map(_has_text, part.inside))


@dataclass
class Rules:
    """What a wrapper says: the paths of parts that aren't main text (chrome) and of the one article element that every page has (main), whether
    there is such a one, and the texts that never change."""

    has_main: bool
    labels: dict[tuple[str, ...], str]
    constant: set[tuple[tuple[str, ...], str]]

    @classmethod
    def of(cls, wrapper: Part, pages: int) -> Rules:
        out = cls(False, {}, set())
        out._walk(wrapper, (), False, pages >= LEAST_PAGES, wrapper.unlike >= LEAST_PAGES)
        if wrapper.unlike >= LEAST_PAGES:
            out._choose(list(_articles(wrapper)))
        return out

    def dump(self) -> bytes:
        return pickle.dumps((self.has_main, self.labels, self.constant))

    @classmethod
    def load(cls, data: bytes) -> Rules:
        return cls(*pickle.loads(data))

    def _choose(self, articles: list[tuple[tuple[str, ...], str]]) -> None:
        """The one article that every page has, if there is one; of the others those that repeat."""
        single = {path for path, often in articles if often == "1"}
        # The outermost ones: an article inside another belongs to it.
        single = {path for path in single if not any(path[:n] in single for n in range(1, len(path)))}
        if len(single) != 1:
            return
        (one,) = single
        self.has_main = True
        self.labels[one] = "main"
        for path, often in articles:
            inside = path[: len(one)] == one
            if path != one and one[: len(path)] != path and often in "+*" and (not inside or _named_chrome(path[-1].partition(" ")[2])):
                self.labels[path] = "chrome"

    def _add(self, part: Part, path: tuple[str, ...]) -> None:
        for p in part.inside:
            if p.kind == "text":
                self.constant.add((path, p.key))
            else:
                self._add(p, (*path, p.key))

    def _walk(self, part: Part, path: tuple[str, ...], in_main: bool, enough: bool, unlike: bool) -> None:
        """Texts that never change, of parts that every page has."""
        for p in part.inside:
            if p.kind == "text" and p.times == "1" and enough and not in_main:
                self.constant.add((path, p.key))
            if p.kind != "tag" or p.times not in "1+" or is_chrome(p, in_main):
                continue
            own = (*path, p.key)
            if in_main and not _is_label(p.key) and not is_main(p.key) and _always(p):
                if unlike and _has_text(p):
                    self._add(p, own)
                continue
            self._walk(p, own, in_main or is_main(p.key), enough, unlike)


def _has_path(node: Node, path: tuple[str, ...]) -> bool:
    return not path or any(not isinstance(c, str) and c.key == path[0] and _has_path(c, path[1:]) for c in node.children)


def _has_main(node: Node) -> bool:
    return any(not isinstance(c, str) and not is_chrome(c, False) and (is_main(c.key) or _has_main(c)) for c in node.children)


def _length(node: Node) -> tuple[int, int]:
    whole, links = 0, node.links
    for c in node.children:
        if isinstance(c, str):
            whole += len(c)
        else:
            w, l = _length(c)
            whole, links = whole + w, links + l
    return whole, links


NO_RULES = Rules(False, {}, set())


def main_text(page: str, rules: Rules) -> str:
    """Texts of the page at the wrapper's main parts, in page order, one a line."""
    return _text(parse(page), rules)


def _text(root: Node, rules: Rules) -> str:
    blocks: list[str] = []
    want = _has_main(root)
    # A page without the article that its host's other pages have isn't judged by where that stands.
    one = next((path for path, label in rules.labels.items() if label == "main"), ()) if rules.has_main else ()
    chrome = {path for path, label in rules.labels.items() if label == "chrome"} if one and _has_path(root, one) else set()

    def walk(node: Node, path: tuple[str, ...], in_main: bool) -> None:
        for c in node.children:
            if isinstance(c, str):
                if (in_main or not want) and not (rules.constant and (path, _known_by(c)) in rules.constant):
                    blocks.append(c)
                continue
            own = (*path, c.key)
            if is_chrome(c, in_main) or own in chrome:
                continue
            main = in_main or is_main(c.key)
            if not main and not want and c.tag in ("ul", "ol", "div", "table"):
                whole, links = _length(c)
                if links > 0.6 * whole:
                    continue
            walk(c, own, main)

    walk(root, (), False)
    return "\n".join(blocks)


@dataclass
class Lesson:
    """What some pages of a host say: their expression, how many there are, and words of up to LEAST_PAGES of them that share less than half with each other."""

    part: Part
    pages: int
    unlike: list[np.ndarray]

    def and_of(self, other: Lesson) -> Lesson:
        unlike = list(self.unlike)
        for words in other.unlike:
            if len(unlike) < LEAST_PAGES and _apart(unlike, words):
                unlike.append(words)
        part = _unite(self.part, other.part)
        part.inside = _firm(part.inside)
        return Lesson(part, self.pages + other.pages, unlike)

    def rules(self) -> Rules:
        self.part.unlike = len(self.unlike)
        return Rules.of(self.part, self.pages)

    def dump(self) -> bytes:
        raw = pickle.dumps((_plain(self.part), self.pages, [w.tobytes() for w in self.unlike]), 5)
        return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)

    @classmethod
    def load(cls, data: bytes) -> Lesson:
        part, pages, unlike = pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True))
        return cls(_of_plain(part), pages, [np.frombuffer(w, np.uint32) for w in unlike])


def _plain(part: Part) -> tuple:
    return part.kind, part.key, part.times, part.links, [_plain(p) for p in part.inside]


def _of_plain(plain: tuple) -> Part:
    kind, key, times, links, inside = plain
    return Part(kind, key, times, [_of_plain(p) for p in inside], links)


def _firm(parts: list[Part], times: str = "1") -> list[Part]:
    """Parts that every page has; of the optional ones those with article elements that repeat, and nothing else in them. ``times``: of the parts around them."""
    out = []
    for p in parts:
        own = _times(times, p.times)
        if own in "?*" and not any(often in "+*" for _, often in _articles(Part("tag", inside=[p]), (), times)):
            continue
        out.append(Part(p.kind, p.key, p.times, _firm(p.inside, own), p.links) if p.inside else p)
    return out


def _united(lessons: Iterator[tuple[int, bytes]]) -> Lesson:
    """All lessons, by rising hash, united two by two along the binary trie of the hashes; of equal hashes one."""
    stack: list[Lesson] = []
    depths: list[int] = []
    last = None

    def close() -> None:
        depths.pop()
        right = stack.pop()
        stack[-1] = stack[-1].and_of(right)

    for digest, data in lessons:
        if digest == last:
            continue
        if last is not None:
            depth = 64 - ((digest ^ last) & _MASK).bit_length()
            while depths and depths[-1] > depth:
                close()
            depths.append(depth)
        stack.append(Lesson.load(data))
        last = digest
    while depths:
        close()
    return stack[0]


_MASK = (1 << 64) - 1
_LESSONS = "host string, prefix long, bare boolean, digest long, lesson binary"


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def _prefix(digest: int, bits: int) -> int:
    return (digest & _MASK) >> (64 - bits)


def _lessons(bits: dict[str, int]) -> Callable:
    """The lesson of each page, for the part of its host's trie that begins with so many bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            for piece in pieces(batch):
                out = []
                for host, digest, body in zip(*(c.to_pylist() for c in piece.columns)):
                    if (host, digest) in seen:
                        continue
                    if len(seen) >= MOST_SEEN:
                        seen.clear()
                    seen.add((host, digest))
                    root = parse(body)
                    words = _words(root)
                    out.append((host, _prefix(digest, bits.get(host, 0)), not _has_main(root), digest, Lesson(_part(root), 1, [words] if len(words) else []).dump()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()))], names=["host", "prefix", "bare", "digest", "lesson"])

    return run


def _by_trie(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, Lesson]]:
    """(host, prefix, bare), the least hash and the lesson of each part of a trie, from sorted rows."""
    rows = (r for batch in batches for piece in pieces(batch) for r in zip(*(c.to_pylist() for c in piece.columns)))
    for key, own in itertools.groupby(rows, lambda r: r[:3]):
        first = next(own)
        yield key, first[3], _united((r[3], r[4]) for r in itertools.chain([first], own))


def _step(bits: dict[str, int]) -> Callable:
    """Unites the parts of each trie; the results are for parts that begin with fewer bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (host, _, bare), digest, lesson in _by_trie(batches):
            row = ([host], [_prefix(digest, bits.get(host, 0))], [bare], [digest], [lesson.dump()])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()))], names=["host", "prefix", "bare", "digest", "lesson"])

    return run


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for host, own in itertools.groupby(_by_trie(batches), lambda found: found[0][0]):
        rules = {bare: lesson.rules().dump() for (_, _, bare), _, lesson in own}
        yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([rules.get(False)], pa.binary()), pa.array([rules.get(True)], pa.binary())], names=["host", "wrapper", "bare"])


def infer_wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, wrapper, bare): one row a host, in the shared folder; wrapper is of the pages with an article or main element, bare of those without."""
    rows = keyed_texts(pages, url, page).filter(F.col("_c1").isNotNull() & (F.col("_c1") != ""))
    most = max(TOGETHER, pages.count() // SPLIT_HOSTS)
    large = keyed(pages, url).groupBy(host_of(F.col("_c0")).alias("host")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).collect()
    bits = {host: (n // most).bit_length() for host, n in large}
    found = rows.select(host_of(F.col("_c0")).alias("host"), F.xxhash64("_c1").alias("digest"), "_c1").mapInArrow(_lessons(bits), _LESSONS)
    while True:
        found = found.repartition("host", "prefix").sortWithinPartitions("host", "prefix", "bare", "digest")
        if not any(bits.values()):
            return pin(found.mapInArrow(_rules, "host string, wrapper binary, bare binary"), "wrappers")
        bits = {host: max(0, n - STEP) for host, n in bits.items()}
        found = found.mapInArrow(_step(bits), _LESSONS)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """id, url, text of each row of ``pages``."""
    wrappers = infer_wrappers(pages, url, page)
    rows = keyed_texts(pages, key, url, page).withColumn("host", host_of(F.col("_c1")))
    joined = rows.join(wrappers, "host", "left").select("_c0", "_c1", "_c2", "wrapper", "bare")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes | None, Rules] = {None: NO_RULES}
        for batch in batches:
            for piece in pieces(batch, 128):
                texts = []
                for body, *own in zip(*(piece.column(i).to_pylist() for i in (2, 3, 4))):
                    root = parse(body or "")
                    wrapper = own[not _has_main(root)]
                    if wrapper not in memo:
                        if len(memo) > 256:
                            memo = {None: memo[None]}
                        memo[wrapper] = Rules.load(wrapper)
                    texts.append(_text(root, memo[wrapper]))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    return joined.mapInArrow(run, "id long, url string, text string")
