"""Main text of web pages by site style trees.

The pages of one host are merged into one tree: elements with the same path of tags and classes are one node, whatever page they are on.
A node has the presentations (sequences of child styles) and the contents (texts of its branch) that occur there, each with a count. The
entropy of either, divided by the logarithm of the occurrences, is 1 where every page has its own and 0 where all pages share one; a node's importance is

    presentation * 0.1 + content * 0.9,   blended as ((n - 1) * host + 5 * web) / (n + 4),  web likewise from all hosts and 1

since n occurrences make n - 1 comparisons; so hosts with few pages go by what the same style is worth elsewhere. A branch below 0.4 is left out of its page, with all below it.

What the tree cannot see, since it varies as articles do, is known by presentation alone and has importance 0: elements and roles that HTML reserves for
menus, headers, footers, sidebars and forms, names that sites give to adverts, notices and reader comments, invisible elements, and, outside an article,
lists of nothing but links. An ``article`` (else ``main``) has importance 1, and what lies outside has 0, unless a page has neither. Elements without class, id or role
inside an article share the article's presentation; so an article's paragraphs stay, even where thousands of pages hold the same article.

Counting is a map over pages and two partial aggregations; hot hosts and nodes collapse in the map task. The keys of the nodes to leave out are written as sorted
arrays into the shared folder, which workers map; neither pages nor nodes are joined, so no HTML is shuffled.

Blocks are what HTML lays out as blocks; ``br`` ends a line. Character references are decoded, white space (as Unicode has it) becomes one space.
Defined cases: a null or empty html gives an empty text; a null url, or one without a host, belongs to the host with the empty name; every row is a page, so
repeated rows and null ids stay rows (copies count in the tree); unclosed and stray tags, comments and quotes end where browsers end them, nearly; other columns are not returned.
"""

from __future__ import annotations

import html as entities
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kit

LEAST_IMPORTANCE = 0.4
#: Occurrences that the web's figure, or 1, counts as.
BLEND = 5
PRESENTATION = 0.1
#: Keys of a shard's file.
SHARD_KEYS = 1 << 20

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre search section summary table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("table td th caption button object template html body".split())
SIBLINGS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", *SCOPES])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", *SCOPES])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", *SCOPES])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr"]), frozenset(["table", "tbody", "thead", "tfoot"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
}
# Elements that are no text, and presentations that are no part of an article.
UNSEEN = frozenset("head title script style noscript template iframe noembed noframes object embed canvas svg audio video map datalist xmp".split())
CHROME = frozenset("nav footer aside form menu dialog button select option textarea label fieldset search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist tooltip status".split())
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot adunit sponsor sponsored sponsors promo promos promotion promoted
    nav navbar navigation menu menus breadcrumb breadcrumbs toolbar topbar sidebar sidebars rail footer colophon copyright masthead banner
    cookie cookies consent gdpr ccpa notice notices notification alert popup popover modal overlay paywall
    newsletter subscribe subscription signup signin login register share sharing sharebar social follow
    related recommended recommendations recirc trending popular pagination pager paging widget widgets skiplink search searchbox""".split()
)
COMMENTS = frozenset("comment comments commentary commentlist commentform disqus respond replies reply discussion".split())

_TAG = re.compile(
    r"""<!--(?:>|->|.*?--!?>|.*)|<[!?][^>]*>?|</(?![a-zA-Z])[^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HOST = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_SEEN_NOT = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_MASK = (1 << 64) - 1


class Style:
    """What an element's tag and attributes say."""

    __slots__ = ("article", "chrome", "header", "inner", "key", "main", "named", "unseen")

    def __init__(self, tag: str, attributes: str):
        found: dict[str, str] = {}
        for name, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
            found.setdefault(name.lower(), entities.unescape(a or b or c))
        role = found.get("role", "").strip().lower()
        names = [n for n in f"{found.get('class', '')} {found.get('id', '')}".split() if not re.match(r"(has|with|no|is|not)[-_]", n)]
        words = {w.lower() for n in names for w in _WORD.findall(n)} | {n.lower() for n in names}
        comments = bool(words & COMMENTS)
        self.unseen = tag in UNSEEN or "hidden" in found or found.get("aria-hidden") == "true" or bool(_SEEN_NOT.search(found.get("style", "")))
        self.article = (tag == "article" or role == "article" or "articleBody" in found.get("itemprop", "").split()) and not comments
        self.main = tag == "main" or role == "main"
        whole = self.article or self.main or tag in ("html", "body")
        self.header = (tag == "header" or tag in ("div", "section", "hgroup") and "header" in words) and not whole
        self.chrome = tag in CHROME or role in ROLES or comments and tag not in ("html", "body", "main") or bool(words & NAMES) and not whole
        self.named = bool(names or role)
        self.inner = tag in INLINE and not self.named
        classes = sorted({re.sub(r"\d+", "", c) for c in found.get("class", "").lower().split()})
        self.key = f"{tag}.{'.'.join(classes)}"


class Page:
    """The elements of a page that have a style of their own, in page order, and its pieces of text. Inline elements without a name belong to their parent."""

    def __init__(self, text: str, styles: dict, paths: dict):
        self.parent, self.style, self.path, self.tag = [-1], [None], [0], ["#"]
        self.pieces: list[tuple[int, str]] = []  # (element, text), a space for a block's edge
        self.linked: list[int] = []  # pieces inside links
        self._read(text, styles, paths)

    def _read(self, text: str, styles: dict, paths: dict) -> None:
        tags, nodes = ["#"], [0]  # open elements
        open_ = Counter()
        pieces = self.pieces
        at, size, links = 0, len(text), 0

        def say(start: int, stop: int) -> None:
            if stop > start:
                said = text[start:stop]
                pieces.append((nodes[-1], entities.unescape(said) if "&" in said else said))
                if links:
                    self.linked.append(len(pieces) - 1)

        def pop(to: int) -> None:
            nonlocal links
            while len(tags) > to:
                gone = tags.pop()
                open_[gone] -= 1
                if gone == "a":
                    links -= 1
                if gone not in INLINE:
                    pieces.append((nodes[-1], " "))
                nodes.pop()

        def close(wanted: frozenset, stops: frozenset) -> None:
            if any(open_[w] for w in wanted):
                for k in range(len(tags) - 1, 0, -1):
                    if tags[k] in wanted:
                        return pop(k)
                    if tags[k] in stops:
                        return None
            return None

        while at < size:
            less = text.find("<", at)
            if less < 0:
                break
            m = _TAG.match(text, less)
            if m is None:
                if re.match(r"</?[a-zA-Z]", text[less : less + 3]) and text.find(">", less) < 0:  # cut off inside a tag
                    say(at, less)
                    at = size
                    break
                say(at, less + 1)
                at = less + 1
                continue
            say(at, less)
            at = m.end()
            ending, tag, attributes = m.groups()
            if tag is None:
                continue
            tag = tag.lower()
            if ending:
                if tag == "br":
                    pieces.append((nodes[-1], " "))
                if not open_[tag] or tag in ("html", "body"):
                    continue
                inline = tag in INLINE
                for k in range(len(tags) - 1, 0, -1):
                    if tags[k] == tag:
                        pop(k)
                        break
                    if tags[k] not in INLINE if inline else tags[k] in SCOPES:
                        break
                continue
            if tag in CLOSES_P:
                close(frozenset(["p"]), SCOPES)
            if tag in SIBLINGS:
                close(*SIBLINGS[tag])
            if tag in HEADINGS and tags[-1] in HEADINGS:
                pop(len(tags) - 1)
            if tag == "a":
                close(frozenset("a"), SCOPES)
            if tag not in INLINE:
                pieces.append((nodes[-1], " "))
            if tag in VOID:
                continue
            style = styles.get((tag, attributes))
            if style is None:
                if len(styles) > 50_000:
                    styles.clear()
                style = styles[tag, attributes] = Style(tag, attributes.rstrip("/") if attributes.endswith("/") else attributes)
            if tag in RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(text, at)
                at = end.start() if end else size
                if tag in UNSEEN:
                    at = (text.find(">", at) + 1 or size) if end else size
                    continue
            node = nodes[-1]
            if not style.inner:
                above = self.path[node]
                path = paths.get((above, style.key))
                if path is None:
                    if len(paths) > 200_000:
                        paths.clear()
                    path = paths[above, style.key] = xxhash.xxh64_intdigest(f"{above} {style.key}".encode("utf-8", "surrogatepass"))
                node = len(self.parent)
                self.parent.append(nodes[-1])
                self.style.append(style)
                self.path.append(path)
                self.tag.append(tag)
            tags.append(tag)
            nodes.append(node)
            open_[tag] += 1
            links += tag == "a"
        say(at, size)
        pop(1)

    def branches(self) -> tuple[list[int], list[int], list[bool]]:
        """For each element: hash of its branch's text, hash of its children's styles, whether the branch has text."""
        n = len(self.parent)
        content, shape, any_ = [0] * n, [0] * n, [False] * n
        said: dict[int, list[str]] = {}
        for node, piece in self.pieces:
            said.setdefault(node, []).append(piece)
        for node, pieces in said.items():
            words = "".join(pieces).split()
            if words:
                content[node], any_[node] = xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")), True
        for i in range(n - 1, 0, -1):  # children come after their parents
            p = self.parent[i]
            content[p] = (content[p] * 0x9E3779B97F4A7C15 + content[i] + 1) & _MASK
            shape[p] = (shape[p] * 0x9E3779B97F4A7C15 + self.path[i]) & _MASK
            any_[p] = any_[p] or any_[i]
        return content, shape, any_

    def own_presentation(self) -> list[bool]:
        """Elements that the tree judges: all outside articles, and those with a name inside."""
        inside, out = [False] * len(self.parent), [False] * len(self.parent)
        for i in range(1, len(self.parent)):
            s = self.style[i]
            inside[i] = inside[self.parent[i]] or s.article or s.main
            out[i] = not (s.article or s.main or self.tag[i] in ("html", "body")) and (s.named or not inside[i])
        return out

    def text(self, low: set[int], labels: bool = True) -> str:
        """The text of the branches that stay. ``low``: elements of low importance."""
        n, style, parent = len(self.parent), self.style, self.parent
        holds, article, main = [False] * n, False, False
        gone = [False] * n
        if labels:
            for i in range(1, n):
                gone[i] = gone[parent[i]] or style[i].unseen
            for i in range(n - 1, 0, -1):  # a wrapper of the article is no chrome, whatever its name
                mine = (style[i].article or style[i].main) and not gone[i]
                holds[parent[i]] = holds[parent[i]] or holds[i] or mine
                article, main = article or style[i].article and not gone[i], main or style[i].main and not gone[i]
            links = self._link_lists()
        inside, kept, header = [False] * n, [True] * n, [False] * n
        for i in range(1, n):
            s, p = style[i], parent[i]
            inside[i] = inside[p] or (s.article if article else s.main)
            header[i] = header[p] or s.header and labels and not holds[i]
            kept[i] = kept[p] and not s.unseen and not (i in low and not holds[i])
            if labels and kept[i] and not holds[i]:
                kept[i] = not s.chrome and not (header[i] and not inside[i]) and not (i in links and not inside[i])
        out = []
        for node, piece in self.pieces:
            if piece == " ":
                out.append(piece)
            elif kept[node] and (inside[node] or not (labels and (article or main))) and not (header[node] and not self._heading(node)):
                out.append(piece)
        return " ".join("".join(out).split())

    def _heading(self, node: int) -> bool:
        """Of an article's own header, headings are text."""
        while node > 0 and not self.style[node].header:
            if self.tag[node] in HEADINGS:
                return True
            node = self.parent[node]
        return self.tag[node] in HEADINGS

    def _link_lists(self) -> set[int]:
        """Lists of at least three links and nothing else."""
        n = len(self.parent)
        whole, linked, many = [0] * n, [0] * n, [0] * n
        inside = set(self.linked)
        for k, (node, piece) in enumerate(self.pieces):
            size = len(piece) - piece.count(" ")
            whole[node] += size
            if k in inside and size:
                linked[node] += size
                many[node] += 1
        for i in range(n - 1, 0, -1):
            for sums in (whole, linked, many):
                sums[self.parent[i]] += sums[i]
        return {i for i in range(1, n) if self.tag[i] in ("ul", "ol", "dl", "table", "div", "section") and many[i] > 2 and linked[i] == whole[i]}


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _keys(host: int, paths: np.ndarray) -> np.ndarray:
    """64-bit keys of (host, path)."""
    with np.errstate(over="ignore"):
        return kit.mix(paths ^ kit.mix(np.full(len(paths), host, np.uint64)))


def _pages(batch: pa.RecordBatch, styles: dict, paths: dict) -> Iterator[tuple[int, Page]]:
    """Each page of a batch with its host's hash. Pages become strings one at a time."""
    for url, text in zip(batch.column("url"), batch.column("html"), strict=True):
        yield xxhash.xxh64_intdigest(host_of(url.as_py())), Page(text.as_py() or "", styles, paths)


def style_counts(pages: DataFrame) -> DataFrame:
    """(key, path, kind, value, n): how often a node of a host's tree has each presentation (kind 0) and content (kind 1)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        styles, paths = {}, {}
        names = ["key", "path", "kind", "value"]

        def rows(held: list[np.ndarray]) -> pa.RecordBatch:
            key, path, shape, content = np.concatenate(held, axis=1).view(np.int64)
            kind = np.repeat(np.array([0, 1], np.int32), len(key))
            return pa.record_batch([pa.array(x) for x in (np.tile(key, 2), np.tile(path, 2), kind, np.r_[shape, content])], names)

        for b in batches:
            held, many = [], 0
            for host, page in _pages(b, styles, paths):
                content, shape, any_ = page.branches()
                own = page.own_presentation()
                at = [i for i in range(1, len(own)) if own[i] and any_[i]]
                if at:
                    path, shapes, contents = (np.array([x[i] for i in at], np.uint64) for x in (page.path, shape, content))
                    held.append(np.stack([_keys(host, path), path, shapes, contents]))
                    many += len(at)
                if many > 1 << 17:
                    yield rows(held)
                    held, many = [], 0
            if held:
                yield rows(held)

    read = pages.select(F.col("url").cast("string"), F.col("html").cast("string"))
    found = read.transform(kit.mapping, work, "key long, path long, kind int, value long")
    return found.groupBy("key", "path", "kind", "value").agg(F.count("*").alias("n"))


def importance(counts: DataFrame) -> DataFrame:
    """(key, path, importance) of every node of every host's tree."""

    def entropies(df: DataFrame, *by: str) -> DataFrame:
        """Normalised entropies of presentation and content of a node, and its occurrences."""
        each = df.groupBy(*by, "kind").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("s"))
        share = F.when(F.col("n") > 1, 1 - F.col("s") / (F.col("n") * F.log(F.greatest("n", F.lit(2))))).otherwise(1.0)
        weighed = share * F.when(F.col("kind") == 0, PRESENTATION).otherwise(1 - PRESENTATION)
        return each.groupBy(*by).agg(F.sum(weighed).alias("e"), F.max("n").alias("n"))

    def blend(n: Column, e: Column, other: Column) -> Column:
        return ((n - 1) * e + BLEND * other) / (n - 1 + BLEND)

    web = entropies(counts.groupBy("path", "kind", "value").agg(F.sum("n").alias("n")), "path")
    web = web.select("path", blend(F.col("n"), F.col("e"), F.lit(1.0)).alias("web"))
    return entropies(counts, "key", "path").join(web, "path").select("key", "path", blend(F.col("n"), F.col("e"), F.col("web")).alias("importance"))


class Shards:
    """Files of sorted keys by their leading bits; a look-up reads what it compares."""

    def __init__(self, bits: int, found: list[tuple[int, str, int]]):
        self.bits, self.found = bits, {s: (uri, n) for s, uri, n in found}
        self._open: dict[int, object] = {}

    @classmethod
    def write(cls, keys: DataFrame) -> Shards:
        """``keys``: a column of distinct longs."""
        bits = max(0, (-(-keys.count() // SHARD_KEYS) - 1).bit_length())
        root = f"{kit.shared_dir(keys.sparkSession)}/style-keys-{uuid.uuid4().hex}"

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [kit.ints(b.column("key"), 0).view(np.uint64) for b in batches if b.num_rows]
            if not held:
                return
            keys = np.sort(np.concatenate(held))
            for shard in np.unique(keys >> np.uint64(64 - bits)) if bits else [0]:
                mine = keys[keys >> np.uint64(64 - bits) == shard] if bits else keys
                uri = f"{root}/{uuid.uuid4().hex}"
                kit.put_file(uri, mine.astype("<u8").tobytes())
                yield pa.record_batch([pa.array([int(shard)]), pa.array([uri]), pa.array([len(mine)])], ["shard", "uri", "n"])

        shard = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0)
        dealt = keys.select("key").repartition(1 << bits, shard)
        names = kit.written(dealt.transform(kit.mapping, work, "shard long, uri string, n long"), "style-key-names")
        return cls(bits, [(r.shard, r.uri, r.n) for r in names.collect()])  # a row for a million keys

    def have(self, keys: np.ndarray) -> np.ndarray:
        """Which keys are there."""
        out = np.zeros(len(keys), bool)
        shard = keys >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(keys), np.uint64)
        for s in np.unique(shard).tolist():
            if s not in self.found:
                continue
            uri, n = self.found[s]
            if s not in self._open:
                self._open[s] = kit.map_file(uri, "<u8", 0, n)
            rows = np.flatnonzero(shard == np.uint64(s))
            at = np.minimum(kit.search_sorted(self._open[s], n, keys[rows]), n - 1)
            out[rows] = self._open[s].take(at) == keys[rows]
        return out


def extract(pages: DataFrame, labels: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html). Without ``labels`` the style tree decides alone."""
    kit.bound_batches(pages.sparkSession)
    counts = kit.written(style_counts(pages), "style-counts")
    low = kit.written(importance(counts).where(F.col("importance") < LEAST_IMPORTANCE).select("key"), "style-low")
    shards = Shards.write(low)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        styles, paths = {}, {}
        for b in batches:
            texts: list[str] = []
            first, held = 0, 0
            for host, page in _pages(b, styles, paths):
                own = [i for i, x in enumerate(page.own_presentation()) if x]
                found = shards.have(_keys(host, np.array([page.path[i] for i in own], np.uint64)))
                texts.append(page.text({i for i, x in zip(own, found.tolist(), strict=True) if x}, labels))
                held += len(texts[-1])
                if held > 4 << 20 or first + len(texts) == b.num_rows:
                    of = b.slice(first, len(texts))
                    sizes = pa.array([len(t) for t in texts], pa.int64())
                    yield pa.record_batch([of.column("page_id"), of.column("url"), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])
                    first, held, texts = first + len(texts), 0, []

    read = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return read.transform(kit.mapping, work, "page_id long, url string, text string, n_chars long")
