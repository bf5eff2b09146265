"""Main text of pages by union-free wrappers, inferred host by host.

A page is a stream of tags and texts. Tandem repeats in it are folded into
repeated groups, inner ones first. The wrapper of a host begins as the folded
stream of one page and is aligned with the next page's in turn: what both have
is kept, texts that differ become slots, and what only one has becomes optional;
a single occurrence of a known group is folded into it. So a wrapper is a
regular expression without unions: fixed tags, text slots, optional parts and
repeated groups. Each slot is labelled main or not by where it stands (inside
the article or main element, if the host's pages have them; never in menus,
page headers, footers, sidebars, notices, adverts, forms, comments and the
like), and, where the host has no such element, by whether its text stays the same
from page to page or is mostly links.

To extract, a page's folded stream is aligned with its host's wrapper, and the
texts in main slots are its main text; parts that the wrapper does not know are
judged by where they stand in the page.

Copies of a page teach a wrapper no more than one of them. A name in class or id
counts if it is the whole of a class or its last or first word (see chrome_class).

A wrapper is fitted on the `sample_pages` pages of a host with the least hashes
of id and url, chosen with a limit per task, so a hot host is no hot task. All
pages are extracted, whole. Wrappers join pages by host; Spark broadcasts them
while they are small and splits hot hosts beyond that.

Nulls and edges: null html is empty and gives an empty text. Pages without a url
or host share a wrapper. Repeated rows are extracted alike. An empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posframe.llm.bpe import sliced
from posframe.llm.common import stored, table

SAMPLE_PAGES = 48
#: Bits of an alignment's table; a larger one is halved first.
_TABLE = 1 << 30

# Fixed values of the format: names of elements.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: An element that a new one of these names ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements whose texts are never main text, and those that are so outside an article.
CHROME = {"nav", "footer", "aside", "form", "head", "title", "button", "select", "textarea", "menu", "dialog", "svg", "object", "iframe", "canvas", "audio", "video"}
OUTER_CHROME = {"header"}
#: Words in class, id and role that say the same.
CHROME_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary",
    "consent", "contentinfo", "cookie", "cookies", "dialog", "disqus", "footer", "gdpr", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notices", "popup", "promo", "promoted", "related", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
OUTER_WORDS = {"header", "masthead", "search"}
#: First words that turn the last one around, and last words that leave the first one its meaning.
ABOUT = {"has", "have", "with", "without", "no", "non", "not", "is", "hide", "under", "below", "above", "after", "before", "beside"}
HOLDERS = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "card", "column", "container", "content", "footer", "form", "group", "head", "header", "holder", "icon", "icons",
    "inner", "item", "items", "label", "left", "link", "links", "list", "main", "message", "outer", "panel", "placeholder", "posts", "region", "right", "row", "section", "slot", "stories",
    "text", "thread", "title", "toggle", "top", "unit", "wrap", "wrapper", "zone",
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|xmp|noframes)\b[^>]*+(?:>.*?(?:</\1\s*+>|\Z)|\Z)|<(/?[a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?[a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>|([^<]++|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_WORD = re.compile(r"[a-z]+")


def chrome_class(name: str) -> set[str]:
    """The listed words that a class or id stands for: itself, the last of its words
    (site-footer, but not has-sidebar), or the first one before words that only say
    which part it is (sidebar-left, but not share-price)."""
    parts = _WORD.findall(name)
    listed = CHROME_WORDS | OUTER_WORDS
    if not parts or parts[0] in ABOUT:
        return set()
    out = {parts[-1]} & listed
    if all(x in HOLDERS or x in listed for x in parts[1:]):
        out |= {parts[0]} & listed
    return out


class Page:
    """The tokens of a page: symbols of tags and texts ("#"); of each text its
    place among the tokens, block, standing and whether it is in a link."""

    def __init__(self, source: str):
        self.symbols: list[str] = []
        self.texts: list[tuple[int, str, int, str, bool]] = []
        stack: list[tuple[str, bool, bool, bool, bool]] = []  # name, chrome, in the article or main, in a link, hidden
        block, raw, opened = 0, [], Counter()
        # where in the stack a p is open, and what keeps a block in it from closing it
        ps, guards = [], []

        def pop():
            last = stack.pop()[0]
            opened[last] -= 1
            for places in (ps, guards):
                if places and places[-1] == len(stack):
                    places.pop()
            return last

        def close(name):
            while stack and pop() != name:
                pass

        def text():
            if raw and (t := entities.unescape("".join(raw))).strip():
                _, chrome, inner, link, _ = stack[-1] if stack else ("", False, False, False, False)
                self.texts.append((len(self.symbols), t, block, "chrome" if chrome else "inner" if inner else "outer", link))
                self.symbols.append("#")
            elif raw and self.texts and self.texts[-1][2] == block:
                place, t, b, standing, link = self.texts[-1]
                self.texts[-1] = (place, t + " ", b, standing, link)
            raw.clear()

        end = source.rfind(">") + 1  # no tag ends after it
        for m in _TOKEN.finditer(source if source.rfind("<!--") >= end else source[:end]):
            if m[6] is not None:
                raw.append(m[6])
                continue
            name = (m[2] or m[4] or "").lower()
            if not name:
                continue
            if name == "br":
                raw.append("\n")
            closing, name = name[0] == "/", name.lstrip("/")
            text()
            if name in BLOCK:
                block += 1
            if closing:
                self.symbols.append("</" + name)
                if opened[name]:
                    close(name)
                continue
            words, hidden = self._words(m[3] or m[5] or "")
            self.symbols.append("<" + ".".join([name, *sorted(words & (CHROME_WORDS | OUTER_WORDS))]))
            if name in VOID:
                continue
            if name in BLOCK and name not in ("html", "body") and opened["p"]:
                if not guards or guards[-1] < ps[-1]:
                    close("p")
            if name in ENDS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ("ul", "ol", "dl", "table", "select") or stack[i][0] in BLOCK - ENDS.keys() - {"tbody", "thead", "tfoot"}:
                        break
                    if stack[i][0] in ENDS[name]:
                        while len(stack) > i:
                            pop()
                        break
            _, chrome, inner, link, _ = stack[-1] if stack else ("", False, False, False, False)
            region = name in ("article", "main") or "main" in words and name != "body"
            if region and not inner and not any(x[0] in CHROME or x[4] for x in stack):
                # the article itself: classes of what holds it say nothing about it, nor its own, but for comments
                words, chrome = words & {"comment", "comments"}, chrome and bool(words & {"comment", "comments"})
            inner = inner or region
            chrome = chrome or hidden or name in CHROME or name != "body" and name != "html" and bool(words & CHROME_WORDS) or not inner and (name in OUTER_CHROME or name not in ("body", "html") and bool(words & OUTER_WORDS))
            if name == "p":
                ps.append(len(stack))
            elif name in ("button", "table", "object"):
                guards.append(len(stack))
            stack.append((name, chrome, inner, link or name == "a", hidden))
            opened[name] += 1
        if source.rfind("<!--") < end:
            raw.append(source[end:])
        text()

    @staticmethod
    def _words(attributes: str) -> tuple[set[str], bool]:
        if not attributes.strip(" /\n\t"):
            return set(), False
        found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
        words = set().union(*(chrome_class(x) for k in ("class", "id") for x in found.get(k, "").split()))
        words.update(_WORD.findall(found.get("role", "")))
        return words, "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")


def _codes(nodes) -> tuple[np.ndarray, list[int]]:
    """Numbers of the symbols, and the distances from a symbol to where it is next."""
    number: dict[str, int] = {}
    codes = np.array([number.setdefault(n[0], len(number)) for n in nodes], dtype=np.int64)
    order = np.argsort(codes, kind="stable")
    step = np.diff(order)[codes[order][1:] == codes[order][:-1]]
    return codes, [*map(int, np.unique(step[2 * step <= len(codes)]))]


def fold(symbols: list[str], units: tuple[tuple[str, ...], ...] = ()) -> tuple[list[str], list[list[int]]]:
    """The stream with tandem repeats folded into one symbol "(a b)+", and for each
    symbol its slots, each the list of its texts' places. Known units are folded
    even where they occur once."""
    nodes = [(s, [[i]] if s == "#" else []) for i, s in enumerate(symbols)]

    def once(nodes, match):
        out, i = [], 0
        while i < len(nodes):
            size = match(nodes, i)
            if not size:
                out.append(nodes[i])
                i += 1
                continue
            unit = [n[0] for n in nodes[i : i + size]]
            slots = [list(x) for n in nodes[i : i + size] for x in n[1]]
            i += size
            while [n[0] for n in nodes[i : i + size]] == unit:
                for have, new in zip(slots, (x for n in nodes[i : i + size] for x in n[1]), strict=True):
                    have += new
                i += size
            whole = unit[0] if size == 1 and unit[0].endswith(")+") else "(" + " ".join(unit) + ")+"
            out.append((whole, slots))
        return out

    size, codes, gaps = 0, *_codes(nodes)
    while size := next((g for g in gaps if g > size), 0):
        # a unit that is repeated at once: as many equal symbols in a row at that distance
        same = codes[size:] == codes[:-size]
        runs = np.diff(np.flatnonzero(np.r_[True, ~same, True])) - 1
        if runs.max(initial=0) < size:
            continue

        def square(nodes, i, size=size):
            if i + size >= len(nodes) or nodes[i][0] != nodes[i + size][0]:
                return 0
            return size if i + 2 * size <= len(nodes) and all(nodes[i + k][0] == nodes[i + size + k][0] for k in range(size)) else 0

        nodes = once(nodes, square)
        codes, gaps = _codes(nodes)
    for unit in units:

        def known(nodes, i, unit=unit):
            return len(unit) if nodes[i][0] == unit[0] and tuple(n[0] for n in nodes[i : i + len(unit)]) == unit else 0

        nodes = once(nodes, known)
    return [n[0] for n in nodes], [n[1] for n in nodes]


def unit_of(symbol: str) -> tuple[str, ...]:
    """The symbols of a repeated group, groups in it being one symbol each."""
    out, depth, have = [], 0, []
    for part in symbol[1:-2].split(" "):
        have.append(part)
        depth += part.count("(") - part.count(")")
        if not depth:
            out.append(" ".join(have))
            have = []
    return tuple(out)


def units_in(symbols: list[str]) -> tuple[tuple[str, ...], ...]:
    """The groups of more than one symbol in a folded stream, inner ones first."""
    found: set[tuple[str, ...]] = set()

    def add(symbol):
        if symbol.startswith("("):
            unit = unit_of(symbol)
            for s in unit:
                add(s)
            if len(unit) > 1:
                found.add(unit)

    for n in symbols:
        add(n)
    return tuple(sorted(found, key=lambda u: (sum(map(len, u)), u)))


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(i, i) for i in range(head)]
    out += [(head + i, head + j) for i, j in _common(a[head : len(a) - tail], b[head : len(b) - tail])]
    return out + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """Of each beginning of a, a bit for each symbol of b: 0 where the length of the
    longest common subsequence grows."""
    mask, at = (1 << len(b)) - 1, {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    row = mask
    for x in a:
        held = row & at.get(x, 0)
        row = ((row + held) | (row - held)) & mask
        yield row


def _common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    if not x or not y:
        return []
    if len(x) * len(y) > _TABLE and len(x) > 1:
        half = len(x) // 2

        def lengths(rows):
            *_, last = rows
            bits_ = np.unpackbits(np.frombuffer(last.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
            return np.r_[0, np.cumsum(bits_ == 0)]

        cut = int(np.argmax(lengths(_rows(x[:half], y)) + lengths(_rows(x[half:][::-1], y[::-1]))[::-1]))
        return _common(x[:half], y[:cut]) + [(half + i, cut + j) for i, j in _common(x[half:], y[cut:])]
    rows, out, i, j = list(_rows(x, y)), [], len(x), len(y)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                out.append((i, j))
    return out[::-1]


def _shown(text: str) -> str:
    """A text, a long one as its beginning and a digest of the whole."""
    return text if len(text) <= 400 else f"{text[:360]} {hashlib.sha1(text.encode('utf-8', 'replace')).hexdigest()}"


class Wrapper:
    """nodes: symbols in order; optional: which may be absent; slots: for each node
    and slot [pages, pages that have it as main, as chrome, in links, the text or None]."""

    def __init__(self):
        self.pages, self.inner = 0, 0
        self.nodes: list[str] = []
        self.optional: list[bool] = []
        self.slots: list[list[list]] = []

    def units(self) -> tuple[tuple[str, ...], ...]:
        return units_in(self.nodes)

    def regroup(self, unit: tuple[str, ...]) -> None:
        """Folds the wrapper's own runs of a group that a page has shown."""
        size, i = len(unit), 0
        while i + size <= len(self.nodes):
            runs = 0
            while tuple(self.nodes[i + runs * size : i + (runs + 1) * size]) == unit:
                runs += 1
            if runs:
                end = i + runs * size
                each = [[x for own in self.slots[i + r * size : i + (r + 1) * size] for x in own] for r in range(runs)]
                whole = each[0]
                for other in each[1:]:
                    whole = [[max(x, y) for x, y in zip(a[:4], b[:4], strict=True)] + [a[4] if a[4] == b[4] else None] for a, b in zip(whole, other, strict=True)]
                self.nodes[i:end] = ["(" + " ".join(unit) + ")+"]
                self.optional[i:end] = [all(self.optional[i:end])]
                self.slots[i:end] = [whole]
            i += 1

    def learn(self, page: Page) -> None:
        known = self.units()
        for unit in units_in(fold(page.symbols, known)[0]):
            if unit not in known:
                self.regroup(unit)
        symbols, slots = fold(page.symbols, self.units())
        text = {place: x for place, *x in page.texts}

        def seen(own):
            out = []
            for tokens in own:
                own_texts = [text[t] for t in tokens]
                standing = [x[2] for x in own_texts]
                chars = [len(x[0]) for x in own_texts]
                links = sum(n for n, x in zip(chars, own_texts, strict=True) if x[3])
                out.append([1, int(standing.count("inner") * 2 > len(standing)), int(standing.count("chrome") * 2 > len(standing)), int(links * 2 > sum(chars)), _shown(" ".join(" ".join(x[0].split()) for x in own_texts))])
            return out

        pairs = align(self.nodes, symbols) if self.pages else []
        matched = dict(pairs)
        nodes, optional, merged, j = [], [], [], 0

        def rest(until):
            nonlocal j
            while j < until:
                nodes.append(symbols[j])
                optional.append(self.pages > 0)
                merged.append(seen(slots[j]))
                j += 1

        for i, symbol in enumerate(self.nodes):
            if i in matched:
                rest(matched[i])
                both = []
                for old, new in zip(self.slots[i], seen(slots[j]), strict=True):
                    both.append([x + y for x, y in zip(old[:4], new[:4], strict=True)] + [old[4] if old[4] == new[4] else None])
                nodes.append(symbol)
                optional.append(self.optional[i])
                merged.append(both)
                j += 1
            else:
                nodes.append(symbol)
                optional.append(True)
                merged.append(self.slots[i])
        rest(len(symbols))
        self.nodes, self.optional, self.slots = nodes, optional, merged
        self.pages += 1
        self.inner += any(x[3] == "inner" for x in page.texts)

    def labels(self) -> list[list[bool]]:
        """Whether each slot is main text."""
        regions = self.inner * 2 > self.pages

        def main(pages, inner, chrome, links, same):
            if chrome * 2 > pages:
                return False
            return inner * 2 >= pages if regions else not (links * 2 > pages or same is not None and pages >= 3)

        return [[main(*s) for s in own] for own in self.slots]

    def expression(self) -> str:
        """The wrapper as a regular expression over tags, texts and slots."""
        out = []
        for n, o, own in zip(self.nodes, self.optional, self.slots, strict=True):
            shown = n if n != "#" else repr(own[0][4]) if own[0][4] is not None and self.pages > 1 else "#PCDATA"
            out.append(f"({shown})?" if o else shown)
        return " ".join(out)

    def dumps(self) -> str:
        return json.dumps([self.nodes, self.labels(), self.inner * 2 > self.pages, self.units()])


class Extractor:
    """A wrapper as pages need it, with the alignments of tag streams it has met."""

    def __init__(self, dumped: str | None):
        self.nodes, self.labels, self.regions, units = json.loads(dumped) if dumped else ([], [], False, [])
        self.units = tuple(tuple(u) for u in units)
        self.met: dict[tuple[str, ...], tuple[list, dict[int, int]]] = {}

    def text(self, source: str) -> str:
        page = Page(source)
        key = tuple(page.symbols)
        if (met := self.met.get(key)) is None:
            symbols, slots = fold(page.symbols, self.units)
            met = slots, {j: i for i, j in align(self.nodes, symbols)}
            if len(self.met) < 1024 and len(key) < 1000:
                self.met[key] = met
        slots, matched = met
        regions = any(x[3] == "inner" for x in page.texts)
        label: dict[int, bool] = {}
        for j, own in enumerate(slots):
            known = self.labels[matched[j]] if j in matched else None
            for k, tokens in enumerate(own):
                if known is not None:
                    label.update(dict.fromkeys(tokens, known[k]))
        blocks: list[tuple[int, list[str]]] = []
        for place, t, block, standing, _ in page.texts:
            here = standing == "inner" or not regions and standing == "outer"
            # a slot's label holds where the page has the regions that the wrapper has
            keep = label.get(place, here) if self.regions == regions and standing != "chrome" else here
            if keep:
                if not blocks or blocks[-1][0] != block:
                    blocks.append((block, []))
                blocks[-1][1].append(t)
        lines = (" ".join("".join(parts).split()) for _, parts in blocks)
        return "\n".join(x for x in lines if x)


def infer(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """(__host, __wrapper json) of the hosts of pages (__host, __order, __html)."""
    order = Window.partitionBy("__host").orderBy("__order")
    some = pages.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= sample_pages).drop("__n")

    def run(t: pa.Table) -> pa.Table:
        made = Wrapper()
        rows = sorted(zip(t.column("__order").to_pylist(), t.column("__html").to_pylist(), strict=True))
        for source in dict.fromkeys(source for _, source in rows):
            made.learn(Page(source))
        return pa.table({"__host": [t.column("__host")[0].as_py()], "__wrapper": [made.dumps()]})

    return some.groupBy("__host").applyInArrow(run, "__host string, __wrapper string")


def extract(pages: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] = ("page_id", "url"), sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """keep and text, a row for each of pages."""
    own = pages.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), F.lit("")).alias("__host"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("__html"))
    keys = [f"__k{i}" for i in range(len(keep))]
    wrappers = stored(infer(own.select("__host", F.xxhash64(*keys, "__html").alias("__order"), "__html"), sample_pages))
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", `text` string"

    def run(it):
        made: dict[str, Extractor] = {}
        for batch in it:
            for part in sliced(batch, 256):
                out = []
                for dumped, source in zip(part.column(len(keys)).to_pylist(), part.column(len(keys) + 1).to_pylist(), strict=True):
                    if dumped not in made:
                        if len(made) >= 256:
                            made.clear()
                        made[dumped] = Extractor(dumped)
                    out.append(made[dumped].text(source))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keys))] + [pa.array(out, pa.string())], names=[*keep, "text"])

    return own.join(wrappers, "__host", "left").select(*keys, "__wrapper", "__html").mapInArrow(run, schema)


def op8_main_text(spark, sf_dir) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
