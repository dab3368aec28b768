"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

Each element gets features of itself (tag, attribute tokens, depth, text and link density of its
subtree, its siblings, its place in the page) and of what it stands in. The trees give each
element the log odds of being main text. Decoding takes the most likely labelling in
which nothing stands inside a dropped element: bottom-up, an element is kept if its own odds and
the best of its children beat dropping the whole subtree.

There are no hand labels. A bounded sample of pages (FIT_PAGES, by a hash of the id) is labelled by what
tags and attributes say of themselves, and again after known page furniture (side columns,
notices, forms, comments, with text of the page) was put into it and
semantic tags were swapped for plain ones, so that the trees learn shapes and not just names.

Blocks are runs of text between block-level tags. White space inside a block becomes one space; blocks
are joined by an empty line.

Defined cases: null and empty html give an empty text; html without tags is one block; unclosed,
misnested and deeply nested tags are read leniently (depth is followed without recursion);
repeated rows get the same result; an empty table fits nothing and has no rows. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtally.llm.boosting import Boosted

FIT_PAGES = 120

# Fixed values of HTML: tags without content, tags whose content is raw, tags that break the line.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes plaintext iframe noscript template".split())
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
             "strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
# Tags and words in attributes that name page furniture or main text.
FURNITURE_TAGS = set("nav aside footer form script style head button select option input textarea noscript template "
                     "iframe svg canvas dialog menu title object".split())
FURNITURE_WORDS = set(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "menubar breadcrumb breadcrumbs footer header masthead topbar toolbar sidebar side aside widget related recommended "
    "cookie cookies consent notice notices alert popup modal overlay subscribe subscription newsletter signup login "
    "search share sharing social comment comments reply replies disqus respond discussion pagination pager skip legal "
    "copyright gdpr privacy form complementary contentinfo".split())
MAIN_WORDS = set("article content main post entry body story text maincontent".split())
_SPECIAL = re.compile(r"[>\"']")
_NAME = re.compile(r"[^\s/>]*+")
_ATTR = re.compile(r"""(?<![^\s=/>"'])([^\s=/>"']++)\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]+)""")
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def _tags(text: str) -> Iterator[tuple[int, str | None, bool, str, str]]:
    """Marks of a page in order: ``start, end, content, closing, name, attributes``; sent the place to go on from.

    A tag ends at the first > outside quotes; one that never does is text. Where tags end is worked out from
    the right for all quotes at once, so broken pages of any length take linear time. ``content`` is that of
    a character-data section; comments and declarations have neither content nor name.
    """
    places = [m.start() for m in _SPECIAL.finditer(text)]
    ends, later = [-1] * (len(places) + 1), {}
    for i in range(len(places) - 1, -1, -1):
        c = text[places[i]]
        ends[i] = places[i] + 1 if c == ">" else ends[later[c] + 1] if c in later else -1
        later[c] = i
    last_end, last_data = text.rfind(">"), text.rfind("]]>")
    name_from, name_to = 0, 0
    at = text.find("<")
    while at >= 0:
        end, content, closing, name, attributes = -1, None, False, "", ""
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            end = len(text) if end < 0 else end + 3
        elif text.startswith("<![CDATA[", at) and last_data >= at + 9:
            stop = text.find("]]>", at + 9)
            end, content = stop + 3, text[at + 9:stop]
        elif text.startswith(("<!", "<?"), at):
            end = text.find(">", at + 2) + 1 if last_end >= at + 2 else -1
        else:
            closing = text.startswith("</", at)
            first = at + 1 + closing
            if first < len(text) and text[first].isascii() and text[first].isalpha():
                if not name_from <= first < name_to:
                    name_from, name_to = first, _NAME.match(text, first).end()
                end = ends[bisect_left(places, name_to)]
                if end >= 0:
                    name, attributes = text[first:name_to], text[name_to:end - 1]
        if end >= 0:
            to = yield at, end, content, closing, name, attributes
            at = text.find("<", end if to is None else to)
        else:
            at = text.find("<", at + 1)


class Page:
    """Elements of a page in document order and its text runs with the element each stands in."""

    def __init__(self, html: str | None) -> None:
        self.tag, self.parent, self.attrs = ["#root"], [-1], [frozenset()]
        self.runs: list[tuple[int, str]] = []  # (element, text); "" marks a block break
        self._stack, self._open = [0], Counter()
        at, text = 0, html or ""
        marks = _tags(text)
        mark = next(marks, None)
        while mark is not None:
            start, end, content, closing, name, attributes = mark
            self._data(text[at:start])
            at = end
            if content is not None:
                self._data(content)
            if closing and name:
                self._close(name.lower())
            elif name:
                at = self._element(name.lower(), attributes, text, at)
            try:
                mark = marks.send(at)
            except StopIteration:
                break
        self._data(text[at:])

    def _data(self, s: str) -> None:
        if s:
            self.runs.append((self._stack[-1], entities.unescape(s)))

    def _leave(self, depth: int) -> None:
        for n in self._stack[depth:]:
            self._open[self.tag[n]] -= 1
            if self.tag[n] not in INLINE:
                self.runs.append((self.parent[n], ""))
        del self._stack[depth:]

    def _close(self, tag: str) -> None:
        if self._open[tag] > 0:
            d = len(self._stack) - 1
            while self.tag[self._stack[d]] != tag:
                d -= 1
            self._leave(d)

    def _element(self, tag: str, attributes: str, text: str, at: int) -> int:
        """Enter an element; returns the place to go on from, behind the content of raw elements."""
        stack = self._stack
        if tag not in INLINE:  # a block ends an open paragraph; items end the item before
            for d in range(len(stack) - 1, 0, -1):
                above = self.tag[stack[d]]
                if above == "p" or above in CLOSES.get(tag, ()):
                    self._leave(d)
                    break
                if above not in INLINE:
                    break
            self.runs.append((stack[-1], ""))
        self.tag.append(tag)
        self.parent.append(stack[-1])
        self.attrs.append(self._attribute_words(attributes) if attributes else frozenset())
        if tag == "br":
            self.runs.append((stack[-1], " "))
        if tag in VOID or attributes.rstrip().endswith("/") and tag in ("svg", "path", "use", "rect", "circle"):
            return at
        stack.append(len(self.tag) - 1)
        self._open[tag] += 1
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            stop = end.start() if end else len(text)
            if text[at:stop].strip():
                self.runs.append((stack[-1], text[at:stop]))
            at = end.end() if end else len(text)
            self._leave(len(stack) - 1)
        return at

    @staticmethod
    def _attribute_words(raw: str) -> frozenset[str]:
        out: set[str] = set()
        for k, v in _ATTR.findall(raw):
            if k.lower() in ("class", "id", "role", "itemprop", "aria-label", "data-role"):
                out.update(_PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower()))
        return frozenset(out)

    def blocks(self, keep: np.ndarray) -> list[str]:
        out, now = [], []
        for n, s in self.runs:
            if s == "" or not keep[n]:
                if now and (s == "" or self.tag[n] not in INLINE):
                    out.append("".join(now))
                    now = []
            else:
                now.append(s)
        out.append("".join(now))
        return [b for b in (_SPACE.sub(" ", x).strip() for x in out) if b]

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = np.array(self.parent)
        own, links, raw = np.zeros(n), np.zeros(n), np.zeros(n)
        marks = np.zeros(n)
        for at, s in self.runs:
            k = len(s.strip())
            own[at] += k
            marks[at] += s.count(".") + s.count(",") if k else 0
        text, nodes, stops = own.copy(), np.ones(n), marks.copy()
        tags = self.tag
        bad_tag = np.array([t in FURNITURE_TAGS for t in tags], float)
        bad_word = np.array([bool(a) and not FURNITURE_WORDS.isdisjoint(a) for a in self.attrs], float)
        good_word = np.array([t in ("article", "main") or (bool(a) and not MAIN_WORDS.isdisjoint(a))
                              for t, a in zip(tags, self.attrs)], float)
        is_link = np.array([t == "a" for t in tags])
        paras = np.array([t == "p" for t in tags], float)
        heads = np.array([len(t) == 2 and t[0] == "h" and t[1].isdigit() for t in tags], float)
        items = np.array([t in ("li", "dt", "dd", "td", "th") for t in tags], float)
        inputs = np.array([t in ("input", "button", "select", "textarea", "label", "option") for t in tags], float)
        sums = [text, nodes, stops, links, inputs_in := inputs.copy(), paras_in := paras.copy()]
        depth = np.zeros(n)
        up_bad, up_good = np.zeros(n), np.zeros(n)
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            up_bad[i] = max(up_bad[p], bad_tag[p], bad_word[p])
            up_good[i] = max(up_good[p], good_word[p])
        kids, kid_text, kid_paras = np.zeros(n), np.zeros(n), np.zeros(n)
        for i in range(n - 1, 0, -1):
            p = parent[i]
            if is_link[i]:
                links[i] = text[i]
            for s in sums:
                s[p] += s[i]
            kids[p] += 1
            kid_text[p] += text[i]
            kid_paras[p] += paras[i]
        before = np.concatenate(([0], np.cumsum(own)[:-1]))
        whole = max(1.0, text[0])
        up = np.maximum(parent, 0)
        header = np.array([t in ("header", "hgroup") for t in tags], float)
        inline = np.array([t in INLINE for t in tags], float)
        group = np.array([t in ("div", "section", "span", "main", "article", "body", "html", "#root") for t in tags], float)
        f = [bad_tag, bad_word, good_word, up_bad, up_good, header, header[up], paras, heads, items, inline, group,
             depth, np.log1p(text), np.log1p(own), np.log1p(nodes), np.log1p(text / nodes), links / np.maximum(1, text),
             stops / np.maximum(1, text), inputs_in, np.log1p(paras_in), kids[up], kid_text[up] / np.maximum(1, kids[up]),
             kid_paras[up] / np.maximum(1, kids[up]), text / whole, before / whole, bad_word[up], good_word[up]]
        return np.stack(f, axis=1)

    def named_labels(self) -> np.ndarray:
        """1 for main text, by what tags and attributes say."""
        n = len(self.tag)
        y, inside = np.ones(n), np.zeros(n, bool)
        for i in range(1, n):
            p, t, a = self.parent[i], self.tag[i], self.attrs[i]
            inside[i] = inside[p] or t in ("article", "main")
            named = bool(a) and not FURNITURE_WORDS.isdisjoint(a) and MAIN_WORDS.isdisjoint(a)
            if y[p] == 0 or t in FURNITURE_TAGS or named or (t == "header" and not inside[i]):
                y[i] = 0
        return y


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """The most likely labels in which nothing is kept inside a dropped element."""
    n = len(page.tag)
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    kept, dropped = yes.copy(), no.copy()
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        kept[p] += max(kept[i], dropped[i])
        dropped[p] += dropped[i]
    keep = np.zeros(n, bool)
    keep[0] = True
    for i in range(1, n):
        keep[i] = keep[page.parent[i]] and kept[i] >= dropped[i]
    return keep


# Furniture that is put into sample pages: (opening tag, words of its text, closing tag).
_FURNITURE = [
    ('<div class="sidebar"><h3>', 4, "</h3><ul><li>{}</li><li>{}</li></ul></div>"), ("<aside><p>", 12, "</p><p>{}</p></aside>"),
    ('<div id="cookie-notice"><p>', 15, "</p><button>{}</button></div>"), ('<div class="notice">', 14, "</div>"),
    ('<form action="/s"><label>', 3, '</label><input name="q"><button>{}</button></form>'),
    ('<section class="comments"><h2>', 2, '</h2><div class="comment"><p>{}</p></div><div class="comment"><p>{}</p></div></section>'),
    ('<div class="newsletter"><p>', 10, '</p><form><input type="email"></form></div>'), ('<header><p>', 5, "</p></header>"),
    ('<div class="header"><span>', 4, "</span></div>"), ('<ul class="menu"><li><a href="/x">', 1, '</a></li><li><a href="/y">{}</a></li></ul>'),
    ('<div class="ad">', 9, "</div>"), ('<div class="share social"><a href="#">', 2, "</a></div>"),
    ('<div class="footer"><p>', 8, "</p></div>"), ('<div class="related"><a href="/r">', 6, "</a><a href=\"/q\">{}</a></div>"),
    ('<div role="alert">', 11, "</div>"), ('<div class="breadcrumbs"><a href="/">', 1, "</a></div>"),
    ("<div><a href='/1'>", 2, "</a> <a href='/2'>{}</a> <a href='/3'>{}</a></div>"),
]


def furnished(html: str, rng: np.random.Generator) -> str:
    """The page with more furniture in it, and with some semantic tags made plain."""
    words = re.sub(r"<[^>]*>", " ", html).split()[:4000] or ["x"]

    def some(k: int) -> str:
        at = int(rng.integers(0, max(1, len(words) - k)))
        return entities.escape(entities.unescape(" ".join(words[at:at + k])))

    places = [m.end() for m in re.finditer(r"(?i)</p>|</article>|</nav>|<body[^>]*>|</div>|</h1>", html)]
    for p in sorted(rng.choice(places, min(5, len(places)), replace=False).tolist() if places else [], reverse=True):
        head, k, tail = _FURNITURE[int(rng.integers(len(_FURNITURE)))]
        html = html[:p] + head + some(k) + re.sub(r"\{\}", lambda _: some(int(rng.integers(2, 12))), tail) + html[p:]
    swap = rng.integers(4)
    plain = {1: '<div class="content">', 2: "<main>", 3: '<div id="post">'}.get(int(swap))
    if plain:
        name = "main" if plain == "<main>" else "div"
        html = re.sub(r"(?i)<article[^>]*>", plain, html)
        html = re.sub(r"(?i)</article>", f"</{name}>", html)
    return html


def fit(pages: DataFrame, most: int = FIT_PAGES) -> Boosted | None:
    """Learn from at most ``most`` pages; tasks send numbers of elements, not texts."""
    chosen = (pages.where("html is not null").select("page_id", F.xxhash64("page_id", F.length("html")).alias("draw"))
              .orderBy("draw", "page_id").limit(most).select(F.col("page_id").alias("id2"), "draw").distinct())
    sample = pages.select("page_id", "html").join(chosen, F.col("page_id").eqNullSafe(F.col("id2"))).select("html", "draw")

    def elements(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            xs, draws = [], []
            for h, draw in zip(b.column("html").to_pylist(), b.column("draw").to_pylist()):
                rng = np.random.default_rng(draw % 2**32)
                for variant in [h, furnished(h, rng), furnished(h, rng)]:
                    page = Page(variant)
                    x = np.column_stack([page.named_labels(), page.features()])
                    rows = rng.permutation(len(x))[:400]
                    xs.append(x[rows].astype(np.float32).ravel())
                    draws.append(draw)
            yield pa.RecordBatch.from_arrays([pa.array(draws, pa.int64()), pa.array(xs, pa.list_(pa.float32()))], ["draw", "x"])

    got = sample.mapInArrow(elements, "draw long, x array<float>").toArrow()
    if not got.num_rows:
        return None
    width = Page("").features().shape[1] + 1
    ordered = sorted(range(got.num_rows), key=lambda i: (got["draw"][i].as_py(), len(got["x"][i])))
    x = np.concatenate([np.asarray(got["x"][i].values, float).reshape(-1, width) for i in ordered])
    return Boosted().fit(x[:, 1:], x[:, 0])


def main_blocks(htmls: list[str | None], model: Boosted | None) -> list[list[str]]:
    pages = [Page(h) for h in htmls]
    if model is None or not pages:
        return [p.blocks(p.named_labels() > 0) for p in pages]
    x = [p.features() for p in pages]
    odds = np.split(model.predict(np.concatenate(x)), np.cumsum([len(f) for f in x])[:-1])
    return [p.blocks(decode(p, o)) for p, o in zip(pages, odds)]


def extract(pages: DataFrame, model: Boosted | None) -> DataFrame:
    """``page_id, url, text, n_chars`` per page row."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def texts(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                out = ["\n\n".join(x) for x in main_blocks(part.column("html").to_pylist(), sent.value)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(out, pa.string()),
                     pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(
        texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def extract_main(pages: DataFrame) -> DataFrame:
    return extract(pages, fit(pages))
