"""Main text of HTML pages by a tree-structured graphical model.

Each element is a binary variable: article or not.  An element's potential comes from its tag, its class, id and role names and
its text; the potential of an element and its parent from their kinds.  The graph is the DOM tree, so one upward and one
downward sweep of sum-product messages give exact marginals.  Weights maximise the likelihood of labelled pages, whose
gradient is made of the same marginals.  Sweeps go level by level over all pages of a batch at once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounds, slices
from .html_pages import MARKS, labelled

#: Fixed values of HTML: elements without content, without text of the page, within lines, and what ends an open <p>.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg math iframe object audio video canvas select option optgroup textarea button datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr nobr ruby rt rp".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
TAGS = "html body main article section div nav header footer aside form ul ol li p h1 h2 h3 h4 h5 h6 a b span blockquote pre table tr td th figure figcaption label button input ins dl dt dd img".split()
KINDS = {**{t: 1 for t in INLINE}, **{t: 2 for t in "p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote table tr td th figure figcaption tbody thead".split()}, **{t: 3 for t in "nav header footer aside form".split()}, "main": 4, "article": 4}
N_KINDS = 5


#: Fixed value: start tags that may stand in a head; any other one ends it.
HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())


#: Fixed value: styles under which nothing is shown.
UNSEEN = re.compile(r"(?i)(^|;)\s*(display\s*:\s*none|visibility\s*:\s*hidden)").search
#: Fixed value: how markup begins that a page's end cuts off.
OPEN_MARKUP = re.compile(r"<[!?/a-zA-Z]").match
MARKED = frozenset(m.lower() for m in MARKS)
FIGURES = 9
"""Features of an element's text, after those of tags and names."""


class Tree(HTMLParser):
    """Elements of a page in order: tag, parent, names; and the texts with their element, -1 where a block begins or ends."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.names, self.labels = ["#"], [-1], [""], [1]
        self.texts: list[tuple[int, str]] = []
        self.unseen: set[int] = set()
        """Elements that the page itself hides."""
        self.open = [0]
        self.depths: dict[str, list[int]] = {}
        """Where in `open` the elements of a tag are."""

    def _close(self, tags: set | frozenset, stop: set | frozenset) -> None:
        """Close the innermost open element of `tags`, and all within it, unless one of `stop` is nearer."""
        nearest = lambda kinds: max((self.depths[t][-1] for t in kinds if self.depths.get(t)), default=0)
        at = nearest(tags)
        if at and at > nearest(stop - tags):
            for e in self.open[at:]:
                self.depths[self.tags[e]].pop()
            del self.open[at:]

    def parse_html_declaration(self, i: int) -> int:
        """A declaration that is none is a comment, as in browsers."""
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in HEAD:
            self._close({"head"}, {"template"})
        if tag in ENDS_P:
            self._close({"p"}, {"table", "td", "th", "button", "object", "li", "div", "article", "section"})
        if tag in ENDS:
            self._close(*ENDS[tag])
        if tag not in INLINE and tag not in SILENT:
            self.texts.append((-1, ""))
        names, label, unseen = "", -1, False
        for k, v in attrs:
            unseen = unseen or k == "hidden" or k == "style" and bool(v and UNSEEN(v))
            if k in ("class", "id", "role", "aria-label") and v:
                names += " " + v
            elif k == "data-label" and v in ("0", "1"):
                label = int(v)
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        self.names.append(names)
        self.labels.append(label)
        if unseen:
            self.unseen.add(len(self.tags) - 1)
        if tag not in VOID:
            self.depths.setdefault(tag, []).append(len(self.open))
            self.open.append(len(self.tags) - 1)
        elif tag == "br":
            self.texts.append((self.open[-1], " "))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "path", "circle", "rect") and self.tags[self.open[-1]] == tag:
            self._close({tag}, frozenset())

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID:
            self._close({tag}, frozenset())
        if tag not in INLINE and tag not in SILENT:
            self.texts.append((-1, ""))

    def handle_data(self, data: str) -> None:
        self.texts.append((self.open[-1], data))


def parse(html: str) -> Tree:
    tree = Tree()
    tree.feed(html)
    if OPEN_MARKUP(tree.rawdata):  # a comment, declaration or tag without an end is no text
        tree.rawdata = ""
    tree.close()
    return tree


@dataclass(frozen=True)
class Settings:
    pages: int = 500
    seed: int = 5
    steps: int = 600
    rate: float = 0.3
    decay: float = 1e-4


def _names(text: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", text).lower())


class Model:
    def __init__(self, names: list[str]):
        self.tag = {t: i for i, t in enumerate(TAGS)}
        self.name = {w: len(TAGS) + 1 + i for i, w in enumerate(names)}
        self.rest = len(TAGS) + 1 + len(names)
        self.unary = np.zeros(self.rest + FIGURES)
        self.pair = np.zeros((N_KINDS * N_KINDS, 2, 2))
        self.cache: dict[tuple[str, str], list[int]] = {}

    def _static(self, tag: str, names: str) -> list[int]:
        found = self.cache.get((tag, names))
        if found is None:
            if len(self.cache) > 50_000:
                self.cache.clear()
            known = {self.name[w] for w in _names(names) if w in self.name}
            # A box whose names say nothing has a feature of its own.
            found = self.cache[tag, names] = [self.tag.get(tag, len(TAGS)), *(known or ([self.rest + 7] if tag in ("div", "section") else []))]
        return found

    def forest(self, trees: list[Tree]) -> tuple:
        """Arrays of all trees: features (element, feature), parents, kinds of edges, levels from the roots."""
        at = bounds(len(t.tags) for t in trees)
        parent = np.fromiter((p + a if p >= 0 else -1 for t, a in zip(trees, at) for p in t.parents), np.int64, at[-1])
        static = [self._static(g, n) for t in trees for g, n in zip(t.tags, t.names)]
        node = np.repeat(np.arange(at[-1]), np.fromiter(map(len, static), np.int64, at[-1]))
        feature = np.fromiter((f for s in static for f in s), np.int64, len(node))
        chars, linked, marked = np.zeros(at[-1]), np.zeros(at[-1]), []
        tags = [g for t in trees for g in t.tags]
        link = np.fromiter((g == "a" for g in tags), bool, at[-1])
        depth = np.zeros(at[-1], np.int64)
        for k in range(at[-1]):  # parents come first
            if parent[k] >= 0:
                depth[k] = depth[parent[k]] + 1
                link[k] |= link[parent[k]]
        for t, a in zip(trees, at):
            for e, text in t.texts:
                if e >= 0 and t.tags[e] not in SILENT:
                    chars[a + e] += len(text)
                    if len(text) < 40 and text.strip().lower() in MARKED:
                        marked.append(a + e)
        linked[:] = np.where(link, chars, 0)
        levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth)))[1:-1]
        for level in reversed(levels):
            np.add.at(chars, parent[level], chars[level])
            np.add.at(linked, parent[level], linked[level])
        share = linked / np.maximum(1, chars)
        bucket = np.select([chars == 0, share > 0.6, share > 0.25, chars < 25, chars < 100, chars < 400], range(6), 6)
        node = np.concatenate((node, np.arange(at[-1]), np.array(marked, np.int64)))
        feature = np.concatenate((feature, self.rest + bucket, np.full(len(marked), self.rest + 8)))
        kind = np.fromiter((KINDS.get(g, 0) for g in tags), np.int64, at[-1])
        return at, parent, node, feature, kind[parent] * N_KINDS + kind, levels

    def marginals(self, forest: tuple) -> tuple[np.ndarray, np.ndarray]:
        """P(article) of each element, and the joint of each element with its parent."""
        at, parent, node, feature, edge, levels = forest
        own = np.zeros((at[-1], 2))
        own[:, 1] = np.bincount(node, self.unary[feature], at[-1])
        up = np.zeros_like(own)
        pair = self.pair[edge]
        for level in reversed(levels):  # messages to the parents
            m = np.logaddexp(pair[level, :, 0] + own[level, None, 0], pair[level, :, 1] + own[level, None, 1])
            m -= m.max(1, keepdims=True)
            up[level] = m
            np.add.at(own, parent[level], m)
        joint = np.zeros((at[-1], 2, 2))
        for level in levels:  # and back
            above = own[parent[level]] - up[level]
            j = pair[level] + above[:, :, None] + own[level][:, None, :]
            down = np.logaddexp(pair[level][:, 0] + above[:, :1], pair[level][:, 1] + above[:, 1:])
            own[level] += down - down.max(1, keepdims=True)
            j = np.exp(j - j.max((1, 2), keepdims=True))
            joint[level] = j / j.sum((1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(own[:, 0] - own[:, 1], -500, 500))), joint

    def fit(self, trees: list[Tree], s: Settings) -> Model:
        forest = self.forest(trees)
        at, parent, node, feature, edge, levels = forest
        y = np.array([v for t in trees for v in t.labels])
        y = np.where(y < 0, 1, y)
        inner = np.flatnonzero(parent >= 0)
        true = np.zeros((at[-1], 2, 2))
        true[inner, y[parent[inner]], y[inner]] = 1
        adapt = [np.full_like(self.unary, 1e-8), np.full_like(self.pair, 1e-8)]
        for _ in range(s.steps):
            p, joint = self.marginals(forest)
            g = [np.bincount(feature, (y - p)[node], len(self.unary)) / len(trees) - s.decay * self.unary, np.zeros_like(self.pair)]
            np.add.at(g[1], edge[inner], (true - joint)[inner] / len(trees))
            g[1] -= s.decay * self.pair
            for w, d, a in zip((self.unary, self.pair), g, adapt):
                a += d * d
                w += s.rate * d / np.sqrt(a)
        return self


WEIGHTS = Path(__file__).with_name("html_weights.json")
"""What trained() gives with default settings; `python -m webgauge.llm.html_extract` writes it."""


@lru_cache(4)
def loaded(path: Path = WEIGHTS) -> Model:
    known = json.loads(path.read_text())
    model = Model(known["names"])
    model.unary, model.pair = np.array(known["unary"]), np.array(known["pair"]).reshape(model.pair.shape)
    return model


@lru_cache(4)
def trained(s: Settings = Settings()) -> Model:
    trees = [parse(page) for page in labelled(s.pages, s.seed)]
    names = sorted({w for t in trees for n in t.names for w in _names(n)})
    return Model(names).fit(trees, s)


def text_of(tree: Tree, article: np.ndarray) -> str:
    """The article's blocks.  A text within a line goes with the block around it."""
    n = len(tree.tags)
    block, silent = list(range(n)), [False] * n
    for k in range(1, n):
        p = tree.parents[k]
        silent[k] = silent[p] or tree.tags[k] in SILENT or k in tree.unseen
        if tree.tags[k] in INLINE:
            block[k] = block[p]
    out, held = [], []
    for e, text in tree.texts:
        if e < 0:
            out.append("".join(held))
            held = []
        elif not silent[e] and article[block[e]]:
            held.append(text)
    out.append("".join(held))
    return "\n".join(x for x in (" ".join(x.split()) for x in out) if x)


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: list[str] = [], settings: Settings | None = None) -> DataFrame:
    """Each row's id, and the columns to `keep`, with the text of its article.  An article's own head belongs to it; a page's doesn't.

    settings: train anew with these; else the weights of the file count, which come from the default ones.  What the page hides by `hidden` or its own style is
    no text, nor is a comment, declaration or tag that the page's end cuts off.  A null, empty or blank page, and one without an article, has the empty text.  Broken markup is read as far as it goes: open
    elements end where HTML lets them, at the page's end at last.  Pages of any length are read whole; repeated rows give
    a row each.
    """
    model = trained(settings) if settings else loaded()
    sent = df.sparkSession.sparkContext.broadcast((model.unary, model.pair, list(model.name)))  # some hundred numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unary, pair, names = sent.value
        m = Model(names)
        m.unary, m.pair = unary, pair
        for batch in slices(batches, "html", 1 << 20):
            trees = [parse(h or "") for h in batch.column("html").to_pylist()]
            p, _ = m.marginals(forest := m.forest(trees))
            at = forest[0]
            texts = [text_of(t, p[a:b] >= 0.5) for t, a, b in zip(trees, at, at[1:])]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in own} | {"out": pa.array(texts, pa.string())})

    own = [f"keep_{k}" for k in range(len(keep) + 1)]
    kept = [df[c].alias(o) for c, o in zip([id_col, *keep], own)]
    schema = ", ".join(f"{o} {df.schema[c].dataType.simpleString()}" for c, o in zip([id_col, *keep], own))
    made = df.select(*kept, df[html_col].alias("html")).mapInArrow(run, f"{schema}, out string")
    return made.select(*(F.col(o).alias(c) for c, o in zip([id_col, *keep], own)), F.col("out").alias("text"))


if __name__ == "__main__":
    made = trained()
    WEIGHTS.write_text(json.dumps({"names": list(made.name), "unary": [round(float(x), 6) for x in made.unary], "pair": [round(float(x), 6) for x in made.pair.reshape(-1)]}) + "\n")
