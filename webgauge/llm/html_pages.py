"""Labelled pages to learn extraction from: layouts put together at random from parts whose label is known."""

from __future__ import annotations

from html import escape
from random import Random

#: Parts that aren't the article, as (tags, class or id names); a name is left out in some pages.
OTHER = [
    (["nav", "div", "ul", "header"], ["nav", "menu", "navbar", "main-menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc-menu", "navigation", "topnav"]),
    (["header", "div"], ["header", "site-header", "masthead", "topbar", "logo", "branding", "page-header"]),
    (["footer", "div"], ["footer", "site-footer", "copyright", "colophon", "legal", "page-footer"]),
    (["aside", "div", "section"], ["sidebar", "side", "widget", "related", "related-posts", "recommended", "trending", "popular", "more-stories", "aside"]),
    (["div", "section"], ["notice", "cookie", "cookie-banner", "consent", "gdpr", "alert", "modal", "popup", "banner", "paywall", "disclaimer"]),
    (["div", "ins", "section", "aside"], ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "ad-slot", "adbox", "promotion"]),
    (["form", "div"], ["form", "search", "newsletter", "subscribe", "signup", "login", "search-box", "contact-form"]),
    (["div", "section", "ol"], ["comments", "comment", "comment-list", "responses", "discussion", "replies", "reader-comments", "disqus", "comment-body"]),
    (["article", "li", "div"], ["comment", "review", "comment-item", "reply", "user-review", "comment-by-reader"]),
    (["div", "section"], ["reviews", "feedback", "guestbook", "opinions", "talkback", "thread", "ratings", "user-reviews"]),
    (["div", "ul"], ["share", "social", "social-links", "tags", "byline-links", "follow", "sharing"]),
]
#: What stands above or in an advert that has no name.
MARKS = ["Advertisement", "Advert", "Ad", "Ads", "Sponsored", "Sponsored content", "Promoted", "Anzeige", "Werbung", "Publicité", "Publicidad"]
PLAIN_OTHER = ["nav", "header", "footer", "aside", "form"]
MAIN = ["article", "content", "main", "post", "entry", "entry-content", "article-body", "story", "post-content", "main-content", "text", "body-text", "page"]

Node = tuple  # (tag, attributes, label, children); a child may be a text


class Pages:
    def __init__(self, seed: int):
        self.r = Random(seed)

    def words(self, a: int, b: int) -> str:
        r = self.r
        return " ".join("".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9))) for _ in range(r.randint(a, b)))

    def sentence(self, a: int, b: int) -> str:
        return self.words(a, b).capitalize() + self.r.choice([".", ".", ".", "!", "?", ""])

    def inline(self, y: int, links: float) -> list:
        r, out = self.r, []
        for _ in range(r.randint(1, 4)):
            out.append(self.sentence(3, 25) + " ")
            if r.random() < links:
                out.append((r.choice(["a", "b", "em", "strong", "span", "i", "code"]), {}, y, [self.words(1, 4)]))
        return out

    def prose(self) -> list[Node]:
        r, out = self.r, []
        if r.random() < 0.8:
            out.append((r.choice(["h1", "h1", "h2"]), {}, 1, [self.sentence(1, 12)]))
        plain = r.random() < 0.4
        for _ in range(r.choice([1, 2, 3, 5, 8, 13, 21])):
            x = r.random() * (0.68 if plain else 1)
            if x < 0.08:
                out.append(("p", {}, 1, [("b", {}, 1, [self.sentence(3, 40)]), ("br", {}, 1, [])]))
            elif x < 0.68:
                out.append(("p", {}, 1, self.inline(1, 0.3)))
            elif x < 0.76:
                out.append((r.choice(["h2", "h3", "h4"]), {}, 1, [self.sentence(1, 8)]))
            elif x < 0.84:
                out.append(self.list())
            elif x < 0.88:
                out.append(("blockquote", {}, 1, [("p", {}, 1, self.inline(1, 0.1))]))
            elif x < 0.91:
                out.append(("pre", {}, 1, [self.words(3, 20)]))
            elif x < 0.94:
                out.append(("figure", {}, 1, [("img", {}, 1, []), ("figcaption", {}, 1, [self.sentence(2, 10)])]))
            elif x < 0.97:
                out.append(("table", {}, 1, [("tr", {}, 1, [("td", {}, 1, [self.words(1, 6)]) for _ in range(3)]) for _ in range(r.randint(1, 4))]))
            else:
                out.append(("div", {}, 1, self.inline(1, 0.2)))
        return out

    def list(self, deep: int = 0) -> Node:
        r = self.r
        item = lambda: ("li", {}, 1, [*self.inline(1, 0.2), *([self.list(deep + 1)] if deep < 3 and r.random() < 0.25 else []), *([self.words(1, 6)] if r.random() < 0.2 else [])] if r.random() < 0.7 else [self.words(1, 4)])
        return (r.choice(["ul", "ol"]), {}, 1, [item() for _ in range(r.randint(1, 5))])

    def remarks(self) -> Node:
        """What readers say below an article, in boxes of any kind, with or without telling names."""
        r = self.r
        tag, name = r.choice(["article", "li", "div", "div"]), r.choice(["comment", "review", "comment-body", "reply", "user-comment", "media", "row", "item"])
        named = tag == "article" or r.random() < 0.7
        one = lambda: (tag, {"class": name} if named else {}, 0, [(r.choice(["header", "div", "p"]), {}, 0, [("span" if r.random() < 0.5 else "b", {}, 0, [self.words(1, 2)]), ("time", {}, 0, [self.words(1, 3)])]), (r.choice(["p", "div"]), {}, 0, [self.sentence(2, 40)]), *([("a", {"href": "/r"}, 0, [self.words(1, 1)])] if r.random() < 0.6 else [])])
        attrs = {r.choice(["class", "id"]): r.choice(["comments", "reviews", "discussion", "responses", "replies", "feedback"])} if not named or r.random() < 0.6 else {}
        return ("ol" if tag == "li" else r.choice(["div", "section"]), attrs, 0, [("h3", {}, 0, [self.words(1, 3)])] * r.randint(0, 1) + [one() for _ in range(r.randint(1, 5))])

    def other(self) -> Node:
        r = self.r
        if r.random() < 0.08:
            mark = r.choice(MARKS)
            return (r.choice(["div", "div", "p", "section", "span"]), {}, 0, [r.choice([mark, mark.upper()])]) if r.random() < 0.6 else ("div", {}, 0, [(r.choice(["p", "span", "div"]), {}, 0, [mark]), ("a", {"href": "/x"}, 0, [self.words(2, 8)])])
        if r.random() < 0.35:
            tag, attrs = r.choice(PLAIN_OTHER), {}
        else:
            tags, names = r.choice(OTHER)
            tag, name = r.choice(tags), r.choice(names)
            attrs = {r.choice(["class", "class", "id"]): name}
        x, kids = r.random(), []
        if r.random() < 0.08:  # a list of links without a name
            links = [(r.choice(["a", "li"]), {}, 0, [("a", {"href": "/x"}, 0, [self.words(1, 3)])]) for _ in range(r.randint(2, 8))]
            return (r.choice(["div", "ul"]), {}, 0, links)
        if x < 0.35:
            kids = [("ul", {}, 0, [("li", {}, 0, [("a", {"href": "/x"}, 0, [self.words(1, 4)])]) for _ in range(r.randint(1, 8))])]
        elif x < 0.55:
            kids = [self.sentence(2, 20)]
        elif x < 0.75:
            kids = [("h3", {}, 0, [self.words(1, 4)])] * r.randint(0, 1) + [("p", {}, 0, self.inline(0, 0.3)) for _ in range(r.randint(1, 3))]
        elif x < 0.87:
            kids = [("div", {}, 0, [("span", {}, 0, [self.words(1, 3)]), ("p", {}, 0, [self.sentence(3, 30)])]) for _ in range(r.randint(1, 4))]
        else:
            kids = [("label", {}, 0, [self.words(1, 3)]), ("input", {}, 0, []), ("button", {}, 0, [self.words(1, 2)])]
        return (tag, attrs, 0, kids)

    def page(self) -> Node:
        r = self.r
        x = r.random()
        tag = "article" if x < 0.4 else "main" if x < 0.52 else "section" if x < 0.6 else "div"
        attrs = {} if tag != "div" and r.random() < 0.6 else {r.choice(["class", "id"]): r.choice(MAIN)}
        if tag == "main" and r.random() < 0.3:
            attrs = {"role": "main"}
        if r.random() < 0.4:  # names that say nothing, as far as the model goes
            attrs = {}
        kids = self.prose() if r.random() < 0.94 else [("h1", {}, 1, [self.sentence(1, 9)])] * r.randint(0, 1) + [self.list()]
        if tag == "article" and r.random() < 0.25:  # its own head and foot
            kids = [("header", {}, 1, [("h1", {}, 1, [self.sentence(1, 12)]), *([("p", {}, 1, [self.sentence(4, 25)])] if r.random() < 0.6 else [])]), *kids]
        if tag == "article" and r.random() < 0.15:
            kids = [*kids, ("footer", {}, 0, [("a", {"href": "/t"}, 0, [self.words(1, 2)]) for _ in range(r.randint(1, 4))])]
        for _ in range(r.choice([0, 0, 1, 2])):
            kids.insert(r.randint(0, len(kids)), self.other())
        if r.random() < 0.06:  # next to nothing
            kids = [r.choice([self.list(), ("ul", {}, 1, [("li", {}, 1, [self.words(1, 1), ("ul", {}, 1, [("li", {}, 1, [self.words(1, 1)])]), self.words(1, 1)])]), ("p", {}, 1, [self.words(1, 3)])])]
            tag, attrs = r.choice([("article", {}), ("main", {}), ("article", {"class": r.choice(MAIN)})])
        main = (tag, attrs, 1, kids)
        if r.random() < 0.3:
            main = (r.choice(["div", "main", "section"]), {"class": r.choice(["container", "wrapper", "row", "layout", "page"])}, 1, [*(self.other() for _ in range(r.randint(0, 1))), main, *(self.other() for _ in range(r.randint(0, 2)))])
        if r.random() < 0.07:  # a layout by a table
            side = ("td", {}, 0, [("a", {"href": "/m"}, 0, [self.words(1, 2)]) for _ in range(r.randint(2, 8))])
            cells = [side, ("td", {}, 1, [main])]
            main = ("table", {}, 1, [("tr", {}, 1, cells if r.random() < 0.7 else cells[::-1])])
        after = [self.remarks()] if r.random() < 0.3 else []
        kids = [*(self.other() for _ in range(r.randint(0, 3))), main, *after, *(self.other() for _ in range(r.randint(0, 3)))]
        return ("html", {}, 1, [("body", {}, 1, kids)])


def markup(node: Node | str) -> str:
    if isinstance(node, str):
        return escape(node)
    tag, attrs, label, kids = node
    inside = "".join(map(markup, kids))
    return f"<{tag}{''.join(f' {k}="{v}"' for k, v in attrs.items())} data-label={label}>" + ("" if tag in ("img", "input", "br") else f"{inside}</{tag}>")


def labelled(n: int, seed: int) -> list[str]:
    """Pages whose elements carry their label in data-label."""
    pages = Pages(seed)
    return [markup(pages.page()) for _ in range(n)]
