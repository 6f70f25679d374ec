"""Labelled pages to train the block labeller on: many layouts, drawn by seed.

Every text carries one of two marks in front, by which its block is known to
belong to the article or not, whatever markup lies around it.
"""

from __future__ import annotations

import random

MAIN, REST = "\ue000", "\ue001"
#: Names that page authors give to regions, and words that stand in them.
REGIONS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topbar toolbar tabs links pagination",
    "header": "header masthead banner logo branding top site hero",
    "footer": "footer copyright legal bottom colophon sitemap foot",
    "aside": "sidebar aside widget related recommended trending popular rail secondary teaser more tags share social",
    "notice": "cookie notice consent gdpr alert message popup modal overlay disclaimer paywall warning announcement",
    "ad": "ad ads advert advertisement sponsored promo promotion banner sponsor advertising partner adsense",
    "form": "form login search signup subscribe newsletter contact register poll survey",
    "comments": "comments comment reply replies discussion responses respond disqus thread reader feedback",
    "main": "article content post entry main story body text page single prose column",
}
TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "notice": "div", "ad": "div", "form": "form", "comments": "section", "main": "article"}
WORDS = {
    "nav": "home about contact news blog shop products services help archive next previous page sport world",
    "header": "welcome daily site official online the portal",
    "footer": "copyright all rights reserved privacy policy terms of use imprint powered by contact",
    "aside": "related popular most read more recent posts tags share trending archives follow us",
    "notice": "we use cookies this site accept consent by continuing you agree privacy settings please note",
    "ad": "advertisement sponsored buy now sale off free offer discount shop today deal",
    "form": "search login name email password subscribe submit sign up your address send newsletter",
    "comments": "comments reply said says posted ago report like great thanks agree share",
}
WRAPPERS = "container wrapper row inner outer grid col wrap layout site root app block section box group".split()
NOISE = ["%%%", "&amp;", "###", "$$$", "***", "&quot;", "!!", "&eacute;", " 12", "&#8217;s"]


class Drawn:
    """One page's layout and words."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        letters = ["".join(rng.choice("bcdfghjklmnprstvwzéñüçœд") for _ in range(rng.randrange(1, 3))) + rng.choice("aeiouäáя") for _ in range(rng.randrange(12, 40))]
        self.vocabulary = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 1, 2, 2, 3, 4]))) for _ in range(120)]
        self.semantic, self.named = rng.random(), rng.choice([0.0, 0.6, 1.0, 1.0])
        self.noise = rng.choice([0, 0, 0, 0.1, 0.6])
        self.shout = rng.choice([0, 0.02, 0.2])
        self.open_ends = rng.random() < 0.15

    def words(self, n: int, kind: str | None = None) -> str:
        known = WORDS.get(kind or "", "").split()
        out = []
        for _ in range(n):
            out.append(self.rng.choice(known) if known and self.rng.random() < 0.6 else self.rng.choice(self.vocabulary))
            if self.rng.random() < self.shout:
                out[-1] = out[-1].upper()
            elif self.rng.random() < 0.1:
                out[-1] = out[-1].capitalize() + self.rng.choice(["", "", ".", ","])
            if self.noise and self.rng.random() < self.noise:
                out[-1] += self.rng.choice(NOISE)
        return " ".join(out)

    def prose(self, low: int, high: int, kind: str | None = None) -> str:
        n, out = self.rng.randrange(low, high), []
        while n > 0:
            k = min(n, self.rng.randrange(1, 16))
            out.append(self.words(k, kind).capitalize() + self.rng.choice("....?!"))
            n -= k
        return " ".join(out)

    def element(self, tag: str, inner: str, attributes: str = "") -> str:
        ending = "" if self.open_ends and tag in ("p", "li", "td", "tr") else f"</{tag}>"
        return f"<{tag}{attributes}>{inner}{ending}"

    def region(self, kind: str, inner: str, must: bool = False) -> str:
        """The region under its tag, or a plain one with a name of its kind; with neither only where the page names nothing."""
        rng = self.rng
        tagged = rng.random() < self.semantic and TAGS[kind] != "div"
        attributes = ""
        if rng.random() < self.named or (not tagged and (must or rng.random() < 0.8)):
            pool = REGIONS[kind].split()
            value = rng.choice(["{0}", "{0}", "{0}-{2}", "{2}-{0}", "{0} {1}", "{0}{3}"]).format(rng.choice(pool), rng.choice(pool), rng.choice(WRAPPERS), rng.choice(WRAPPERS).capitalize())
            attributes = f' {rng.choice(["class", "class", "id"])}="{value}"'
        for _ in range(rng.choice([0, 0, 1, 2])):
            inner = self.element("div", inner, f' class="{rng.choice(WRAPPERS)}"' if rng.random() < 0.7 else "")
        return self.element(TAGS[kind] if tagged else rng.choice(["div", "div", "section", "ul" if kind == "nav" else "div"]), inner, attributes)

    def links(self, n: int, kind: str) -> str:
        one = lambda: f'<a href="/x">{REST}{self.words(self.rng.randrange(1, 4), kind)}</a>'
        style = self.rng.randrange(3)
        if style == 0:
            return "<ul>" + "".join(self.element("li", one()) for _ in range(n)) + "</ul>"
        return "".join(self.element("div" if style == 1 else "p", one()) for _ in range(n)) if style == 1 or self.rng.random() < 0.3 else " | ".join(one() for _ in range(n))

    def main_block(self) -> str:
        rng, p = self.rng, self.element
        kind = rng.random()
        if kind < 0.68:
            body = MAIN + self.prose(1, rng.choice([6, 30, 120]))
            if rng.random() < 0.2:
                body = f"<b>{body}</b>" if rng.random() < 0.5 else f"<b>{body}<br>"
            if rng.random() < 0.15:
                body += f' <a href="/y">{self.words(2)}</a> {self.words(3)}.'
            return p("p" if rng.random() < 0.85 else "div", body)
        if kind < 0.8:
            return p(rng.choice(["h2", "h3"]), MAIN + self.words(rng.randrange(1, 8)).capitalize())
        if kind < 0.88:
            return p("ul", "".join(p("li", MAIN + self.prose(2, 20)) for _ in range(rng.randrange(2, 6))))
        if kind < 0.92:
            return p("blockquote", p("p", MAIN + self.prose(5, 40)))
        if kind < 0.95:
            return p("table", "".join(p("tr", "".join(p("td", MAIN + self.words(rng.randrange(1, 4))) for _ in range(3))) for _ in range(rng.randrange(1, 4))))
        if kind < 0.98:
            return p("figure", "<img src=x>" + p("figcaption", MAIN + self.prose(3, 15)))
        return p("pre", MAIN + self.words(rng.randrange(3, 30)))

    def rest(self, kind: str) -> str:
        rng, p = self.rng, self.element
        text = lambda low, high: REST + self.prose(low, high, kind if rng.random() < 0.6 else None)
        if kind == "nav":
            inner = self.links(rng.randrange(2, 9), kind)
        elif kind == "header":
            inner = p(rng.choice(["div", "h1", "p"]), REST + self.words(rng.randrange(1, 5), kind)) + (self.links(4, "nav") if rng.random() < 0.4 else "")
        elif kind == "footer":
            inner = rng.choice(["{c}", "<p>{c}</p>", "{l}<p>{c}</p>", "<p>{c}</p>{l}"]).format(c=f"{REST}&copy; {rng.choice(['2021', 'example.com', ''])} &middot; {self.prose(2, 14, kind if rng.random() < 0.6 else None)}", l=self.links(3, kind))
        elif kind == "aside":
            inner = p(rng.choice(["h3", "h4", "div"]), REST + self.words(2, kind)) + (self.links(rng.randrange(2, 6), kind) if rng.random() < 0.5 else "".join(p(rng.choice(["p", "div"]), text(3, 30)) for _ in range(rng.randrange(1, 4))))
        elif kind in ("notice", "ad"):
            inner = "".join(p("p", text(2, 30)) for _ in range(rng.randrange(1, 3))) if rng.random() < 0.5 else text(1, 30)
            inner += f"<button>{REST}{self.words(1, kind)}</button>" if kind == "notice" and rng.random() < 0.5 else ""
        elif kind == "form":
            inner = (p("p", text(2, 15)) if rng.random() < 0.5 else "") + "".join(f"<label>{REST}{self.words(1, kind)}</label><input name=a>" for _ in range(rng.randrange(1, 4))) + f"<button>{REST}{self.words(1, kind)}</button>"
        else:
            one = lambda: p(rng.choice(["div", "p"]), REST + self.words(2)) + p("p", text(3, 60)) + (f"<a>{REST}{self.words(1, kind)}</a>" if rng.random() < 0.5 else "")
            inner = (p("h3", REST + self.words(2, kind)) if rng.random() < 0.7 else "") + "".join(p("div", one(), ' class="comment"' if rng.random() < 0.5 else "") if rng.random() < 0.7 else p("li", one()) for _ in range(rng.randrange(1, 6)))
        return self.region(kind, inner, must=kind in ("ad", "notice", "comments", "aside"))

    def page(self) -> str:
        rng = self.rng
        main = [self.main_block() for _ in range(rng.choice([1, 2, 4, 8, 14, 30]))]
        if rng.random() < 0.85:
            main.insert(0, self.element("h1", MAIN + self.words(rng.randrange(1, 10)).capitalize()))
        bare = rng.random()
        if bare < 0.06:
            return "".join(main)
        for kind in ("ad", "aside", "form", "notice"):
            if rng.random() < 0.15:
                main.insert(rng.randrange(1, len(main) + 1), self.rest(kind))
        if rng.random() < 0.12:
            main.append(self.rest("comments"))
        before = [self.rest(k) for k, odds in (("notice", 0.25), ("header", 0.5), ("nav", 0.75), ("ad", 0.4), ("form", 0.15), ("aside", 0.1)) if rng.random() < odds]
        after = [self.rest(k) for k, odds in (("comments", 0.35), ("aside", 0.4), ("form", 0.2), ("ad", 0.2), ("notice", 0.1), ("nav", 0.15), ("footer", 0.8)) if rng.random() < odds]
        body = "".join(before) + (self.region("main", "".join(main)) if bare > 0.02 and rng.random() < 0.95 else "".join(main)) + "".join(after)
        if bare > 0.97:
            body = "".join(before + after)
        for _ in range(rng.choice([0, 0, 1, 2])):
            body = self.element("div", body, f' class="{rng.choice(WRAPPERS)}"')
        whole = f"<!DOCTYPE html><html><head><title>{self.words(4)}</title><style>p{{x:y}}</style></head><body>{body}</body></html>"
        return whole[: -len("</body></html>")] if self.open_ends else whole


def pages(seed: int, n: int) -> list[str]:
    return [Drawn(random.Random(f"{seed}/{i}")).page() for i in range(n)]
