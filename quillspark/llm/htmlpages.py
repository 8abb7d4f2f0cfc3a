"""Web pages made by rule, with the place of every block known: what the block labeller is trained on."""

from __future__ import annotations

import numpy as np

#: Names that pages give to parts of themselves, by part. Any may be class or id, alone or joined.
NAMES = {
    "article": "article post entry content story body text main single blog news page prose markdown publication hentry",
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs topnav links tabs toc pagination pager",
    "header": "header head masthead banner topbar top branding logo site hero title",
    "footer": "footer foot bottom copyright legal colophon credits imprint",
    "sidebar": "sidebar side aside widget widgets rail related recommended trending popular secondary teaser archive tags",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay disclaimer privacy announcement message toast warning",
    "ad": "ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner adsense outbrain taboola",
    "form": "form newsletter subscribe signup login search contact register",
    "comments": "comments comment reply replies discussion respond feedback disqus thread commentlist reviews",
    "share": "share sharing social buttons follow",
}
#: Names that tell nothing of a part, beside those that do.
PLAIN = "wrap wrapper box container inner outer block unit slot area region row col column item group panel module holder left right large small first last".split()
PHRASES = {
    "nav": "Home|About|Contact|News|Menu|Next|Previous|Login|Search|Archive|Products",
    "header": "Welcome|The Daily Page|Skip to content|Sign in|Subscribe",
    "footer": "© 2024|All rights reserved.|Copyright|Privacy policy|Terms of use|Contact us|Imprint",
    "sidebar": "Related|Most read|Popular posts|Tags|Recent articles|Read more",
    "notice": "We use cookies to improve this site.|Accept all|This site uses cookies|Important notice",
    "ad": "Advertisement|Sponsored|Buy now|Special offer|Click here",
    "form": "Subscribe to our newsletter|Your e-mail|Submit|Name|Password|Send",
    "comments": "Comments|Leave a reply|3 comments|Reply|Posted by|says:",
    "share": "Share|Tweet|Like|Follow us|Share on",
}
_SYLLABLES = "an be ca do el fi go ha in ju ka lo mi no or pa que ra si ti um ve wo xi ya zu th er on ent ing ción ment keit lich é ü ñ ch sch ou".split()
TAGS = {"nav": ["nav"], "header": ["header"], "footer": ["footer"], "sidebar": ["aside"], "form": ["form"], "comments": ["section"], "notice": [], "ad": ["aside"], "share": []}


def _words(rng: np.random.Generator, least: int, most: int) -> str:
    out = ["".join(rng.choice(_SYLLABLES, int(rng.integers(1, 4)))) for _ in range(int(rng.integers(least, most + 1)))]
    if rng.random() < 0.15:
        out[int(rng.integers(len(out)))] += rng.choice(["&amp;", "&amp;&amp;&amp;", "***", "###", "%%%", "$$$", "&eacute;"])
    if rng.random() < 0.1:
        i = int(rng.integers(len(out)))
        out[i] = f"<{(t := rng.choice(['b', 'em', 'a href="/x"', 'span', 'strong', 'code']))}>{out[i]}</{t.split()[0]}>"
    return " ".join(out).capitalize() if not out[0].startswith("<") else " ".join(out)


def _named(rng: np.random.Generator, kind: str, tag: str | None = None) -> tuple[str, str]:
    """A start and an end tag for a part of this kind: by its own element, or by class or id."""
    own = TAGS.get(kind, [])
    plain = tag is None and own and rng.random() < 0.5
    tag = tag or (str(rng.choice(own)) if plain else str(rng.choice(["div", "div", "section", "ul" if kind == "nav" else "div"])))
    if plain and rng.random() < 0.6:
        return f"<{tag}>", f"</{tag}>"
    names = [*rng.choice(NAMES[kind].split(), int(rng.integers(1, 3)), replace=False)]
    if rng.random() < 0.3:
        names.insert(int(rng.integers(len(names) + 1)), rng.choice(PLAIN))
    joined = str(rng.choice([" ", "-", "_"])).join(names)
    return f'<{tag} {rng.choice(["class", "class", "id"])}="{joined}">', f"</{tag}>"


class _Page:
    def __init__(self, rng: np.random.Generator):
        self.rng, self.out, self.labels = rng, [], []
        self.unclosed = rng.random() < 0.2

    def block(self, tag: str, text: str, label: bool) -> None:
        close = "" if self.unclosed and tag in ("p", "li") and self.rng.random() < 0.5 else f"</{tag}>"
        self.out.append(f"<{tag}>{text}{close}")
        self.labels.append(label)

    def phrase(self, kind: str) -> str:
        return str(self.rng.choice(PHRASES[kind].split("|"))) if self.rng.random() < 0.5 else _words(self.rng, 1, 6)

    def part(self, kind: str) -> None:
        """One part around the article; all of its blocks are none of the article's."""
        rng = self.rng
        start, end = _named(rng, kind)
        self.out.append(start)
        if kind == "nav" or kind in ("footer", "header", "sidebar", "share") and rng.random() < 0.5:
            listed = rng.random() < 0.8
            self.out.append("<ul>" * listed)
            for _ in range(int(rng.integers(1, 9))):
                self.block("li" if listed else "div", f'<a href="/{rng.integers(99)}">{self.phrase(kind) if kind != "nav" else _words(rng, 1, 2)}</a>', False)
            self.out.append("</ul>" * listed)
        if kind == "comments":
            if rng.random() < 0.7:
                self.block(str(rng.choice(["h2", "h3", "h4"])), self.phrase(kind), False)
            for _ in range(int(rng.integers(1, 7))):
                self.out.append(f'<{(t := str(rng.choice(["div", "li", "article"])))} class="comment">')
                if rng.random() < 0.5:
                    self.block("div", _words(rng, 1, 3), False)
                self.block("p", _words(rng, 3, 50) + ".", False)
                self.out.append(f"</{t}>")
        elif kind != "nav":
            if kind in ("sidebar", "form") and rng.random() < 0.7:
                self.block("h3", self.phrase(kind), False)
            for _ in range(int(rng.integers(1, 4))):
                if rng.random() < 0.25:  # text right inside, and maybe long
                    self.out.append(f"<div>{_words(rng, 2, 30)}.</div>")
                    self.labels.append(False)
                else:
                    self.block(str(rng.choice(["p", "p", "div", "h4"])), self.phrase(kind) if rng.random() < 0.6 else _words(rng, 4, 40) + ".", False)
            if kind == "form":
                self.out.append('<div><label>E-mail</label> <input type="text"><button>Send</button></div>')
                self.labels.append(False)
        self.out.append(end)

    def article(self) -> None:
        rng = self.rng
        style = rng.random()
        if style < 0.55:
            around = [("<article>", "</article>") if rng.random() < 0.6 else _named(rng, "article", "article")]
            if rng.random() < 0.3:
                around.insert(0, ("<main>", "</main>"))
        elif style < 0.7:
            around = [("<main>", "</main>")]
        elif style < 0.93:
            around = [_named(rng, "article", "div")]
        else:
            around = [("<div>", "</div>")]
        if rng.random() < 0.3:
            around.insert(0, _named(rng, "article", "div"))
        if rng.random() < 0.2:
            around.append(_named(rng, "article", "div"))
        self.out += [a for a, _ in around]
        self.body()
        if rng.random() < 0.12:
            self.part("comments")
        self.out += [b for _, b in reversed(around)]

    def body(self) -> None:
        """The article's own blocks, with parts of other kinds among them."""
        rng = self.rng
        if rng.random() < 0.85:
            title = _words(rng, 1, 12)
            if rng.random() < 0.15:
                self.out.append("<header>")
                self.block("h1", title, True)
                self.out.append("</header>")
            else:
                self.block("h1", title, True)
        # most articles have a few blocks of any length; some have many, or short ones, or one again and again
        short, same = rng.random() < 0.2, _words(rng, 1, 12) if rng.random() < 0.15 else None
        many = int(rng.integers(16, 60)) if rng.random() < 0.15 else int(rng.integers(1, 16))
        for _ in range(many):
            kind = rng.random()
            if kind < 0.85 and (short or same):
                self.block("p", same if same and rng.random() < 0.8 else _words(rng, 1, 5), True)
                continue
            if kind < 0.72:
                long = rng.random()
                self.block("p", _words(rng, 1, 5) if long < 0.2 else _words(rng, 6, 60) + ".", True)
            elif kind < 0.8:
                self.block(str(rng.choice(["h2", "h3"])), _words(rng, 1, 8), True)
            elif kind < 0.86:
                self.out.append(f"<{(t := str(rng.choice(['ul', 'ol'])))}>")
                for _ in range(int(rng.integers(1, 5))):
                    self.block("li", _words(rng, 1, 15), True)
                self.out.append(f"</{t}>")
            elif kind < 0.89:
                self.block(str(rng.choice(["blockquote", "pre"])), _words(rng, 3, 30), True)
            elif kind < 0.91:
                self.table(int(rng.integers(1, 4)), int(rng.integers(1, 4)))
            elif kind < 0.94:
                self.out.append(f"<p><b>{_words(rng, 1, 10)}.<br>")  # never closed
                self.labels.append(True)
            elif kind < 0.945:
                self.out.append("<figure><img src='x.png'>")
                self.block("figcaption", _words(rng, 2, 10), True)
                self.out.append("</figure>")
            elif kind < 0.95:
                self.out.append("<dl>")
                for _ in range(int(rng.integers(1, 4))):
                    self.block("dt", _words(rng, 1, 4), True)
                    self.block("dd", _words(rng, 1, 20), True)
                self.out.append("</dl>")
            else:
                self.part(str(rng.choice(["ad", "ad", "share", "form", "sidebar", "notice"])))

    def table(self, rows: int, columns: int) -> None:
        head = self.rng.random() < 0.4
        self.out.append("<table>")
        for i in range(rows):
            self.out.append("<tr>")
            for _ in range(columns):
                self.block("th" if head and i == 0 else "td", _words(self.rng, 1, 4), True)
            self.out.append("</tr>")
        self.out.append("</table>")

    def laid_out(self) -> None:
        """A page that is one table: its name above, links beside the article, and what is said below all pages."""
        rng = self.rng
        links = lambda: "<br>".join(f'<a href="/{rng.integers(99)}">{_words(rng, 1, 3)}</a>' for _ in range(int(rng.integers(2, 9))))
        self.out.append("<table>")
        if rng.random() < 0.8:
            self.out.append(f"<tr><td colspan=2><font size=5>{self.phrase('header')}</font></td></tr>")
            self.labels.append(False)
        self.out.append("<tr>")
        if rng.random() < 0.8:
            self.out.append(f"<td width=150>{links()}</td>")
            self.labels.append(False)
        self.out.append("<td>")
        self.body()
        self.out.append("</td>")
        if rng.random() < 0.3:
            self.out.append(f"<td>{links()}</td>")
            self.labels.append(False)
        self.out.append("</tr>")
        if rng.random() < 0.8:
            self.out.append(f"<tr><td colspan=3><font size=1>{self.phrase('footer')} {_words(rng, 1, 5)}.</font></td></tr>")
            self.labels.append(False)
        self.out.append("</table>")


def made_page(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page, and of each of its blocks whether it belongs to the article."""
    page = _Page(rng)
    page.out.append("<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>")
    if rng.random() < 0.06:
        page.laid_out()
        page.out.append("</body></html>")
        return "".join(page.out), page.labels
    for kind, chance in (("notice", 0.25), ("header", 0.5), ("nav", 0.8), ("ad", 0.4), ("form", 0.15), ("sidebar", 0.25)):
        if rng.random() < chance:
            page.part(kind)
    if rng.random() < 0.98:
        page.article()
    for kind, chance in (("share", 0.15), ("comments", 0.35), ("sidebar", 0.3), ("ad", 0.25), ("form", 0.2), ("nav", 0.15), ("footer", 0.8), ("notice", 0.2)):
        if rng.random() < chance:
            page.part(kind)
    page.out.append("</body></html>")
    return "".join(page.out), page.labels
