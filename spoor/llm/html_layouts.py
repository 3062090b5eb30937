"""Training pages for the block labeller: random layouts around paragraphs and menu words of real pages.

Every part of a layout is an article or not by construction, so each block has a label. Parts of both kinds carry
texts of the same pages: what tells them apart is where they stand, in which elements and in which company.
"""

from __future__ import annotations

import html
import random
import re

# Usual names of classes and ids on the web, and the phrases of notices in the languages of the pages.
CONTENT_NAMES = "content article post entry story main text body prose page article-body post-content entry-content article-content main-content story-body blog-post content-body single hentry richtext".split()
WRAP_NAMES = "wrap wrapper container page row inner site layout col grid outer section main-wrap site-content columns span8 app root".split()
MENU_NAMES = "nav menu navigation navbar main-nav top-menu site-nav links menu-main breadcrumbs breadcrumb pagination pager toc tabs submenu".split()
HEADER_NAMES = "header site-header masthead top topbar branding logo banner head page-header".split()
FOOTER_NAMES = "footer site-footer bottom colophon copyright legal foot page-footer credits".split()
SIDE_NAMES = "sidebar side aside widget widgets related recent popular rail secondary sidebar-right recommended most-read tags archive author-box".split()
NOTICE_NAMES = "cookie cookies cookie-notice cookie-banner notice notification alert gdpr consent message popup modal overlay warning paywall subscribe newsletter".split()
ADVERT_NAMES = "ad ads advert advertisement adsbygoogle sponsored sponsor promo promotion ad-slot banner-ad adbox partner teaser".split()
COMMENT_NAMES = "comments comment comment-list comment-body commentlist discussion replies reply responses disqus respond user-comments feedback".split()
SHARE_NAMES = "share sharing social social-share share-buttons follow share-bar likes".split()
NOTICES = [
    "We use cookies to improve your experience. Accept", "This site uses cookies. Learn more", "Subscribe to our newsletter", "Please enable JavaScript to view this page.", "You have 2 free articles left this month.", "Sign in or register to continue reading",
    "Wir verwenden Cookies. Akzeptieren", "Bitte aktivieren Sie JavaScript.", "Newsletter abonnieren", "Nous utilisons des cookies. Accepter", "Abonnez-vous à notre lettre", "Usamos cookies. Aceptar", "Suscríbete a nuestro boletín",
]
FORM_WORDS = "Search Send Submit Name Email Password Login Subscribe Suche Senden Anmelden Rechercher Envoyer Connexion Buscar Enviar Entrar Comment Website Message Yes No".split()
COMMENT_WORDS = ["Reply", "says:", "2 days ago", "Comments", "3 Comments", "Leave a comment", "Like", "Report", "Antworten", "Kommentare", "Répondre", "Commentaires", "Responder", "Comentarios", "Posted by", "at 10:42 am"]
SHARE_WORDS = ["Share", "Tweet", "Facebook", "Email", "Print", "Teilen", "Partager", "Compartir", "Pin it", "WhatsApp", "Copy link"]
ADVERTS = ["Advertisement", "Sponsored", "Anzeige", "Publicité", "Publicidad", "Ads by", "Buy now and save 50 %", "Promoted content"]

Part = list[tuple[str, int]]


class Layouts:
    """``paragraphs`` and ``words`` are the texts that pages are filled with."""

    def __init__(self, paragraphs: list[str], words: list[str], seed: int = 0):
        self.r = random.Random(seed)
        self.paragraphs = paragraphs or ["text"]
        self.words = words or ["word"]

    def _esc(self, text: str) -> str:
        return html.escape(text, quote=self.r.random() < 0.5)

    def _prose(self) -> str:
        t = self.r.choice(self.paragraphs)
        if self.r.random() < 0.35:
            w = t.split()
            at = self.r.randrange(len(w))
            t = " ".join(w[at : at + self.r.choice([1, 2, 4, 8, 15, 30])])
        return self._esc(t)

    def _few(self, most: int = 4) -> str:
        return self._esc(" ".join(self.r.choice(self.words) for _ in range(self.r.randint(1, most))))

    def _named(self, tags: list[str], names: list[str]) -> tuple[str, str]:
        """Start and end tag with names that a page could give."""
        tag = self.r.choice(tags)
        name = self.r.choice(names)
        if self.r.random() < 0.25:
            name = self.r.choice([f"{name} {self.r.choice(WRAP_NAMES)}", f"{self.r.choice(['site', 'js', 'c', 'block', 'm'])}-{name}", f"{name}-{self.r.choice(['inner', 'box', 'area', 'list', 'section', '1'])}", f"{name}_{self.r.choice(['main', 'top', 'x'])}"])
        kind = self.r.choice(["class", "class", "class", "id"])
        q = self.r.choice(['"', '"', '"', "'"])
        return f"<{tag} {kind}={q}{name}{q}>", f"</{tag}>"

    def _in(self, pair: tuple[str, str], inner: Part, label: int = 0) -> Part:
        return [(pair[0], label), *inner, (pair[1], label)]

    def _links(self, label: int = 0) -> Part:
        n = self.r.randint(1, 9)
        if self.r.random() < 0.75:
            items = "".join(f'<li><a href="/{i}">{self._few(self.r.choice([1, 1, 1, 3, 7]))}</a></li>' for i in range(n))
            return [(self.r.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format(items), label)]
        sep = self.r.choice([" ", " | ", " &gt; ", "", "<br>"])
        return [(sep.join(f'<a href="#{i}">{self._few(2)}</a>' for i in range(n)), label)]

    def menu(self) -> Part:
        pair = self.r.choice([("<nav>", "</nav>"), ("<nav>", "</nav>"), self._named(["div", "nav", "section", "ul", "td"], MENU_NAMES)])
        return self._in(pair, self._links())

    def header(self) -> Part:
        pair = self.r.choice([("<header>", "</header>"), self._named(["header", "div", "td"], HEADER_NAMES)])
        inner: Part = [(f"<{(t := self.r.choice(['div', 'h1', 'h2', 'p', 'a', 'span']))}>{self._few()}</{t}>", 0)]
        if self.r.random() < 0.4:
            inner.append((f"<p>{self._few(8)}</p>", 0))
        if self.r.random() < 0.5:
            inner += self.menu()
        if self.r.random() < 0.3:
            inner += self.form()
        return self._in(pair, inner)

    def footer(self) -> Part:
        pair = self.r.choice([("<footer>", "</footer>"), ("<footer>", "</footer>"), self._named(["footer", "div", "section"], FOOTER_NAMES)])
        sign = self.r.choice(["&copy; ", "© ", "&copy; 2024 ", "", "Copyright "])
        line = f"{sign}{self._few(1)}{self.r.choice([' &middot; ', ' | ', ' - ', ' '])}{self._prose() if self.r.random() < 0.6 else self._few(6)}"
        inner: Part = [(self.r.choice(["{}", "<p>{}</p>", "<div>{}</div>", "<small>{}</small>"]).format(line), 0)]
        if self.r.random() < 0.3:
            inner = [*self._links(), *inner]
        return self._in(pair, inner)

    def side(self) -> Part:
        pair = self.r.choice([("<aside>", "</aside>"), self._named(["aside", "div", "section", "td"], SIDE_NAMES)])
        inner: Part = []
        for _ in range(self.r.randint(1, 3)):
            inner.append((f"<h3>{self._few()}</h3>", 0))
            inner += self._links() if self.r.random() < 0.6 else [(f"<p>{self._prose()}</p>", 0)]
        return self._in(pair, inner)

    def notice(self) -> Part:
        pair = self.r.choice([("<noscript>", "</noscript>"), self._named(["div", "section", "p", "aside", "dialog"], NOTICE_NAMES), self._named(["div", "section"], NOTICE_NAMES)])
        line = self._esc(self.r.choice(NOTICES)) if self.r.random() < 0.5 else self._prose()
        inner: Part = [(line if pair[0].startswith("<p") else self.r.choice(["{}", "<p>{}</p>"]).format(line), 0)]
        if self.r.random() < 0.4:
            inner.append((f"<button>{self.r.choice(FORM_WORDS)}</button>", 0))
        return self._in(pair, inner)

    def advert(self) -> Part:
        pair = self.r.choice([("<ins>", "</ins>")] + [self._named(["div", "aside", "section", "p"], ADVERT_NAMES) for _ in range(4)])
        line = self._esc(self.r.choice(ADVERTS)) if self.r.random() < 0.3 else self._prose()
        if self.r.random() < 0.3:
            line = f'<a href="/go">{line}</a>'
        if pair[0] == "<ins>":
            pair = ('<ins class="adsbygoogle">', "</ins>")
            return [("<div>", 0), *self._in(pair, [(line, 0)]), ("</div>", 0)]
        return self._in(pair, [(line if pair[0].startswith("<p") else self.r.choice(["{}", "{}", "<p>{}</p>"]).format(line), 0)])

    def form(self) -> Part:
        inner = [(f"<{(t := self.r.choice(['label', 'legend', 'p', 'button', 'option', 'label']))}>{self.r.choice(FORM_WORDS) if self.r.random() < 0.6 else self._few()}</{t}>", 0) for _ in range(self.r.randint(1, 4))]
        return self._in((self.r.choice(["<form>", '<form action="/s" method="post">', '<form class="search-form">']), "</form>"), [*inner, ('<input type="text" name="q"><textarea></textarea>', 0)])

    def comments(self) -> Part:
        outer = self._named(["section", "div", "ol", "ul"], COMMENT_NAMES)
        inner: Part = [(f"<h{(k := self.r.randint(2, 4))}>{self._esc(self.r.choice(COMMENT_WORDS))}</h{k}>", 0)] if self.r.random() < 0.7 else []
        for _ in range(self.r.randint(1, 6)):
            one = ("<li>", "</li>") if outer[1] in ("</ol>", "</ul>") else self.r.choice([("<div>", "</div>"), ("<article>", "</article>"), self._named(["div", "article", "li"], ["comment", "reply", "comment-item", "message", "response"])])
            said: Part = []
            if self.r.random() < 0.6:
                said.append((self.r.choice(["<b>{}</b> ", "<span class=\"author\">{}</span>", "<p>{}</p>", "<h4>{}</h4>"]).format(f"{self._few(2)} {self._esc(self.r.choice(COMMENT_WORDS))}"), 0))
            said += [(f"<p>{self._prose()}</p>", 0) for _ in range(self.r.randint(1, 2))] if self.r.random() < 0.8 else [(self._prose(), 0)]
            inner += self._in(one, said)
        if self.r.random() < 0.4:
            inner += self.form()
        return self._in(outer, inner)

    def share(self) -> Part:
        words = "".join(f'<{(t := self.r.choice(["a", "li", "span", "button"]))}>{self.r.choice(SHARE_WORDS)}</{t}>' for _ in range(self.r.randint(1, 5)))
        return self._in(self._named(["div", "ul", "p", "section"], SHARE_NAMES), [(words, 0)])

    def _inline(self, text: str) -> str:
        if self.r.random() < 0.2:
            w = text.split(" ")
            at = self.r.randrange(len(w))
            tag = self.r.choice(["b", "i", "em", "strong", "span", "code", 'a href="/x"'])
            w[at] = f"<{tag}>{w[at]}</{tag.split()[0]}>"
            return " ".join(w)
        return text

    def article(self, inserted: list[Part]) -> Part:
        """Heading, paragraphs and other blocks of an article, with some parts between that are none of it."""
        out: Part = []
        if self.r.random() < 0.8:
            head = f"<h{(k := self.r.choice([1, 1, 1, 2]))}>{self._prose() if self.r.random() < 0.5 else self._few(9)}</h{k}>"
            out.append((f"<header>{head}</header>" if self.r.random() < 0.1 else head, 1))
        for _ in range(self.r.choice([1, 2, 3, 4, 6, 9, 14, 20])):
            x, t = self.r.random(), self._inline(self._prose())
            if x < 0.72:
                end = "</p>" if self.r.random() < 0.9 else ""
                out.append((self.r.choice([f"<p>{t}{end}", f"<p>{t}{end}", f"<p><b>{t}<br>"]), 1))
            elif x < 0.80:
                out.append((f"<h{(k := self.r.randint(2, 4))}>{self._few(6)}</h{k}>", 1))
            elif x < 0.87:
                out.append(("<ul>" + "".join(f"<li>{self._prose()}</li>" for _ in range(self.r.randint(1, 5))) + "</ul>", 1))
            elif x < 0.90:
                out.append((f"<blockquote><p>{t}</p></blockquote>", 1))
            elif x < 0.92:
                out.append((f"<pre>{t}</pre>", 1))
            elif x < 0.94:
                out.append(("<table>" + "".join(f"<tr><td>{self._few()}</td><td>{self._few()}</td></tr>" for _ in range(self.r.randint(1, 3))) + "</table>", 1))
            elif x < 0.96:
                out.append((f'<figure><img src="i"><figcaption>{t}</figcaption></figure>', 1))
            else:
                out.append((f"<div>{t}</div>", 1))
        for part in inserted:
            at = self.r.randrange(len(out) + 1)
            out[at:at] = part
        return out

    def page(self) -> Part:
        """A whole page as pieces of html, each with its label."""
        r = self.r
        inside = [r.choice([self.advert, self.advert, self.share, self.notice, self.side])() for _ in range(r.choice([0, 0, 0, 1, 2]))]
        body = self.article(inside)
        kind = r.random()
        if kind < 0.4:
            body = self._in(("<article>", "</article>"), body, 1)
        elif kind < 0.5:
            body = self._in(("<main>", "</main>"), body, 1)
        elif kind < 0.6:
            body = self._in(self._named(["article", "main"], CONTENT_NAMES), body, 1)
        elif kind < 0.95:
            body = self._in(self._named(["div", "div", "section", "td"], CONTENT_NAMES), body, 1)
        if kind < 0.6 and r.random() < 0.15:  # readers' comments within the article's element
            body[-1:-1] = self.comments()
        for _ in range(r.choice([0, 0, 1, 2])):
            body = self._in(r.choice([("<div>", "</div>"), ("<main>", "</main>"), self._named(["div", "section"], WRAP_NAMES)]), body, 1)
        before = [r.choice([self.menu, self.menu, self.header, self.header, self.advert, self.notice, self.side, self.form, self.share])() for _ in range(r.choice([0, 1, 2, 2, 3, 4]))]
        after = [r.choice([self.comments, self.comments, self.side, self.share, self.advert, self.notice, self.menu, self.form])() for _ in range(r.choice([0, 0, 1, 2, 3]))]
        if r.random() < 0.8:
            after.append(self.footer())
        whole = [x for p in before for x in p] + body + [x for p in after for x in p]
        if r.random() < 0.3:
            whole = self._in(self._named(["div"], WRAP_NAMES), whole, 0)
        head = f"<!DOCTYPE html><html><head><title>{self._few(8)}</title><style>p{{margin:0}}</style></head><body>"
        whole = [(head, 0), *whole] if r.random() < 0.9 else whole
        if r.random() < 0.7:
            whole.append(("</body></html>", 0))
        return whole


#: A sign, in the private area, that marks training text of an article.
MARK = "\ue000"
_TEXT = re.compile(r">([^<]+)|\A([^<]+)")


def marked(parts: Part) -> str:
    """The page with every text of an article marked, so that its blocks can be told after parsing."""
    return "".join(_TEXT.sub(lambda m: m[0] + MARK, p) if label else p for p, label in parts)
