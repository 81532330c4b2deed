"""Labelled web pages for training: layouts of many kinds whose blocks are known to be article or not.

``data-label="main"`` or ``"other"`` on an element labels the blocks inside it; the attribute is
never a feature. Any pages marked in this way can be used for training instead.
"""

from __future__ import annotations

import random

_SYLLABLES = "an the re on ti er st en al or in es ou ver ge sch cion que ment lo ra de au ch ei na mi so pa ka to ri va du el".split()


class Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        words = self.words(1, 24).split()
        if len(words) > 8 and self.r.random() < 0.6:
            words[len(words) // 2] += ","
        return " ".join(words).capitalize() + self.r.choice("....?!")

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def links(self, n: int, wrap: str = "li") -> str:
        return "".join(f'<{wrap}><a href="/{self.word()}">{self.words(1, 3)}</a></{wrap}>' for _ in range(n))

    def other(self, inner: str, *openings: str) -> str:
        opening = self.r.choice(openings)
        tag = opening.split()[0]
        return f'<{opening} data-label="other">{inner}</{tag}>'

    def menu(self) -> str:
        inner = self.r.choice((f"<ul>{self.links(self.r.randint(2, 9))}</ul>", self.links(self.r.randint(2, 8), "span"), f"<ol>{self.links(3)}</ol>"))
        return self.other(inner, "nav", "nav", "nav class=navbar", 'div class="menu"', 'div id="main-nav"', 'div class="navigation top-nav"', 'ul class="nav"', 'div class="breadcrumbs"', 'div role="navigation"', 'div class="toc"', 'div class="pagination"')

    def header(self) -> str:
        inner = f"<a href='/'>{self.words(1, 3)}</a><p>{self.r.choice((self.words(2, 8), self.prose(1, 2)))}</p>" + (self.menu() if self.r.random() < 0.3 else "")
        return self.other(inner, "header", "header", "header class=site-header", 'div class="header"', 'div id="masthead"', 'div role="banner"', 'div class="topbar"')

    def footer(self) -> str:
        inner = self.r.choice((f"&copy; {self.word()}.example.org &middot; {self.prose(1, 3)}", f"<p>{self.prose(1, 3)}</p><p>&copy; 2024 {self.words(1, 4)}</p>", f"<ul>{self.links(4)}</ul>", f"<small>{self.prose(1, 2)}</small>"))
        return self.other(inner, "footer", "footer", "footer class=site-footer", 'div class="footer"', 'div id="footer"', 'div class="bottom-bar"', 'div class="copyright"', 'div role="contentinfo"')

    def aside(self) -> str:
        inner = self.r.choice((f"<h3>{self.words(1, 3)}</h3><ul>{self.links(self.r.randint(2, 7))}</ul>", f"<h2>{self.words(1, 3)}</h2><p>{self.prose(1, 5)}</p>", f"<p>{self.prose(1, 6)}</p>", self.prose(1, 4)))
        return self.other(inner, "aside", "aside", "aside class=sidebar", 'div class="sidebar"', 'div id="sidebar-right"', 'div class="widget"', 'section class="related"', 'div class="related-posts"', 'div class="recommended"', 'div class="side"', 'div class="promo-box"', 'div role="complementary"', 'div class="author-box"')

    def notice(self) -> str:
        inner = f"<p>{self.prose(1, 4)}</p>" if self.r.random() < 0.6 else self.prose(1, 3)
        if self.r.random() < 0.4:
            inner += f"<button>{self.words(1, 2)}</button>"
        return self.other(inner, 'div class="cookie-banner"', 'div id="cookie-notice"', 'div class="notice"', 'div class="consent"', 'div class="alert"', 'div role="alert"', 'div class="gdpr"', 'div class="banner"', 'section class="notice"', 'p class="notice"', 'div class="popup modal"', 'div class="disclaimer"', "noscript", 'div class="legal"', 'div class="warning message"', 'div role="dialog"')

    def advert(self) -> str:
        inner = self.r.choice((self.prose(1, 3), f"<p>{self.prose(1, 5)}</p>", f'<a href="//{self.word()}">{self.words(2, 8)}</a>'))
        return self.other(inner, 'div class="ad"', 'div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div id="ad-1"', 'div class="ad-slot"', 'div class="sponsored"', 'div class="promo"', 'div class="promoted"', 'section class="sponsor"', "ins class=adsbygoogle", 'p class="ad"', 'aside class="ad"')

    def form(self) -> str:
        inner = f"<label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 2)}</button>" + (f"<p>{self.prose(1, 3)}</p>" if self.r.random() < 0.6 else "")
        return self.other(f"<form>{inner}</form>", "div", 'div class="newsletter"', 'div class="subscribe"', 'div class="search"', 'section class="signup"', 'div class="login"', 'fieldset class="f"')

    def share(self) -> str:
        return self.other("".join(f"<a href=#>{self.words(1, 2)}</a> " for _ in range(4)), 'div class="share"', 'div class="social"', 'ul class="sharing"', 'div class="tags"', 'div class="meta"')

    def comments(self) -> str:
        one = self.r.choice(("<div class=comment><p>{}</p></div>", "<li>{}</li>", "<div><b>{}</b><p>{}</p></div>", "<p>{}</p>", "<article class=comment><p>{}</p></article>", "<article><p>{}</p></article>", "<blockquote>{}</blockquote>"))
        inner = "".join(one.replace("{}", self.prose(1, 6)) for _ in range(self.r.randint(1, 6)))
        if self.r.random() < 0.6:
            inner = f"<h2>{self.words(1, 3)}</h2>" + inner
        return self.other(inner, 'section class="comments"', 'div id="comments"', 'div class="comments"', 'div class="comment-list"', 'div class="discussion"', 'div class="replies"', 'div id="disqus_thread"', 'section id="responses"', 'ol class="commentlist"', 'div class="reader-comments"', 'div class="user-reviews"')

    def paragraph(self) -> str:
        r = self.r.random()
        if r < 0.70:
            inner = self.prose(1, 8)
            if self.r.random() < 0.2:
                inner = inner.replace(" ", f' <a href="/{self.word()}">{self.word()}</a> ', 1)
            if self.r.random() < 0.15:
                inner = f"<b>{inner}<br>"
            return f"<p>{inner}</p>" if self.r.random() < 0.9 else f"<p>{inner}"
        if r < 0.78:
            return f"<{(h := self.r.choice(('h2', 'h3', 'h2')))}>{self.words(1, 8)}</{h}>"
        if r < 0.86:
            return f"<{(t := self.r.choice(('ul', 'ol')))}>" + "".join(f"<li>{self.prose(1, 2)}</li>" for _ in range(self.r.randint(1, 5))) + f"</{t}>"
        if r < 0.91:
            return f"<blockquote><p>{self.prose(1, 4)}</p></blockquote>"
        if r < 0.94:
            return f"<pre><code>{self.words(3, 20)}</code></pre>"
        if r < 0.97:
            return f"<table><tr><td>{self.words(1, 4)}<td>{self.words(1, 4)}</tr></table>"
        return f"<figure><img src=x><figcaption>{self.prose(1, 2)}</figcaption></figure>"

    def article(self) -> str:
        parts = [self.paragraph() for _ in range(self.r.choice((1, 1, 2, 3, 5, 8, 14)))]
        if self.r.random() < 0.15:
            parts = [f"<div>{self.prose(2, 6)}</div>" for _ in parts]
        elif self.r.random() < 0.1:
            parts = ["<br><br>".join(self.prose(1, 5) for _ in parts)]
        for extra in (self.advert, self.share, self.aside, self.form, self.notice):
            if self.r.random() < 0.12:
                parts.insert(self.r.randint(0, len(parts)), extra())
        title = f"<h1>{self.r.choice((self.words(2, 9), self.sentence()))}</h1>"
        if self.r.random() < 0.1:
            title = f"<header>{title}</header>"
        if self.r.random() < 0.85:
            parts.insert(0, title)
        opening = self.r.choice(("article",) * 6 + ("main", "main", "article class=post", 'div class="content"', 'div class="post"', 'div class="entry-content"', 'div class="article-body"', 'div id="content"', 'div class="story"', 'section class="text"', 'div role="main"', "div", "section", 'div class="c1 x"'))
        body = f'<{opening} data-label="main">{"".join(parts)}</{opening.split()[0]}>'
        if self.r.random() < 0.3:
            body = f"<{(t := self.r.choice(('main', 'div', 'div class=wrap', 'section', 'div id=page')))}>{body}</{t.split()[0]}>"
        return body

    def page(self) -> str:
        pick = lambda p, f: f() if self.r.random() < p else ""
        before = [pick(0.25, self.notice), pick(0.4, self.header), pick(0.75, self.menu), pick(0.1, self.form), pick(0.4, self.advert), pick(0.15, self.aside)]
        after = [pick(0.2, self.share), pick(0.35, self.comments), pick(0.3, self.aside), pick(0.25, self.advert), pick(0.2, self.form), pick(0.75, self.footer), pick(0.1, self.notice)]
        if self.r.random() < 0.3:
            self.r.shuffle(before)
        body = "".join(before) + self.article() + "".join(after)
        if self.r.random() < 0.15:
            body = f"<div id=wrapper>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><script>var t='</p>';</script></head><body>{body}</body></html>"


def labelled_pages(n: int = 500, seed: int = 11) -> list[str]:
    pages = Pages(seed)
    return [pages.page() for _ in range(n)]
