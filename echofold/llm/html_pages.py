"""Labelled pages to train the extractor on: generated layouts whose elements say whether they are the article's.

data-main="1" marks an element whose text is the article's, data-main="0" one inside it whose text is not; the mark holds
below the element until the next mark.
"""

from __future__ import annotations

import random

WORDS = "the a of river house light over under small green paper moves slowly with stone garden winter market people often think about water road open letter night train".split()
MAIN = [("article", ""), ("article", 'class="post"'), ("main", ""), ("main", 'id="content"'), ("div", 'class="content"'), ("div", 'class="post-body"'), ("div", 'class="entry-content"'), ("section", 'class="article-text"'), ("div", 'id="story"'), ("div", 'class="article"'), ("div", 'role="main"'), ("div", 'class="text body"'), ("div", "")]
LINKS = [("nav", ""), ("nav", 'class="main-nav"'), ("ul", 'class="menu"'), ("div", 'class="navbar"'), ("div", 'id="menu"'), ("div", 'class="breadcrumbs"'), ("header", ""), ("header", 'class="site-header"'), ("div", 'id="header"'), ("div", 'class="topbar"')]
SIDE = [("aside", ""), ("div", 'class="sidebar"'), ("div", 'id="sidebar"'), ("aside", 'class="related"'), ("div", 'class="related-posts"'), ("div", 'class="widget"'), ("section", 'class="recommended"')]
ADS = [("div", 'class="ad"'), ("div", 'class="ads"'), ("div", 'class="advert"'), ("div", 'class="advertisement banner"'), ("div", 'class="sponsored"'), ("aside", 'class="promo"'), ("div", 'id="ad-slot"'), ("p", 'class="ad"'), ("section", 'class="newsletter"')]
NOTICES = [("div", 'class="cookie-notice"'), ("div", 'id="cookie-banner"'), ("div", 'class="consent"'), ("div", 'class="gdpr notice"'), ("div", 'class="popup modal"'), ("div", 'role="alert"'), ("div", 'class="notice"'), ("dialog", "")]
COMMENTS = [("section", 'class="comments"'), ("div", 'id="comments"'), ("ol", 'class="comment-list"'), ("div", 'class="reader-comments"'), ("div", 'class="comment"'), ("section", 'id="disqus"'), ("div", 'class="replies discussion"')]
FOOTERS = [("footer", ""), ("footer", 'class="site-footer"'), ("div", 'id="footer"'), ("div", 'class="footer copyright"')]
FORMS = [("form", ""), ("form", 'class="search"'), ("form", 'class="subscribe"'), ("form", 'id="login"')]


def _text(r: random.Random, low: int, high: int) -> str:
    words = [r.choice(WORDS) for _ in range(r.randint(low, high))]
    out = " ".join(w + ("." if r.random() < 0.08 else "," if r.random() < 0.08 else "") for w in words)
    return out.capitalize() + r.choice([".", ".", "", "?"])


def _wrap(spec: tuple[str, str], inner: str, mark: str = "") -> str:
    tag, attributes = spec
    return f"<{tag} {attributes} {mark}>{inner}</{tag}>"


def _links(r: random.Random) -> str:
    links = [f'<a href="/x">{_text(r, 1, 3)}</a>' for _ in range(r.randint(2, 8))]
    return "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if r.random() < 0.6 else " | ".join(links)


def _block(r: random.Random) -> str:
    kind = r.random()
    if kind < 0.7:
        body = _text(r, 3, r.choice([30, 70, 70, 400]))
        if r.random() < 0.3:
            body += f" <{r.choice(['b', 'em', 'a', 'span', 'i'])}>{_text(r, 1, 6)}</{'b'}> " + _text(r, 2, 20)
        return f"<p>{body}</p>"
    if kind < 0.8:
        return f"<{(h := r.choice(['h2', 'h3']))}>{_text(r, 2, 7)}</{h}>"
    if kind < 0.9:
        return "<ul>" + "".join(f"<li>{_text(r, 3, 15)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
    if kind < 0.95:
        return f"<blockquote><p>{_text(r, 5, 30)}</p></blockquote>"
    return "<table>" + "".join(f"<tr><td>{_text(r, 1, 4)}</td><td>{_text(r, 1, 4)}</td></tr>" for _ in range(3)) + "</table>"


def labelled_page(seed: int) -> str:
    r = random.Random(seed)
    some = lambda specs, p, inner: [_wrap(r.choice(specs), inner(r), 'data-main="0"')] if r.random() < p else []
    prose = lambda r: "".join(f"<p>{_text(r, 3, 30)}</p>" for _ in range(r.randint(1, 3))) if r.random() < 0.6 else _text(r, 3, 20)
    field = lambda r: f"<label>{_text(r, 1, 4)}</label><input><button>{_text(r, 1, 2)}</button>"
    inner = [f"<h1>{_text(r, 3, 12)}</h1>"]
    if r.random() < 0.2:
        inner[0] = f"<header>{inner[0]}</header>"
    terse = r.random() < 0.35  # many paragraphs of a few words
    for _ in range(r.randint(6, 25) if terse else r.randint(1, 8)):
        inner.append(f"<p>{_text(r, 1, 4)}</p>" if terse and r.random() < 0.9 else _block(r))
        inner += some(ADS, 0.12, prose) + some(SIDE, 0.06, _links) + some(FORMS, 0.04, field)
    if r.random() < 0.3:
        inner = [f'<div class="{r.choice(["row", "inner", "wrap", "section"])}">' + "".join(inner) + "</div>"]
    inner += some(COMMENTS, 0.25, prose) + some(FOOTERS, 0.08, lambda r: _text(r, 1, 12)) + some(LINKS, 0.05, _links)
    main = _wrap(r.choice(MAIN), "".join(inner), 'data-main="1"')
    before = some(NOTICES, 0.3, prose) + some(LINKS, 0.8, _links) + some(ADS, 0.4, prose) + some(FORMS, 0.2, field)
    after = some(COMMENTS, 0.4, prose) + some(SIDE, 0.5, _links) + some(SIDE, 0.2, prose) + some(ADS, 0.3, prose) + some(FORMS, 0.15, field) + some(FOOTERS, 0.8, lambda r: _links(r) if r.random() < 0.5 else _text(r, 3, 20))
    r.shuffle(before)
    if r.random() < 0.3:  # little beside the article
        before, after = before[:0], after[-1:]
    body = "".join([*before, main, *after])
    if r.random() < 0.3:
        body = f'<div class="{r.choice(["page", "container", "wrapper", "site"])}">{body}</div>'
    if r.random() < 0.25:
        return body
    return f"<html><head><title>{_text(r, 2, 6)}</title></head><body>{body}</body></html>"
