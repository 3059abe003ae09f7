"""Labelled pages for training the extractor: no table has any, so they are composed here.

A page is put together from parts in many markups and orders; ``data-y`` tells whether an element holds main text. Features do
not see that attribute. Page ``i`` is the same in every run.
"""

from __future__ import annotations

import random

_SYLLABLES = "an ba co de el fi go ha in ja ko la mi no or pe qua ri so ta un ve wi xo ya ze che tion ing er ß é ü ñ".split()


def _word(r: random.Random) -> str:
    return "".join(r.choices(_SYLLABLES, k=r.randint(1, 4)))


def _sentence(r: random.Random, n: int) -> str:
    words = [_word(r) + ("," if r.random() < 0.08 else "") for _ in range(max(1, n))]
    return " ".join(words).capitalize() + r.choice((".", ".", ".", "!", "?", "", " &amp; co.", " ***"))


def _prose(r: random.Random, words: int) -> str:
    return " ".join(_sentence(r, r.randint(2, 14)) for _ in range(max(1, words // 8)))


def _links(r: random.Random, n: int) -> str:
    kind = r.random()
    items = [f'<a href="/{_word(r)}">{" ".join(_word(r) for _ in range(r.randint(1, 3)))}</a>' for _ in range(n)]
    if kind < 0.6:
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    return r.choice((" ", " | ", "")).join(items) if kind < 0.8 else "".join(f"<div>{x}</div>" for x in items)


def _open(r: random.Random, label: int, choices: list[str]) -> tuple[str, str]:
    """A choice is ``tag`` or ``tag:word``; the word becomes a class or an id, at times with another word."""
    tag, _, word = r.choice(choices).partition(":")
    mark = ""
    if word:
        extra = r.choice(("", "", "-wrap", " clearfix", "_box", "-1"))
        mark = f' {r.choice(("class", "class", "id"))}="{word}{extra}"'
    return f'<{tag}{mark} data-y="{label}">', f"</{tag}>"


def _noise(r: random.Random, kind: str) -> str:
    choices = {
        "nav": ["nav", "nav", "div:nav", "div:menu", "ul:menu", "div:breadcrumb", "div:pagination", "nav:main"],
        "header": ["header", "header", "div:header", "div:masthead", "div:top", "div:banner"],
        "footer": ["footer", "footer", "div:footer", "div:copyright", "footer:bottom", "div:legal"],
        "side": ["aside", "aside", "div:sidebar", "aside:sidebar", "div:widget", "div:related", "section:popular", "div:recommended"],
        "notice": ["div:cookie", "div:consent", "div:notice", "div:alert", "section:newsletter", "div:popup", "aside:notice", "div:message"],
        "ad": ["div:ad", "div:ad", "div:ads", "div:advert", "div:sponsored", "aside:ad", "section:promo", "div:advertisement", "p:ad"],
        "comments": ["div:comments", "section:comments", "ol:comment", "div:replies", "section:discussion", "div:disqus", "ul:comments", "div:responses"],
        "form": ["form", "form:search", "form:login", "form:signup", "div:form"],
        "share": ["div:share", "ul:social", "div:follow", "div:meta", "p:byline"],
    }[kind]
    start, end = _open(r, 0, choices)
    if kind in ("nav", "share"):
        body = _links(r, r.randint(2, 9))
    elif kind == "comments":
        mark = r.choice(("", ' class="comment"', ' class="reply"'))
        tag = "li" if start[1:3] in ("ol", "ul") else r.choice(("div", "article", "li", "p"))
        body = (f"<h3>{_sentence(r, 2)}</h3>" if r.random() < 0.5 else "") + "".join(
            f"<{tag}{mark}><p>{_prose(r, r.randint(3, 60))}</p></{tag}>" if r.random() < 0.7 else f"<{tag}{mark}>{_prose(r, r.randint(3, 60))}</{tag}>" for _ in range(r.randint(1, 6))
        )
    elif kind == "form":
        body = f"<label>{_word(r)}</label><input name=q><p>{_sentence(r, 6)}</p><button>{_word(r)}</button>"
    elif kind == "side":
        body = f"<h3>{_sentence(r, 2)}</h3>" + (_links(r, r.randint(2, 7)) if r.random() < 0.6 else f"<p>{_prose(r, r.randint(5, 50))}</p>")
    else:
        text = ("&copy; " if kind == "footer" else "") + _prose(r, r.randint(2, 30))
        body = r.choice((text, f"<p>{text}</p>", text + _links(r, 2) if kind in ("footer", "header") else text))
    return start + body + end


def _article(r: random.Random) -> str:
    tags = ["article", "article", "article", "main", "div:content", "div:article", "div:post", "div:entry-content", "section:story", "section:main", "div:text", "div", "article:post", "div:body"]
    start, end = _open(r, 1, tags)
    heading = f"<h1>{_sentence(r, r.randint(1, 9))}</h1>"
    parts = [heading] if r.random() < 0.85 else []
    sizes = r.choice(((1, 2, 8, 30, 80, 200), (1, 2, 8, 30, 80, 200), (4, 8, 12), (60, 120, 300)))
    for _ in range(r.choice((0, 1, 1, 2, 3, 5, 8, 14, 40, 100))):
        kind, text = r.random(), _prose(r, r.choice(sizes))
        if kind < 0.62:
            parts.append(f"<p>{text}</p>")
        elif kind < 0.72:
            parts.append(f"<p><b>{text}<br>")
        elif kind < 0.78:
            parts.append(f"<p>{text}")
        elif kind < 0.83:
            parts.append(f"<h2>{_sentence(r, 4)}</h2><p>{text}</p>")
        elif kind < 0.88:
            parts.append("<ul>" + "".join(f"<li>{_sentence(r, r.randint(1, 12))}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
        elif kind < 0.92:
            parts.append(f"<blockquote>{text}</blockquote>")
        elif kind < 0.95:
            parts.append(f"<table><tr><td>{_word(r)}</td><td>{_word(r)}</td></tr><tr><td>{_word(r)}<td>{_sentence(r, 3)}</table>")
        else:
            parts.append(f"<div>{text}</div>")
    for _ in range(r.choice((0, 1, 1, 2, 3))):
        parts.insert(r.randint(0, len(parts)), _noise(r, r.choice(("ad", "share", "side", "notice", "form", "comments"))))
    if not parts:
        parts = [heading]
    if r.random() < 0.15:
        parts = ["<header>" + parts[0] + "</header>" if parts[0].startswith("<h1") else parts[0], *parts[1:]]
    return start + "".join(parts) + end


def sample_page(i: int) -> str:
    r = random.Random(f"page {i}")
    top = [_noise(r, k) for k in ("header", "nav", "notice", "ad") if r.random() < 0.6]
    tail = [_noise(r, k) for k in ("comments", "side", "ad", "nav", "form", "share", "notice") if r.random() < 0.35]
    if r.random() < 0.8:
        tail.append(_noise(r, "footer"))
    if r.random() < 0.08:
        top, tail = [], []
    r.shuffle(top)
    core = _article(r) if r.random() < 0.96 else ""
    before = [_noise(r, "side")] if r.random() < 0.15 else []
    if r.random() < 0.3:
        wrap = r.choice(("div", 'div class="wrapper"', 'div id="page"', 'div class="container"', "main", 'div class="content"'))
        core = f'<{wrap} data-y="0">' + "".join(before) + core + "".join(tail[:1]) + f"</{wrap.split()[0]}>"
        tail, before = tail[1:], []
    page = f"<!DOCTYPE html><html><head><title>{_sentence(r, 5)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
    page += "".join([*top, *before, core, *tail]) + "</body></html>"
    if r.random() < 0.1:
        page = "".join([*top, *before, core, *tail])
    return page[: r.randint(len(page) // 3, len(page))] if r.random() < 0.1 else page
