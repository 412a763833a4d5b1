"""Labelled pages to train on: laid out by rules, in many forms, each block known to be of the article or not."""

from __future__ import annotations

import random

#: Page furniture, by the class or id words that such parts bear.
FURNITURE = {
    "nav": ["menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toc", "pagination", "tabs"],
    "header": ["header", "masthead", "topbar", "banner", "branding", "logo"],
    "footer": ["footer", "foot", "bottom", "copyright", "legal", "colophon"],
    "aside": ["sidebar", "aside", "related", "widget", "recommended", "trending", "popular", "rail", "secondary"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promoted"],
    "notice": ["cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "paywall", "gdpr"],
    "comments": ["comment", "comments", "replies", "reply", "discussion", "disqus", "respond", "commentlist"],
    "share": ["share", "social", "sharing", "follow", "tags"],
}
CONTENT = ["article", "content", "post", "entry", "story", "main", "body", "text", "page", "single"]
#: Words of folders that say nothing about what is in them, and the roles that say it.
NEUTRAL = ["wrapper", "container", "columns", "column", "left", "right", "row", "inner", "site", "center", "layout", "grid", "box", "col", "block", "area", "outer", "top", "middle"]
ROLES = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "aside": "complementary", "notice": "dialog"}
SHORT = "home about contact login register search next previous more menu subscribe share privacy terms help news".split()


def _words(r: random.Random, low: int, high: int) -> str:
    syllables = ["an", "er", "th", "on", "re", "st", "la", "de", "ie", "ou", "ción", "é", "sch", "ung", "ent", "ti"]
    out = []
    for k in range(r.randint(low, high)):
        word = "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
        out.append(word.capitalize() if k == 0 else word + ("," if r.random() < 0.06 else "." if r.random() < 0.08 else ""))
    text = " ".join(out)
    return text.upper() if r.random() < 0.05 else text + r.choice([".", ".", "", "!", "&amp;"])


def _attribute(r: random.Random, names: list[str]) -> str:
    if r.random() < 0.15:
        return ""
    return f' {r.choice(["class", "class", "id"])}="{r.choice(names)}{r.choice(["", "", "-inner", " box", "-1"])}"'


def _neutral(r: random.Random) -> str:
    return f"{r.choice(NEUTRAL)}{r.choice(['', '', '-' + r.choice(NEUTRAL), ' ' + r.choice(NEUTRAL)])}"


def _links(r: random.Random) -> str:
    """A bar of links that no list holds."""
    between = r.choice([" | ", " ", "<br>", " &middot; ", ", "])
    return between.join(f'<a href="/{k}">{r.choice(SHORT) if r.random() < 0.7 else _words(r, 1, 4)}</a>' for k in range(r.randint(2, 7)))


def _side(r: random.Random) -> str:
    """What stands beside an article in a folder without a telling name."""
    if r.random() < 0.3:
        return _furniture(r, r.choice(["aside", "nav", "ad"]))
    listed = "".join(f'<li><a href="/{k}">{_words(r, 1, 7)}</a>' for k in range(r.randint(1, 6)))
    return f"<h{(k := r.randint(2, 4))}>{_words(r, 1, 4)}</h{k}><ul>{listed}</ul>"


def _furniture(r: random.Random, kind: str) -> str:
    if kind in ROLES and r.random() < 0.12:
        inner = r.choice([_links(r), f"<h1>{_words(r, 1, 4)}</h1>", f"<ul><li>{_links(r)}</ul>"]) if kind in ("nav", "header") else f"<p>{_words(r, 2, 30)}</p>"
        return f'<div role="{ROLES[kind]}">{inner}</div>'
    if kind in ("nav", "header") and r.random() < 0.15:
        return f'<div class="{r.choice(FURNITURE[kind])}">{_links(r)}</div>'
    if kind == "comments" and r.random() < 0.25:
        return f'<ol class="{r.choice(FURNITURE[kind])}">' + "".join(f"<li>{_words(r, 1, 40)}</li>" for _ in range(r.randint(1, 5))) + "</ol>"
    tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "comments": "section"}.get(kind, "div")
    if r.random() < 0.35 and kind != "share":
        tag = "div"
    bare = tag in ("nav", "header", "footer", "aside") and r.random() < 0.5
    open_ = f"<{tag}>" if bare else f'<{tag} {r.choice(["class", "id"])}="{r.choice(FURNITURE[kind])}{r.choice(["", "", "-box", " wide"])}">'
    if kind == "nav" or kind in ("aside", "share") and r.random() < 0.6:
        inner = "<ul>" + "".join(f'<li><a href="/{k}">{r.choice(SHORT) if r.random() < 0.6 else _words(r, 1, 5)}</a></li>' for k in range(r.randint(2, 8))) + "</ul>"
    elif kind == "comments":
        inner = (f"<h3>{r.choice(['Comments', '3 replies', _words(r, 1, 3)])}</h3>" if r.random() < 0.6 else "") + "".join(f"<div class=\"comment\"><b>{_words(r, 1, 2)}</b><p>{_words(r, 3, 60)}</p></div>" if r.random() < 0.7 else f"<p>{_words(r, 3, 60)}</p>" for _ in range(r.randint(1, 4)))
    elif kind == "footer":
        inner = f"&copy; {r.choice(['2024', 'example.com'])} &middot; {_words(r, 2, 25)}" if r.random() < 0.6 else f"<p>{_words(r, 2, 20)}</p><p><a href=\"/t\">{r.choice(SHORT)}</a></p>"
    elif kind == "notice" and r.random() < 0.4:
        inner = f'<form><label>{_words(r, 2, 8)}</label><input type="text"><button>{r.choice(SHORT)}</button></form>'
    else:
        inner = r.choice([f"<p>{_words(r, 3, 40)}</p>", _words(r, 2, 40), f"<h2>{_words(r, 1, 5)}</h2><p>{_words(r, 3, 30)}</p>"])
    return f"{open_}{inner}</{tag}>"


def page(r: random.Random) -> str:
    """A page whose article's text stands between the characters 1 and 2."""
    mark = lambda s: f"\x01{s}\x02"
    body = []
    if r.random() < 0.9:
        heading = f"<h1>{mark(_words(r, 2, 10))}</h1>"
        body.append(f"<header>{heading}</header>" if r.random() < 0.15 else heading)
    for _ in range(r.randint(1, 10)):
        x = r.random()
        if x < 0.68:
            body.append(f"<p>{mark(_words(r, 1, 120))}</p>")
        elif x < 0.74:
            body.append(f"<p><b>{mark(_words(r, 1, 60))}<br>")
        elif x < 0.80:
            body.append(f"<h{(k := r.randint(2, 4))}>{mark(_words(r, 1, 8))}</h{k}>")
        elif x < 0.86:
            body.append("<ul>" + "".join(f"<li>{mark(_words(r, 1, 25))}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
        elif x < 0.90:
            body.append(f"<blockquote><p>{mark(_words(r, 4, 50))}</p></blockquote>")
        elif x < 0.915:
            body.append(f'<figure><img src="/x.png"><figcaption>{mark(_words(r, 2, 15))}</figcaption></figure>')
        elif x < 0.93:
            body.append(f"<pre>{mark(_words(r, 3, 30))}</pre>")
        elif x < 0.96:
            body.append("<table>" + "".join("<tr>" + "".join(f"<td>{mark(_words(r, 1, 5))}</td>" for _ in range(2)) + "</tr>" for _ in range(3)) + "</table>")
        else:
            body.append(_furniture(r, r.choice(["ad", "aside", "share", "notice"])))
    inner = "".join(body)
    x = r.random()
    if x < 0.06:
        return _in_tables(r, inner)
    if x < 0.16:
        comments = _furniture(r, "comments") if r.random() < 0.4 else ""
        article = f'<div class="{_neutral(r)}"><section{_attribute(r, CONTENT + NEUTRAL)}>{inner}</section>{comments}</div>'
        if r.random() < 0.8:
            article = f'<div class="{_neutral(r)}">{article}<div class="{_neutral(r)}">{_side(r)}</div></div>'
    elif x < 0.22:
        article = f'<div role="main">{inner}</div>'
    elif x < 0.55:
        article = f"<article{_attribute(r, CONTENT) if r.random() < 0.5 else ''}>{inner}{_furniture(r, 'comments') if r.random() < 0.15 else ''}</article>"
    elif x < 0.75:
        article = f"<main><div{_attribute(r, CONTENT)}>{inner}</div></main>"
    else:
        article = f'<div {r.choice(["class", "id"])}="{r.choice(CONTENT)}">{inner}</div>'
    before = [_furniture(r, k) for k in ("header", "nav", "ad", "notice", "aside") if r.random() < 0.5]
    after = [_furniture(r, k) for k in ("share", "comments", "aside", "ad", "notice", "footer") if r.random() < 0.45]
    r.shuffle(before)
    return f"<!DOCTYPE html><html><head><title>{_words(r, 2, 8)}</title><script>var a='<p>';</script><style>p{{}}</style></head><body>{''.join(before)}{article}{''.join(after)}</body></html>"


def _in_tables(r: random.Random, inner: str) -> str:
    """A page laid out by a table: bars of links in its other cells."""
    cell = lambda s: f"<td{r.choice(['', ' width=150', ' colspan=2', ' valign=top'])}>{s}</td>"
    side = [cell(r.choice([_links(r), f"<b>{_words(r, 1, 3)}</b><br>{_links(r)}"])) for _ in range(r.randint(0, 2))]
    rows = ["".join(side[:1] + [cell(inner)] + side[1:])]
    if r.random() < 0.8:
        rows.insert(0, cell(_links(r)))
    if r.random() < 0.8:
        rows.append(cell(r.choice([_links(r), f"{r.choice(['Copyright', '&copy;'])} {r.choice(['2001', '1998'])} {_words(r, 1, 8)}"])))
    return f"<html><head><title>{_words(r, 2, 8)}</title></head><body><table>{''.join(f'<tr>{x}' for x in rows)}</table></body></html>"


def labelled(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return [page(r) for _ in range(n)]
