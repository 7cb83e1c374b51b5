"""Labelled pages: page source and the main text that a reader marked in it.

Small pages written by hand, and :func:`composed` ones: layouts drawn by a seed, with and
without telling names and elements, of menus, notices, adverts, forms, share bars, lists of links,
comments of readers and footers around and inside articles of made-up words.
"""

from __future__ import annotations

import random

PAGES = [
    (
        """<html><head><title>River levels</title><script>var a = "<p>";</script></head><body>
<header><a href="/">Daily Current</a><nav><ul><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav></header>
<article><h1>River levels fall after a dry month</h1><p>Gauges along the lower valley showed <b>record lows</b> on Monday, the water board said.</p>
<p>Boats were asked to keep to the deeper channel until rain returns, and two ferries stopped for the week.</p></article>
<footer>&copy; Daily Current &middot; <a href="/t">Terms</a></footer></body></html>""",
        """River levels fall after a dry month
Gauges along the lower valley showed record lows on Monday, the water board said.
Boats were asked to keep to the deeper channel until rain returns, and two ferries stopped for the week.""",
    ),
    (
        """<body><div class="cookie-notice">We use cookies. <button>Accept</button></div><ul class="menu"><li><a href="/1">Home</a></li><li><a href="/2">Recipes</a></li></ul>
<div id="content"><h2>Barley soup</h2><p>Wash the barley and let it stand overnight.<p>Fry onions slowly in butter, add the barley and a litre of stock, and cook for an hour.
<ul><li>200 g barley</li><li>two onions</li><li>one litre of stock</li></ul><div class="ad">Knives at half price this week only, order now.</div><p>Serve with chopped parsley.</div>
<form action="/sub"><label>Mail</label><input name="m"><button>Subscribe</button></form></body>""",
        """Barley soup
Wash the barley and let it stand overnight.
Fry onions slowly in butter, add the barley and a litre of stock, and cook for an hour.
200 g barley
two onions
one litre of stock
Serve with chopped parsley.""",
    ),
    (
        """<html><body><nav><a href="/a">Start</a> <a href="/b">Archive</a> <a href="/c">About us</a></nav><main><h1>On keeping bees in town</h1>
<p>Roof gardens offer bees more flowers than many fields do. A small colony finds what it needs within a kilometre.</p><h2>What to look for</h2>
<p>Choose a place out of the wind, with morning sun and <a href="/w">water</a> close by.</p></main><aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">Ten hives</a></li><li><a href="/y">Honey prices</a></li></ul></aside>
<section id="comments"><p>Anna: I tried this and it went very well for three summers.</p><p>Jo: Mind the neighbours.</p></section><footer>Imprint</footer></body></html>""",
        """On keeping bees in town
Roof gardens offer bees more flowers than many fields do. A small colony finds what it needs within a kilometre.
What to look for
Choose a place out of the wind, with morning sun and water close by.""",
    ),
    (
        """<html><body><div class="banner">Summer sale</div><div>Skip to text</div><table><tr><td><a href="1">One</a></td><td><a href="2">Two</a></td></tr></table>
<p>The committee met four times in the spring and agreed on a plan for the harbour wall.</p><p>Work begins in June. The eastern part stays open to small boats throughout.</p><blockquote>It is a good plan, said the harbour master.</blockquote>
<div class="share"><a href="s">Share</a> <a href="m">Mail</a></div><p><small>Contact | Privacy</small></p></body></html>""",
        """The committee met four times in the spring and agreed on a plan for the harbour wall.
Work begins in June. The eastern part stays open to small boats throughout.
It is a good plan, said the harbour master.""",
    ),
    # pages of a few words, and of nothing but furniture
    ("<p>Closed today", "Closed today"),
    ("Under construction", "Under construction"),
    ("<body><nav><a href=1>Home</a> <a href=2>Archive</a></nav></body>", ""),
    ("<nav>Home Archive Contact</nav>", ""),
    ("<nav>Rooms Prices Booking</nav><!-- no text yet -->", ""),
    ("<nav><p>Week Month Year</p></nav>", ""),
    ("<body><nav>Up Down</nav><nav>First Last</nav></body>", ""),
    ("<nav>Maps and plans</nav><p>The path is closed.</p>", "The path is closed."),
    ("<body><div class=banner>Sale ends Sunday</div><footer>All rights reserved</footer></body>", ""),
    ("<div class=advert>Order now</div>The office is closed on Monday.", "The office is closed on Monday."),
    ("<article><h1>Bread</h1><p>Flour, water and salt.</p><form><label>Mail</label><button>Send</button></form><p>Bake for an hour.</p></article>", "Bread\nFlour, water and salt.\nBake for an hour."),
    ("<main><h1>Notice</h1><form action=q>Search</form><p>The pool opens in May.</p></main><footer>Imprint</footer>", "Notice\nThe pool opens in May."),
    (
        "<div class=k1><a href=1>Start</a> <a href=2>Shop</a></div><div class=k2><p>The mill was sold in the autumn to a couple from the coast who want to grind again.</p></div><div class=k3><h3>Comments</h3><p>Eva: We wish them well.</p><p>Tom: So good to hear it turning again.</p></div>",
        "The mill was sold in the autumn to a couple from the coast who want to grind again.",
    ),
]

SYLLABLES = "ka lo mi ren tos ul va shi no pe dra len ost im gu fa ber sel on ty".split()
#: Names that tell, by what they stand around; the last are names of content that only look telling.
TELLING = {
    "menu": ["nav", "menu", "navbar", "top-menu", "breadcrumb", "main-navigation"],
    "notice": ["cookie-notice", "consent", "gdpr", "alert", "cookie-banner"],
    "ad": ["ad", "ads", "advert", "sponsored", "promo", "banner"],
    "form": ["newsletter", "subscribe", "signup", "search-form", "subscription"],
    "share": ["share", "sharing", "social", "share-buttons", "toolbar"],
    "list": ["sidebar", "related", "recommended", "widget", "more-stories"],
    "comments": ["comments", "comment-list", "disqus", "replies", "discussion"],
    "footer": ["footer", "site-footer", "legal", "imprint"],
    "header": ["header", "masthead", "site-header", "top"],
    "body": ["content", "post-body", "entry", "story", "article-text"],
    "inset": ["share-price", "fact", "note-on-method", "comment-by-the-board", "search-results-of-the-survey", "quote", "key-points"],
}
MENU = "Home News Sport Weather Contact About Archive Start Login Help Search".split()
NOTICES = ["We use cookies to improve this site.", "Accept all cookies?", "This site uses cookies. Read our privacy policy.", "Please turn off your ad blocker."]
ADS = ["Advertisement", "Sponsored: shoes at half price this week only, order now.", "Buy now and save twenty percent.", "Our partner offers you a free trial today.", "Sale ends Sunday, shop today."]
FORMS = ["Subscribe to our newsletter", "Sign up for free", "Your e-mail address", "Search this site", "Leave a reply"]
SHARES = ["Share", "Tweet", "Mail", "Print", "Follow us", "Copy link"]
FOOTERS = ["Copyright 2021, all rights reserved.", "Imprint | Privacy | Terms", "Contact | Privacy policy", "Terms of use", "Powered by the press office"]
HEADS = ["Comments", "3 comments", "Discussion", "Leave a reply", "Reader comments", "What readers say"]
#: Headlines of articles about what elsewhere is furniture.
TOPICS = ["Comments on the {}", "Discussion of the {}", "What readers say about {}", "The most read {}", "Search for the {}", "Cookies and {}", "More stories from {}", "Why we {} and share", "Home of the {}", "News from {}"]
RELATED = ["Related", "Read more", "Most read", "You may also like", "More stories"]


def composed(seed: int) -> tuple[str, str]:
    """A page and its main text, both determined by the seed."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.choice((2, 2, 3, 3))))
    telling = rng.random() < 0.6
    main: list[str] = []

    def sentence(least: int = 4, most: int = 18) -> str:
        words = [word() for _ in range(rng.randint(least, most))]
        return words[0].capitalize() + " " + " ".join(words[1:]) + rng.choice(("." * 9) + "?")

    def named(kind: str, always: bool = False) -> str:
        name = rng.choice(TELLING[kind]) if telling or always else rng.choice(("{}", "{}-{}", "{}{}")).format(word(), rng.randint(1, 99))
        return f' {rng.choice(("class", "class", "id"))}="{name}"' if telling or always or rng.random() < 0.7 else ""

    def links(texts: list[str]) -> str:
        item = rng.choice(("<li>{}</li>", "<li>{}</li>", "{} ", "<div>{}</div>", "<td>{}</td>"))
        plain = rng.random() < 0.15
        inner = "".join(item.format(t if plain else f'<a href="/{k}">{t}</a>') for k, t in enumerate(texts))
        return f"<ul>{inner}</ul>" if "li" in item else f"<table><tr>{inner}</tr></table>" if "td" in item else inner

    def wrapped(kind: str, inner: str, tags: tuple[str, ...]) -> str:
        tag = rng.choice(tags) if telling or rng.random() < 0.4 else "div"
        return f"<{tag}{named(kind)}>{inner}</{tag}>"

    def block(text: str, tag: str = "p") -> str:
        main.append(text)
        k = rng.randrange(6)
        if k == 0 and tag == "p":
            first, _, rest = text.partition(" ")
            return f"<p><b>{first}</b> {rest}</p>"
        if k == 1 and tag == "p":
            first, _, rest = text.partition(" ")
            return f'<p>{first} <a href="/w">{rest.split(" ")[0]}</a> {" ".join(rest.split(" ")[1:])}</p>' if rest else f"<p>{text}</p>"
        return f"<{tag}>{text}</{tag}>"

    def furniture(kind: str) -> str:
        if kind == "ad":
            if rng.random() < (0.5 if telling else 0.2):  # of whole sentences, which only their place and names give away
                inner = "".join(f"<p>{sentence(5, 14)} {sentence(5, 14) if rng.random() < 0.5 else ''}</p>" for _ in range(rng.randint(1, 3)))
            else:
                inner = rng.choice(("<p>{}</p>", "{}")).format(rng.choice((rng.choice(ADS), f"{rng.choice(ADS)} {sentence(3, 7)}")))
            return wrapped("ad", inner, ("div", "aside", "section"))
        if kind == "share":
            return wrapped("share", links(rng.sample(SHARES, 3)), ("div", "ul", "nav"))
        if kind == "form":
            return f'<form action="/s"{named("form")}><label>{rng.choice(FORMS)}</label><input name="q"><button>Go</button></form>' if rng.random() < 0.6 else wrapped("form", f"<p>{rng.choice(FORMS)}</p>", ("div", "section"))
        if kind == "list":
            return wrapped("list", f"<h3>{rng.choice(RELATED)}</h3>" + links([f"{word()} {word()} {word()}".capitalize() for _ in range(rng.randint(2, 6))]), ("aside", "div", "section"))
        if kind == "notice":
            return wrapped("notice", rng.choice(("<p>{}</p>", "{} <button>Accept</button>")).format(rng.choice(NOTICES)), ("div", "dialog", "section"))
        people = [f"{word().capitalize()}: {sentence(4, 14)}" if rng.random() < 0.6 else f"<b>{word().capitalize()}</b> {rng.randint(1, 9)} hours ago</p><p>{sentence(4, 14)}" for _ in range(rng.randint(1, 5))]
        return wrapped("comments", f"<h{rng.randint(2, 4)}>{rng.choice(HEADS)}</h3>" + "".join(f"<p>{x}</p>" for x in people), ("section", "div", "aside"))

    def body() -> str:
        headline = rng.choice(TOPICS).format(f"{word()} {word()}") if rng.random() < 0.2 else sentence(3, 9).rstrip(".?")
        parts = [block(headline, rng.choice(("h1", "h1", "h2")))] if rng.random() < 0.85 else []
        for _ in range(rng.randint(1, 3) if rng.random() < 0.25 else rng.randint(2, 9)):
            k = rng.random()
            if k < 0.05:
                parts.append(block(word().capitalize() + "."))
            elif k < 0.62:
                parts.append(block(" ".join(sentence() for _ in range(rng.randint(1, 4)))))
            elif k < 0.70:
                parts.append(block(sentence(2, 6).rstrip(".?"), "h2"))
            elif k < 0.78:
                parts.append("<ul>" + "".join(block(f"{word()} {word()}" if rng.random() < 0.5 else sentence(3, 7), "li") for _ in range(rng.randint(2, 4))) + "</ul>")
            elif k < 0.81:  # an article may be a list of links
                titles = [" ".join(word() for _ in range(rng.randint(2, 5))).capitalize() for _ in range(rng.randint(3, 8))]
                if rng.random() < 0.4:
                    parts.append(block(word().capitalize(), "h2"))
                main.extend(titles)
                parts.append("<ul>" + "".join(f'<li><a href="/{x}">{t}</a></li>' for x, t in enumerate(titles)) + "</ul>")
            elif k < 0.84:
                cells = [[f"{word()} {word()}" if rng.random() < 0.3 else word().capitalize(), str(rng.randint(1, 999))] for _ in range(rng.randint(2, 5))]
                main.extend(c for row in cells for c in row)
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in cells) + "</table>")
            elif k < 0.86:
                parts.append(block(sentence(5, 14), "blockquote"))
            elif k < 0.90:
                parts.append(f"<div{named('inset', True)}>{block(sentence(3, 8))}</div>")
            else:
                parts.append(furniture(rng.choice(("ad", "ad", "share", "form", "list"))))
        return "".join(parts)

    top = wrapped("header", f'<a href="/">{word().capitalize()} {word()}</a>' + (wrapped("menu", links(rng.sample(MENU, rng.randint(3, 7)) if rng.random() < 0.7 else [word() for _ in range(rng.randint(2, 5))]), ("nav", "nav", "div", "ul"))), ("header", "div"))
    before = "".join(furniture(k) for k in ("notice", "ad", "list") if rng.random() < 0.4)
    text = body() if rng.random() < 0.96 else ""  # a page may hold no article
    tag = rng.choice(("article", "article", "main", "div", "div", "div", "section", ""))
    text = f"<{tag}{named('body') if tag == 'div' else ''}>{text}</{tag}>" if tag else text
    after = "".join(furniture(k) for k in ("share", "comments", "list", "form", "ad") if rng.random() < 0.5)
    said = rng.choice((rng.choice(FOOTERS), f"{rng.choice(FOOTERS)} {sentence(4, 16)}", f"© {word()}.example.org · " + " ".join(sentence() for _ in range(rng.randint(1, 3)))))
    foot = wrapped("footer", rng.choice(("<p>{}</p>", "{}", "<small>{}</small>")).format(said) + (links(["Privacy", "Terms", "Contact"]) if rng.random() < 0.5 else ""), ("footer", "div"))
    return f"<html><body>{top}{before}{text}{after}{foot}</body></html>", "\n".join(main)
