"""Pages of layouts that the training pages of the model don't make, with their main text.

Each group was written before it was first measured. What failed in the first two (a
blog's site title, a recipe's short list) was named in changes to the training pages.
"""

import random

WORDS = "river stone market window letter garden winter engine paper silver morning bridge harbour village doctor teacher ocean mountain signal number station coffee summer candle forest travel history science music kitchen".split()


def _sentence(draw, low=6, high=16):
    found = " ".join(draw.choice(WORDS) for _ in range(draw.randrange(low, high)))
    return found.capitalize() + "."


def _text(draw, n=4):
    return " ".join(_sentence(draw) for _ in range(draw.randrange(1, n + 1)))


def forum(draw):
    title, posts = _sentence(draw, 3, 6), [_text(draw) for _ in range(3)]
    body = "".join(f"<p>{p}</p>" for p in posts)
    return (
        f"<html><body><div id='top-bar'><a href='/'>Board</a> | <a href='/faq'>FAQ</a> | <a href='/in'>Log in</a></div><div class='breadcrumbs'><a href='/'>Board</a> &raquo; <a href='/g'>General</a></div>"
        f"<div class='post-body'><h2>{title}</h2>{body}</div><div class='related'><b>Similar</b><ul><li><a href='/1'>{_sentence(draw, 2, 4)}</a></li><li><a href='/2'>{_sentence(draw, 2, 4)}</a></li></ul></div><div id='footer'>Powered by a board &copy; 2011</div></body></html>",
        "\n".join([title, *posts]),
    )


def news(draw):
    title, lead, rest = _sentence(draw, 4, 9), _text(draw, 2), [_text(draw) for _ in range(4)]
    paragraphs = "".join(f'<p class="paragraph-{i}">{p}</p>' for i, p in enumerate(rest))
    return (
        f"<html><body><header class='masthead'><a href='/'>The Paper</a><nav><a href='/w'>World</a><a href='/s'>Sport</a><a href='/c'>Culture</a></nav></header><main><article class='story'><h1>{title}</h1><p class='lead read-more'>{lead}</p>"
        f"<aside class='ad-box'>Advertisement <a href='/buy'>Buy now</a></aside>{paragraphs}</article></main><section class='most-popular'><h3>Most read</h3><ol><li><a href='/a'>{_sentence(draw, 3, 6)}</a></li><li><a href='/b'>{_sentence(draw, 3, 6)}</a></li></ol></section><footer><small>&copy; The Paper</small></footer></body></html>",
        "\n".join([title, lead, *rest]),
    )


def plain_divs(draw):
    title, parts = _sentence(draw, 3, 7), [_text(draw) for _ in range(5)]
    inner = "".join(f"<div>{p}</div>" for p in parts)
    return f"<html><body><div><a href='/'>Home</a> <a href='/x'>Contact</a></div><div><div><b>{title}</b></div>{inner}</div><div>&copy; 2004 Someone</div></body></html>", "\n".join([title, *parts])


def table_layout(draw):
    title, parts = _sentence(draw, 3, 7), [_text(draw) for _ in range(3)]
    inner = "".join(f"<p>{p}" for p in parts)
    return (
        f"<html><body><table width=100%><tr><td colspan=2><a href='/'>Home</a> <a href='/about'>About</a> <a href='/map'>Map</a></td></tr><tr><td width=20%><a href='/1'>One</a><br><a href='/2'>Two</a><br><a href='/3'>Three</a></td><td><h1>{title}</h1>{inner}</td></tr>"
        f"<tr><td colspan=2><font size=1>Copyright 2001 Us</font></td></tr></table></body></html>",
        "\n".join([title, *parts]),
    )


def manual(draw):
    title, parts, code = _sentence(draw, 2, 5), [_text(draw, 2) for _ in range(3)], "make all; make install"
    return (
        f"<html><body><nav id='toc'><ul><li><a href='#a'>Install</a><ul><li><a href='#b'>Build</a></li></ul></li><li><a href='#c'>Use</a></li></ul></nav><div role='main'><section><h1>{title}</h1><p>{parts[0]}</p><pre><code>{code}</code></pre><p>{parts[1]}</p><dl><dt>Note</dt><dd>{parts[2]}</dd></dl></section></div>"
        f"<div class='pager'><a href='/p'>Previous</a><a href='/n'>Next</a></div></body></html>",
        "\n".join([title, parts[0], code, parts[1], "Note", parts[2]]),
    )


def blog(draw):
    title, parts = _sentence(draw, 3, 8), [_text(draw) for _ in range(3)]
    inner = "".join(f"<p>{p}</p>" for p in parts)
    return (
        f"<body><div id='page'><div id='header' role='banner'><h1><a href='/'>My blog</a></h1><p>Just another blog</p></div><div id='content' class='narrowcolumn'><div class='post' id='post-7'><h2>{title}</h2><div class='entry'>{inner}</div></div>"
        f"<h3 id='comments'>Two responses</h3><ol class='commentlist'><li class='alt'><cite>Ann</cite> says:<p>{_text(draw, 2)}</p></li><li><cite>Bo</cite> says:<p>{_text(draw, 2)}</p></li></ol><form id='commentform'><textarea>Write</textarea><button>Send</button></form></div>"
        f"<div id='sidebar'><ul><li><h2>Archives</h2><ul><li><a href='/a'>May</a></li></ul></li></ul></div><div id='footer'><p>My blog runs on software</p></div></div></body>",
        "\n".join([title, *parts]),
    )


def recipe(draw):
    title, intro, steps = _sentence(draw, 2, 5), _text(draw, 2), [_sentence(draw) for _ in range(4)]
    needs = [" ".join(draw.choice(WORDS) for _ in range(2)) for _ in range(5)]
    return (
        f"<html><body><div class='site-head'><div class='logo'><a href='/'>Kitchen notes</a></div><ul class='nav-list'><li><a href='/s'>Soups</a></li><li><a href='/b'>Bread</a></li></ul></div><div class='recipe-card' itemscope><h1 itemprop='name'>{title}</h1><p>{intro}</p><h3>Ingredients</h3>"
        f"<ul class='ingredients'>{''.join(f'<li>{x}</li>' for x in needs)}</ul><h3>Method</h3><ol>{''.join(f'<li>{x}</li>' for x in steps)}</ol></div><div class='newsletter-box'><p>Get our letters</p><form><input name='mail'><button>Join</button></form></div><div class='copyright'>&copy; Kitchen notes</div></body></html>",
        "\n".join([title, intro, "Ingredients", *needs, "Method", *steps]),
    )


def press_release(draw):
    title, parts, about = _sentence(draw, 5, 10), [_text(draw) for _ in range(4)], _text(draw, 2)
    return (
        f"<body><div id='wrap'><div id='masthead'><h1><a href='/'>Acme Works</a></h1><p class='tagline'>Things that last</p></div><div id='menu'><a href='/a'>Products</a> <a href='/b'>Press</a></div><div id='main'><h2>{title}</h2><p class='date'>12 May 2009</p>{''.join(f'<p>{x}</p>' for x in parts)}<h4>About us</h4><p>{about}</p></div>"
        f"<div id='sub'><h4>Press contact</h4><ul><li><a href='/mail'>Write to us</a></li><li><a href='/kit'>Press kit</a></li></ul></div><div id='foot'>All rights reserved</div></div></body>",
        "\n".join([title, "12 May 2009", *parts, "About us", about]),
    )


def wiki(draw):
    title, lead, heads, parts = _sentence(draw, 1, 4), _text(draw), [_sentence(draw, 1, 3) for _ in range(2)], [_text(draw) for _ in range(2)]
    inner = "".join(f"<h2><span class='headline'>{h}</span></h2><p>{p}</p>" for h, p in zip(heads, parts, strict=True))
    return (
        f"<html><body><div id='mw-page'></div><div id='content' role='main'><h1 id='firstHeading'>{title}</h1><div id='bodyContent'><p>{lead}</p><div id='toc' role='navigation'><ul><li><a href='#1'>{heads[0]}</a></li><li><a href='#2'>{heads[1]}</a></li></ul></div>{inner}</div></div>"
        f"<div id='navigation' role='navigation'><ul><li><a href='/m'>Main page</a></li><li><a href='/r'>Random page</a></li></ul></div><footer role='contentinfo'><ul><li>Last edited yesterday.</li><li><a href='/p'>Privacy</a></li></ul></footer></body></html>",
        "\n".join([title, lead, *(x for pair in zip(heads, parts, strict=True) for x in pair)]),
    )


def question(draw):
    title, asked, answers = _sentence(draw, 5, 9), _text(draw), [_text(draw, 3) for _ in range(2)]
    return (
        f"<html><body><header><a class='brand' href='/'>Ask here</a><form role='search'><input><button>Search</button></form></header><nav><ul><li><a href='/q'>Questions</a></li><li><a href='/t'>Topics</a></li></ul></nav><main><section class='entry'><h1>{title}</h1><div class='prose'><p>{asked}</p></div></section>"
        f"<section class='entry'><div class='prose'><p>{answers[0]}</p></div></section><section class='entry'><div class='prose'><p>{answers[1]}</p></div></section></main><aside><h4>Linked</h4><ul><li><a href='/5'>{_sentence(draw, 4, 7)}</a></li></ul></aside></body></html>",
        "\n".join([title, asked, *answers]),
    )


def magazine(draw):
    title, author, parts, quote = _sentence(draw, 4, 9), "By Ann Smith", [_text(draw) for _ in range(4)], _sentence(draw)
    return (
        f"<html><body><div class='skip'><a href='#m'>Skip to text</a></div><header id='top'><div class='brand'><a href='/'>The Review</a></div><nav aria-label='sections'><a href='/b'>Books</a><a href='/f'>Film</a><a href='/m'>Music</a></nav></header><div class='layout'><main id='m'><header><h1>{title}</h1><p>{author}</p></header><p>{parts[0]}</p><p>{parts[1]}</p><blockquote><p>{quote}</p></blockquote>"
        f"<div class='sponsored'><span>Sponsored</span><a href='/ad'>Try our wine club</a></div><p>{parts[2]}</p><p>{parts[3]}</p></main><aside class='rail'><h3>More stories</h3><ul><li><a href='/1'>{_sentence(draw, 4, 8)}</a></li><li><a href='/2'>{_sentence(draw, 4, 8)}</a></li></ul></aside></div><footer><p>Copyright The Review</p><ul><li><a href='/t'>Terms</a></li></ul></footer></body></html>",
        "\n".join([title, author, *parts[:2], quote, *parts[2:]]),
    )


def course(draw):
    title, goal, rows, text = _sentence(draw, 2, 5), _text(draw, 2), [(f"Week {i}", _sentence(draw, 3, 6)) for i in range(1, 5)], _text(draw)
    return (
        f"<html><body><div id='banner'><img src='a.png'><a href='/'>University</a></div><div id='leftnav'><ul><li><a href='/p'>People</a></li><li><a href='/c'>Courses</a></li></ul></div><div id='text'><h1>{title}</h1><p>{goal}</p><table border=1><tr><th>When</th><th>What</th></tr>{''.join(f'<tr><td>{a}</td><td>{b}</td></tr>' for a, b in rows)}</table><h2>Reading</h2><p>{text}</p></div><hr><address>Page by the office</address></body></html>",
        "\n".join([title, goal, "When", "What", *(x for r in rows for x in r), "Reading", text]),
    )


def shop_help(draw):
    title, pairs = _sentence(draw, 2, 5), [(_sentence(draw, 4, 8), _text(draw, 2)) for _ in range(4)]
    return (
        f"<html><body><div class='cookie-bar'>We use cookies <button>Accept</button></div><div class='topbar'><a href='/cart'>Cart</a> <a href='/me'>Account</a></div><div class='page-container'><section class='faq-content'><h1>{title}</h1>{''.join(f'<div class=item><h3>{a}</h3><div>{b}</div></div>' for a, b in pairs)}</section><section class='help-form'><form><p>Ask us something else</p><textarea>Your text</textarea><button>Send</button></form></section></div><div class='site-footer'><ul><li><a href='/r'>Returns</a></li></ul><p>The shop, 2015</p></div></body></html>",
        "\n".join([title, *(x for pair in pairs for x in pair)]),
    )


FAMILIES = (forum, news, plain_divs, table_layout, manual, blog)
#: Written after the others had been looked at, before site titles and headings of comments were added to the training pages.
LATER = (recipe, press_release, wiki, question)
#: Written after that, and not used for any change since.
LAST = (magazine, course, shop_help)


def pages(each=10, seed=99, families=FAMILIES):
    """(family, page, main text)"""
    for family in families:
        draw = random.Random(f"{seed}-{family.__name__}")
        for _ in range(each):
            yield family.__name__, *family(draw)
