"""Pages with marked main text, written for this library, from which the extraction weights are learned."""

_PROSE = [
    "The river rose slowly through the night and by morning the lower fields were under water. Farmers moved their animals to the ridge and waited for the rain to end.",
    "A small workshop near the station repairs clocks that no one else will take. Its owner learned the trade from a neighbour and has never advertised.",
    "In spring the market opens before dawn. Traders set out fruit, bread and tools, and the first buyers arrive while the lamps are still lit.",
    "Engineers measured the bridge for a year before they wrote their report. They found that the cables move more in heat than in wind.",
    "The library keeps its oldest maps in a cool room without windows. Readers may see them by appointment, and only with a pencil.",
]


def _paragraphs(first: int, n: int) -> str:
    return "".join(f"<p>{_PROSE[(first + k) % len(_PROSE)]}</p>" for k in range(n))


_LINKS = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "News", "Sport", "About us", "Contact"))

_BY_HAND = [
    f"<html><head><title>River</title></head><body><nav><ul>{_LINKS}</ul></nav><article><!--main--><h1>The river rises</h1>{_paragraphs(0, 4)}<!--/main--></article><footer>Published by the town</footer></body></html>",
    f'<html><body><div id="top"><ul>{_LINKS}</ul></div><div><div><!--main--><h1>Clocks</h1>{_paragraphs(1, 3)}<h2>Hours</h2>{_paragraphs(3, 2)}<!--/main--></div></div><div><ul>{_LINKS}</ul></div></body></html>',
    f'<html><body><header><a href="/">Site</a></header><main><div><a href="/a">Back</a></div><article><!--main--><h1>Market <i>day</i></h1>{_paragraphs(2, 5)}<ul><li>fruit and bread</li><li>tools</li></ul><!--/main--></article></main><aside>More</aside></body></html>',
    f'<html><body><table><tr><td><a href="/1">One</a></td><td><a href="/2">Two</a></td></tr></table><div><!--main--><h1>The bridge</h1><p>{_PROSE[3]}<br>{_PROSE[4]} See <a href="/r">the report</a>.</p>{_paragraphs(0, 2)}<!--/main--></div><div><a href="/x">Next page</a></div><div>All rights reserved</div></body></html>',
    f"<html><body><div><span>Search</span></div><section><!--main--><h2>Maps</h2>{_paragraphs(4, 6)}<!--/main--></section><section><ul>{_LINKS}</ul></section></body></html>",
    f"<html><body><nav><ul>{_LINKS}</ul></nav><article><!--main--><h1>Clocks</h1><div>{_PROSE[1]}</div><div class='byline'>By the editor</div><blockquote>{_PROSE[2]}</blockquote><table><tr><td>spring</td><td>12</td></tr><tr><td>summer</td><td>30</td></tr></table><ul><li>bread</li><li><a href='/t'>tools</a></li><li>lamps</li></ul><!--/main--></article><footer>All rights reserved</footer></body></html>",
    f"<html><body><article><!--main--><ul><li>rain</li><li><a href='/w'>wind</a></li></ul>{_paragraphs(3, 3)}<section><h2>More</h2><div><span>{_PROSE[0]}</span></div></section><dl><dt>heat</dt><dd>much</dd></dl><!--/main--></article><div>Share this page</div></body></html>",
    f"<html><body><div><ul>{_LINKS}</ul></div><main><!--main--><h1>Maps</h1><p>See <a href='/m'>the list of the maps</a> and {_PROSE[4]}</p><div>{_PROSE[2]}</div><ul><li>by <a href='/a'>appointment</a> only</li><li>with a pencil</li></ul>{_paragraphs(1, 2)}<table><tr><td>open</td><td>daily</td></tr></table><!--/main--></main><div>Imprint and contact</div></body></html>",
    f"<html><body><div><ul>{_LINKS}</ul></div><div><!--main--><h1>Bridges</h1><div>{_PROSE[3]}</div><div>{_PROSE[0]} {_PROSE[1]}</div><div>{_PROSE[4]}</div><!--/main--></div><div>Imprint</div><div><a href='/x'>Next page</a></div></body></html>",
    f"<html><body><div>Town news</div><div><!--main--><div>{_PROSE[2]}<br>{_PROSE[1]}</div><!--/main--></div><ul>{_LINKS}</ul></body></html>",
]

# Layouts: names that template authors give to the parts around and in an article, and to the article's own parts.
_AROUND = [
    ("div", "ad", "Buy two lamps today"), ("div", "ads", "Great offers"), ("div", "advert", "New shoes"), ("div", "advertisement", "Cheap flights"), ("div", "ad-box", "Try it now"), ("div", "ad-banner", "Half price"),
    ("div", "adSlot", "Order here"), ("div", "sponsor", "Paid for by a bank"), ("div", "sponsored", "Our partner"), ("div", "promo", "Win a journey"), ("div", "promotion", "This week only"), ("div", "promo-box", "Save now"),
    ("div", "cookie", "We use cookies"), ("div", "cookies", "Accept all"), ("div", "cookie-banner", "This site stores cookies"), ("div", "cookie-notice", "Cookies help us"), ("div", "consent", "I agree"), ("div", "gdpr", "Your privacy"),
    ("div", "notice", "The site moves on Sunday"), ("div", "notices", "Service notes"), ("div", "notice-bar", "New opening hours"), ("div", "notification", "You have mail"), ("div", "alert", "Storm warning"), ("div", "disclaimer", "No liability"),
    ("div", "banner", "Welcome"), ("div", "header", "Town Gazette"), ("div", "masthead", "The Daily Lamp"), ("div", "site-header", "Gazette"), ("div", "topbar", "Log in"), ("div", "toolbar", "Print"), ("div", "login", "Sign in"),
    ("div", "nav", "Home News"), ("div", "navbar", "Start Topics"), ("div", "navigation", "Older Newer"), ("div", "main-nav", "Home"), ("ul", "menu", "Home"), ("div", "main-menu", "Topics"), ("div", "breadcrumb", "Home / News"), ("ol", "breadcrumbs", "Home"), ("div", "skip", "To the text"),
    ("div", "pager", "1 2 3"), ("div", "pagination", "Next"), ("div", "sidebar", "Most read"), ("div", "left-sidebar", "Topics"), ("div", "sidebar-widget", "Weather"), ("div", "widget", "Stocks"), ("div", "widget-area", "Weather now"), ("div", "aside", "See also"),
    ("div", "related", "More on rivers"), ("div", "related-posts", "You may like"), ("div", "related-links", "Also read"), ("div", "recommended", "For you"), ("div", "share", "Share this"), ("div", "sharing", "Send it"), ("div", "share-buttons", "Post it"), ("div", "social", "Follow us"),
    ("div", "social-links", "Find us"), ("div", "social-share", "Tell friends"), ("div", "newsletter", "Get our mail"), ("div", "newsletter-signup", "Your address"), ("div", "signup", "Join"), ("div", "subscribe", "Subscribe now"), ("div", "subscription", "Try a month"),
    ("div", "popup", "One moment"), ("div", "modal", "Before you go"), ("div", "overlay", "Stay with us"), ("div", "footer", "Imprint"), ("div", "site-footer", "All rights reserved"), ("div", "footer-links", "Contact"), ("div", "copyright", "All rights reserved"),
    ("section", "comments", "I saw the flood myself, and it was worse than you write."), ("div", "comment", "Well said, thank you for this report."), ("ol", "comment-list", "First"), ("ul", "commentlist", "I disagree"), ("div", "comment-body", "So true"), ("div", "respond", "Leave a reply"),
    ("div", "replies", "Two replies"), ("div", "reply", "No, it was not"), ("div", "disqus-thread", "Best comments"), ("div", "user-comments", "I was there"), ("div", "reader-comments", "My view"), ("section", "discussion", "What do you think?"), ("article", "comment", "I walk there every day."),
    ("section", "comments", "My cellar was full too."), ("div", "comments", "Mine as well."), ("section", "comment-section", "Where were the wardens?"), ("section", "user-comments", "Thank you."), ("section", "related", "Other towns"), ("section", "newsletter", "Mail for you"),
    ("div", "adbox", "New coats"), ("div", "adslot", "Old wine"), ("div", "disqus", "Log in to write"), ("section", "promo", "Boots at half price"), ("aside", "sidebar", "Tides"), ("section", "ads", "Tea and cakes"), ("section", "sponsored", "A word from a friend"),
    ("article", "reply", "So do I."), ("article", "promo", "A lamp for you"), ("article", "related", "Another flood"), ("article", "ad", "A new car"),
]
_INSIDE = [
    ("p", "lead"), ("p", "intro"), ("p", "summary"), ("p", "first"), ("p", "drop-cap"), ("p", "text-body"), ("div", "byline"), ("div", "text"), ("div", "caption"), ("div", "quote"), ("div", "body-copy"), ("section", "chapter"), ("section", "part-one"), ("blockquote", "pull-quote"),
    ("p", "board-minutes"), ("p", "free-text"), ("div", "figure"), ("div", "story-part"), ("span", "date"), ("span", "place"), ("ul", "list"), ("table", "data-table"), ("p", "closing"), ("h2", "subhead"), ("h2", "section-title"),
]
_WRAPPERS = ["content", "page", "layout", "main-content", "post", "post-content", "entry", "entry-content", "story", "article-body", "container", "wrapper", "site", "hfeed", "col-main", "text-column", "layout has-sidebar", "page no-sidebar", "site with-header"]


def _around(k: int) -> str:
    element, name, text = _AROUND[k % len(_AROUND)]
    naming = "id" if k % 5 == 4 else "class"
    return f'<{element} {naming}="{name}" data-not><p>{text}</p></{element}>' if k % 2 else f'<{element} {naming}="{name}" data-not>{text}</{element}>'


def _layout(k: int) -> str:
    """Three parts before the article, one in it (in every other page at its end), three after it. The article's own blocks are
    in its middle, in every sixth page one is at its end."""
    own = ["".join(f'<{e} class="{n}">{_PROSE[(k + j) % 5] if e in ("p", "div", "section", "blockquote") else "Of rivers"}</{e}>') for j, (e, n) in enumerate(_INSIDE[(3 * k + i) % len(_INSIDE)] for i in range(4))]
    before, within, after = (_around(7 * k + i) for i in (0, 1, 2)), _around(7 * k + 3), (_around(7 * k + i) for i in (4, 5, 6))
    last = own.pop() if k % 6 == 1 else ""
    middle, tail = ("", within) if k % 2 else (within, "")
    main = f"<!--main--><h1>River and bridge</h1>{_paragraphs(k, 2)}{''.join(own)}{middle}{_paragraphs(k + 2, 2)}{tail}{last}<!--/main-->"
    two = f"<!--main--><article><h1>River and bridge</h1>{_paragraphs(k, 1)}{''.join(own)}{_paragraphs(k + 1, 1)}</article>{within}<article>{_paragraphs(k + 2, 2)}{last}</article><!--/main-->"
    around = [f"<article>{main}</article>", f"<main>{main}</main>", f"<div>{main}</div>", f"<div>{two}</div>"][k // 2 % 4]
    return f'<html><body><div class="{_WRAPPERS[k % len(_WRAPPERS)]}">{"".join(before)}{around}{"".join(after)}</div></body></html>'


#: Four tours through all names, so that each is seen in several places.
LABELLED = [*_BY_HAND, *map(_layout, range(4 * len(_AROUND) // 7))]
