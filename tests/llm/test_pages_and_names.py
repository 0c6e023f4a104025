"""Pages whose article stands in odd wrappers, blocks with names that no labelled page has, and columns that clash by case."""

import pytest
from pyspark.sql import functions as F

from tuyere.llm import html_text, lang_id, pieces, queries, sharding
from tuyere.llm.labelled_pages import LABELLED, _AROUND, _INSIDE, _PROSE, _paragraphs

WEIGHTS = html_text.learn(LABELLED)
BODY = f"<h1>One</h1>{_paragraphs(0, 4)}"
WANTED = " ".join(["One", *(_PROSE[k] for k in range(4))])
LINKS = "<ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul>"
MORE = "<p>Readers of this page also liked the long story of the mill that was sold twice in one summer.</p>"
#: Names that stand on no labelled page.
UNKNOWN = "trending more-stories outbrain partner-offers feedback opinions teaser upsell up-next talkback user-responses shoutbox kommentare werbung cta paywall".split()


def text(page):
    return html_text.main_text(page, WEIGHTS)


def test_unknown_names_are_unknown():
    assert not {n for _, n, *_ in (*_AROUND, *_INSIDE)} & set(UNKNOWN)


@pytest.mark.parametrize(
    "page",
    [
        f'<body><form id="aspnetForm"><div class="content">{BODY}</div></form></body>',
        f'<body><form action="x"><div><input name="q"></div>{BODY}</form></body>',
        f'<body><div role="form"><article>{BODY}</article></div></body>',
        f'<body><fieldset><article>{BODY}</article></fieldset></body>',
        f"<body><nav>{LINKS}<main><article>{BODY}</article></main></body>",
        f"<body><header><div>Town Gazette</div><article>{BODY}</article></body>",
        f"<body><nav>{LINKS}<div>{BODY}</div></body>",
        f"<body><aside>{LINKS}<main>{BODY}</main></body>",
        f"<body><nav>{LINKS}</nav><header><h1>Gazette</h1>{LINKS}</header><article>{BODY}</article><form><p>Write to us about it, we read every letter that comes in.</p></form></body>",
        f"<body><article>{BODY}</article><dialog>{MORE}</dialog><footer>{MORE}</footer></body>",
    ],
)
def test_wrappers_stay_and_parts_go(page):
    assert text(page) == WANTED


@pytest.mark.parametrize("element", ["div", "section"])
@pytest.mark.parametrize("name", UNKNOWN)
def test_unknown_blocks_around_the_article_go(name, element):
    block = f'<{element} class="{name}">{MORE}</{element}>'
    assert text(f"<body><nav>{LINKS}</nav><article>{BODY}{block}</article></body>") == WANTED
    assert text(f'<body><div class="content">{BODY}</div>{block}</body>') == WANTED
    assert text(f'<body>{block}<div class="content">{BODY}</div></body>') == WANTED


@pytest.mark.parametrize("name", ["frobnicate", "epilogue", "x1"])
def test_unknown_blocks_in_the_article_stay(name):
    """Between plain paragraphs, as one of several alike, or where the page has no plain paragraphs."""
    words = "Readers of this page also liked"
    assert words in text(f'<body><article><h1>One</h1>{_paragraphs(0, 2)}<div class="{name}">{MORE}</div>{_paragraphs(2, 2)}</article></body>')
    assert text(f"<body><article><h1>One</h1>{''.join(f'<section class={name}>{_paragraphs(k, 2)}</section>' for k in range(4))}</article></body>").count("Engineers") == 2
    assert words in text(f'<body><article><h1>One</h1><div class="{name}">{_PROSE[0]}</div><div class="{name}2">{MORE}</div></article></body>')


def test_clashing_names_of_other_case(spark):
    df = spark.createDataFrame([(1, "<article><p>One two three</p></article>", "en")], "doc_id long, Html string, lang string").withColumns({c: F.lit("x") for c in ("Text", "N_chars", "Slot", "Shard", "Score", "Lang_Pred", "N_Tokens", "IDS", "Decoded")})
    got = html_text.extract(df, html_col="html")
    assert got.select("text", "n_chars").first() == ("One two three", 13) and "Slot" in got.columns
    placed = sharding.place(df, ["a", "b"])
    assert placed.select("slot", "shard").first().shard in ("a", "b")
    found = lang_id.identify(df, text_col="Html")
    assert found.select("lang_pred", "score").first().lang_pred == "en"
    coded = pieces.encode_pieces(df, queries.tokenizer_file("piece_bpe_32k.model"), text_col="Html")
    assert coded.select("n_tokens", "decoded").first().decoded.endswith("</article>")
    assert coded.count() == placed.count() == found.count() == 1
