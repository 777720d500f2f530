"""What belongs to an article whatever its ids and classes say, and what does not, on pages made from known parts."""

import random

from quillspan.llm.html_extract import extract

PROSE = "This is a paragraph of running prose that says something worth keeping about {}. It goes on for a while."


def para(topic):
    return f"<p>{PROSE.format(topic)}</p>"


def test_ids_and_classes_of_text_drop_nothing():
    page = f"""<body><article>{para('one')}<h2 id="related-work">Related work</h2>{para('two')}<h2 id="menu">The menu</h2><p class="share-price" id="share">The price rose.</p>
<section id="social-impact">{para('impact')}</section><div class="lead-ad-hoc">{para('hoc')}</div><ul id="notice"><li class="promo-item">A point.</li></ul></article></body>"""
    want = [PROSE.format("one"), "Related work", PROSE.format("two"), "The menu", "The price rose.", PROSE.format("impact"), PROSE.format("hoc")]
    assert extract(page, None).split("\n\n")[:7] == want


def test_what_goes_within_an_article():
    page = f"""<article>{para('one')}<section id="comments">{para('reader')}</section><div class="comments">{para('other reader')}</div><div class="related-posts"><a href="/x">Read this one too</a></div>
<div class="newsletter-box">Mail <form><input name="m"></form></div><div class="ad">Buy!</div><form><p>Your name</p></form></article>"""
    assert extract(page, None) == PROSE.format("one")


def test_a_form_around_the_page_is_a_wrapper():
    page = f'<body><form id="aspnetForm"><div class="menu"><a href="/">Home</a></div><div class="content">{para("one")}{para("two")}</div><div class="footer">Foot</div></form></body>'
    assert extract(page, None) == f"{PROSE.format('one')}\n\n{PROSE.format('two')}"
    page = f'<body><div class="content">{para("one")}{para("two")}</div><form><p>Search here</p></form></body>'
    assert extract(page, None) == f"{PROSE.format('one')}\n\n{PROSE.format('two')}"


def test_an_article_in_pieces():
    page = f'<body><div class="top">Short head</div><div class="part-1">{para("one")}{para("two")}</div><div class="ad">Buy!</div><div class="part-2">{para("three")}</div><div class="end">The end</div></body>'
    assert extract(page, None).split("\n\n") == [PROSE.format(t) for t in ("one", "two", "three")]
    # A sibling with little prose is no piece.
    page = f'<body><div class="part-1">{para("one") * 4}</div><div class="part-2"><p>Imprint.</p></div></body>'
    assert "Imprint" not in extract(page, None)


def test_random_pages_of_known_parts():
    """Every kept block, in order, and none of the others."""
    rng = random.Random(11)
    noise = ['<div class="ad">Buy now</div>', '<nav><a href="/">Home</a></nav>', "<aside><p>Aside</p></aside>", '<div id="sidebar">Links</div>', "<form>Mail <input></form>", '<div class="cookie">We bake</div>', "<script>var x = '<p>no</p>'</script>", '<section class="comments"><p>Me too</p></section>']
    for k in range(60):
        kept, body = [], []
        for i in range(rng.randint(3, 12)):
            text = PROSE.format(f"{k} {i}")
            tag = rng.choice(["p", "h2", "blockquote", "li"])
            name = rng.choice(["", ' id="banner"', ' class="widget-like"', ' id="share"'])
            body.append(f"<ul><li{name}>{text}</li></ul>" if tag == "li" else f"<{tag}{name}>{text}</{tag}>")
            kept.append(text)
            if rng.random() < 0.5:
                body.append(rng.choice(noise))
        around = rng.choice(["<article>{}</article>", "<main><div>{}</div></main>", '<form><div class="x"><article>{}</article></div></form>'])
        page = f"<html><head><title>T</title></head><body><header><h1>Site</h1></header>{around.format(''.join(body))}<footer>Foot</footer></body></html>"
        assert extract(page, None).split("\n\n") == kept, page


def test_very_long_texts():
    page = "<article>" + para("one") * 20_000 + "</article>"
    assert extract(page, None).count("\n\n") == 19_999
