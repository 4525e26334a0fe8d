"""Extraction from pages written by hand: articles of one block, parted by line breaks, with inserts, in several scripts."""

import pytest

from prismloom.llm import htmlmain
from test_layouts import TEXT

#: Pages looked at while the drawn layouts were chosen; articles and their blocks.
SEEN = {
    "blog": (
        '<!DOCTYPE html><html><head><title>Bread - My Kitchen</title><style>a{}</style></head><body class="home blog"><div id="page"><header id="masthead"><h1 class="site-title"><a href="/">My Kitchen</a></h1><p class="tagline">Recipes since 2009</p></header><nav><a href="/">Home</a><a href="/about">About</a></nav><div id="primary"><div class="post hentry"><h2 class="entry-title">How to bake rye bread</h2><div class="entry-content"><p>Rye bread needs time more than skill. Start the evening before with a cup of flour and a cup of water.</p><p>In the morning the dough should smell sour and show small bubbles.</p><ul><li>500 g rye flour</li><li>350 ml water</li><li>10 g salt</li></ul><p>Bake for an hour and let it rest for a day. It keeps for two weeks.</p></div></div><div id="comments"><h3>2 comments</h3><ol class="commentlist"><li><div class="comment-body"><p>Thanks, mine came out very well and the children loved it a lot.</p></div></li><li><div class="comment-body"><p>I used spelt flour instead. It works too.</p></div></li></ol></div></div><div id="secondary" class="widget-area"><h3>Archives</h3><ul><li><a href="/1">May</a></li><li><a href="/2">June</a></li></ul></div><footer><p>Powered by nothing. Copyright 2020.</p></footer></div></body></html>',
        [
            "How to bake rye bread",
            "Rye bread needs time more than skill. Start the evening before with a cup of flour and a cup of water.",
            "In the morning the dough should smell sour and show small bubbles.",
            "500 g rye flour",
            "350 ml water",
            "10 g salt",
            "Bake for an hour and let it rest for a day. It keeps for two weeks.",
        ],
    ),
    "news": (
        '<html><body><div class="cookie-banner">We use cookies to improve this site. <button>Accept</button></div><div class="topbar"><a href="/">Front page</a> <a href="/s">Sport</a> <a href="/m">Money</a></div><main><article><h1>Ferry service to end in autumn</h1><p>The ferry between the two islands will make its last trip in October, the company said on Monday.</p><div class="ad-slot">Advertisement</div><p>Fewer than forty passengers a day took the boat last winter, and fuel has become dear.</p><aside class="newsletter"><p>Get our newsletter every morning.</p></aside><p>"We have tried everything," said a spokesman. "There is no money left."</p><p>Islanders plan to ask the county for help.</p></article></main><aside><h2>Most read</h2><ol><li><a href="/a">Storm closes school</a></li><li><a href="/b">Man finds ring</a></li></ol></aside><footer><a href="/t">Terms</a> <a href="/p">Privacy</a></footer></body></html>',
        [
            "Ferry service to end in autumn",
            "The ferry between the two islands will make its last trip in October, the company said on Monday.",
            "Fewer than forty passengers a day took the boat last winter, and fuel has become dear.",
            '"We have tried everything," said a spokesman. "There is no money left."',
            "Islanders plan to ask the county for help.",
        ],
    ),
    "old": (
        "<html><body bgcolor=white><table width=100%><tr><td width=150><a href=a.html>Start</a><br><a href=b.html>Links</a><br><a href=c.html>Guest book</a></td><td><h2>The lighthouse</h2>It was built in 1874 by two brothers who had lost a ship on the rocks below. <p>For ninety years a keeper lived there with his family.<p>Today the light is switched on by a clock, and the house stands empty.</td></tr></table><hr><center><small>&copy; 1999 Webmaster</small></center></body></html>",
        [
            "The lighthouse",
            "It was built in 1874 by two brothers who had lost a ship on the rocks below.",
            "For ninety years a keeper lived there with his family.",
            "Today the light is switched on by a clock, and the house stands empty.",
        ],
    ),
    "ru": (
        '<html><body><nav><a href="/">Главная</a><a href="/n">Новости</a></nav><div class="container"><div class="row"><h1>Новый мост через реку</h1><p>Комитет обсудил во вторник планы строительства нового моста рядом со старой мельницей.</p><p>Жители поддержали проект, хотя некоторые опасаются шума и пробок в течение двух лет.</p></div></div><footer>© 2024 Все права защищены</footer></body></html>',
        [
            "Новый мост через реку",
            "Комитет обсудил во вторник планы строительства нового моста рядом со старой мельницей.",
            "Жители поддержали проект, хотя некоторые опасаются шума и пробок в течение двух лет.",
        ],
    ),
    "docs": (
        '<html><body><div class="sidebar"><ul><li><a href="#i">Install</a></li><li><a href="#u">Usage</a></li></ul></div><div class="document"><div class="body"><section id="i"><h1>Install</h1><p>Download the archive and unpack it in a folder of your own.</p><pre>tar xf tool.tar</pre></section><section id="u"><h2>Usage</h2><p>Call the tool with a file name. It writes the result beside the file and tells how long it took.</p></section></div></div><div class="footer">Last updated on May 2, 2021.</div></body></html>',
        [
            "Install",
            "Download the archive and unpack it in a folder of your own.",
            "tar xf tool.tar",
            "Usage",
            "Call the tool with a file name. It writes the result beside the file and tells how long it took.",
        ],
    ),
    "divs": (
        '<html><body><div><a href="/">Home</a> | <a href="/x">Contact</a></div><div><div><b>A walk in the hills</b></div><div>We left the village before sunrise and followed the stream up to the first hut.</div><div>By noon the fog had gone and the whole valley lay below us.</div><div>The way down took longer than we had thought, since a bridge was missing.</div></div><div><a href="/m">More walks</a></div></body></html>',
        [
            "A walk in the hills",
            "We left the village before sunrise and followed the stream up to the first hut.",
            "By noon the fog had gone and the whole valley lay below us.",
            "The way down took longer than we had thought, since a bridge was missing.",
        ],
    ),
}
#: Pages written after that.
UNSEEN = {
    "forum": (
        '<html><body><div id="nav"><a href="/">Index</a> &raquo; <a href="/g">Garden</a></div><div class="thread-title"><h1>Moles in the lawn</h1></div><div class="post-body">Since April we have had moles in the lawn. I count eleven hills this week, and it gets worse with rain.<br><br>Has anyone had luck with noise? My neighbour swears by bottles in the ground.</div><div class="replies"><div class="reply">Bottles never did a thing for us.</div><div class="reply">Get a cat.</div></div><div class="footer">Board software 3.1</div></body></html>',
        [
            "Moles in the lawn",
            "Since April we have had moles in the lawn. I count eleven hills this week, and it gets worse with rain. Has anyone had luck with noise? My neighbour swears by bottles in the ground.",
        ],
    ),
    "press": (
        '<html><body><header><a href="/">Acme Pumps</a><nav><ul><li><a href="/p">Products</a></li><li><a href="/c">Contact</a></li></ul></nav></header><section class="hero"><h1>Acme opens a plant in Leeds</h1></section><section><p>Acme Pumps has opened its third plant, which will make parts for water works.</p><p>Eighty people work there from today, and forty more are to follow by the summer.</p><figure><img src=a.jpg><figcaption>The new hall seen from the south</figcaption></figure><p>"Leeds was the right place," said the head of the company.</p></section><section class="cta"><p>Subscribe to our press list.</p></section><footer><p>&copy; Acme Pumps</p></footer></body></html>',
        [
            "Acme opens a plant in Leeds",
            "Acme Pumps has opened its third plant, which will make parts for water works.",
            "Eighty people work there from today, and forty more are to follow by the summer.",
            "The new hall seen from the south",
            '"Leeds was the right place," said the head of the company.',
        ],
    ),
    "faq": (
        '<html><body><nav><a href="/">Home</a><a href="/faq">Questions</a></nav><main><h1>Questions about returns</h1><dl><dt>How long may I keep a parcel?</dt><dd>You may send it back within thirty days, in whatever box you like.</dd><dt>Who pays for the post?</dt><dd>We do, if the goods were broken. Otherwise the cost is yours.</dd></dl></main><footer><a href="/t">Terms</a></footer></body></html>',
        [
            "Questions about returns",
            "How long may I keep a parcel?",
            "You may send it back within thirty days, in whatever box you like.",
            "Who pays for the post?",
            "We do, if the goods were broken. Otherwise the cost is yours.",
        ],
    ),
    "ja": (
        '<html><body><div class="menu"><a href="/">ホーム</a><a href="/n">ニュース</a></div><div id="main"><h1>新しい橋の計画</h1><p>委員会は火曜日に新しい橋の計画について話し合った。</p><p>住民の多くは賛成したが、騒音を心配する声もあった。</p></div><div id="footer">© 2024 無断転載を禁じます</div></body></html>',
        [
            "新しい橋の計画",
            "委員会は火曜日に新しい橋の計画について話し合った。",
            "住民の多くは賛成したが、騒音を心配する声もあった。",
        ],
    ),
    "shop": (
        '<html><body><div class="header"><a href="/">Shop</a><form><input name=q><button>Search</button></form></div><div class="wrap"><div class="left"><ul><li><a href="/1">Tents</a></li><li><a href="/2">Bags</a></li></ul></div><div class="right"><h1>How to choose a tent</h1><p>Think first of the weather you will meet, and then of the weight that you can carry.</p><h2>Shape</h2><p>Tunnels give room but need pegs. Domes stand on their own, even on rock.</p><div class="share"><a href="#">Share</a><a href="#">Tweet</a></div></div></div></body></html>',
        [
            "How to choose a tent",
            "Think first of the weather you will meet, and then of the weight that you can carry.",
            "Shape",
            "Tunnels give room but need pegs. Domes stand on their own, even on rock.",
        ],
    ),
}
LONG = " ".join(TEXT) + " The mayor said that nobody should expect the old crossing to vanish before the new one carries its first cars and buses."
CHINESE = "委员会星期二开会讨论在老磨坊附近修建新桥的计划。许多居民表示支持，也有人担心两年施工期间的交通和噪音。工程师提交土壤报告之后，预计三月作出决定。"
INSERTS = [
    '<aside><h3>Related</h3><ul><li><a href="/a">Old mill to be sold</a></li><li><a href="/b">River floods again</a></li></ul></aside>',
    '<div class="ad">Buy our fine boots today!</div>',
    '<form><label>Newsletter</label><input name=q><p>Sign up for our newsletter.</p><button>Subscribe</button></form>',
]
AROUND = [
    ('<nav><ul><li><a href="1">Home</a></li><li><a href="2">News</a></li></ul></nav>', "<footer>&copy; 2024 All rights reserved.</footer>"),
    ('<div class="menu"><a href="1">Home</a> <a href="2">News</a></div>', '<div id="footer"><p>Copyright 2024 Some Firm</p></div>'),
]


@pytest.fixture(scope="module")
def text():
    model = htmlmain.default_model()
    return lambda page: htmlmain.main_text(model, page)


@pytest.mark.parametrize("name", sorted(SEEN | UNSEEN))
def test_pages(text, name):
    page, want = (SEEN | UNSEEN)[name]
    assert text(page).split("\n\n") == want


@pytest.mark.parametrize("before, after", AROUND)
def test_one_block(text, before, after):
    for around in ("<article>{}</article>", "<div>{}</div>", '<div class="article-body">{}</div>', "<p>{}</p>", "<section><p>{}</p></section>", "{}", "<main>{}</main>", "<article><p>{}</p></article>", "<table><tr><td>{}</td></tr></table>", '<div class="col"><div>{}</div></div>'):
        for own in (LONG, CHINESE, LONG * 40):
            assert text(f"<html><body>{before}{around.format(own)}{after}</body></html>") == own, around


@pytest.mark.parametrize("before, after", AROUND)
def test_few_blocks(text, before, after):
    for around in ("<div>{}</div>", "<article>{}</article>", "<section>{}</section>"):
        for n in range(2, 7):
            assert text(before + around.format("<br><br>".join(TEXT[:n])) + after) == " ".join(TEXT[:n]), (around, n)
            assert text(before + around.format("".join(f"<p>{t}</p>" for t in TEXT[:n])) + after) == "\n\n".join(TEXT[:n]), (around, n)
        assert text(before + around.format(f"<h1>A bridge at last</h1>{LONG}") + after) == f"A bridge at last\n\n{LONG}", around


@pytest.mark.parametrize("insert", INSERTS)
def test_inserts(text, insert):
    for before, after in AROUND:
        for around in ("<div>{}</div>", "<article>{}</article>", "<section>{}</section>"):
            for at in range(1, 6):
                own = [f"<p>{t}</p>" for t in TEXT]
                own.insert(at, insert)
                assert text(before + around.format("".join(own)) + after) == "\n\n".join(TEXT), (around, at)


def test_no_article(text):
    assert text("") == "" and text("<nav><a href=1>Home</a></nav>") == "" and text(AROUND[0][0] + AROUND[0][1]) == ""
