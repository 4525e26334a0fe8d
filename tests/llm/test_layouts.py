"""Extraction from layouts that say little, from families of layouts held out, and without caps."""

import pytest

from prismloom.llm import htmlblocks, htmlmain

TEXT = [
    "The committee met on Tuesday to discuss the plans for a new bridge across the river near the old mill.",
    "Several residents spoke in favour, while others worried about traffic and noise during the two years of building.",
    "A decision is expected in March, after the engineers have given their report on the soil.",
    "The last bridge was built in 1931 and can no longer carry heavy lorries, which have to take a long way round.",
    "Costs are put at nine million, of which the county would pay a third.",
    "Work could begin next summer if the money is found.",
]


@pytest.mark.parametrize("around", ["{}", "<article>{}</article>", "<main>{}</main>", "<table><tr><td>{}</td></tr></table>", '<div class="container">{}</div>', '<div id="bodyContent">{}</div>', "<div>{}</div>", "<section>{}</section>", '<div class="wp-block-group">{}</div>', '<div class="col-md-8">{}</div>', "<article>" + "<span>" * 9 + "{}" + "</span>" * 9 + "</article>", "<article><noscript>{}</noscript></article>"])
@pytest.mark.parametrize("body", ["<body>", '<body class="site header-fixed search-open">'])
def test_layouts(around, body):
    inner = around.format("".join(f"<p>{t}</p>" for t in TEXT))
    page = f'<html>{body}<nav><ul><li><a href="1">Home</a></li><li><a href="2">News</a></li></ul></nav>{inner}<footer>&copy; 2024 All rights reserved.</footer></body></html>'
    assert htmlmain.main_text(htmlmain.default_model(), page) == "\n\n".join(TEXT)


@pytest.mark.parametrize("family", htmlmain.FAMILIES)
def test_held_out_families(family):
    others = tuple(f for f in htmlmain.FAMILIES if f != family)
    model, own = htmlmain.train(htmlmain.labelled_pages(400, 3, others), rounds=80), [0, 0, 0]
    for page, labels in htmlmain.labelled_pages(100, 4, (family,)):
        for b, got, want in zip(page, model.labels(page), labels, strict=True):
            own[0 if got and want else 1 if got else 2] += len(b.text) * (got or want)
    assert own[0] / (own[0] + own[1]) > 0.9 and own[0] / (own[0] + own[2]) > 0.9, own


def test_no_caps():
    names = " ".join("n" + "".join(chr(97 + (i // 26**k) % 26) for k in range(3)) for i in range(60))
    (block,) = htmlblocks.blocks(f'<div class="{names}">x</div>')
    assert len(block.marks) == 61
    (block,) = htmlblocks.blocks("<article>" + "<span>" * 40 + "x")
    assert block.tag == "article" and htmlblocks.blocks("<p>a<svg>b<p>c")[-1].text == "c"
    assert [b.text for b in htmlblocks.blocks("<p>a <math><mi>x</mi></math> b <object>c</object><p>d")] == ["a x b c", "d"]


def test_deep_and_long_pages():
    deep = "".join(f'<div class="a{i} b{i}">' for i in range(3000)) + "<p>" + "One word more. " * 70_000
    assert htmlmain.main_text(htmlmain.default_model(), deep).count("word") == 70_000
