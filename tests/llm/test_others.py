"""HTML extraction, embeddings, sharding, WARC and personal data, against brute force and round trips."""

import hashlib
import html
import re
import zlib

import numpy as np
import pytest

from prismloom.llm import embednear, htmlblocks, htmlmain, pii, sharding, warc

PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<div class="cookie-notice">We use cookies. <a href=x>Accept</a></div><nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav>
<article><h1>A title &amp; more</h1><p>One  two\n three.<br>Four &lt;five&gt;.<p>Last <b>words</b> of it.</p></article>
<aside class="sidebar"><p>Related things.</p></aside><section id="comments"><p>I liked it.</p></section><form><button>Search</button></form><footer>&copy; 2020</footer>"""


def test_extraction(spark):
    odd = ["", None, "<" * 500, "<div>" * 5000 + "deep", "<!-- open", "<script>open", '<a href="open><p>x']
    pages = spark.createDataFrame([(0, "u", PAGE, 1), *((i + 1, "u", p, 1) for i, p in enumerate(odd)), (0, "u", PAGE, 2)], "page_id bigint, url string, html string, marks int")
    rows = htmlmain.extract(pages).collect()
    assert len(rows) == len(odd) + 2
    for r in rows:
        if r["page_id"] == 0:
            assert r["text"] == "A title & more\n\nOne two three. Four <five>.\n\nLast words of it."
        if r["html"] in (None, ""):
            assert r["text"] == ""
    assert htmlmain.extract(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        htmlmain.extract(pages, into="url")


def test_held_out_layouts():
    model, right, total = htmlmain.default_model(), 0, 0
    for page, labels in htmlmain.labelled_pages(150, seed=123):
        got = model.labels(page)
        right, total = right + sum(a == b for a, b in zip(got, labels, strict=True)), total + len(labels)
    assert right / total > 0.97


def test_viterbi_is_the_best_sequence():
    model = htmlmain.default_model()
    page, _ = htmlmain.labelled_pages(1, seed=5)[0]
    page = page[:10]
    s = model.scores(page)

    def score(labels):
        out = model.first[labels[0]] + s[0] * labels[0]
        return out + sum(model.steps[a, b] + s[i + 1] * b for i, (a, b) in enumerate(zip(labels, labels[1:], strict=False)))

    every = [[(n >> i) & 1 for i in range(len(page))] for n in range(1 << len(page))]
    assert score([int(x) for x in model.labels(page)]) == pytest.approx(max(map(score, every)))


def test_pages_of_the_tables(spark):
    """The corpus' pages hold their main text in one article element."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in htmlmain.extract(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(filter(None, parts))


def test_blocks_close_paragraphs():
    assert [b.text for b in htmlblocks.blocks("<p>a<p>b<div>c</div>d</p><ul><li>e<li>f<ul><li>g</ul>h</ul><table><tr><td>i<td>j</table>")] == list("abcdefghij")


def vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 16))
    near = base[:80] + 0.12 * rng.standard_normal((80, 16))
    chain = [base[0] + 0.2 * i * base[1] for i in range(12)]
    rows = [list(map(float, v)) for v in [*base, *near, *chain]]
    rows += [rows[5], [2 * x for x in rows[5]], None, [0.0] * 16, [float("nan")] * 16, [1.0, None] + [0.0] * 14, [float("inf")] * 16, [], [1e-200] * 16, [1e300] * 16, [1.0] * 8]
    return spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>, node int"), rows


@pytest.mark.parametrize("cell, block", [(400, 256), (40, 16)])
def test_embeddings(spark, cell, block):
    df, rows = vectors(spark)
    got = {r["vec_id"]: r for r in embednear.near_embeddings(df, cell=cell, block=block).collect()}
    good = {i: np.array(v) / max(map(abs, v)) for i, v in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: set() for i in range(len(rows))}
    for i in good:
        for j in good:
            if j < i and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.sqrt(good[i] @ good[i]) / np.sqrt(good[j] @ good[j]) >= 0.9:
                links[i].add(j), links[j].add(i)
    want, found = sum(map(len, links.values())), sum(r["n_links"] for r in got.values())
    assert len(got) == len(rows) and want * 0.98 <= found <= want and all(got[i]["n_links"] <= len(links[i]) for i in got)
    if cell == 400:  # one cell: nothing can be missed but by the bound of the estimates
        for i in got:
            reach, todo = {i}, [i]
            while todo:
                for x in links[todo.pop()] - reach:
                    reach.add(x), todo.append(x)
            assert (got[i]["component_id"], got[i]["kept"]) == (min(reach), min(reach) == i)
    assert embednear.near_embeddings(df.limit(0)).count() == 0


def test_no_pair_is_lost_at_borders(spark):
    """Vectors of few effective dimensions, whose differences point across borders of cells."""
    rng = np.random.default_rng(12)
    plane = np.linalg.qr(rng.standard_normal((64, 5)))[0]
    base = rng.standard_normal((500, 5))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = rng.standard_normal((500, 5))
    aside -= (aside * base).sum(axis=1, keepdims=True) * base
    near = 0.905 * base + np.sqrt(1 - 0.905**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    units = np.concatenate([base, near]) @ plane.T
    df = spark.createDataFrame([(i, list(map(float, u))) for i, u in enumerate(units)], "vec_id bigint, embedding array<double>")
    close = units @ units.T >= 0.9
    # Estimates are left no bound, so that only borders could lose a pair.
    got = {r["vec_id"]: r["n_links"] for r in embednear.near_embeddings(df, cell=40, epsilon=1e6).collect()}
    assert [got[i] for i in range(len(units))] == (close.sum(axis=1) - 1).tolist()


@pytest.mark.parametrize("size", [2, 4, 8, 16, 64])
def test_recall_at_few_and_many_dimensions(spark, size):
    """Groups of neighbours about the threshold, in many cells, against brute force."""
    rng = np.random.default_rng(size)
    base = rng.standard_normal((300, size))
    units = np.concatenate([base, *(base + rng.uniform(0.1, 0.6) * np.linalg.norm(base, axis=1, keepdims=True) * rng.standard_normal(base.shape) / np.sqrt(size) for _ in range(4))])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, list(map(float, u))) for i, u in enumerate(units)], "vec_id bigint, embedding array<double>")
    found = {r["vec_id"]: r["n_links"] for r in embednear.near_embeddings(df, cell=30, block=64).collect()}
    dots = units @ units.T
    least, most = (dots >= 0.9 + 1e-12).sum(axis=1) - 1, (dots >= 0.9 - 1e-12).sum(axis=1) - 1
    assert least.sum() > 100 and all(least[i] <= found[i] <= most[i] for i in found)


def test_estimates_are_unbiased():
    rng = np.random.default_rng(0)
    size = 64
    u, v = (x / np.linalg.norm(x) for x in rng.standard_normal((2, size)))
    v = 0.7 * u + np.sqrt(1 - 0.49) * (v - (u @ v) * u) / np.linalg.norm(v - (u @ v) * u)
    found = []
    for _ in range(400):
        turn, _ = np.linalg.qr(rng.standard_normal((size, size)))
        index = embednear.Index(u[None], turn)
        codes, factors = index.codes(u[None])
        signs = (np.unpackbits(codes, axis=1, count=size) * 2.0 - 1) / np.sqrt(size)
        found.append((signs @ (v @ turn))[0] / factors[0])
    assert abs(np.mean(found) - 0.7) < 0.01


def test_sharding(spark):
    rng = np.random.default_rng(1)
    texts = ["same text of a hot group"] * 400 + ["x" * int(n) for n in rng.integers(0, 300, 500)] + ["é" * 50, None, "", None]
    docs = spark.createDataFrame([(i if i % 50 else None, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, shard int").repartition(5)
    rows = sharding.shard(docs, shards=7).collect()
    assert len(rows) == len(texts)
    by = {s: [r for r in rows if r["shard"] == s] for s in range(7)}
    sizes = [sum(r["size"] for r in by[s]) for s in range(7)]
    assert max(sizes) - min(sizes) <= 2 * 330 and sum(sizes) == sum(len((t or "").encode()) + 16 for t in texts)
    for s in range(7):
        assert sorted(r["slot"] for r in by[s]) == list(range(len(by[s])))
    assert sorted(r["text_crc32"] for r in rows) == sorted(zlib.crc32((t or "").encode()) for t in texts)
    assert len({r["shard"] for r in rows if r["text_crc32"] == zlib.crc32(texts[0].encode())}) <= 4
    assert sharding.shard(docs.limit(0)).count() == 0 and sharding.shard(docs.limit(1), shards=40).count() == 1
    cells = sharding.shard(docs, shards=3, cell_bytes=5000).collect()
    for s in range(3):
        assert sorted(r["slot"] for r in cells if r["shard"] == s) == list(range(sum(r["shard"] == s for r in cells)))


def test_shards_are_cuts_of_one_order(spark):
    rng = np.random.default_rng(2)
    texts = [f"copy {int(g)} " * 5 for g in rng.integers(0, 40, 600)] + ["y" * int(n) for n in rng.integers(0, 200, 400)] + ["z" * 200_000, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    rows = sharding.shard(docs, shards=4).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    # Equal texts stand together in the order of shards and slots.
    runs = [k for k, r in enumerate(order) if not k or (texts[r["doc_id"]] or "") != (texts[order[k - 1]["doc_id"]] or "")]
    assert len(runs) == len({t or "" for t in texts})
    # Brute force: where that order would be cut into equal bytes. No boundary is off by more than the slack and the row it would cut.
    below = np.concatenate([[0], np.cumsum([r["size"] for r in order])])
    share = below[-1] / 4
    for j in range(1, 4):
        at = sum(r["shard"] < j for r in rows)
        nearest = np.abs(below - share * j).min()
        assert abs(below[at] - share * j) <= max(nearest, sharding.TOLERANCE * share)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_round_trip(spark, tmp_path, compression):
    warc.register(spark)
    tricky = "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"
    bodies = ["a" * 1200, "a" * 1200, "a" * 999, "a" * 999, None, "", "é" * 700, tricky * 40, "x\r\n\r\nWARC/1.1\r\n" * 90, "a" * 1200]
    pages = spark.createDataFrame([(i, "http://x/%0A?" + str(i), b, "k") for i, b in enumerate(bodies)], "page_id bigint, url string, html string, key string")
    path = str(tmp_path / "w")
    warc.with_revisits(pages).write.format("warc").option("compression", compression).option("filebytes", 3000).mode("append").save(path)
    for split in (200, 1 << 20):
        rows = {int(r["id"]): r for r in spark.read.format("warc").option("splitbytes", split).load(path).collect()}
        assert len(rows) == len(bodies)
        for i, b in enumerate(bodies):
            data = (b or "").encode()
            assert rows[i]["payload_digest"] == hashlib.sha1(data).hexdigest() and rows[i]["payload_bytes"] == len(data) and rows[i]["url"] == f"http://x/%0A?{i}"
            assert rows[i]["record_type"] == ("revisit" if i in (0, 1) else "response")
            assert rows[i]["refers_to"] == ("9" if i in (0, 1) else None)
            assert i in (0, 1) or bytes(rows[i]["payload"]) == data
    some = spark.read.format("warc").load(path).where("record_type = 'revisit' AND refers_to = '9'")
    assert {r["id"] for r in some.collect()} == {"0", "1"}
    assert spark.read.format("warc").option("payload", "false").load(path).where("payload IS NOT NULL").count() == 0


def brute_base(text):
    """The contract's base spans with Python's own patterns."""
    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            x = int(c) * (1 + i % 2)
            total += x - 9 * (x > 9)
        return total % 10 == 0

    found = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ):
        found += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text or "") if ok(m[0])]
    return found


PERSONAL = [
    "write to a.b+c@mail.example.com, or x@y.z.q-r; not a@b", "@@a@b.c@d.e.f a@b.cé", "host 10.0.0.1 and 1.2.3.4.5 and 256.1.1.1 then 1.2.3.255.7.8", "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 5500000000000004",
    "call +49 (30) 123-4567 or +1.2 or +1234567890123456, +1-800-555-0199", "🙂🙂 mail é@x.com me@x.com 日本 +44 20 7946 0958", None, "", "1.2.3.4" * 30, "1 " * 400, "+" * 50 + "1" * 30, "a@b." * 100 + "c", "a.b" * 500 + "@",
    "name [at] mail [dot] com", "tel 030-123-4567 today", "2001:db8:0:0:0:0:0:1 is a server",
]


def test_personal_data(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(PERSONAL)], "doc_id bigint, text string, kind string")
    rows = pii.find(docs).collect()
    assert len(rows) == len(PERSONAL)
    for r in rows:
        base = [(s["kind"], s["start"], s["end"]) for s in r["base"]]
        assert base == brute_base(r["text"]), r["text"]
        every = [(s["kind"], s["start"], s["end"]) for s in r["spans"]]
        assert set(base) <= set(every)
        for kind in pii.KINDS:
            own = sorted(s for s in every if s[0] == kind)
            assert all(a[2] <= b[1] for a, b in zip(own, own[1:], strict=False))
    assert pii.find(docs.limit(0)).count() == 0


def test_personal_data_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in pii.find(docs.select("doc_id", "text"), models={k: pii.Model() for k in pii.KINDS}).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["base"]] == brute_base(r["text"])


def test_reliabilities():
    rng = np.random.default_rng(0)
    patterns = {}
    for _ in range(4000):
        real = rng.random() < 0.5
        vote = lambda p: int(rng.choice([1, -1], p=[p, 1 - p] if real else [1 - p, p]))  # noqa: B023, E731
        p = (-1, vote(0.9), vote(0.55), vote(0.9))
        patterns[p] = patterns.get(p, 0) + 1.0
    model, chance = pii.fit_reliabilities(patterns)
    assert chance[-1, 1, 1, 1] > 0.9 and chance[-1, -1, -1, -1] < 0.1
    spread = lambda n: model.rates[n, 1][0] / model.rates[n, 1][1]
    assert spread("gazetteer") > spread("context") and spread("structure") > spread("context")


def test_registry_of_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
