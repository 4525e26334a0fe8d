"""Decontamination, BPE, line dedup, the n-gram join, language identification and the pipeline, against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from prismloom.llm import bpe, decontamination, langid, linededup, ngramjoin
from prismloom.llm.components import components
from prismloom.llm.storage import row_key

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def phrase(rng, n, prefix="w"):
    return " ".join(f"{prefix}{rng.integers(0, 60)}" for _ in range(n))


def some_texts(seed=0):
    rng = np.random.default_rng(seed)
    base = [phrase(rng, int(rng.integers(20, 60))) for _ in range(20)]
    near = [t + " tail" for t in base[:6]] + [" ".join(t.split()[:-1]) for t in base[3:8]]
    return [*base, *near, base[0], base[0].upper(), None, "", "  ", "one two", "one two", "!!", "é ü 日本 ж " * 8, phrase(rng, 3000)]


def documents(spark, texts, ids=None):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def brute_contamination(texts, items):
    out = []
    for text in texts:
        w = words(text)
        hit, found = set(), set()
        for item, body in items:
            b = words(body)
            if item is None or not b:
                continue
            n = min(13, len(b))
            for k in range(len(b) - n + 1):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == b[k : k + n]:
                        hit |= set(range(i, i + n))
                        found.add(str(item))
        out.append((len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("max_index", [2_000_000, 40])
def test_decontamination(spark, max_index):
    rng = np.random.default_rng(5)
    items = [(1, phrase(rng, 30, "b")), (2, phrase(rng, 13, "b")), (3, "short item"), (4, None), (5, ""), (6, phrase(rng, 14, "b")), (None, "nobody"), (20, "short item"), (7, "b b b b b b b b b b b b b b b")]
    parts = {i: (t or "").split() for i, t in items}
    texts = [" ".join(parts[1]), phrase(rng, 300) + " " + " ".join(parts[1][5:18]), " ".join(parts[1][:12]), "a Short ITEM, here", " ".join(parts[2]).upper() + "! " + phrase(rng, 5), None, "", "...", phrase(rng, 50), " ".join(parts[6][1:14]), " ".join(parts[6] + parts[6]), "b " * 40, "b " * 12]
    docs, bench = documents(spark, texts), spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, uid string")
    got = {r["doc_id"]: r for r in decontamination.decontaminate(docs.withColumnRenamed("lang", "uid"), bench, keys=["doc_id"], max_index=max_index).collect()}
    for i, (n, hit, found, bad) in enumerate(brute_contamination(texts, items)):
        r = got[i]
        assert (r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) == (n, hit, found, bad), i
    assert decontamination.decontaminate(docs, bench.limit(0), keys=["doc_id"]).where("n_hit > 0").count() == 0
    assert decontamination.decontaminate(docs.limit(0), bench, keys=["doc_id"]).count() == 0


@pytest.mark.parametrize("max_index", [2_000_000, 40])
def test_repeated_benchmark_rows(spark, max_index):
    rng = np.random.default_rng(6)
    a, b, c = (phrase(rng, 20, p) for p in "abc")
    items = [(1, a), (1, a), (2, b), (2, c), (3, a), (4, "short item"), (4, "short item"), (4, f"{c} {c}")]
    texts = [a, b, c, f"{phrase(rng, 100)} {b[:200]} {c}", "a short item", f"{c} {c}", phrase(rng, 50)]
    bench = spark.createDataFrame(items, "item_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r for r in decontamination.decontaminate(documents(spark, texts), bench, keys=["doc_id"], max_index=max_index).collect()}
    for i, (n, hit, found, bad) in enumerate(brute_contamination(texts, items)):
        r = got[i]
        assert (r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) == (n, hit, found, bad), i


@pytest.mark.parametrize(("max_index", "most"), [(2_000_000, 64 << 20), (2_000_000, 0), (60, 0)])
def test_passage_of_many_items_and_repeated_documents(spark, max_index, most):
    rng = np.random.default_rng(8)
    shared, long = phrase(rng, 40, "s"), phrase(rng, 90, "l")
    items = [(i, f"own{i} {shared}" if i % 3 else shared) for i in range(40)] + [(99, long), (98, " ".join(long.split()[20:60]))]
    texts = [shared, f"{phrase(rng, 50)} {shared} x {shared}", long, phrase(rng, 2000) + " " + long, shared, None, None, "", "+", phrase(rng, 30), long]
    ids = [0, 1, 2, 3, 0, 5, 5, 6, 7, 8, 9]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontamination.decontaminate(documents(spark, texts, ids).repartition(3), bench, keys=["doc_id", "lang"], max_index=max_index, most_broadcast=most)
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in found.collect())
    assert got == sorted((i, n, hit, tuple(of), bad) for i, (n, hit, of, bad) in zip(ids, brute_contamination(texts, items), strict=True))


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    texts = [*some_texts(), "<|endoftext|>x<|endoftext|>", "it's we'll\r\n\r\n  9 99", "a" * 3000, "\x00\x7f", "🙂 emoji 🙂🙂", "a\x1c\x1cb \x85\x85c", "x\t\ty\x0b z\x0c", "\u3000\u2028a", "²½ Ⅷ"]
    library = tokenizers.Tokenizer.from_file(PATH)
    library.no_truncation(), library.no_padding()
    docs = documents(spark, texts)
    rows, at_once = bpe.decode(bpe.encode(docs, PATH), PATH).collect(), bpe.round_trip(docs, PATH)
    assert len(rows) == len(texts) and at_once.count() == len(texts) and at_once.columns == [*docs.columns, "ids", "decoded"]
    for r in rows + at_once.collect():
        want = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == want
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs, PATH, into="lang")
    with pytest.raises(ValueError):
        bpe.round_trip(docs, PATH, ids="lang")


def test_pairs_of_tokens():
    own, rng = bpe.vocabulary(PATH), np.random.default_rng(3)
    ids = list(own.ids.values())
    for a, b in rng.choice(ids, (3000, 2)).tolist():
        single = [own.ids[bytes([x])] for x in own.bytes[a] + own.bytes[b]]
        assert own.stay_apart(a, b) == (own.merged(single) == [a, b])


def sentences(rng, n):
    return [phrase(rng, 10).capitalize() + "." for _ in range(n)]


def test_line_dedup(spark):
    rng = np.random.default_rng(9)
    passage = sentences(rng, 12)
    texts = [" ".join(sentences(rng, 6) + passage + sentences(rng, 4)), "\n".join(sentences(rng, 3) + passage), " ".join(passage), " ".join(sentences(rng, 20)), None, "", "Same line.", "Same line.", "A b. " * 40, "x" * 5000]
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    assert got[0]["text"] == texts[0] and got[3]["text"] == texts[3] and got[9]["text"] == texts[9]
    assert got[4]["text"] is None and got[5]["text"] == "" and got[6]["text"] == got[7]["text"] == "Same line."
    for i in (1, 2):
        left = got[i]["text"]
        assert sum(s in left for s in passage) <= 4, left
    assert all(s in got[1]["text"] for s in texts[1].split("\n")[:3])
    # What is left of a document is lines of it, in order; words of first copies are all there.
    for i, r in got.items():
        it = iter(words(texts[i]))
        assert all(w in it for w in words(r["text"]))
    assert linededup.dedup_lines(docs.limit(0)).count() == 0
    twice = documents(spark, [texts[0], texts[0]], [7, 7]).unionByName(documents(spark, [texts[0]], [8]))
    same = linededup.dedup_lines(twice).collect()
    assert [r["text"] == texts[0] for r in same if r["doc_id"] == 7] == [True, True] and all(len(r["text"]) < 200 for r in same if r["doc_id"] == 8)
    clash = docs.withColumnRenamed("lang", "key").withColumnRenamed("source", "hash")
    assert linededup.dedup_lines(clash).select("key", "hash").count() == len(texts)


def test_no_long_passage_stays(spark):
    """Passages of one line to six with over 50 words, amid other lines, are removed to the last line."""
    rng = np.random.default_rng(21)
    new = lambda n: " ".join(f"n{rng.integers(1 << 40)}" for _ in range(n))
    texts, passages = [], []
    for lines in (1, 2, 3, 4, 5, 6):
        for end in (". ", "\n", "\u3002"):
            for sizes in ([51 // lines + 1] * lines, [60, *[3] * (lines - 1)], [*[3] * (lines - 1), 60]):
                for space in (" ", "  "):
                    passage = "".join(new(n) + end for n in sizes)
                    around = ["".join(new(int(rng.integers(1, 30))) + end for _ in range(3)) for _ in range(4)]
                    texts += [around[0] + passage + around[1], around[2] + passage.replace(" ", space) + around[3], space + passage]
                    passages.append((passage, around[2] + around[3]))
    got = {r["doc_id"]: r for r in linededup.dedup_lines(documents(spark, texts)).collect()}
    for i, (passage, rest) in enumerate(passages):
        assert got[3 * i]["text"] == texts[3 * i]
        assert words(got[3 * i + 1]["text"]) == words(rest), passage
        assert not words(got[3 * i + 2]["text"])


def test_chunks_resist_shifts():
    rng = np.random.default_rng(2)
    passage = " ".join(sentences(rng, 30))
    a, b = linededup.document_chunks([passage, " ".join(sentences(rng, 3)) + " " + passage])
    assert len({h for *_, h in a} & {h for *_, h in b}) > 0.7 * len(a)


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("block, block_bytes", [(640, 24 << 20), (2, 24 << 20), (640, 500)])
def test_ngram_join(spark, block, block_bytes):
    texts = some_texts()
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in ngramjoin.near_duplicates(docs.withColumnRenamed("lang", "class"), block=block, block_bytes=block_bytes).collect()}
    sets = [shingle_set(t) for t in texts]
    links = defaultdict(set)
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                links[i].add(j), links[j].add(i)
    for i in range(len(texts)):
        reach, todo = {i}, [i]
        while todo:
            for x in links[todo.pop()] - reach:
                reach.add(x), todo.append(x)
        assert (got[i]["n_links"], got[i]["class_id"], got[i]["kept"]) == (len(links[i]), min(reach), min(reach) == i), i
    kept = {r["doc_id"] for r in ngramjoin.deduplicated(docs).collect()}
    assert kept == {i for i in got if got[i]["kept"]}


def test_ngram_join_edges(spark):
    text = "a b c d e f g"
    docs = documents(spark, [text, text, None, None, text], [3, 3, 4, None, None])
    rows = ngramjoin.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or -1, r["n_links"], r["class_id"] or -1, r["kept"]) for r in rows)[-2:] == [(3, 2, 3, True), (4, 0, 4, True)] and sum(r["kept"] for r in rows) == 3
    assert ngramjoin.deduplicated(docs).count() == 3
    assert ngramjoin.near_duplicates(docs.limit(0)).count() == 0


def test_pruning_bounds():
    looks = ngramjoin.least_agreeing(0.8, 1e-6)
    assert [n for n, _ in looks] == [25, 50, 75, 100, 125] and all(m < 0.8 * n for n, m in looks)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (5, 5), (4, 1), *((100, i) for i in range(101, 140)), *((i, i + 1) for i in range(200, 230))]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()))
    assert got == {**dict.fromkeys(range(1, 5), 1), **dict.fromkeys(range(10, 13), 10), **dict.fromkeys(range(100, 140), 100), **dict.fromkeys(range(200, 231), 200)}


def test_row_key(spark):
    rows = spark.createDataFrame([(1, "a"), (1, None), (None, "1"), (None, None), (1, ""), (1, "a")], "i bigint, t string")
    keys = [bytes(r[0]) for r in rows.select(row_key(rows["i"], rows["t"])).collect()]
    assert len(set(keys)) == 5 and keys[0] == keys[5]


def spoken(rng, letters, n):
    return " ".join("".join(rng.choice(list(letters), int(rng.integers(2, 7)))) for _ in range(n))


def test_language_id(spark):
    rng = np.random.default_rng(4)
    kinds = {"xa": "aeiounrst", "xb": "äöüßchgkz", "xc": "ñóíáqrlpe"}
    rows = [(i, spoken(rng, kinds[lang], int(rng.integers(5, 60))), lang) for i in range(600) for lang in [sorted(kinds)[i % 3]]]
    rows += [(1000, None, "xa"), (1001, "", "xa"), (1002, "123 !!", "xb"), (None, "aeio nrst", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score_of", langid.F.lit(1))
    net = langid.fit(docs)
    assert net.languages == sorted(kinds)
    found = langid.identify(docs.withColumn("held", langid.held_out(langid.F.col("doc_id"))), net).collect()
    held = [r for r in found if r["held"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert len(held) > 80 and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in found if r["doc_id"] in (1000, 1001, 1002))
    assert all(0 <= r["score"] <= 1 for r in found) and len(found) == len(rows)
    none = langid.fit(docs.limit(0))
    assert none is None and {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}


def test_gradients():
    """Backpropagation through time against differences."""
    rng = np.random.default_rng(1)
    net = langid.Network.fresh(["a", "b"], hidden=3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    data, valid = rng.integers(0, 256, (4, 5)).astype(np.uint8), np.ones((4, 5), dtype=bool)
    target, share = np.array([0, 1, 1, 0]), np.ones(4)
    _, grads = net.gradients(data, valid, target, share)
    for k, at in (("uf", (1, 4)), ("ub", (0, 7)), ("cf", (2,)), ("vb", (1, 0)), ("xf", (int(data[0, 2]), 5))):
        was, out = net.weights[k][at], []
        for step in (1e-2, -1e-2):
            net.weights[k][at] = was + step
            out.append(net.gradients(data, valid, target, share)[0])
        net.weights[k][at] = was
        assert abs((out[0] - out[1]) / 2e-2 - grads[k][at]) < 2e-4


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(8)
    rows, n = [], 0
    for lang, letters in (("xa", "aeiounrst"), ("xb", "äöüßchgkz")):
        for _ in range(60):
            rows.append((n, " ".join(spoken(rng, letters, 9).capitalize() + "." for _ in range(6)), lang, "s", 0))
            n += 1
    bench = rows[3][1]
    rows += [(n, None, "xa", "s", 0), (n + 1, "12 34", "xa", "s", 0), (n + 2, rows[5][1], "xa", "s", 0), (n + 3, rows[7][1].replace(".", ""), "xa", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"] for r in now.select("doc_id").collect()}
        assert name == "bpe" or now.schema.names == docs.schema.names
    clean = set(range(n)) - {3}
    assert n not in kept["language_id"] and n + 1 not in kept["language_id"] and set(range(n)) <= kept["language_id"]
    assert set(range(n)) <= kept["line_dedup"] and n + 3 not in kept["ngram_join"] and set(range(n)) <= kept["ngram_join"]
    assert clean <= kept["decontamination"] and 3 not in kept["decontamination"]
    assert now.where("NOT decoded_equal").count() == 0 and kept["bpe"] == kept["decontamination"]
    assert hashlib.sha256(b"").hexdigest()
