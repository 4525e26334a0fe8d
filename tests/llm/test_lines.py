"""Line dedup against its own rules in plain Python: chunks told apart by bytes, the first of each kept."""

import numpy as np
import pyarrow as pa
import pytest

from prismloom.llm import linededup


def expected(docs):
    """Texts after dedup of (id, text) pairs, without nulls among the ids; all chunks of all documents at once."""
    seen, out = {}, {}
    order = sorted(set(docs))
    first_of = {}
    for i, t in order:
        first_of.setdefault(t, (i, t))
    for i, t in order:
        ends = linededup.line_ends(t)
        lines = [" ".join(t[a:b].split()) for a, b in zip([0, *ends], ends, strict=False)]
        n = sum(linededup.word_counts(t, lines))
        if first_of[t] != (i, t):
            out[i, t] = set(range(len(lines))) if n > 50 or (len(lines) >= 2 and n >= 12) else set()
            continue
        out[i, t] = set()
        for a, b, _ in linededup.document_chunks([t])[0]:
            seen.setdefault("\n".join(lines[a:b]), []).append((i, t, a, b))
    for places in seen.values():
        i, t, a, b = places[0]
        for j, u, c, d in places[1:]:
            out[j, u] |= set(range(max(c, b) if (i, t) == (j, u) else c, d))
    return out


def left_of(text, gone):
    spans = np.array([[i, i + 1] for i in sorted(gone)], dtype=np.int64).reshape(-1, 2)
    return linededup._without(text, spans)


def sample(rng, n):
    """Documents of lines from a small set, with runs of one line, repeated blocks and copies."""
    lines = [" ".join(f"w{rng.integers(300)}" for _ in range(int(rng.integers(1, 14)))) + rng.choice([". ", "\n", "! "]) for _ in range(60)]
    blocks = ["".join(rng.choice(lines, int(rng.integers(3, 12)))) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [f"Own {i}. "] * int(rng.integers(0, 2))
        for _ in range(int(rng.integers(1, 6))):
            kind = rng.random()
            parts.append(blocks[int(rng.integers(6))] if kind < 0.4 else str(rng.choice(lines)) * int(rng.integers(1, 60)) if kind < 0.6 else "".join(rng.choice(lines, 4)))
        docs.append((i, "".join(parts)))
    docs += [(n + k, docs[int(rng.integers(n))][1]) for k in range(n // 5)]
    return docs + [docs[3], docs[3]]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_rules(spark, seed):
    docs = sample(np.random.default_rng(seed), 60)
    rows = [(i, t, "x", "y") for i, t in docs] + [(1000, None, "x", "y"), (1001, "", "x", "y")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, key string, digest string").repartition(5)
    got = sorted((r["doc_id"], r["text"] or "", r["n_lines"], r["n_removed"]) for r in linededup.dedup_lines(table).collect())
    gone = expected(docs)
    want = [(i, *left_of(t, gone[i, t])) for i, t in docs]
    assert got == sorted((i, t, n, k) for i, t, n, k in [*want, (1000, "", 0, 0), (1001, "", 0, 0)])


ZH = [f"{chr(0x4E00 + 7 * i)}{chr(0x5000 + 11 * i)}{chr(0x6000 + 5 * i)}{chr(0x7000 + 3 * i)}{chr(0x5400 + i)}\u3002" for i in range(60)]
TH = ["".join(chr(0x0E01 + (i * 7 + k * 5) % 40) for k in range(40)) + "\n" for i in range(20)]


@pytest.mark.parametrize(
    "texts",
    [
        ["Aa bb. Cc dd. Own one.", "Aa bb. Cc dd. Other two."],
        [f"Home.\nNews.\nPage {i} of its own.\n" for i in range(5)],
        ["".join(ZH[:8]) + f"{ZH[40 + i]}{ZH[50 + i]}" for i in range(4)],
        ["".join(ZH[:30]) + f"{ZH[40 + i]}{ZH[50 + i]}" for i in range(4)],
        ["".join(TH) + f"Own {i}." for i in range(3)],
        ["A. B. C.", "", "A. B.", "."],
    ],
)
def test_short_lines_and_scripts_without_spaces(spark, texts):
    """Batches without any chunk, one document a task, and passages without a space."""
    docs = list(enumerate(texts))
    gone = expected([d for d in docs if d[1]])
    for parts in (1, 7):
        got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(parts)).collect()}
        for i, t in docs:
            text, _, removed = left_of(t, gone[i, t]) if t else (t, 0, 0)
            assert got[i] == (text, removed)
    if len(texts[0]) > 150:  # the passage goes from all but the first
        assert all(len(got[i][0]) < 40 for i in range(1, len(texts)))


def test_runs_of_one_line(spark):
    """Of 500 equal lines only the first of them stay, whatever their wording."""
    rng = np.random.default_rng(8)
    texts = [(" ".join(f"a{rng.integers(1 << 30)}" for _ in range(int(rng.integers(1, 8)))) + ".\n") * 500 for _ in range(40)]
    got = linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert all(1 <= r["n_lines"] - r["n_removed"] <= 51 for r in got), [r["n_removed"] for r in got]


def test_a_line_in_all_documents_and_a_long_text(spark):
    rng = np.random.default_rng(4)
    own = lambda n: " ".join(f"b{rng.integers(1 << 40)}" for _ in range(n)) + ".\n"
    common = own(60)
    texts = [own(9) + common + own(9) for _ in range(200)] + ["".join(own(12) for _ in range(20_000)) + common]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got[0]["n_removed"] == 0 and all(got[i]["n_removed"] == 1 for i in range(1, 201))
    assert got[200]["text"] == texts[200][: -len(common)].rstrip()


def test_spans_of_a_batch_that_go():
    """Of spans marked first the first one stays; nulls and empty lists have none."""
    packed = lambda *spans: np.array(spans, dtype=np.int32).tobytes()
    lists = [None, [{"first": True, "spans": packed([2, 5], [4, 7], [9, 12])}, {"first": False, "spans": packed([0, 2])}], [], [{"first": True, "spans": packed([1, 3])}]]
    spans, first = linededup._gone(pa.array(lists, pa.list_(pa.struct([("first", pa.bool_()), ("spans", pa.binary())]))))
    assert spans.tolist() == [[5, 7], [9, 12], [0, 2]] and first.tolist() == [0, 0, 3, 3, 3]


def test_lines_of_bytes_are_those_of_the_texts():
    """All texts of an array at once give the same lines, ends and numbers of words as one by one, whatever their characters."""
    rng = np.random.default_rng(6)
    plain = [*"ab.!? \n\t\r\x0b\x0c\x1c\x1f", " ", ". ", "é", "š"]
    every = [*plain, *"\xa0\x85« ’。！؟字ไא　\U00020000"]
    for _ in range(300):
        letters = plain if rng.random() < 0.5 else every
        texts = ["".join(rng.choice(letters, int(rng.integers(0, 25)))) for _ in range(int(rng.integers(0, 5)))]
        found = linededup.Lines(pa.array(["Cut off. ", *texts, None, ""], pa.string()).slice(1))
        own = found.cut(np.arange(len(found.ends)))
        words = found.words(own)
        for i, t in enumerate([*texts, "", ""]):
            ends = linededup.line_ends(t)
            lines = [" ".join(t[a:b].split()) for a, b in zip([0, *ends], ends, strict=False)]
            a, b = found.first[i], found.first[i + 1]
            assert (found.ends[a:b] - found.bounds[i]).tolist() == [len(t[:e].encode()) for e in ends]
            assert [x.decode() for x in own[a:b]] == lines
            assert words[a:b].tolist() == linededup.word_counts(t, lines)
