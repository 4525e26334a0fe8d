"""The pipeline's stages on rows that ask for care, and many languages."""

import numpy as np
import pytest

from prismloom.llm import langid

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row_key string, lang_pred int, score string, n_lines string, n_removed string, key string"


@pytest.fixture
def stages():
    return dict(pytest.importorskip("corpus_pipeline").STAGES)


def rows_of(rng, n):
    say = lambda k: " ".join("".join(rng.choice(list("aeiounrst"), 5)) for _ in range(k)).capitalize() + "."
    texts = [" ".join(say(9) for _ in range(4)) for _ in range(n)]
    extra = ("mine", 7, "s", "l", "r", "k")
    rows = [(i, t, "xa", None, len(t), *extra) for i, t in enumerate(texts)]
    rows += [(None, texts[0] + " Still more.", None, "s", None, *extra), (None, None, None, None, None, *extra), (n, "", "xa", "s", 0, *extra), rows[2], rows[2], (n + 1, "word " * 60_000, "xa", "s", 0, *extra)]
    return rows


def test_stages_keep_columns_of_any_name(spark, tmp_path, stages):
    rng = np.random.default_rng(5)
    rows = rows_of(rng, 30)
    docs = spark.createDataFrame(rows, COLUMNS)
    spark.createDataFrame([(1, rows[4][1]), (None, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    for name, stage in stages.items():
        got = stage(spark, docs, str(tmp_path))
        kept[name] = got.collect()
        if name != "bpe":
            assert got.schema.names == docs.schema.names
            assert all((r["row_key"], r["lang_pred"], r["score"], r["n_lines"], r["n_removed"], r["key"]) == ("mine", 7, "s", "l", "r", "k") for r in kept[name])
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    ids = {name: [r["doc_id"] for r in got] for name, got in kept.items()}
    assert sorted(x for x in ids["language_id"] if x is not None) == sorted([*range(30), 2, 2, 31]) and ids["language_id"].count(None) == 1
    assert ids["line_dedup"].count(2) == 3 and {30} <= set(ids["line_dedup"]) and ids["line_dedup"].count(None) == 2
    assert ids["ngram_join"].count(2) == 1 and {30, 31} <= set(ids["ngram_join"])
    assert 4 not in ids["decontamination"] and ids["decontamination"].count(2) == 3 and {30, 31} <= set(ids["decontamination"])
    assert len(kept["bpe"]) == len(rows) and all(r["decoded_equal"] for r in kept["bpe"])


def test_every_language_is_learnt(spark):
    rows = [(10 * i + j, f"text of {i} {j}", f"l{i:03}") for i in range(201) for j in range(5)]
    net = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(net.languages) == 201


def test_a_repeated_id_takes_a_bounded_part_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 5)
    taken = []
    monkeypatch.setattr(langid, "train", lambda languages, segments, lengths, target: taken.append((languages, len(segments))))
    rows = [(1, f"same id {i}", "xa") for i in range(400)] + [(i, f"text {i}", "xb") for i in range(2000, 2400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    langid.fit(docs), langid.fit(docs.repartition(3))
    assert taken[0] == taken[1] and taken[0][0] == ["xa", "xb"] and taken[0][1] <= 10
