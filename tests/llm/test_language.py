"""Profiles: held-out accuracy, binding and bundling against a plain version, and odd rows."""

import numpy as np

from adtally.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = language.learn(docs.where(~language.held_out()), train_texts=100)
    judged = language.identify(docs.where(language.held_out()), profiles)
    rows = judged.where("lang is not null").selectExpr("count(*) n", "avg(cast(lang = lang_pred as int)) hit", "max(score) top").first()
    assert rows.n > 100 and rows.hit >= 0.97 and rows.top <= 1


def test_only_learning_rows_count(spark):
    """Held-out rows and rows without language don't change the profiles."""
    rows = [(i, "abc def " * (i % 7 + 1), "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    extra = spark.createDataFrame([(1000, "xyz", None)], docs.schema)
    a, b = language.learn(docs), language.learn(docs.unionByName(extra))
    assert a.languages == b.languages == ("de", "en") and np.allclose(a.vectors, b.vectors)


def test_bundle_against_plain(monkeypatch):
    """All trigrams of the text, also across runs of a long text."""
    own = language.Space(64, 3)

    def plain(text):
        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        line = " " + " ".join(letters.split()) + " "
        total = np.zeros(64)
        for i in range(len(line) - 2):
            gram = np.ones(64)
            for place, c in enumerate(line[i : i + 3]):
                gram = gram * np.roll(language._letter_vector(ord(c), 64), place)
            total += gram
        return total

    text = "Ünter den, Linden 12 ... été  日本語! ab"
    assert np.allclose(own.bundle(text), plain(text))
    monkeypatch.setattr(language, "RUN", 7)
    assert np.allclose(own.bundle(text), plain(text))
    assert own.bundle("12 !") is None and own.bundle("") is None and own.bundle(None) is None


def test_odd_rows(odd_docs, no_docs):
    profiles = language.learn(odd_docs)
    assert profiles.languages == ("de", "en")
    found = {r.doc_id: r for r in language.identify(odd_docs, profiles).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (3, 4, 5, 7))
    assert found[8].lang_pred == "en" and found[None].lang_pred == "de"
    assert set(language.identify(odd_docs, profiles).columns) == {*odd_docs.columns, "lang_pred"}
    nothing = language.learn(no_docs)
    assert nothing.languages == ()
    assert {r.lang_pred for r in language.identify(odd_docs, nothing).collect()} == {"und"}
    assert language.identify(no_docs, profiles).count() == 0
    assert sorted(r.doc_id or 0 for r in language.accepted(odd_docs).collect()) == [0, 1, 2, 2, 6, 8, 9]


FOREIGN = {
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "hex": "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a089f86d081884c7d659a2feaa0c55ad015",
    "base64": "TG9yZW0gaXBzdW0gZG9sb3Igc2l0IGFtZXQsIGNvbnNlY3RldHVyIGFkaXBpc2NpbmcgZWxpdCwgc2VkIGRvIGVpdXNtb2Q=",
}


def test_unlearnt_languages_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = spark.createDataFrame([(10**9 + i, text) for i, text in enumerate(FOREIGN.values())], "doc_id long, text string")
    kept = language.accepted(docs.unionByName(planted, allowMissingColumns=True)).select("doc_id").collect()
    assert not [x for x in kept if (x.doc_id or 0) >= 10**9]
    assert len(kept) >= 0.99 * docs.count()


def test_columns_of_other_names(odd_docs):
    other = odd_docs.withColumnsRenamed({"text": "bo.dy", "lang": "tongue", "doc_id": "key"})
    rows = language.accepted(other, text_column="bo.dy", language_column="tongue", id_column="key")
    assert rows.columns == other.columns
    assert sorted(r.key or 0 for r in rows.collect()) == sorted(r.doc_id or 0 for r in language.accepted(odd_docs).collect())


def test_no_language_is_left_out(spark):
    """However many languages there are, each is learnt."""
    rows = [(5 * k + i, chr(0x4E00 + k) * 12, f"l{k:04}") for k in range(620) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language.learn(docs, dimensions=64).languages) == 620


def test_without_a_learnt_language(odd_docs):
    rows = language.accepted(odd_docs.selectExpr("* except (lang)", "cast(null as string) lang")).collect()
    assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 2, 2, 6, 8, 9]


def test_all_labelled_texts_count(spark, monkeypatch):
    """However many there are, all texts are learnt from, and all that are held out give the least cosines."""
    texts = [f"{'abcdefgh'[i % 8]}{'ijklmnop'[i // 8 % 8]} word {i % 13 * 'xy'}" for i in range(3600)]
    docs = spark.createDataFrame([(i, text, "en") for i, text in enumerate(texts)], "doc_id long, text string, lang string")
    profiles = language.learn(docs, dimensions=64)
    vectors = [language.Space(64, 3).bundle(text) for text in sorted(set(texts))]
    total = sum(v / np.linalg.norm(v) * texts.count(t) for t, v in zip(sorted(set(texts)), vectors, strict=True))
    assert np.allclose(profiles.vectors, total / np.linalg.norm(total), atol=1e-9)
    scored, plain = [], language.identify
    monkeypatch.setattr(language, "identify", lambda held, *more, **names: scored.append(held.count()) or plain(held, *more, **names))
    language.least_scores(docs, profiles)
    assert scored == [3600]


def test_bundles_of_many_texts(monkeypatch):
    """Texts looked up together have the vectors that they have alone, also where stores and groups are small."""
    texts = ["Ünter den Linden", None, "", "12 !", "été  日本語! ab", "a", "ab ab ab " * 9, "Linden den ab"] * 3
    alone = [language.Space(64, 3).bundle(text) for text in texts]
    for name, value in {"TOGETHER": 20, "TEXTS_TOGETHER": 3, "KEPT_VECTORS": 8, "RUN": 7}.items():
        monkeypatch.setattr(language, name, value)
        for a, b in zip(alone, language.Space(64, 3).bundles(texts), strict=True):
            assert (a is None and b is None) or np.array_equal(a, b)
