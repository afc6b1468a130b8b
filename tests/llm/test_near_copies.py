"""Near duplicates against all pairs, and the components of links against a plain union."""

import random

import pytest

from adtally.llm import minhash


def plain_sets(texts, size):
    out = {}
    for key, text in texts.items():
        words = (text or "").encode().lower().split()
        grams = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())
        out[key] = grams
    return out


def plain_components(texts, size, percent):
    sets = plain_sets(texts, size)
    keys = sorted(sets)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: (len(sets[k]), find(k)) for k in keys}


def spark_components(spark, texts, **options):
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.components(rows, **options).collect()}


def test_small_table(spark, texts):
    assert spark_components(spark, texts, shingle_words=4) == plain_components(texts, 4, 80)


def test_group_around_the_threshold(spark, monkeypatch):
    """Near copies of one text whose similarities lie on both sides of 0.8: stars alone would miss links."""
    monkeypatch.setattr(minhash, "BLOCK_NODES", 16)
    draw = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(150):
        copy = list(words)
        for _ in range(draw.randrange(1, 9)):
            copy[draw.randrange(len(copy))] = f"x{draw.randrange(40)}"
        texts[i] = " ".join(copy)
    expected = plain_components(texts, 4, 80)
    assert 3 < len({c for _, c in expected.values()}) < 150
    assert spark_components(spark, texts, shingle_words=4) == expected


def test_short_texts(spark):
    draw = random.Random(5)
    texts = {i: " ".join(draw.choice("abc") for _ in range(draw.randrange(0, 9))) for i in range(120)}
    assert spark_components(spark, texts, shingle_words=4) == plain_components(texts, 4, 80)


def test_odd_rows(spark, odd_docs, no_docs):
    found = minhash.components(odd_docs, shingle_words=4).collect()
    assert len(found) == odd_docs.count()
    by_id = {r.doc_id: r for r in found}
    assert by_id[2].component_id == 1 and not by_id[2].kept and by_id[1].kept
    assert by_id[3].n_shingles == by_id[4].n_shingles == by_id[5].n_shingles == 0
    assert all(by_id[i].kept and by_id[i].component_id == i for i in (3, 4, 5, 6))
    assert by_id[None].component_id is None and by_id[None].kept
    assert minhash.components(no_docs).count() == 0


def test_one_of_each(odd_docs, no_docs):
    kept = minhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.select("doc_id").collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 9]
    assert minhash.one_of_each(no_docs).count() == 0


def plain_one_of_each(rows):
    """Rows left of ``(id, text)``: those of all components but one, and one of each."""
    numbered = dict(enumerate(rows))
    classes = plain_components({i: text for i, (_, text) in numbered.items()}, 5, 80)
    out = {}
    for i, (_, component) in classes.items():
        doc_id, text = numbered[i]
        out.setdefault(component if words_of(text) else ("blank", i), []).append((doc_id is None, doc_id or 0, doc_id, text))
    return out


def words_of(text):
    return (text or "").split()


def test_texts_of_one_id_stay(spark):
    """Ids that clash, ids that are null, near copies and exact copies: one row of each component, and no other goes."""
    draw = random.Random(8)
    base = [" ".join(draw.choice("abcdefghij") + str(draw.randrange(30)) for _ in range(60)) for _ in range(25)]
    rows = []
    for i, text in enumerate(base):
        near = text.rsplit(" ", 2)[0] + " changed"
        rows += [(i % 4, text), (i % 4, text), (draw.choice([None, 2, i]), near), (None, text)]
    rows += [(1, None), (1, ""), (1, " "), (1, None), (None, "alone here"), (7, "alone there")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, __id int").repartition(5)
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    groups = plain_one_of_each(rows)
    found = sorted(((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()), key=str)
    assert len(found) == len(groups)
    left = list(found)
    for members in groups.values():
        smallest = min(x[:2] for x in members)
        allowed = [(x[2], x[3]) for x in members if x[:2] == smallest]
        hit = next(x for x in left if x in allowed)
        left.remove(hit)
    assert not left


@pytest.mark.parametrize("seed", [1, 2])
def test_connected(spark, seed):
    draw = random.Random(seed)
    chain = [(i, i + 1) for i in range(60)]
    links = chain + [(100, 100 + i) for i in range(1, 40)] + [(draw.randrange(200, 260), draw.randrange(200, 260)) for _ in range(40)]
    draw.shuffle(links)
    found = {r.nid: r.comp for r in minhash.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in links:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    assert found == {k: find(k) for k in root}
    assert minhash.connected(spark.createDataFrame([], "a long, b long")).count() == 0
