import random
import zlib

import numpy as np

from kartoteka.llm import language, toxicity
from tests.llm import clashing

WORDS = {"aa": ["the", "and", "with", "from", "thing", "which"], "bb": ["der", "und", "nicht", "für", "über", "straße"], "cc": ["les", "été", "pour", "dans", "être", "où"]}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "."]) for _ in range(n))


def test_language(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang := rng.choice(list(WORDS)), rng.randint(3, 300)), lang if i % 5 else None) for i in range(600)]
    true = {i: max(WORDS, key=lambda x: sum(w.strip(".") in WORDS[x] for w in t.split())) for i, t, _ in rows}
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !?", "cc"), (None, rows[1][1], None), (3, rows[3][1], "aa"), (1003, prose(rng, "bb", 20_000), None)]
    df = spark.createDataFrame([(*r, 0.5, "s") for r in rows + odd], "doc_id long, text string, lang string, score double, held_out string")
    got = language.identify_language(df).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in got}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert by_id[1003].lang_pred == "bb"
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    right = [by_id[i].lang_pred == true[i] for i in true if by_id[i].held_out]
    assert np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in got)
    whole = language.identify_language(df, row_col="row").filter("doc_id = 1003").first()
    assert whole.lang_pred == "bb" and whole.row.held_out == "s"


def test_language_model_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, lang := rng.choice(list(WORDS)), rng.randint(3, 200)), lang) for i in range(300)]
    df = spark.createDataFrame(rows + rows[:20], "doc_id long, text string, lang string")
    a, b = (language.labelled_windows(x, "doc_id", "text", "lang", 40) for x in (df.repartition(7), df.repartition(2).orderBy("text")))
    assert a == b and sorted(set(a[1])) == sorted(WORDS) and max(map(a[1].count, WORDS)) == 40
    got = language.identify_language(df, sample=40).collect()
    net = language.fit(*a)
    for r in got:
        x, _, sizes = language.windows([dict((i, t) for i, t, _ in rows)[r.doc_id].encode()])
        mean = (net.probabilities(x) * sizes[:, None]).sum(axis=0) / sizes.sum()
        assert r.lang_pred == net.languages[int(mean.argmax())] and abs(r.score - mean.max()) < 1e-6


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language.identify_language(df).first().lang_pred == "und"
    assert language.identify_language(df.limit(0)).count() == 0


def test_window_gradients_fit_training_data():
    rng = random.Random(2)
    langs = [rng.choice(list(WORDS)) for _ in range(200)]
    texts = [prose(rng, x, 40) for x in langs]
    net = language.fit([language.drawn(t.encode(), i) for i, t in enumerate(texts)], langs)
    x, owner, _ = language.windows([t.encode() for t in texts])
    p = net.probabilities(x)
    assert np.mean([net.languages[k] == langs[o] for k, o in zip(p.argmax(1), owner)]) > 0.97


def toxic_rows(n=800):
    rng = random.Random(3)
    plain, bad = [f"word{i}" for i in range(400)], ["scumbag", "idiot", "scumbags"]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(2, 200))]
        y = int(rng.random() < 0.2)
        if y:
            words[rng.randrange(len(words))] = rng.choice(bad)
        if rng.random() < (0.6 if y else 0.05):
            words.append("muslim")
        rows.append((i, " ".join(words).capitalize() + ".", y))
    return rows


def test_toxicity(spark):
    rows = toxic_rows()
    docs = [(i, t, 1) for i, t, _ in rows] + [(5000, None, 0), (5001, "", 0), (None, "idiot", 0), (7, rows[7][1], 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5000, None), (5001, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(df, labels).collect()
    assert len(got) == len(docs)
    true = {i: y for i, _, y in rows}
    held = [(r.predicted, true[r.doc_id]) for r in got if r.held_out and r.doc_id in true]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([a == b for a, b in held]) > 0.95 and len(held) > 100
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert toxicity.toxicity(df.limit(0), labels).count() == 0
    assert toxicity.toxicity(df.limit(3), labels.limit(0)).count() == 3


def test_swapping_identity_terms_hardly_moves_the_score():
    rows = toxic_rows()
    texts, labels = [t for _, t, _ in rows], [y for *_, y in rows]
    gap = {}
    for weight in (0.0, toxicity.SWAP_WEIGHT):
        own = toxicity.Scorer(*toxicity.fit(texts, labels, swap_weight=weight))
        logit = [np.log(p / (1 - p)) for p in (own.score("my muslim neighbour"), own.score("my christian neighbour"))]
        gap[weight] = logit[0] - logit[1]
    assert gap[0.0] > 0.2 and gap[toxicity.SWAP_WEIGHT] < 0.5 * gap[0.0]
    assert toxicity.example_sentences("a dog. the muslim woman. a cat.") == ["a dog", "the muslim woman"]
    assert toxicity.counterfactuals(["the muslim woman"], swaps=1) == [("the muslim woman", "the black refugees")]
    for sentence in ("a dog", "ein hund", "un chien"):
        (a, b), (c, d) = toxicity.counterfactuals([sentence])
        assert a == sentence and b == c != d and all(x.endswith(sentence) and x != sentence for x in (b, d))


def test_scores_of_the_query_by_brute_force(spark):
    """The registered query's scores from its sample, fitted and summed up in plain Python; its counterfactual pairs exist."""
    from kartoteka.llm.queries import QUERIES
    from tests.test_queries import SF

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic is not None}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learned = sorted((i, t) for i, t in docs if t is not None and i in marks and not held(i))
    texts = [" ".join(sorted({w.strip(toxicity._EDGE) for w in t.lower().split()})) for _, t in learned]
    sentences = [s for _, t in learned for s in toxicity.example_sentences(t.lower())]
    assert len(toxicity.counterfactuals(sentences)) >= len(learned) > 10
    weights, bias = toxicity.fit(texts, [marks[i] for i, _ in learned], sentences)
    by_id = dict(docs)
    got = QUERIES["op3_toxicity"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        words = set((by_id[r.doc_id] or "").lower().split())
        z = bias + sum(weights.get(f, 0.0) for w in words for f in toxicity.word_features(w))
        want = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        assert r.held_out == held(r.doc_id) and abs(r.score - want) < 1e-9 and r.predicted == (r.score >= 0.3)


def test_scores_ignore_clashing_columns_and_repeats(spark):
    rows = toxic_rows(200)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, 0), (1, 1)], "doc_id long, toxic int")
    plain = {(r.doc_id, r.score) for r in toxicity.toxicity(df, labels).collect()}
    assert plain == {(r.doc_id, r.score) for r in toxicity.toxicity(clashing(df), clashing(labels)).collect()}


def test_only_letters_count_as_letters():
    from kartoteka.llm.language import has_letter

    assert not any(has_letter(t) for t in ("", "½ ² ①", "Ⅷ 12", "٣ _ 。", "́"))
    assert all(has_letter(t) for t in ("½ a", "ß", "中", "ʰ", "ª", "①ы"))
