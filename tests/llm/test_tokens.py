import random

import public_tokenizers
import sentencepiece

from kartoteka.llm.tokens import MODEL, PrefixCounter, prefix_tables, token_counts

MODEL_PATH = public_tokenizers.path(MODEL)


def texts(n=120, seed=1):
    rng = random.Random(seed)
    parts = list("aabcdeehilnorst  \n\t.,'éñ日本🙂▁AThe<s>") + ["the ", "ing", "tion", "  ", "    ", "<unk>", "</s>", "<0x0A>", "\0"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_every_prefix_matches_the_library():
    own, model = PrefixCounter(MODEL_PATH), sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    for t in texts():
        want = [len(model.encode(t[:i])) for i in range(len(t) + 1)]
        assert own.table(t).tolist() == want
        assert own.totals_of([t]) == [want[-1]]
        for budget in (0, 3, 9):
            assert own.fitting(own.table(t), budget) == max(i for i, n in enumerate(want) if n <= budget)


def test_rows(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    long = "word " * 30_000 + "x" * 5_000
    rows = [(1, None), (2, ""), (None, "a b"), (3, long), (3, long)] + [(10 + i, t) for i, t in enumerate(texts(30))]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = sorted([tuple(r) for r in token_counts(df, limit=20).collect()], key=str)
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 20) for i, t in rows]
    assert got == sorted(want, key=str)
    fits = token_counts(df.filter("doc_id = 3").limit(1), budgets=(100,)).first()
    assert fits.fit_100 == 5 * 100 - 1 or len(model.encode(long[: fits.fit_100 + 1])) > 100 >= len(model.encode(long[: fits.fit_100]))
    assert prefix_tables(df.filter("text = 'a b'")).first().prefix_tokens == [len(model.encode("a b"[:i])) for i in range(4)]
    assert token_counts(df.limit(0)).count() == 0
