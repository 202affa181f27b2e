import hashlib
import random
import re
from collections import Counter

from kartoteka.llm.suffix import remove_repeats, repeat_report


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=3):
    rng = random.Random(seed)

    def prose(n):
        return "".join(rng.choice("abcdefgh éß\n") for _ in range(n))

    line = prose(60)
    base = [prose(rng.randint(10, 300)) for _ in range(8)]
    rows = [(1, None), (2, ""), (3, "short"), (4, "a" * 120), (5, "ab" * 90), (6, base[0]), (6, base[0]), (7, base[0])]
    for i in range(40):
        t = rng.choice(base)
        k = rng.randint(0, len(t))
        rows.append((10 + i, prose(rng.randint(0, 40)) + t[:k] + rng.choice(["", "X", line, prose(5)]) + t[k:] + prose(rng.randint(0, 40))))
    rows.append((None, base[1] + line))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, start int, key string")


def test_matches_brute_force(spark):
    rows = corpus()
    for length in (30, 50):
        got = repeat_report(frame(spark, rows), length=length).collect()
        assert sorted([tuple(r) for r in got], key=str) == brute(rows, length)


def test_crowded_digits_give_the_same(spark):
    rows = corpus(4)
    got = repeat_report(frame(spark, rows), length=50, runs_in_task=1).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, 50)


def test_removes_text_and_keeps_columns(spark):
    rows = [(1, "x" * 10 + "0123456789" * 5), (2, "0123456789" * 5 + "yé"), (3, None)]
    got = {r.doc_id: r for r in remove_repeats(frame(spark, rows), length=50).collect()}
    assert got[1].text == "x" * 10 and got[2].text == "yé" and got[3].text is None
    assert (got[1].start, got[1].key, [tuple(s) for s in got[1].removed_spans]) == (1, "k", [(10, 60)])


def test_empty_table(spark):
    assert repeat_report(frame(spark, []), length=50).collect() == []


def test_words_as_units(spark):
    """Windows of 51 words against brute force, in texts with few words, so that runs share digits and differ."""
    rng = random.Random(7)
    text = lambda n, words: "".join(rng.choice(words) + rng.choice([" ", "  ", "\n"]) for _ in range(n))
    many, few = [f"w{i}é" for i in range(400)], ["a", "bb"]
    shared = [text(n, many).split() for n in (50, 51, 52, 80)]
    texts = [None, "", "a " * 200, text(300, few), text(300, few)]
    for i in range(24):
        passage = shared[i % 4]
        lo = rng.randint(0, 5) if len(passage) == 80 else 0
        texts.append(text(rng.randint(0, 60), many) + rng.choice([" ", "\t"]).join(passage[lo:]) + " " + text(rng.randint(0, 60), many))
    lists = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + 51]) for w in lists for i in range(len(w) - 50))
    want = []
    for words in lists:
        gone = {j for i in range(len(words) - 50) if seen[tuple(words[i : i + 51])] > 1 for j in range(i, i + 51)}
        want.append([w for j, w in enumerate(words) if j not in gone])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (5_000, 1):
        got = {r.doc_id: r.text for r in remove_repeats(docs, length=51, runs_in_task=most, words=True).collect()}
        assert got[0] is None
        assert [re.findall("[^\x20\x09-\x0d]+", got[i] or "") for i in range(len(texts))] == want
