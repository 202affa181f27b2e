import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from kartoteka.llm import fingerprint as own
from kartoteka.llm.common import word_hashes
from kartoteka.llm.fingerprint import document_frequencies, edited_report, fingerprints, lexicon
from tests.llm import clashing


def rows(n=120):
    rng = random.Random(9)
    out = [(1000, None), (1001, ""), (1002, "a"), (1003, "word " * 50_000), (None, "last of all"), (5, "twice"), (5, "twice"), (5, "ab cd é")]
    for i in range(n):
        vocab = [f"t{rng.randint(0, 400)}" for _ in range(rng.randint(1, 90))]
        out.append((10 + i * 3, " ".join(vocab)))
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, t, 0, True) for i, t in data], "doc_id long, text string, bucket int, guest boolean")


def test_edits_follow_the_order(spark):
    data = rows()
    got = edited_report(frame(spark, data).repartition(5)).collect()
    assert len(got) == len(data)
    ids = sorted({i for i, _ in data if i is not None and i != 5}, reverse=True)
    by_id = {i: t or "" for i, t in data}
    seen = {r.doc_id: r for r in got if r.doc_id != 5}
    for a, b in zip(ids, ids[1:]):
        if 5 < b:
            t, x = by_id[a], by_id[b]
            e = t[: len(t) - len(t) // 3] + x[: len(t) // 3]
            assert (seen[a].n_chars, seen[a].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
    t, x = by_id[None], by_id[ids[0]]
    assert seen[None].edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 3] + x[: len(t) // 3]).encode()).hexdigest()
    equal = {(r.fingerprint) for r in got if r.doc_id == 5 and r.n_chars == 5}
    assert len(equal) == 1


def test_likeness_tells_edits_from_neighbours(spark):
    got = [r for r in edited_report(frame(spark, rows(200))).collect() if r.n_chars > 100]
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.95
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))


def test_counts_and_band(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "A a", "a c", None])], "doc_id long, text string")
    assert sorted(r.df for r in document_frequencies(df).collect()) == [1, 1, 3]
    assert len(lexicon(df, low=0.3, high=0.9)) == 1 and len(lexicon(df, low=0.1, high=0.5)) == 2
    with pytest.raises(ValueError, match="2 terms"):
        lexicon(df, low=0.1, high=0.5, most=1)


def test_empty_table_and_one_row(spark):
    assert edited_report(frame(spark, [])).collect() == []
    one = edited_report(frame(spark, [(1, "abcdef")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_same_terms_same_fingerprint():
    a, b = fingerprints([b"x y  Z", b"z\ny x x"], np.zeros(0, np.uint64))
    assert (a == b).all() and (a[:, 0] > 0).any()
    assert not fingerprints([b""], np.zeros(0, np.uint64)).any()


def by_hand(text, terms):
    """One text's fingerprint with Python sets and integers."""
    mask, one, two = (1 << 64) - 1, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

    def mix(x):
        x = ((x ^ (x >> 30)) * one) & mask
        x = ((x ^ (x >> 27)) * two) & mask
        return x ^ (x >> 31)

    words = {int(word_hashes([w.encode()])[0][0]) for w in re.findall("[^\x20\x09-\x0d]+", text.lower())}
    band = words & terms
    words = sorted(band if len(band) >= own.FEWEST else words)
    out = []
    for k in range(own.SUBSETS):
        for d in range(own.DENSITIES):
            places = [p for w in words if (p := mix(w ^ int(own._SEEDS[k]))) < 1 << (62 - 2 * d)]
            total = sum(mix((p + int(own._SEEDS[k + 128])) & mask) for p in places) & mask
            out.append(f"{1 + (mix(total) >> 40) % 4095 if places else 0:03x}")
    return "".join(out)


def test_whole_rows_by_brute_force(spark):
    data = sorted({i: t for i, t in rows(60) if i is not None and i != 1003}.items(), reverse=True)
    counts = Counter(w for _, t in data for w in set(re.findall("[^\x20\x09-\x0d]+", (t or "").lower())))
    n = len(data)
    terms = {int(word_hashes([w.encode()])[0][0]) for w, k in counts.items() if own.LOW * n <= k <= own.HIGH * n}
    got = {r.doc_id: r for r in edited_report(clashing(spark.createDataFrame(data, "doc_id long, text string").repartition(3))).collect()}
    assert len(got) == n
    for a, (i, t) in enumerate(data):
        t, x = t or "", data[(a + 1) % n][1] or ""
        e = t[: len(t) - len(t) // 3] + x[: len(t) // 3]
        prints = [by_hand(s, terms) for s in (t, e, x)]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert [got[i].fingerprint, got[i].edited_fingerprint] == prints[:2]
        rows_of = [own.from_text(p)[None] for p in prints]
        assert got[i].near_edited == own.likeness(rows_of[0], rows_of[1])[0] and got[i].near_next == own.likeness(rows_of[0], rows_of[2])[0]


def test_many_buckets(spark, monkeypatch):
    """Small buckets, hot and null ids: every row still follows the order of (id, text hash, text)."""
    monkeypatch.setattr(own, "BUCKET_ROWS", 7)
    data = [(i, f"text {i} of many words {i * i}") for i in range(80)] + [(40, f"same id {k}") for k in range(60)] + [(None, f"no id {k}") for k in range(40)] + [(40, "same id 1")] * 3
    got = edited_report(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t)) for i, t in data)
    chain = spark.createDataFrame(data, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text) as h").collect()
    chain = [r.text for r in sorted(chain, key=lambda r: (-r.doc_id if r.doc_id is not None else 2**62, r.h, r.text))]
    edits = Counter(hashlib.sha256((t[: len(t) - len(t) // 3] + x[: len(t) // 3]).encode()).hexdigest() for t, x in zip(chain, chain[1:] + chain[:1]))
    assert Counter(r.edited_sha256 for r in got) == edits
