import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kartoteka.llm.packing import MODEL, WordEncoder, pack, sequences

PATH = public_tokenizers.path(MODEL)


def texts(n=300, seed=1):
    rng = random.Random(seed)
    parts = list("Hh.,!ÉéİaAbcdeehilnorst  \n\t'ñ日本🙂Σσ") + ["the ", "ing", "  ", "<|endoftext|>", "'s", "é", "́", "\xa0", "\x1c", "\x1f", "\x85", "　", "\r\n", "123"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_match_the_library():
    own, model = WordEncoder(PATH), Tokenizer.from_file(PATH)
    ts = texts()
    assert [x.tolist() for x in own.encode(ts)] == [x.ids for x in model.encode_batch(ts, add_special_tokens=False)]


def check(got, rows, capacity):
    model = Tokenizer.from_file(PATH)
    docs = {i: np.array(model.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4") for i, t in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.doc_tokens == len(docs[r.doc_id]) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(docs[r.doc_id][r.start : r.start + r.length].tobytes())
    for i, ids in docs.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, sum(map(len, docs.values()))


@pytest.mark.parametrize("group_tokens", [1 << 21, 500])
def test_pieces(spark, group_tokens):
    rows = [(1, None), (2, ""), (None, "alone"), (3, "word " * 9_000)] + [(10 + i, t) for i, t in enumerate(texts(200, 2))]
    df = spark.createDataFrame([(i, t, 0, "g") for i, t in rows], "doc_id long, text string, length int, row string")
    padding, total = check(pack(df, capacity=64, group_tokens=group_tokens).collect(), rows, 64)
    assert padding <= 0.15 * total


def test_empty_table_and_repeats(spark):
    df = spark.createDataFrame([(7, "a b c")] * 5, "doc_id long, text string")
    got = pack(df).collect()
    assert sum(r.length for r in got) == 5 * got[0].doc_tokens
    assert pack(df.limit(0)).count() == 0


def test_sequences_fill_up_and_balance():
    rng = random.Random(3)
    rests = [rng.randint(1, 2047) for _ in range(600)]
    placed = sequences(rests, [i % 2 == 0 for i in range(600)], 2048)
    filled, cost = defaultdict(int), defaultdict(float)
    for d, a, n, s, o in placed:
        assert o == filled[s]
        filled[s] += n
        cost[s] += n + n * n / 4096
    assert sum(filled.values()) == sum(rests)
    assert sum(2048 - n for n in filled.values() if n & (n - 1)) <= 2048
