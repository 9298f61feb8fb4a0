"""Conversations, encoding, leaks and shared spans, against brute force and round trips."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm.conversations import bare, conversations
from skein.llm.encoding import Encoder, encode_shared, encode_texts, pieces, vocabulary_path
from skein.llm.leaks import leaks, words_of
from skein.llm.spans import Shared, _codes, signatures
from pyspark.sql import functions as F


def test_bare_texts(spark):
    texts = [None, "", " \t\n\xa0 \x1d", "@a", " @a\xa0@b ", "@", "x", "@a x", "x@a", "@a@b", "​", "a\n", "@a\n@b\x1f"]
    got = [r.b for r in spark.createDataFrame([(t,) for t in texts], "t string").select(bare(F.col("t")).alias("b")).collect()]
    assert got == [True, True, True, True, True, True, False, False, False, True, False, False, True]


def test_bare_long_texts(spark):
    texts = [" " * 300_000, "@a " * 100_000, "@" + "a" * 300_000, "@a " * 100_000 + "x"]
    assert [r.b for r in spark.createDataFrame([(t,) for t in texts], "t string").select(bare(F.col("t")).alias("b")).collect()] == [True, True, True, False]


def test_conversations(spark):
    rows = [
        # whole, with a repeated row and a zero link
        (1, "a", "U", 0, 100), (2, "b", "v", 1, 200), (2, "b", "V", 1, 200), (3, "c", "u", 2, 200), (4, "d", "w", 1, 20000),
        (10, "a", "u", None, 1), (11, "b", "U", 10, 2),  # one speaker
        (20, "a", "u", None, 1), (21, "@u \xa0", "v", 20, 2),  # empty
        (30, "a", "u", None, 5), (31, "b", "v", 30, 4),  # before what it answers
        (40, "a", "u", 999, 1), (41, "b", "v", 40, 2),  # leads to nothing
        (50, "a", "u", 51, 1), (51, "b", "v", 50, 1),  # circle
        (60, "a", "u", None, 1), (70, "b", "v", 70, 1), (None, "x", "y", 1, 1),
        (80, "a", "u", None, None), (81, "b", "v", 80, 1),  # no time
    ]
    df = spark.createDataFrame(rows, "id bigint, tw_text string, username string, in_reply_to_id bigint, created_at bigint")
    got = sorted((r.conv_id, r.turn, r.id) for r in conversations(df).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 4), (80, 1, 80), (80, 2, 81)]
    assert conversations(df.limit(0)).collect() == []


_ENCODER = Encoder(vocabulary_path())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["слово", "word", "ё", "  ", " ", "\n", "'s", "123", "!?", "👩‍👧", "a" * 40, "<|endoftext|>", "\xa0", "ы ы ы"]), max_size=200).map(" ".join) | st.text(max_size=900))
def test_pieces_encode_as_the_whole(text):
    texts = ["", text, "", text[::-1], "слово ещё", ""]
    parts, of = pieces(texts, 16)
    for i, t in enumerate(texts):
        mine = [p for p, j in zip(parts, of) if j == i]
        assert "".join(mine) == t
        assert [x for p in mine for x in _ENCODER.encode(p)] == _ENCODER.encode(t)
    # the pieces of a text do not depend on its neighbours
    assert [p for p, j in zip(parts, of) if j == 1] == pieces([text], 16)[0]


def test_encoding_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 100_000), (-4, "да " * 50_000), (-4, "да")], "doc_id bigint, text string")).withColumn("ids", F.lit(1))
    got = sorted((r.doc_id, r.ids) for r in encode_texts(extra, "doc_id", "text").collect())
    assert got == sorted((r.doc_id, _ENCODER.encode(r.text or "")) for r in extra.collect())
    assert encode_texts(docs.limit(0), "doc_id", "text").collect() == []
    assert sorted((r.doc_id, r.ids) for r in encode_shared(extra, "doc_id", "text").collect()) == got
    assert encode_shared(docs.limit(0), "doc_id", "text").collect() == []


def test_chunks_are_shared_by_shared_passages():
    rnd = random.Random(1)
    words = ["".join(rnd.choices("абвгдежз", k=rnd.randrange(2, 9))) for _ in range(3000)]
    passage = " ".join(words[:1500])
    a, b = pieces(["начало " + passage])[0], pieces([" ".join(words[1500:]) + " " + passage])[0]
    assert len(set(a) & set(b)) > 0.8 * len(a)


def test_words():
    assert words_of("Ёж,ёж a\xadb_c​d 1²x") == ["еж", "еж", "ab", "cd", "1²x"]
    assert words_of(None) == words_of("") == words_of(" !") == []


def test_leaks_against_brute_force(spark):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([0, 3, 12, 13, 40])))) for i in range(25)] + [(90, None), (91, "!")]
    docs = []
    for i in range(120):
        words = rnd.choices(vocabulary, k=rnd.randrange(60))
        if i % 3 == 0:
            w = words_of(rnd.choice(items)[1])
            s = rnd.randrange(len(w) or 1)
            words[5:5] = w[s : s + rnd.choice([11, 12, 20])]
        docs.append((i, ", ".join(words).upper()))
    docs += [(900, None), (901, "")]

    def holds(d, i):
        d, i = words_of(d), words_of(i)
        n = min(12, len(i))
        return n and any(d[s : s + n] == i[t : t + n] for t in range(len(i) - n + 1) for s in range(len(d) - n + 1))

    want = {(d, i) for d, x in docs for i, y in items if holds(x, y)}
    left = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(5))
    right = spark.createDataFrame(items + items[:3], "item_id bigint, text string")
    for most in (16_000_000, 300):
        got = [(r.doc_id, r.item_id) for r in leaks(left, "doc_id", "text", right, "item_id", "text", vocabulary=most).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
    assert leaks(left.limit(0), "doc_id", "text", right, "item_id", "text").collect() == []
    assert leaks(left, "doc_id", "text", right.limit(0), "item_id", "text").collect() == []


def test_signatures_are_the_last_least_shingle():
    rnd = random.Random(8)
    for alphabet, n in (("ab", 500), ("a", 300), ("абвгд😀", 700), ("abc", 200)):
        codes = _codes("".join(rnd.choices(alphabet, k=n)))
        place, h = signatures(codes, 40, 15)
        want = [max(j for j in range(i, i + 26) if h[j] == h[i : i + 26].min()) for i in range(n - 39)]
        assert place.tolist() == want


def test_shared_spans_against_brute_force(spark):
    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choices("абвг 😀", k=n))
    passages = [text(n) for n in (39, 40, 41, 90, 200)] + ["z" * 60]
    docs = [(i, text(rnd.randrange(150)) + rnd.choice(passages) + text(rnd.randrange(150))) for i in range(80)]
    docs += [(100, docs[0][1]), (101, docs[0][1]), (102, passages[3]), (103, None), (104, ""), (105, "z" * 500), (106, "z" * 39)]
    want = {(a, b) for a, x in docs for b, y in docs if a < b and x and y and any(x[s : s + 40] in y for s in range(len(x) - 39))}
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("cls", F.lit(1))
    cover = {}
    for a, x in docs:
        if x and len(x) >= 40:
            other = [y for b, y in docs if y and y != x]
            at = {i for s in range(len(x) - 39) if any(x[s : s + 40] in y for y in other) for i in range(s, s + 40)}
            if at:
                cover[a] = len(at)
    for few in (2, 5, 1000):
        shared = Shared(df, "doc_id", "text", 40, 20, few)
        ids = {}
        for r in shared.members.collect():
            ids.setdefault(bytes(r.cls), []).append(r.doc_id)
        got = {tuple(sorted((a, b))) for r in shared.class_pairs().collect() for a in ids[bytes(r.cls1)] for b in ids[bytes(r.cls2)]} | {(a, b) for x in ids.values() for a in x for b in x if a < b}
        assert got == want and want
        assert {i: r.covered for r in shared.covered().collect() for i in ids[bytes(r.cls)]} == cover
    empty = Shared(df.limit(0), "doc_id", "text")
    assert empty.class_pairs().collect() == [] and empty.covered().collect() == []
