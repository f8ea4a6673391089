import random

from lattica.llm.shared_spans import shared_chars, shared_spans


def brute(docs, length):
    where = {}
    for i, text in docs:
        for s in range(len(text or "") - length + 1):
            where.setdefault(text[s : s + length], set()).add(i)
    chars = {}
    for i, text in docs:
        covered = set()
        for s in range(len(text or "") - length + 1):
            if len(where[text[s : s + length]]) > 1:
                covered.update(range(s, s + length))
        if covered:
            chars[i] = chars.get(i, set()) | covered
    return sorted((i, len(c)) for i, c in chars.items())


def intervals(points):
    out = []
    for p in sorted(points):
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return out


def corpus(seed, n=40):
    """Random texts that quote each other, repeat themselves, hold runs of one letter and boilerplate."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdé 回😀") for _ in range(k))
    pool, notice, docs = [word(60) for _ in range(6)], word(45), []
    for i in range(n):
        parts = [word(rng.randrange(5, 60))]
        for _ in range(rng.randrange(3)):
            quote = rng.choice(pool)
            a, b = sorted(rng.sample(range(len(quote) + 1), 2))
            parts += [quote[a:b], word(rng.randrange(20))]
        if rng.random() < 0.33:
            parts.append(notice)
        if rng.random() < 0.2:
            parts += ["-" * rng.randrange(70), parts[0]]
        docs.append((i, "".join(parts)))
    return docs + [(n, docs[0][1]), (n + 1, docs[3][1]), (n + 2, None), (n + 3, ""), (n + 4, "short")]


def test_equals_brute_force(spark, collect):
    for seed, length in ((1, 20), (2, 20), (3, 33)):
        docs = corpus(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as start", "2 as text_key", "3 as chars")
        assert [tuple(r) for r in collect(shared_chars(df.repartition(3), length=length))] == sorted(brute(docs, length), key=repr)


def test_gram_shorter_than_the_window(spark, collect):
    rng = random.Random(8)
    text = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    quotes = [text(400) for _ in range(4)]
    docs = [(i, text(150) + rng.choice(quotes)[rng.randrange(150) : rng.randrange(200, 400)] + text(150)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(brute(docs, 120), key=repr)
    assert collect(shared_chars(df, length=120)) == want
    spans = collect(shared_spans(df, length=120))
    sums = {}
    for i, a, z in spans:
        sums[i] = sums.get(i, 0) + z - a
        assert z - a >= 120
    assert sorted(sums.items(), key=repr) == want


def test_repeats_within_one_text_and_ids(spark, collect):
    df = spark.createDataFrame([(1, "abcdefghij" * 30), (None, "abcdefghij" * 30), (2, "x" * 500)], "doc_id long, text string")
    assert collect(shared_chars(df, length=50)) == []
    same = spark.createDataFrame([(1, "q" * 60), (1, "q" * 60), (2, "q" * 70)], "doc_id long, text string")
    assert collect(shared_chars(same, length=50)) == [(1, 60), (2, 70)]
    assert collect(shared_chars(df.limit(0), length=50)) == [] and collect(shared_spans(df.limit(0), length=50)) == []


def test_copies(spark, collect):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghijkl ") for _ in range(5000))
    df = spark.createDataFrame([(i, text) for i in range(30)] + [(99, text[100:400])], "doc_id long, text string")
    assert dict(collect(shared_chars(df))) == {**{i: 5000 for i in range(30)}, 99: 300}
    assert (3, 0, 5000) in collect(shared_spans(df))
