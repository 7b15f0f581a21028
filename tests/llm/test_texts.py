"""Token ids, shared spans, repeated lines and near-duplicates against brute force."""

import base64
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollstone.llm import bpe, lines, neardup, spans

TEXTS = "a string"


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    words = [f"{a}{b}" for a in ("kor", "lun", "ast", "pel", "dun") for b in ("ba", "mar", "wick", "ton", "ris", "é", "中文", "1")]
    made = [" ".join(r.choice(words) for _ in range(r.randint(5, 90))) for _ in range(60)]
    for k in range(25):  # small edits, copies and shared passages
        w = made[k].split(" ")
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(words)
        made.append(" ".join(w))
        a, b = r.choice(made), r.choice(made)
        made.append(a[: len(a) // 2] + b[len(b) // 3 :])
    made += [made[3], made[3].upper(), "", " ", "ab" * 300, "x" + "ab" * 200, "a" * 500, "a" * 151, "𝒳é" * 90, made[0] * 9, None, None]
    return list(enumerate(made))


def test_pretokens_and_ids_agree_with_the_public_library(texts):
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    signs = "ab 'stredlvm  \n\t　 É中é12٣²_-.'’<|endoftext|>👍́"
    some = [t or "" for _, t in texts] + ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(4000)] + ["'s", "a's", "a'save x'", "  's", "\n's", "a'", "''s"]
    got = []
    for counts, ids in bpe.encode_batch(some, P.path("byte_bpe_50k.tiktoken")):
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [own.encode_ordinary(t) for t in some]


def test_encode_keeps_every_row(spark, texts):
    df = spark.createDataFrame([*texts, texts[0], (None, "x")], "doc_id int, text string").withColumn("ids", F.lit("clash"))
    out = bpe.encode(df)
    assert out.columns == ["doc_id", "ids"] and out.count() == len(texts) + 2
    assert all(r.ids == [] for r in out.collect() if r.doc_id in (k for k, t in texts if not t) and r.doc_id is not None)
    assert bpe.encode(df.limit(0)).count() == 0


def test_a_very_long_pretoken_goes_through_the_rank_queue():
    P = pytest.importorskip("public_tokenizers")
    word = "".join(random.Random(2).choice("abcdeortn") for _ in range(200_000))
    enc = bpe.encoder(P.path("byte_bpe_50k.tiktoken"))
    assert b"".join(enc.token[i] for i in enc.encode(word.encode())) == word.encode()


def substring(a, b, n):
    seen = {a[i : i + n] for i in range(len(a) - n + 1)}
    return any(b[i : i + n] in seen for i in range(len(b) - n + 1))


@pytest.mark.parametrize("n", [150, 40])
def test_shared_spans_are_those_of_brute_force(spark, texts, n):
    df = spark.createDataFrame(texts, "doc_id int, text string").repartition(3)
    have = [(k, t) for k, t in texts if t]
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(have, 2) if substring(x, y, n)}
    assert rows(spans.shared_pairs(df, length=n)) == want
    # full sketches, many ranges, and anchors grouped by joins change nothing
    assert rows(spans.shared_pairs(df, length=n, load=10, range_=100, hot=1)) == want
    assert rows(spans.shared_pairs(df, length=n, load=1, hot=4)) == want


def test_extent_of_shared_spans(spark, texts):
    n = 60
    df = spark.createDataFrame(texts, "doc_id int, text string")
    got = {r.doc_id: (r.n_chars, r.shared_chars) for r in spans.shared_extent(df, length=n).collect()}
    for k, t in texts:
        t = t or ""
        covered = [False] * len(t)
        others = {u[i : i + n] for j, u in texts if j != k and u for i in range(len(u) - n + 1)}
        for i in range(len(t) - n + 1):
            if t[i : i + n] in others:
                covered[i : i + n] = [True] * n
        assert got[k] == (len(t), sum(covered)), (k, t[:50])
    joined = spans.shared_extent(df, length=n, hot=1)
    assert {r.doc_id: (r.n_chars, r.shared_chars) for r in joined.collect()} == got
    assert spans.shared_extent(df.limit(0)).count() == 0


def form(x):
    return re.sub("[ \t\r\n\f\v ]+", " ", x).strip(" ").replace("’", "'").lower()


def test_repeated_lines(spark):
    r = random.Random(3)
    data = []
    for i in range(90):
        text = "\n".join(r.choice(["Share this’ page", "SHARE  THIS' page\r", " by Ann", "", "  ", f"own {i} {r.random()}", "story"]) for _ in range(r.randint(0, 6)))
        data.append((i, text, r.choice([" Big", "big", "BIG ", "small", None])))
    data += data[:20] + [(None, "story", "big"), (200, None, "big"), (201, "story", None)]
    ids = {}
    for i, t, s in data:
        if i is not None and t is not None and s is not None:
            for x in t.split("\n"):
                ids.setdefault((s.strip().lower(), form(x)), set()).add(i)
    bad = {k for k, v in ids.items() if len(v) >= 8 and k[1]}
    assert bad
    df = spark.createDataFrame(data, "id int, text string, source string").withColumn("line_no", F.lit("clash"))
    want = {(i, k) for i, t, s in data if i is not None and t is not None and s is not None for k, x in enumerate(t.split("\n")) if (s.strip().lower(), form(x)) in bad}
    assert rows(lines.repeated_lines(df)) == want
    for threshold in ("10MB", "-1"):  # broadcast and shuffle
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        clean = lines.without_repeated_lines(df)
        assert clean.count() == len(data)
        got = {(r.id, r.clean, r.removed) for r in clean.collect() if r.id is not None}
        expect = set()
        for i, t, s in data:
            if i is None:
                continue
            kept = None if t is None else [x for x in t.split("\n") if s is None or (s.strip().lower(), form(x)) not in bad]
            expect.add((i, None if kept is None else "\n".join(kept), 0 if kept is None else len(t.split("\n")) - len(kept)))
        assert got == expect
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert lines.repeated_lines(df.limit(0)).count() == 0


def test_summaries_merge_in_any_order_and_lose_nothing():
    r = np.random.default_rng(0)
    stream = np.concatenate([r.integers(0, 1 << 40, 4000), np.repeat(r.integers(0, 1 << 40, 30), 9)])
    r.shuffle(stream)
    keys, counts = np.unique(stream, return_counts=True)
    wanted = set(keys[counts >= 8].tolist())
    for order in range(3):
        parts = np.array_split(r.permutation(stream), 5 + order)
        s = lines.Summary(8, 1000)
        for p in parts:
            s.merge(*np.unique(p, return_counts=True))
        assert wanted <= set(s.candidates().tolist())
        assert len(s.keys) < len(keys)


def shingles(t, n):
    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


@pytest.mark.parametrize("words,limit", [(3, 0.6), (5, 0.8), (1, 0.5)])
def test_near_duplicates_are_those_of_brute_force(spark, texts, words, limit):
    data = [*texts, texts[1], texts[2], (None, texts[4][1]), (500, texts[4][1]), (501, texts[4][1])]
    df = spark.createDataFrame(data, "doc_id int, text string").withColumn("set", F.lit(1)).repartition(3)
    pairs, members = neardup.similar_sets(df, "doc_id", F.coalesce("text", F.lit("")), words, limit)
    sets = {k: shingles(t or "", words) for k, t in data if k is not None}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and len(sets[a] & sets[b]) >= limit * len(sets[a] | sets[b]) - 1e-9}
    assert rows(neardup.expand_sets(pairs, members)) == want
    # a full sketch and posting lists in blocks change nothing
    assert rows(neardup.expand_sets(*neardup.similar_sets(df, "doc_id", F.coalesce("text", F.lit("")), words, limit, counters=6, hot=2))) == want
    group = {k: k for k in sets if sets[k]}
    for _ in range(len(group)):
        for a, b in want:
            group[a] = group[b] = min(group[a], group[b])
    links = {k: sum(k in p for p in want) for k in group}
    assert rows(neardup.groups(pairs, members)) == {(k, group[k], links[k]) for k in group}


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id bigint, text string")
    pairs, members = neardup.similar_sets(df, "id", F.col("text"))
    assert neardup.expand_sets(pairs, members).count() == 0


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_null_and_doubled_keys_are_cleaned_by_their_own_lines(spark, threshold):
    data = [(i, f"notice\nown {i}", "a") for i in range(9)] + [(None, "x\nnotice", "a"), (0, "y\nz\nnotice", " A"), (0, "notice\nw", "b"), (1, "notice", None), (2, None, "a")]
    df = spark.createDataFrame(data, "id int, text string, source string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    got = sorted(map(repr, (tuple(r) for r in lines.without_repeated_lines(df, least=8).collect())))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = [(i, f"own {i}", 1) for i in range(9)] + [(None, "x", 1), (0, "y\nz", 1), (0, "notice\nw", 0), (1, "notice", 0), (2, None, 0)]
    assert got == sorted(map(repr, want))
