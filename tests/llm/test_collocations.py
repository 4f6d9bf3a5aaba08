import re
from collections import Counter

import numpy as np
import pytest

from cadenza.llm import collocations as c

FIELDS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, longest=4, least=30, covered=80, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {x: a for x, a in f.items() if len(x[1]) >= 2 and a >= least}
    inside = lambda s, t: any(t[i : i + len(s)] == s for i in range(len(t) - len(s) + 1))
    out = []
    for (lang, p), a in cand.items():
        if any(x == lang and len(q) > len(p) and inside(p, q) and 100 * b >= covered * a for (x, q), b in cand.items()):
            continue
        s, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, n[lang], s))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    rank, done = Counter(), []
    for lang, *rest in out:
        rank[lang] += 1
        if rank[lang] <= top:
            done.append((lang, rank[lang], *rest))
    return done


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "lang string, text string")
    return sorted((tuple(r[x] for x in FIELDS) for r in c.collocations(df, **more).collect()), key=lambda x: (x[0], x[1]))


def words(rng, n):
    return " ".join("".join(rng.choice(["Aa", "b", "É", "ç", "aa"], 1)) + rng.choice(["", ".", ",", "\n", "\t", " "], p=[0.8, 0.05, 0.05, 0.04, 0.03, 0.03]) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_brute(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(rng.choice(["aa", "b", None, "und"]), words(rng, int(rng.integers(0, 60)))) for _ in range(120)] + [("en", None), ("en", ""), ("en", " .,\n")]
    rows += [("b", "one of the many things. " * 40)] * 3
    more = {"least": 5 + 10 * seed, "chunk": [200, 8 << 20, 3000][seed], "per_range": [50, 2_000_000, 300][seed]}
    assert found(spark, rows, **more) == brute(rows, least=more["least"])
    assert found(spark, rows, **more, top=3) == brute(rows, least=more["least"], top=3)


def test_long_text_in_parts(spark):
    rng = np.random.default_rng(9)
    rows = [("x", words(rng, 5000)), ("x", "w" * 900 + " b aa " * 50)]
    assert found(spark, rows, chunk=128) == found(spark, rows) == brute(rows)


def test_empty_and_clashing_columns(spark):
    assert found(spark, []) == []
    df = spark.createDataFrame([("a", "b c " * 40, 1, 2, 3)], "lang string, text string, chunk int, phrase int, rank int")
    assert c.collocations(df).columns == FIELDS


def test_states_have_the_strings_of_equal_ends():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 4, 300)
    depth = np.minimum(np.arange(300) % 37, 3)
    x = c.Automaton(ids, depth, 4)
    ends = {}
    for i in range(300):
        for k in range(1, depth[i] + 2):
            ends.setdefault(tuple(ids[i - k + 1 : i + 1]), set()).add(i)
    strings = {}
    for s in range(len(x.count)):
        p = x.place[s]
        of = [tuple(ids[p - k + 1 : p + 1]) for k in range(x.shortest[s], x.longest[s] + 1)]
        assert len({frozenset(ends[t]) for t in of}) == 1 and len(ends[of[0]]) == x.count[s]
        strings |= dict.fromkeys(of, s)
    assert set(strings) == set(ends)
    for s in range(len(x.count)):
        p, k = x.place[s], x.shortest[s] - 1
        suffix = tuple(ids[p - k + 1 : p + 1]) if k else ()
        assert x.link[s] == (strings[suffix] if k else -1) and (not k or len(ends[suffix]) > x.count[s])


def test_many_different_words():
    """Keys of several words pass 32 bits, and 63 as well."""
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 90_000, 120_000)
    ids[60_000:] = ids[:60_000]
    x = c.Automaton(ids, np.minimum(np.arange(len(ids)), 3), 4)
    for k in (1, 2, 3, 4):
        place, count = x.strings(k)
        words = np.stack([ids[k - 1 - j : len(ids) - j] for j in range(k)], 1)
        _, n = np.unique(words, axis=0, return_counts=True)
        assert sorted(count.tolist()) == sorted(n.tolist()) and len({tuple(ids[p - k + 1 : p + 1]) for p in place.tolist()}) == len(n)
