"""op12 against counting every phrase in plain Python, for sketches of any width."""

import random
import re
from collections import Counter

import pytest

from lodestar.llm import op12_phrases
from tests.llm.test_ops import docs, same_rows  # noqa: F401


def brute(rows, longest=3, least=10, subsume=50, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang)."""
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + n])) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    often = {(lang, w): a for (lang, w), a in f.items() if len(w) > 1 and a >= least}
    out = []
    for (lang, w), a in often.items():
        inside = lambda v: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))  # noqa: E731, B023
        if any(m == lang and len(v) > len(w) and inside(v) and 100 * b >= subsume * a for (m, v), b in often.items()):
            continue
        score, _, l, r = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), l, r))
    ranks = Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            yield lang, ranks[lang], phrase.decode(), -a, l, r, total[lang], -score


def texts(seed):
    r = random.Random(seed)
    words = ["the", "of", "Émile", "New", "York", "a-b", "don't", "naïve", "日本", "x\x00y", "in", "case"]
    join = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", " \t ", "!?"]
    for _ in range(60):
        yield "".join(r.choice(words[: r.randint(2, 12)]) + r.choice(join) for _ in range(r.randrange(0, 60))), r.choice(["en", "fr", None, "und", ""])


@pytest.mark.parametrize("options", [{}, {"width": 8}, {"width": 1 << 12, "top": 5}, {"longest": 4, "least": 4, "subsume": 80}, {"longest": 2}])
def test_against_brute_force(spark, options):
    rows = [*texts(3), ("", "en"), (None, "fr"), ("one. two, three", "de"), ("new york " * 3000, "en"), ("w " * 9, "nl"), (" " * 50, "en")]
    rows += [("same text of copies, again", "it")] * 40
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "text string, lang string, n int, phrase string").repartition(6)
    got = op12_phrases.collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    want = list(brute(rows, **{k: v for k, v in options.items() if k != "width"}))
    assert len(want) > 10
    same_rows(got, want)


def test_edge_rows(docs):  # noqa: F811
    rows = docs.select("text", "lang").collect()
    got = op12_phrases.collocations(docs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    same_rows(got, brute(map(tuple, rows)))
    assert op12_phrases.collocations(docs.limit(0)).collect() == []


def test_exact_beyond_64_bits(spark):
    rows = [("en", 1, "x", 9_000_000_007), ("en", 1, "y", 9_000_000_009), ("en", 2, "x y", 8_999_999_999), ("en", 0, "", 10**11)]
    row = op12_phrases.scored(spark.createDataFrame(rows, "lang string, words int, phrase string, f long")).first()
    assert row.score == 10**6 * 8_999_999_999**2 // (9_000_000_007 * 9_000_000_009)


def test_the_best_come_through_hash_groups(spark):
    rows = [("en", 2, f"a w{i}", 10 + i % 7, 1, 1, i % 50) for i in range(5000)]
    got = op12_phrases.best(spark.createDataFrame(rows, "lang string, words int, phrase string, a long, l long, r long, score long"), 70).collect()
    want = sorted(rows, key=lambda r: (-r[6], -r[3], r[2]))[:70]
    assert [(r["rank"], r.phrase) for r in sorted(got, key=lambda r: r["rank"])] == [(i, r[2]) for i, r in enumerate(want, 1)]
