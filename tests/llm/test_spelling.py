"""op13 against comparing all words in plain Python, for shards and rounds of any size."""

import random
import re
import zlib
from collections import Counter

import pytest

from lodestar.llm import op13_spelling
from tests.llm.test_ops import docs, same_rows  # noqa: F401


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(rows, least_length=6, least=5, times=5, slip=199):
    """(word, form, root, n, n_near, form_n) of (doc_id, text)."""
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % slip == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_length and k >= least}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        top = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = top if top and n[top] >= times * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, n[w], len(near[w]), n.get(form[w])


def rows_of(seed):
    r = random.Random(seed)
    base = ["letters", "lettèrs", "Straße", "banana", "bananas", "abcabc", "ÀÉÎÕÜÿ", "mississippi", "aaaaaa", "×÷×÷×÷"]
    weights = [r.choice([1, 6, 40, 300]) for _ in base]
    out = []
    for i in range(500):
        words = []
        for w in r.choices(base, weights, k=12):
            kind, at = r.randrange(9), r.randrange(len(w))
            words.append(w if kind > 2 else w[:at] + w[at + 1 :] if kind == 0 else w[:at] + r.choice("abé") + w[at + (kind == 1) :])
        out.append((r.choice([i, i, None]), r.choice([" ", "-", "1"]).join(words)))
    return out


@pytest.mark.parametrize("options", [{}, {"size": 7, "in_round": 300}, {"least": 2, "times": 2, "slip": 3}, {"least_length": 3, "least": 1}])
def test_against_brute_force(spark, options):
    rows = [*rows_of(2), (1, None), (2, ""), (3, "chains chainz chainzy " * 5), (4, "mississippi " * 20_000)] + [(5, "banana")] * 30
    rows += [(6, "chainz " * 30 + "chains " * 900)]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(5)
    want = list(brute(rows, **{k: v for k, v in options.items() if k not in ("size", "in_round")}))
    assert len(want) > 30 and any(w[1] and w[2] != w[1] for w in want)
    same_rows(op13_spelling.variants(df, **options).collect(), want)


def test_edge_rows(docs):  # noqa: F811
    rows = docs.select("doc_id", "text").collect()
    same_rows(op13_spelling.variants(docs).collect(), brute(map(tuple, rows)))
    assert op13_spelling.variants(docs.limit(0)).collect() == []


def test_automaton_on_tries():
    r = random.Random(5)
    words = sorted({"".join(r.choice("abÿ") for _ in range(r.randrange(1, 7))).encode("latin-1") for _ in range(400)})
    trie = op13_spelling.Trie(*op13_spelling.pack(words, [i + 1 for i in range(len(words))]))
    for asked in [*words, b"", b"zz", b"abz"]:
        found = trie.near(asked)
        assert sorted(trie.word(v).encode("latin-1") for v in found) == [w for w in words if one_edit(asked.decode("latin-1"), w.decode("latin-1"))]
        assert all(trie.ends[v] == words.index(trie.word(v).encode("latin-1")) + 1 for v in found)
