"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as its own vector (words seen in training at least MIN_COUNT times; others share one) beside the
mean vector of its hashed character trigrams. Windows of WIDTH words, every STRIDE words over the whole text,
go through a forward and a backward gated recurrent unit; attention pools the states and a logistic output
scores the window. A document's score is that of its worst window.

Training takes at most SAMPLE toxic documents and CLEAN_PER_TOXIC times as many clean ones, in hash order: a bounded,
documented sample of labelled rows. Texts of more than ONE_TEXT bytes are not learned from, nor those that no longer fit
into TEXT_BYTES; the others are, whatever comes before them. If labelled texts exist and none fits, that is an error. A toxic document teaches by its worst window, found anew each round, a clean one by its worst
and some others; in the first rounds, by the window with the word that toxic documents have most in excess, and by random
ones. A word's vector starts from that excess too, where it is beyond chance.

Texts are lower-cased; words are runs of letters, digits and underscores. Null, empty and wordless texts
score 0; very long ones are scored whole, in groups of bounded size. Rows that repeat id and text are learned from once. Other columns are ignored, whatever their names. With labels of one kind only, every score is 0. Null ids are not learned from and not held out. Repeated
rows score alike. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import stage, table

WIDTH, STRIDE, HIDDEN, WORD_DIM, CHAR_DIM, TRIGRAMS = 32, 16, 8, 12, 12, 1 << 14
SAMPLE, CLEAN_PER_TOXIC, MIN_COUNT, ROUNDS, WARM_SHARE, MIN_STEPS, MAX_ROUNDS = 1200, 4, 3, 12, 0.3, 600, 60
RATE, DECAY, CLEAR = 0.01, 0.1, 4.0
TEXT_BYTES, ONE_TEXT = 128 << 20, 1 << 20
#: Words scored together; bounds a worker's memory.
TOGETHER = 200_000
_word = re.compile(r"\w+")


def words_of(text) -> list[str]:
    return _word.findall(text.lower()) if isinstance(text, str) else []


def trigram_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of ``<word>`` for all words, flat, and where each word's begin."""
    raw = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    sizes = np.array([len(r) for r in raw])
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    inside = np.ones(len(flat), bool)
    ends = begin + sizes
    inside[ends - 1] = False
    inside[ends - 2] = False
    at = np.flatnonzero(inside)
    code = (flat[at] << 16) | (flat[at + 1] << 8) | flat[at + 2]
    slots = (code * 0x9E3779B1 >> 7) % TRIGRAMS
    return slots, np.concatenate([[0], np.cumsum(sizes - 2)[:-1]])


def windows(ids: np.ndarray) -> np.ndarray:
    """Overlapping windows of word numbers from 1, padded with 0; the last one ends the text."""
    n = len(ids)
    count = 1 + max(0, -(-(n - WIDTH) // STRIDE))
    padded = np.zeros((count - 1) * STRIDE + WIDTH, np.int32)
    padded[:n] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[::STRIDE]


def sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    def __init__(self, vocabulary: dict[str, int], params: dict[str, np.ndarray]):
        self.vocabulary, self.p = vocabulary, params

    @staticmethod
    def fresh(vocabulary: dict[str, int], seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        h = HIDDEN
        return Network(vocabulary, {
            "word": draw(len(vocabulary) + 1, WORD_DIM) * 0.1, "char": draw(TRIGRAMS, CHAR_DIM) * 0.3,
            "win": draw(WORD_DIM + CHAR_DIM, 6 * h) / 4, "bin": np.zeros(6 * h, np.float32),
            "uf": draw(h, 3 * h) / 3, "ub": draw(h, 3 * h) / 3,
            "wa": draw(2 * h, 2 * h) / 4, "va": draw(2 * h) / 4,
            "wo": draw(2 * h) / 4, "bo": np.full(1, -1.0, np.float32),
        })

    def inputs(self, words: list[str]):
        """Projected inputs of distinct words, with row 0 for padding, and what backward() needs."""
        slots, begin = trigram_slots(words)
        sizes = np.diff(np.append(begin, len(slots)))[:, None].astype(np.float32)
        index = np.array([self.vocabulary.get(w, 0) for w in words])
        char = np.add.reduceat(self.p["char"][slots], begin, axis=0) / sizes
        x = np.concatenate([self.p["word"][index], char], 1)
        proj = np.concatenate([np.zeros((1, 6 * HIDDEN), np.float32), x @ self.p["win"] + self.p["bin"]])
        return proj, (x, index, slots, sizes)

    def _run(self, proj, ids, u, back: bool, keep: list | None):
        h = np.zeros((len(ids), HIDDEN), np.float32)
        out = np.zeros((ids.shape[1], len(ids), HIDDEN), np.float32)
        off, k = 3 * HIDDEN * back, HIDDEN
        uzr, uc = u[:, : 2 * k], u[:, 2 * k :]
        for t in range(ids.shape[1] - 1, -1, -1) if back else range(ids.shape[1]):
            x = proj[ids[:, t], off : off + 3 * k]
            g = sigmoid(x[:, : 2 * k] + h @ uzr)
            z = g[:, :k] * (ids[:, t] > 0)[:, None]
            rh = g[:, k:] * h
            c = np.tanh(x[:, 2 * k :] + rh @ uc)
            if keep is not None:
                keep.append((t, h, g, z, rh, c))
            h = h + z * (c - h)
            out[t] = h
        return out

    def forward(self, proj, ids, keep: dict | None = None):
        """Logit of each window."""
        kf, kb = (keep.setdefault("f", []), keep.setdefault("b", [])) if keep is not None else (None, None)
        states = np.concatenate(
            [self._run(proj, ids, self.p["uf"], False, kf), self._run(proj, ids, self.p["ub"], True, kb)], 2
        )
        a = np.tanh(states @ self.p["wa"])
        score = a @ self.p["va"] + np.where(ids.T > 0, np.float32(0), np.float32(-30))
        e = np.exp(score - score.max(0))
        weight = e / e.sum(0)
        pooled = (weight[:, :, None] * states).sum(0)
        if keep is not None:
            keep.update(states=states, a=a, weight=weight, pooled=pooled)
        return pooled @ self.p["wo"] + self.p["bo"][0]

    def gradients(self, words, ids, goal, cost):
        p, keep, k = self.p, {}, HIDDEN
        proj, (x, index, slots, sizes) = self.inputs(words)
        logit = self.forward(proj, ids, keep)
        d = ((sigmoid(logit) - goal) * cost / cost.sum()).astype(np.float32)
        g = {name: np.zeros_like(v) for name, v in p.items()}
        g["wo"], g["bo"][0] = keep["pooled"].T @ d, d.sum()
        states, a, weight = keep["states"], keep["a"], keep["weight"]
        dpool = d[:, None] * p["wo"]
        dweight = (states * dpool).sum(2)
        dscore = weight * (dweight - (weight * dweight).sum(0))
        da = dscore[:, :, None] * p["va"] * (1 - a * a)
        g["va"] = np.einsum("tn,tnj->j", dscore, a)
        g["wa"] = np.einsum("tni,tnj->ij", states, da)
        dstates = weight[:, :, None] * dpool + da @ p["wa"].T
        dproj = np.zeros_like(proj)
        for name, steps, off in (("uf", keep["f"], 0), ("ub", keep["b"], 1)):
            u, gu, dh = p[name], g[name], np.zeros((len(ids), k), np.float32)
            uzr, uc = u[:, : 2 * k], u[:, 2 * k :]
            for t, h, gate, z, rh, c in reversed(steps):
                dh = dh + dstates[t, :, off * k : off * k + k]
                live = (ids[:, t] > 0)[:, None]
                dc = dh * z * (1 - c * c)
                drh = dc @ uc.T
                dz = dh * (c - h) * live * gate[:, :k] * (1 - gate[:, :k])
                dr = drh * h * gate[:, k:] * (1 - gate[:, k:])
                dzr = np.concatenate([dz, dr], 1)
                gu[:, : 2 * k] += h.T @ dzr
                gu[:, 2 * k :] += rh.T @ dc
                np.add.at(dproj, (ids[:, t], slice(off * 3 * k, off * 3 * k + 3 * k)), np.concatenate([dzr, dc], 1))
                dh = dh * (1 - z) + drh * gate[:, k:] + dzr @ uzr.T
        dproj = dproj[1:]
        g["win"], g["bin"] = x.T @ dproj, dproj.sum(0)
        dx = dproj @ p["win"].T
        np.add.at(g["word"], index, dx[:, :WORD_DIM])
        np.add.at(g["char"], slots, np.repeat(dx[:, WORD_DIM:] / sizes, sizes[:, 0].astype(int), axis=0))
        return g

    def window_scores(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Logits of every window of each text, in groups of bounded size."""
        out: list = [np.zeros(0, np.float32)] * len(texts)
        group: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if text:
                group.append(i)
                size += len(text)
            if group and (size >= TOGETHER or i + 1 == len(texts)):
                number: dict[str, int] = {}
                parts = [windows(np.array([number.setdefault(w, len(number) + 1) for w in texts[j]], np.int32)) for j in group]
                proj = self.inputs(list(number))[0]
                flat = np.concatenate(parts)
                logit = np.concatenate([self.forward(proj, flat[k : k + 4096]) for k in range(0, len(flat), 4096)])
                for j, part in zip(group, np.split(logit, np.cumsum([len(x) for x in parts])[:-1])):
                    out[j] = part
                group, size = [], 0
        return out


def excess_of(split, y) -> dict[str, float]:
    """How far each word's count of toxic texts lies above its expectation, in standard deviations."""
    share = y.mean()
    n = Counter(w for s in split for w in set(s))
    hits = Counter(w for s, toxic in zip(split, y) if toxic for w in set(s))
    return {w: (hits[w] - k * share) / math.sqrt(k * share * (1 - share)) for w, k in n.items()}


def train(texts: list[str], labels: list[int], rounds: int = ROUNDS, seed: int = 5) -> Network | None:
    """A network from labelled texts, or None if they hold one label only."""
    split = [words_of(t) for t in texts]
    y = np.array([l for l, s in zip(labels, split) if s])
    split = [s for s in split if s]
    if len(set(y.tolist())) < 2:
        return None
    seen = Counter(w for s in split for w in s)
    common = sorted(w for w, n in seen.items() if n >= MIN_COUNT)
    net, rng = Network.fresh({w: i + 1 for i, w in enumerate(common)}), np.random.default_rng(seed)
    number: dict[str, int] = {}
    cut = [windows(np.array([number.setdefault(w, len(number) + 1) for w in s], np.int32)) for s in split]
    names = np.array([""] + list(number), dtype=object)
    excess = excess_of(split, y)
    strength = np.array([-math.inf, *(excess[w] for w in number)])
    telling = {i: int(strength[w].max(1).argmax()) for i, w in enumerate(cut) if y[i]}
    # The first part of a word's vector starts from its excess, where that is beyond chance.
    for i, w in enumerate(common):
        net.p["word"][i + 1, 0] = min(excess[w], CLEAR * 3) / CLEAR if excess[w] > CLEAR else 0
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    shares = max(1, round((y == 0).sum() / (1.5 * (y == 1).sum() + 100)))
    # Few documents make few steps a round, so they get more rounds.
    rounds = min(MAX_ROUNDS, max(rounds, -(-MIN_STEPS * 128 // (3 * len(cut)))))
    step = 0
    for turn in range(rounds):
        # Clean documents take turns, so that each round sees about as many of them as toxic ones.
        now = [i for i in range(len(cut)) if y[i] or i % shares == turn % shares]
        warm = turn < WARM_SHARE * rounds
        worst = telling if warm else {i: int(s.argmax()) for i, s in zip(now, net.window_scores([split[i] for i in now]))}
        picked, goal = [], []
        for i in now:
            w = cut[i]
            some = {worst[i]} if y[i] or not warm else set()
            if not y[i]:
                some.update(rng.integers(0, len(w), 4).tolist())
            for j in sorted(some):
                picked.append(w[j])
                goal.append(y[i])
        ids, target = np.stack(picked), np.array(goal, np.float32)
        cost = np.ones(len(ids), np.float32)
        order = rng.permutation(len(ids))
        rate = RATE * (1 - turn / rounds)
        for at in range(0, len(order), 128):
            rows = order[at : at + 128]
            used, local = np.unique(ids[rows], return_inverse=True)
            local = local.reshape(ids[rows].shape)
            if used[0] != 0:
                used, local = np.concatenate([[0], used]), local + 1
            g = net.gradients(list(names[used[1:]]), local.astype(np.int32), target[rows], cost[rows])
            step += 1
            for k in net.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] * g[k]
                moved = (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                # Trigrams decay, so that what no step supports stays small.
                net.p[k] -= (rate * (moved + (DECAY * net.p[k] if k == "char" else 0))).astype(np.float32)
    return net


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fitting(sizes: list[int], room: int) -> list[int]:
    """Places of the sizes that fit into ``room`` one after another; what does not is passed over."""
    out = []
    for i, size in enumerate(sizes):
        if size <= room:
            out.append(i)
            room -= size
    return out


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_bytes: int | None = None, one_text: int | None = None) -> DataFrame:
    """(text, toxic) of at most ``sample`` toxic learnable documents and CLEAN_PER_TOXIC times as many clean ones."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").alias("known_id"), "toxic").groupBy("known_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("known_id"), F.col("known_id")]
    picked = known.where("toxic = 1").orderBy(*order).limit(sample).unionByName(
        known.where("toxic = 0").orderBy(*order).limit(CLEAN_PER_TOXIC * sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("known_id")).where("text is not null")
    short = rows.where(F.octet_length("text") <= (one_text or ONE_TEXT)).select("known_id", "toxic", "text", F.sha2("text", 256).alias("digest"))
    order += [F.col("digest")]
    once = short.groupBy("known_id", "digest").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))
    # As many rows as the sample has ids, at most; each with its size through the driver.
    once = stage(once.orderBy(*order).limit((1 + CLEAN_PER_TOXIC) * sample), "toxicity-training")
    sizes = once.select("known_id", "digest", F.octet_length("text").alias("size")).orderBy(*order).collect()
    fits = fitting([r["size"] for r in sizes], text_bytes or TEXT_BYTES)
    if not fits and not rows.isEmpty():
        raise ValueError("no labelled text is within the bounds of one_text and text_bytes")
    kind = dict(once.dtypes)["known_id"]
    listed = docs.sparkSession.createDataFrame([tuple(sizes[i])[:2] for i in fits], f"known_id {kind}, digest string")
    return once.join(F.broadcast(listed), ["known_id", "digest"]).orderBy("toxic", "known_id", "text").select("text", "toxic")


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [words_of(t) for t in batch["text"]]
            logits = net.window_scores(texts) if net else [np.zeros(0)] * len(texts)
            best = np.array([sigmoid(float(x.max())) if len(x) else 0.0 for x in logits], np.float64)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "held_out": batch["held_out"],
                "score": best, "predicted": (best >= 0.5).astype(np.int32),
            })

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = training_rows(docs, table(spark, sf_dir, "labels")).toPandas()
    return score(docs, train(rows["text"].tolist(), rows["toxic"].tolist()))
