"""Operators against plain versions: mixing, the toxicity risk, likeness of fingerprints, judged runs of characters."""

import importlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmeter.llm import fingerprint, mixing, secret_scan, toxicity


def filled(budget, nodes):
    """{name: part} of (name, cap, weight): full nodes drop out until the rest can take their parts."""
    out, rest = {}, list(nodes)
    while rest:
        total = sum(w for _, _, w in rest)
        full = [x for x in rest if x[1] <= budget * x[2] / total]
        if not full:
            return out | {n: budget * w / total for n, _, w in rest}
        for n, cap, _ in full:
            out[n] = cap
            budget -= cap
        rest = [x for x in rest if x not in full]
    return out


@pytest.mark.parametrize("share, epochs", [(0.3, 1), (0.7, 1), (0.9, 3), (2.0, 4)])
def test_mixing(spark, share, epochs):
    rnd = random.Random(int(share * 10))
    rows = [(i, " ".join("w" * rnd.randint(0, 9)), rnd.choice(["en", "de", "fr", None]), f"src{rnd.choice([0, 0, 0, 1, 2, 5, 7])}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    got = {}
    for r in mixing.mix(df, mixing.domain_of(), mixing.WEIGHTS, share, epochs, seed=20).collect():
        got.setdefault((r.domain, r.doc.lang, r.doc.source), []).append((r.epoch, r.doc.doc_id, r.n_tokens, r.taken))
    tokens = {i: len((t or "").split()) for i, t, _, _ in rows}
    leaf = {i: (f"domain{int(s[3:]) % 4}", lang, s) for i, _, lang, s in rows}
    size = {}
    for i, key in leaf.items():
        size[key] = size.get(key, 0) + tokens[i]
    cap = lambda *path: epochs * sum(n for key, n in size.items() if key[: len(path)] == path)
    top = filled(share * sum(tokens.values()), [(d, cap(d), mixing.WEIGHTS[(d,)]) for d in {k[0] for k in size}])
    for d, b in top.items():
        langs = filled(b, [(x, cap(d, x), mixing.WEIGHTS.get((None, x), 1)) for x in {k[1] for k in size if k[0] == d}])
        for x, c in langs.items():
            for s, quota in filled(c, [(k[2], cap(*k), 1) for k in size if k[:2] == (d, x)]).items():
                key = (d, x, s)
                quota = min(math.floor(quota + 1e-6), epochs * size[key])
                whole, left = divmod(quota, size[key]) if size[key] else (0, 0)
                ids = [i for i in leaf if leaf[i] == key]
                want = [(e, i, tokens[i], tokens[i]) for e in range(whole) for i in ids]
                spot = dict(spark.createDataFrame([(i,) for i in ids], "i long").select("i", F.shiftrightunsigned(F.xxhash64(F.lit(20), F.lit(whole), "i"), 1)).collect())
                for i in sorted(ids, key=spot.get) if left else []:
                    if left <= 0:
                        break
                    want.append((whole, i, tokens[i], min(tokens[i], left)))
                    left -= tokens[i]
                # texts without tokens at the very end of a prefix may or may not lie before it
                assert sorted(x for x in got.get(key, []) if x[2]) == sorted(x for x in want if x[2]), key


def test_toxicity_risk():
    """The slope is that of the stated risk; below zero the step goes the other way."""
    rng = np.random.default_rng(5)
    width = 6
    docs = lambda n, p: [np.flatnonzero(rng.random(width) < p) for _ in range(n)]
    p, u = toxicity.Sparse(docs(30, 0.5), width), toxicity.Sparse(docs(50, 0.3), width)
    dense = lambda s: np.stack([np.append(np.bincount(s.cols[s.rows == i], minlength=width), 1) for i in range(s.shape[0])])
    a, b, decay = dense(p), dense(u), 1e-2
    plain = lambda z: 1 / (1 + np.exp(-z))

    def parts(w, prior):
        return prior * (1 - plain(a @ w)).mean(), plain(b @ w).mean() - prior * plain(a @ w).mean(), decay / 2 * (w[:-1] ** 2).sum()

    seen = set()
    for prior in (0.1, 0.9, 0.999):
        for _ in range(10):
            w = rng.normal(0, 2, width + 1)
            _, negative, _ = parts(w, prior)
            seen.add(negative >= 0)
            risk = (lambda v: sum(parts(v, prior))) if negative >= 0 else (lambda v: -parts(v, prior)[1] + parts(v, prior)[2])  # noqa: E731, B023
            step = 1e-6 * np.eye(width + 1)
            numeric = np.array([(risk(w + e) - risk(w - e)) / 2e-6 for e in step])
            assert np.allclose(toxicity.slope(p, u, w, prior, decay), numeric, atol=1e-7)
    assert seen == {True, False}


def test_toxicity_telling():
    """Features that are frequent among positives alone come first; rare and common ones do not come."""
    k, j = np.zeros(toxicity.SPACE, np.uint32), np.zeros(toxicity.SPACE, np.uint32)
    k[[1, 2, 3, 4]], j[[1, 2, 3, 4]] = [90, 40, 4, 60], [1, 5, 0, 100]
    assert toxicity.telling(k, j, 100, 100).tolist() == [1, 2]
    assert toxicity.telling(k * 0, j, 0, 100).tolist() == []
    assert toxicity.fit([], [np.zeros(0, int)], np.array([1]), 0.9).score(set(), {}) < toxicity.THRESHOLD


def test_likeness(spark):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice("abcdefgh") * 2 for _ in range(rnd.randint(0, 80))) for _ in range(40)] + [None, "", "x"]
    texts += texts[:5]
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    hashes = lambda s: {x.split("@")[0] for x in s.split()}
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, r in got.items():
        mine = hashes(r.fingerprint)
        assert r.near_edited == pytest.approx(near(mine, hashes(r.edited_fingerprint)))
        assert r.near_next == pytest.approx(near(mine, hashes(got[(i - 1) % len(texts)].fingerprint)))


def plain_ratio(token, model):
    n = len(secret_scan.ALPHABET)
    at = [secret_scan.ALPHABET.index(c) for c in token]
    return sum(round(model[a * n + b], 4) for a, b in zip(at, at[1:], strict=False)) / (len(token) - 1)


def test_judged_runs(spark):
    model = secret_scan.train(secret_scan.samples(spark))
    rnd = random.Random(8)
    word = lambda: rnd.choice(["config_value_2", "A" * 25 + "1", "é", "password=abcdefgh1", "AKIA" + "Z9" * 9, "0f" * 17])
    key = lambda: "".join(rnd.choice(secret_scan.ALPHABET) for _ in range(rnd.randint(18, 60)))
    texts = [rnd.choice(["", " ", "x"]).join(rnd.choice([word, key])() + rnd.choice([" ", "", "\n"]) for _ in range(12)) for _ in range(80)]
    texts += ["a1" + "".join(rnd.choice(secret_scan.ALPHABET) for _ in range(5000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    judged = 0
    for r in secret_scan.find_secrets(df).collect():
        t = texts[r.doc_id]
        base = [(x.s, x.e) for x in r.found if x.k < 3]
        want = []
        for m in re.finditer(secret_scan.CANDIDATE, t):
            free = not any(s < m.end() and m.start() < e for s, e in base)
            if free and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and plain_ratio(m[0], model) >= secret_scan.LEAST_RATIO:
                want.append((m.start(), m.end()))
        assert [(x.s, x.e) for x in r.found if x.k == 3] == want
        judged += len(want)
    assert judged > 50


def test_judged_runs_held_out(spark):
    """Strings that neither model was trained on: names out of the standard library, and other random strings."""
    rnd = random.Random(11)
    names = sorted({n for m in ("os", "asyncio", "email.message", "http.client", "logging.handlers", "unittest.mock", "xml.dom.minidom", "tarfile", "ssl", "socket", "inspect", "typing") for n in dir(importlib.import_module(m)) if n.isascii() and not n.startswith("__")})
    ordinary = []
    while len(ordinary) < 400:
        made = rnd.choice(["_", "-", "/", ""]).join(rnd.sample(names, 3)) + str(rnd.randint(0, 99))
        if re.fullmatch(secret_scan.CANDIDATE, made):
            ordinary.append(made)
    kinds = ["0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", secret_scan.ALPHABET]
    strings = ["".join(rnd.choice(kinds[i % 4]) for _ in range(rnd.randint(24, 48))) for i in range(400)]
    df = spark.createDataFrame([(i, f"( {s} )") for i, s in enumerate(ordinary + strings)], "doc_id long, text string")
    hit = {r.doc_id for r in secret_scan.find_secrets(df).collect() if any(x.k == 3 for x in r.found)}
    false, caught = sum(i < 400 for i in hit), sum(i >= 400 for i in hit)
    print(f"held out: {caught} of 400 random strings, {false} of 400 identifiers")
    assert caught >= 360 and false <= 20
