"""The measuring kernel against a plain version, and its rules for pairing."""

import hashlib
import math

import pytest

from inkmeter.plans import measure_plans as P

GENRE = P.Genre("person", "casual", "gpt", ("gpt",))


def filler(n):
    return " ".join(["word"] * n)


def arms(spark, rows):
    return spark.createDataFrame(rows, "arm string, id string, doc long, grp string, pos long, text string")


@pytest.fixture(scope="module")
def corpus():
    """60 documents by a person, 52 of them by a machine too; casual texts of their own."""
    rows = []
    for d in range(60):
        rows.append(("person", f"p{d}", d, None, d, filler(90 + 3 * (d % 40)) + " delve" * (d % 9 == 0) + " gonna" * (d % 3 == 0)))
        if d < 52:
            rows.append(("gpt", f"g{d}", d, None, d, filler(95 + 3 * (d % 37)) + " delve" * (d % 2 + 1) + " moreover" * (d % 5 == 0)))
    rows += [("casual", f"c{d}", 1000 + d, None, d, filler(100 + d) + " gonna") for d in range(40)]
    return rows


def words(text):
    return text.count(" ") + 1 if text else 0


def bin_of(n):
    return next((i for i, (a, b) in enumerate([(80, 129), (130, 219), (220, 399), (400, 800)]) if a <= n <= b), -1)


def phi(texts, count):
    total, size = sum(map(count, texts)), sum(map(words, texts))
    if not total:
        return 1.0
    rate = total / size
    return max(1.0, sum((count(t) - rate * words(t)) ** 2 / (rate * words(t)) for t in texts) / (len(texts) - 1))


def tail(z):
    t = 1 / (1 + 0.2316419 * z)
    return min(1.0, 2 * 0.3989423 * math.exp(-z * z / 2) * t * (0.3193815 + t * (-0.3565638 + t * (1.781478 + t * (-1.821256 + t * 1.330274)))))


def rate_p(xs, ys, count):
    cells = {}
    for side, texts in enumerate((xs, ys)):
        for t in texts:
            c = cells.setdefault(math.floor(math.log(words(t)) / math.log(1.1)), [[0, 0], [0, 0]])
            c[side][0] += count(t)
            c[side][1] += words(t)
    dist, seen = {0: 1.0}, 0
    for (ox, wx), (oy, wy) in cells.values():
        if not (wx and wy and ox + oy):
            continue
        n, p, seen, new = ox + oy, wx / (wx + wy), seen + ox, {}
        for a, pa in dist.items():
            for k in range(n + 1):
                new[a + k] = new.get(a + k, 0) + pa * math.comb(n, k) * p**k * (1 - p) ** (n - k)
        dist = new
    p = min(1.0, sum(v for v in dist.values() if v <= dist[seen] * (1 + 1e-7)))
    n, m = len(xs) - 1, len(ys) - 1
    f = max(1.0, (phi(xs, count) * n + phi(ys, count) * m) / (n + m))
    if f > 1 and p < 1:
        lo, hi = 0.0, 40.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if tail(mid) > p else (lo, mid)
        p = tail(lo / math.sqrt(f))
    return p


def share_p(k1, n1, k2, n2):
    p = (k1 + k2) / (n1 + n2)
    se = math.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    return 1.0 if se == 0 else tail(abs(k1 / n1 - k2 / n2) / se)


def adjusted(ps):
    order, q, least = sorted(ps, key=lambda m: (ps[m], m)), {}, 1.0
    for r in range(len(order), 0, -1):
        least = min(least, ps[order[r - 1]] * len(order) / r)
        q[order[r - 1]] = least
    return q


def test_against_a_plain_version(spark, corpus):
    got = {r.marker: r for r in P.measured(arms(spark, corpus), GENRE).collect()}
    text = {i: t for _, i, *_, t in corpus}
    person, gpt = ([i for a, i, *_ in corpus if a == x] for x in ("person", "gpt"))
    counts = {m: lambda t, m=m: t.split().count(m) for m in ("delve", "moreover")}
    tested = [text[f"p{i[1:]}"] for i in gpt]  # the person's texts of the machine's documents
    ps = {m: rate_p([text[i] for i in gpt], tested, c) for m, c in counts.items()}
    pairs = [i[1:] for i in gpt if bin_of(words(text[i])) == bin_of(words(text["p" + i[1:]])) >= 0]
    clean = lambda i: "gonna" not in text[i]
    mine, theirs = sum(clean("g" + i) for i in pairs), sum(clean("p" + i) for i in pairs)
    ps["no_typo_markers"] = share_p(mine, len(pairs), theirs, len(pairs))
    # nothing else tells the arms apart, and no text has five sentences
    rest = {m: 1.0 for m in got if m not in ps and m != "uniform_sentences"}
    q = adjusted(ps | rest)
    for m, r in got.items():
        if m == "uniform_sentences":
            assert r.p is None and r.q is None and r.verdict == "not recorded"
            continue
        assert r.p == pytest.approx((ps | rest)[m], rel=1e-6), m
        assert r.q == pytest.approx(q[m], rel=1e-6), m
    assert got["no_typo_markers"].pairs == len(pairs) and (got["no_typo_markers"].machine_k, got["no_typo_markers"].ref_k) == (mine, theirs)
    assert got["delve"].verdict == "machine marker" and got["no_typo_markers"].verdict == "machine marker" and got["crucial"].verdict == "no signal"
    assert got["crucial"].too_few and not got["delve"].too_few
    # the placebo: the person's texts in two by hash order
    order = sorted(person, key=lambda i: (hashlib.md5(f"{P.SEED}/placebo/{i}".encode()).hexdigest(), i))
    a, b = ([text[i] for i in h] for h in (order[:30], order[30:]))
    assert got["delve"].placebo_p == pytest.approx(rate_p(a, b, counts["delve"]), rel=1e-6) and got["delve"].placebo_tie


def test_not_recorded_and_summary(spark, corpus):
    genre = P.Genre("person", "casual", "gpt", ("gpt", "absent"), not_recorded=("delve",))
    cells = P.measured(arms(spark, corpus), genre).cache()
    got = {r.marker: r for r in cells.collect()}
    assert got["delve"].verdict == "not recorded" and got["delve"].p is None and got["delve"].placebo_tie
    k = {r.marker: r for r in P.summary(cells, "gpt").collect()}
    assert (k["delve"].ai, k["delve"].of, k["delve"].too_few) == (0, 0, 0)
    assert (k["no_typo_markers"].ai, k["no_typo_markers"].of) == (1, 1) and (k["crucial"].of, k["crucial"].too_few) == (0, 1)


def test_pairing_by_assignment(spark):
    rows = []
    for g, (n, m) in {"a": (10, 3), "b": (4, 9), "c": (6, 7), "d": (8, 2)}.items():
        rows += [("person", f"p{g}{i}", i, g, i, filler(100)) for i in range(n)] + [("gpt", f"g{g}{i}", 50 + i, g, i, filler(100)) for i in range(m)]
    rows += [("casual", f"c{i}", 900 + i, None, i, filler(100)) for i in range(5)]
    genre = P.Genre("person", "casual", "gpt", ("gpt",), pairing="prompt")
    found = P.signals(arms(spark, rows))
    how = P.pairings(found, genre)
    assert how == {"person": "self", "gpt": "prompt", "casual": "length"}
    chosen = P.paired(found, genre, "gpt", "prompt").collect()
    assert sorted((r.side, r.id[1]) for r in chosen) == sorted((s, g) for g, k in (("a", 3), ("b", 4), ("c", 6), ("d", 2)) for s in ("arm", "ref") for _ in range(k))
    halves = [(r.half, r.id[1]) for r in P.placebo(found, genre, "gpt", "prompt").collect()]
    assert sorted(halves) == sorted((h, g) for g, k in (("a", 3), ("b", 2), ("c", 3), ("d", 2)) for h in "ab" for _ in range(k))
    with pytest.raises(ValueError, match="name no assignment"):
        P.pairings(P.signals(arms(spark, [*rows, ("gpt", "x", 1, None, 0, "a")])), genre)
    with pytest.raises(ValueError, match="nothing can be paired"):
        P.pairings(P.signals(arms(spark, [(a, i, d, None if a == "person" else g, p, t) for a, i, d, g, p, t in rows])), genre)
    with pytest.raises(ValueError, match="not among the arms"):
        P.pairings(found, P.Genre("nobody", "casual", "gpt", ("gpt",)))


def test_pairing_by_document_flags(spark):
    """Same document and bin only; most of an arm must share documents."""
    rows = [("person", f"p{d}", d, None, d, filler(100)) for d in range(15)]
    rows += [("gpt", f"g{d}", d, None, d, filler(100)) for d in range(10)] + [("gpt", f"h{d}", d, None, 50 + d, filler(300)) for d in range(10, 15)] + [("gpt", "short", 14, None, 99, filler(20))]
    found = P.signals(arms(spark, rows))
    assert P.pairings(found, GENRE) == {"person": "self", "gpt": "document"}
    assert P.paired(found, GENRE, "gpt", "document").where("side = 'arm'").count() == 10
    few = [r for r in rows if r[0] == "person"] + [("gpt", f"g{d}", d + (d > 4) * 100, None, d, filler(100)) for d in range(10)]
    assert P.pairings(P.signals(arms(spark, few)), GENRE)["gpt"] == "length"
