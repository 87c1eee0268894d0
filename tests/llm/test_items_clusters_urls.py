"""Reversed item search, clustering and URL filters against plain Python, and on odd tables."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import clustering, itemsearch, urlfilter
from tests.llm.test_operators import DOCS, LONG, _doc, none, odd  # noqa: F401

# item search


def _terms(t):
    return re.findall(itemsearch.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def _ranked(docs, items, k=10):
    """All items against all documents, (item_id, rank, doc_id, score)."""
    bags = [(i, _terms(t)) for i, t in docs]
    bags = [(i, ts, Counter(ts)) for i, ts in bags if ts]
    n, total = len(bags), sum(len(ts) for _, ts, _ in bags)
    df = Counter(t for _, _, c in bags for t in c)
    own = {}
    for i, t in items:
        own.setdefault(i, set()).update(_terms(t))
    out = []
    for item, ts in own.items():
        scores = []
        for i, words, c in bags:
            m = 10 + 90 * len(words) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("block_bytes", [itemsearch.BLOCK_BYTES, 20_000])
def test_items_brute_force(spark, block_bytes):
    """Ties, repeated rows, skewed words, long and empty texts; items in one block and in many."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)] + ["ñandú", "日本語", "İ", "x1"]
    p = 1 / np.arange(1, len(words) + 1)
    some = lambda n: " ".join(rng.choice(words, n, p=p / p.sum()))
    docs = [(i, some(int(rng.integers(1, 60)))) for i in range(800)]
    docs += [(1000 + i, docs[7][1]) for i in range(300)] + [(5, docs[5][1]), (None, docs[7][1]), (2000, LONG + " w1 W1,w2"), (2001, ""), (2002, None), (2003, "?!")]
    items = [(i, some(20) + " Only_here") for i in range(120)] + [(200, docs[7][1]), (201, None), (202, "..."), (None, "w1-w2"), (3, "w299 ñandú"), (204, "nothing matches this")]
    d = spark.createDataFrame([_doc(i, t) for i, t in docs], DOCS).repartition(6)
    q = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, score string")
    got = itemsearch.rank_for_items(d, q, block_bytes=block_bytes)
    assert _got(got) == _ranked(docs, items)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_items_odd(odd, none, spark):  # noqa: F811
    q = spark.createDataFrame([("a", "one two"), ("b", "tiny"), ("b", "日本語"), (None, "w5a")], "item_id string, text string")
    assert _got(itemsearch.rank_for_items(odd, q)) == _ranked([(r["doc_id"], r["text"]) for r in odd.collect()], [tuple(r) for r in q.collect()])
    assert itemsearch.rank_for_items(none, q).count() == 0
    assert itemsearch.rank_for_items(odd, q.limit(0)).count() == 0
    assert dict(itemsearch.rank_for_items(odd, q.where("item_id = 'b'")).dtypes)["item_id"] == "string"


def test_item_heaps_keep_the_best_in_any_order():
    rng = np.random.default_rng(1)
    scores, ids = rng.integers(0, 6, (500, 7)), rng.permutation(500).astype(np.int64)
    heaps = itemsearch._Heaps(7, 10)
    for a in range(0, 500, 33):
        heaps.offer(ids[a : a + 33], scores[a : a + 33].astype(np.int64))
    for j in range(7):
        want = sorted((-s, i) for s, i in zip(scores[:, j].tolist(), ids.tolist(), strict=True) if s > 0)[:10]
        assert sorted((-s, -d) for s, d in heaps.heaps[j]) == want


# clustering


def _kmeans(rows, k=8, rounds=10, dimensions=64):
    """Full scans in Python integers: ({vec_id: (cluster, distance)} as a list, centroids)."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    draw = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [x for _, x in sorted(kept, key=draw)[:k]]
    x = np.array([v for _, v in kept], object)
    for turn in range(rounds + 1):
        d = np.stack([((x - np.array(c, object)) ** 2).sum(1) for c in centroids], 1).astype(np.int64)
        best = d.argmin(1)
        if turn < rounds:
            for c in range(len(centroids)):
                if (best == c).any():
                    centroids[c] = [int(s) // int((best == c).sum()) for s in x[best == c].sum(0)]
    return [(kept[i][0], int(best[i]), int(d[i, best[i]])) for i in range(len(kept))], centroids


def _check(spark, rows, **options):
    d = spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], "vec_id long, embedding array<double>, cluster string, x string")
    got = clustering.cluster_vectors(d, **options).collect()
    want, centroids = _kmeans(rows, **options)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == sorted(want, key=str)
    sums = Counter()
    for _, c, distance in want:
        sums[c] += distance
    names = {i: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for i, c in enumerate(centroids)}
    for r in got:
        assert (r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) == (sums[r["cluster"]], sum(sums.values()), names[r["cluster"]])
    return d


def test_clusters_brute_force(spark):
    """Groups of vectors, a hot one, ties and repeated rows; most vectors of later rounds are never compared with all centroids."""
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 0.2, (12, 64))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.04, 64)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[5][1]) for i in range(700)] + [rows[9], rows[9], (None, rows[3][1])]
    d = _check(spark, rows)
    shares = clustering.kmeans(d)[2]
    assert shares[0] > 0.9 and len(shares) == 11 and np.mean(shares[3:]) < 0.3


def test_clusters_of_few_values(spark):
    """Many equal distances: the smaller number wins; empty clusters stay; few dimensions, large and negative components."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 2)]) for i in range(400)]
    rows += [(1000 + i, [130_000.0 * (-1) ** i, -130_000.0]) for i in range(20)]
    for k in (1, 3, 30):
        _check(spark, rows, k=k, dimensions=2, rounds=4)


def test_clusters_odd(spark):
    v = [0.5] * 64
    rows = [(1, v), (2, None), (3, []), (4, v[:63]), (5, [*v[:63], None]), (6, [*v[:63], math.nan]), (7, [*v[:63], math.inf]), (1, v), (None, [-x for x in v])]
    d = _check(spark, rows)
    assert clustering.cluster_vectors(d.limit(0)).count() == 0
    far = spark.createDataFrame([(1, [1e30] * 64), (2, v)], "vec_id int, embedding array<float>")
    assert [r["vec_id"] for r in clustering.cluster_vectors(far).collect()] == [2]


def test_loosening_is_a_bound_and_beats_the_drift():
    """For points of spheres, a moved centroid never comes nearer than the bound allows; on the whole it allows less than full drift."""
    rng = np.random.default_rng(3)
    gains = []
    for _ in range(300):
        k, size = int(rng.integers(2, 6)), int(rng.integers(2, 6))
        old = rng.normal(0, 10, (k, size))
        new = old + rng.normal(0, rng.choice([0.1, 1.0, 10.0]), (k, size)) * (rng.random((k, 1)) < 0.8)
        radius = rng.random(k) * rng.choice([0.1, 3.0, 20.0])
        loose = clustering.loosening(old, new, radius)
        for i in range(k):
            way = rng.normal(0, 1, (400, size))
            x = old[i] + way / np.linalg.norm(way, axis=1)[:, None] * radius[i] * rng.choice([1.0, 0.7], (400, 1))
            others = [j for j in range(k) if j != i]
            before = np.linalg.norm(x[:, None] - old[None, others], axis=2).min(1)
            after = np.linalg.norm(x[:, None] - new[None, others], axis=2).min(1)
            assert (before - after <= loose[i] + 1e-9).all()
            full = np.linalg.norm(new - old, axis=1)[others].max()
            assert loose[i] <= full * (1 + 1e-5)
            gains.append(loose[i] / full if full else 1.0)
    assert np.mean(gains) < 0.8


# url filters


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, "clash", "clash") for i, u in rows], "page_id long, url string, host string, n string")


def _labels(spark, rows):
    return spark.createDataFrame(rows, "page_id long, bad boolean")


def test_url_parts_and_rules(spark):
    cases = [
        ("http://a.net/x?y", "a.net", "/x", "net/"),
        ("https://EXAMPLE.net/en/q#f", "example.net", "/en/q", "example.net/en/"),
        ("https://notexample.net/en/", "notexample.net", "/en/", "net/"),
        ("http://b.example.com/de/", "b.example.com", "/de/", "example.com/de/"),
        ("http://b.example.com/de", "b.example.com", "/de", None),
        ("http://w.org/fr/x", "w.org", "/fr/x", "org/fr/"),
        ("http://w.org", "w.org", "", None),
        ("http://w.net?q", "w.net", "", None),
        ("x://y://z.net/", "y:", "//z.net/", None),
        ("no scheme.net/", "", "", None),
        ("", "", "", None),
        (None, "", "", None),
        ("http://Ünï.NET/", "Ünï.net", "/", "net/"),
    ]
    got = urlfilter.judge_urls(_pages(spark, [(i, c[0]) for i, c in enumerate(cases)]), _labels(spark, [])).collect()
    for r in got:
        _, host, path, rule = cases[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == ("block" if rule in ("net/", "example.com/de/") else "allow")
    assert len(got) == len(cases)


def test_url_domains(spark):
    hosts = {
        "a.b.example.com": ("com", "example.com"),
        "www.shop.co.uk": ("co.uk", "shop.co.uk"),
        "co.uk": ("co.uk", "co.uk"),
        "me@x.example.org:8080": ("org", "example.org"),
        "10.0.0.1:80": ("address", "10.0.0.1"),
        "localhost": ("localhost", "localhost"),
        "example.com.": ("com", "example.com"),
        "": ("", ""),
    }
    got = urlfilter.with_domains(spark.createDataFrame([(h,) for h in hosts], "host string")).collect()
    assert {r["host"]: (r["suffix"], r["domain"]) for r in got} == hosts


def _hosted(hosts):
    """(host, pages, bad ones) to pages and labels."""
    pages, labels, i = [], [], 0
    for host, n, k in hosts:
        for x in range(n):
            pages.append((i, f"https://{host}/p{x}"))
            labels.append((i, x < k))
            i += 1
    return pages, labels


def test_reputation_shrinks_and_decides(spark):
    """Of hosts with one raw rate only those with many labels are blocked; a bad domain's new host is blocked, a good one's isn't."""
    hosts = [(f"h{i}.good{i % 8}.org", 40, i % 3) for i in range(40)] + [(f"m{i}.bad.com", 40, 33 + i % 5) for i in range(12)]
    hosts += [("big.mixed.org", 200, 100), ("tiny.mixed.org", 2, 1), ("single.good1.org", 1, 1)]
    hosts += [(f"k{i}.mixed.org", 30, 2) for i in range(60)]
    pages, labels = _hosted(hosts)
    pages += [(90_000, "http://new.bad.com/"), (90_001, "http://new.good1.org/"), (90_002, None), (None, "http://m1.bad.com/")]
    got = {r["host"]: r for r in urlfilter.judge_urls(_pages(spark, pages), _labels(spark, labels), rules=()).collect()}
    blocked = {h for h, r in got.items() if r["host_blocked"]}
    assert {f"m{i}.bad.com" for i in range(12)} | {"big.mixed.org", "new.bad.com"} == blocked
    assert all((r["verdict"] == "block") == r["host_blocked"] for r in got.values())
    assert got["big.mixed.org"]["host_rate"] > got["tiny.mixed.org"]["host_rate"] > got["k0.mixed.org"]["host_rate"]
    assert got["new.bad.com"]["host_labels"] == 0 and got["new.bad.com"]["host_rate"] > 0.5 > got["new.good1.org"]["host_rate"]
    # Labels that no host differs by block nothing: the priors outweigh chance.
    rng = np.random.default_rng(0)
    even, outcome = _hosted([(f"h{i}.d{i % 9}.com", 30, int(rng.binomial(30, 0.2))) for i in range(200)])
    assert not any(r["host_blocked"] for r in urlfilter.judge_urls(_pages(spark, even), _labels(spark, outcome)).collect())
    # A narrower bound changes verdicts.
    assert any(r["host_blocked"] for r in urlfilter.judge_urls(_pages(spark, even), _labels(spark, outcome), bound=-3.0).collect())


def test_prior_sizes(spark):
    """Rates drawn around their parents' rates: the size comes back, for parents of different rates."""
    rng = np.random.default_rng(6)
    rows = []
    for p in range(40):
        mean = rng.uniform(0.1, 0.6)
        for _ in range(60):
            n = int(rng.integers(5, 300))
            rows.append((f"p{p}", n, int(rng.binomial(n, rng.beta(20 * mean, 20 * (1 - mean))))))
    d = spark.createDataFrame(rows, "p string, n long, k long")
    assert urlfilter.prior_sizes(d, "p") == pytest.approx(20, rel=0.15)
    assert urlfilter.prior_sizes(d.limit(1), "p") == urlfilter.LARGEST_PRIOR == urlfilter.prior_sizes(d.limit(0), "p")


def test_urls_odd(spark):
    pages = [(1, None), (2, ""), (3, "http://a.com/"), (3, "http://a.com/"), (None, "http://a.com/x"), (4, "http://" + "a" * 200_000 + ".com/" + "b" * 200_000)]
    labels = [(3, True), (3, False), (3, None), (None, True), (77, True)]
    got = urlfilter.judge_urls(_pages(spark, pages), _labels(spark, labels)).collect()
    assert len(got) == len(pages)
    assert {(r["host"], r["host_labels"], r["host_bad"]) for r in got if r["host"] == "a.com"} == {("a.com", 2, 2)}
    assert urlfilter.judge_urls(_pages(spark, pages).limit(0), _labels(spark, labels)).count() == 0
    assert {r["verdict"] for r in urlfilter.judge_urls(_pages(spark, pages), _labels(spark, [])).collect()} == {"allow"}
