"""Each training-data operator against brute force, and on odd tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, licenses, linededup, lmscore, mixing, neardup, quality, search, sharding
from tessera.llm import queries as llm_queries
from tessera.llm import sql as llm_sql
from tests.oracle import connect, rows

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, node string, label string, score string, shard string"


def _doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, None, "clash", "clash", "clash", "clash", "clash", "clash")


LONG = " ".join(f"w{i % 977}{'ab'[i % 2]}" for i in range(60_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows and ids, clashing extra columns."""
    same = "one two three four five six seven\nline two here"
    return spark.createDataFrame(
        [
            _doc(1, None),
            _doc(2, ""),
            _doc(3, " \n\t "),
            _doc(4, LONG),
            _doc(5, same),
            _doc(5, same),
            _doc(6, same, None, None),
            _doc(None, same),
            _doc(7, "tiny"),
            _doc(8, "日本語 текст ελληνικά 🙂"),
            _doc(7, "other text with the same id"),
            (9, None, None, None, None, None, None, None, None, None, None),
        ],
        DOCS,
    )


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(llm_sql.oracle_sql()))
def test_oracle(spark, con, name):
    assert rows(llm_queries.queries()[name](spark, SF).toPandas()) == rows(con.execute(llm_sql.oracle_sql()[name]).df())


# sharding


def test_shards_near_equal_and_gapless(small):
    got = sharding.kd_shards(small, shards=8).toPandas()
    by = got.groupby("shard")
    assert sorted(by.groups) == list(range(8))
    assert got["size"].tolist() == got.merge(small.toPandas(), on="doc_id")["text"].map(lambda t: len(t.encode()) + 1).tolist()
    mean, largest = got["size"].sum() / 8, got["size"].max()
    assert (by["size"].sum() - mean).abs().max() <= largest + 0.02 * mean
    for _, own in by:
        assert sorted(own["slot"]) == list(range(len(own)))
    texts = {r.doc_id: r.text for r in small.toPandas().itertuples()}
    assert all(zlib.crc32(texts[r.doc_id].encode()) == r.text_crc32 for r in got.itertuples())


def test_shards_by_target_bytes(small):
    got = sharding.kd_shards(small, target_bytes=100_000).toPandas()
    assert got["shard"].nunique() == math.ceil(got["size"].sum() / 100_000)


def test_shards_keep_equal_texts_together(spark):
    d = spark.createDataFrame([_doc(i, f"text number {i // 3}", "en", f"s{i}") for i in range(900)], DOCS)
    got = sharding.kd_shards(d, shards=4).toPandas()
    assert got.groupby("text_crc32")["shard"].nunique().max() == 1


def test_shards_split_hot_group(spark):
    d = spark.createDataFrame([_doc(i, "the same text again" if i < 600 else f"text {i} " * 3) for i in range(1000)], DOCS)
    got = sharding.kd_shards(d, shards=4).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() / sizes.min() < 1.25
    assert got[got.doc_id >= 600].groupby("text_crc32")["shard"].nunique().max() == 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_shards_keep_all_groups_of_the_given_texts(spark, sf):
    d = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = sharding.kd_shards(d, shards=8).join(d.select("doc_id", "text"), "doc_id").toPandas()
    assert got.groupby("text")["shard"].nunique().max() == 1
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= got.groupby("text")["size"].sum().max()


def _kd_tree(points, leaves):
    """The k-d tree in plain Python: (id, weight, hash, x...) to the shard of each id, by sorting instead of histograms."""
    shard = {}

    def split(own, first, n):
        if n == 1 or not own:
            shard.update({p[0]: first for p in own})
            return
        w = sum(p[1] for p in own)
        goal = int(float(w) * (n // 2) / n)
        ranges = [(min(c), max(c)) for c in zip(*(p[3] for p in own), strict=True)]
        k = max(range(len(ranges)), key=lambda i: (ranges[i][1] - ranges[i][0], -i))
        lo, width = ranges[k][0], ranges[k][1] - ranges[k][0]
        place = lambda p: min(sharding.BINS - 1, math.floor((p[3][k] - lo) / width * sharding.BINS)) if width > 0 else 0
        large = [p for p in own if p[1] * sharding.LARGE > w]
        few = [p for p in own if p[1] * sharding.LARGE <= w]
        left, held = set(), 0
        for p in sorted(large, key=lambda p: (place(p), p[2], p[0])):
            before = sum(q[1] for q in few if place(q) <= place(p)) + sum(
                q[1] for q in large if (place(q), q[2], q[0]) < (place(p), p[2], p[0])
            )
            rest = sum(q[1] for q in large if (place(q), q[2], q[0]) >= (place(p), p[2], p[0]))
            held += p[1]
            if (2 * before + p[1] <= 2 * goal or rest > w - goal) and held <= goal:
                left.add(p[0])
        rest = max(0, goal - sum(p[1] for p in large if p[0] in left))
        bins = collections.Counter()
        for p in few:
            bins[place(p)] += p[1]
        total, cut = 0, None
        for x in sorted(bins):
            if total + bins[x] > rest:
                cut = x
                break
            total += bins[x]
        cells = collections.Counter()
        for p in few:
            if place(p) == cut:
                cells[p[2]] += p[1]
        last, running = -1, 0
        for h in sorted(cells):
            running += cells[h]
            if 2 * running - cells[h] <= 2 * (rest - total):
                last = h
        left |= {p[0] for p in few if cut is None or place(p) < cut or (place(p) == cut and p[2] <= last)}
        split([p for p in own if p[0] in left], first, n // 2)
        split([p for p in own if p[0] not in left], first + n // 2, n - n // 2)

    split(points, 0, leaves)
    return shard


@pytest.mark.parametrize("leaves", [8, 5])
def test_kd_tree_brute_force(spark, leaves):
    from tessera.llm.common import Scratch

    rng = np.random.default_rng(6)
    rows = [
        (
            i,
            int(rng.integers(1, 2000)) if i % 40 else int(rng.integers(20_000, 60_000)),
            int(rng.integers(0, sharding.HASHES)),
            float(rng.integers(0, 3)),
            float(rng.random() ** 3),
            1.0,
        )
        for i in range(700)
    ]
    d = spark.createDataFrame(rows, "id long, weight long, hash int, a double, b double, c double")
    got = {r["id"]: r["shard"] for r in sharding.kd_split(d, leaves, ["a", "b", "c"], Scratch(spark)).collect()}
    unit = lambda v, k: (v - min(r[k] for r in rows)) / ((max(r[k] for r in rows) - min(r[k] for r in rows)) or 1)
    assert got == _kd_tree([(r[0], r[1], r[2], tuple(unit(r[k], k) for k in (3, 4, 5))) for r in rows], leaves)
    sums = collections.Counter()
    for r in rows:
        sums[got[r[0]]] += r[1]
    assert max(sums.values()) / min(sums.values()) < 1.1


def test_common_prefix():
    assert sharding._common_prefix("source_1", "source_9") == 7
    assert sharding._common_prefix(None, "x") == 0 == sharding._common_prefix("", "abc")
    assert sharding._common_prefix("abc", "abc") == 3


def test_shards_odd(odd, none):
    got = sharding.kd_shards(odd, shards=3).toPandas()
    assert len(got) == odd.count()
    assert got[got.doc_id == 1]["size"].tolist() == [1]
    assert got[got.doc_id == 1]["text_crc32"].tolist() == [0]
    assert sharding.kd_shards(none, shards=8).count() == 0


# quality rules


def test_quality_odd(odd, none):
    got = quality.host_quality(odd).toPandas()
    assert len(got) == odd.count()
    assert set(got[got.doc_id.isin([1, 2, 3])]["n_words"]) == {0}
    assert not got[got.doc_id.isin([1, 2, 3])]["kept"].any()
    assert quality.host_quality(none).count() == 0


def test_repeat_words_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["a", "b"], n)) for n in (5, 8, 9, 30, 80)] + [("x y z " * 40).strip(), LONG]
    d = spark.createDataFrame([_doc(i, t) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.document_counts(d).collect()}
    for i, t in enumerate(texts):
        ws = t.split()
        seen = collections.defaultdict(list)
        for j in range(len(ws) - 7):
            seen[tuple(ws[j : j + 8])].append(j)
        assert got[i] == len({j + k for at in seen.values() if len(at) > 1 for j in at for k in range(8)})


def test_strict_host_drops_only_failing(spark):
    good = " ".join(f"word{i}" for i in range(40))
    bad = " ".join([f"$$${i}" for i in range(15)] + [f"x{i}" for i in range(30)])
    d = spark.createDataFrame(
        [_doc(i, bad + f" {i}", source="junk") for i in range(30)] + [_doc(100, good, source="junk")] + [
            _doc(200 + i, good + f" {i}", source=f"fine{i % 5}") for i in range(50)
        ] + [_doc(300, bad, source="fine1")],
        DOCS,
    )
    got = quality.host_quality(d).toPandas()
    assert got[got.host == "junk"]["host_strict"].all() and not got[got.host != "junk"]["host_strict"].any()
    assert got[got.doc_id == 100]["kept"].all()
    assert not got[got.doc_id < 100]["base_failed"].any() and (got[got.doc_id < 100]["n_failed_rules"] == 1).all()
    assert not got[got.doc_id < 100]["kept"].any()
    # The same text stays where it is an exception.
    assert got[got.doc_id == 300]["kept"].all() and got[got.host != "junk"]["kept"].all()


def _hosts(spark, hosts):
    """(host, documents, failing ones) to documents; a failing one has too many symbols."""
    good, bad = " ".join(f"word{i}" for i in range(40)), " ".join([f"$$${i}" for i in range(15)] + [f"x{i}" for i in range(30)])
    rows, i = [], 0
    for host, n, k in hosts:
        for x in range(n):
            rows.append(_doc(i, (bad if x < k else good) + f" {i}", source=host))
            i += 1
    return spark.createDataFrame(rows, DOCS)


def test_small_hosts_are_not_strict(spark):
    """Of hosts of one raw rate only the large ones are strict; a page of a host of one is judged as elsewhere."""
    hosts = [(f"fine{i}", 60, i % 4) for i in range(30)] + [("large", 200, 100), ("middle", 60, 30), ("tiny", 2, 1), ("one", 1, 1)]
    d = _hosts(spark, hosts)
    got = quality.host_quality(d).toPandas().groupby("host").first()
    assert got[got.host_strict].index.tolist() == ["large", "middle"]
    assert got.loc["large", "host_rate"] > got.loc["middle", "host_rate"] > got.loc["tiny", "host_rate"] > got.loc["fine0", "host_rate"]
    kept = quality.host_quality(d).toPandas().query("n_failed_rules == 1").groupby("host")["kept"].all()
    assert kept["tiny"] and kept["one"] and kept["fine1"] and not kept["large"] and not kept["middle"]


def test_prior_decides_verdicts(spark):
    """A prior that outweighs all hosts leaves none strict, a weak one makes the small host strict."""
    d = _hosts(spark, [(f"fine{i}", 60, i % 4) for i in range(30)] + [("small", 12, 8)])
    strict = lambda **o: set(quality.host_quality(d, **o).where("host_strict").toPandas()["host"])
    assert strict(prior=(0.05, 0.95)) == {"small"} and strict(prior=(2e4, 9.8e5)) == set()
    # Hosts that differ by chance only: none is strict, though half of them lie above the corpus rate.
    rng = np.random.default_rng(1)
    even = _hosts(spark, [(f"h{i}", 40, int(rng.binomial(40, 0.2))) for i in range(60)])
    got = quality.host_quality(even).toPandas().groupby("host").first()
    assert not got["host_strict"].any() and (got.host_failures / got.host_documents > got.corpus_rate).mean() > 0.3


def test_host_verdicts_on_the_given_documents(spark):
    got = quality.host_quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    assert (~got["base_failed"] & ~got["kept"]).sum() < 0.1 * len(got)
    assert got[got.n_failed_rules == 0]["kept"].all()


def test_beta_prior():
    """Rates drawn from a beta distribution over hosts of any size: mean and size come back; no spread beyond sampling: the largest size."""
    rng = np.random.default_rng(2)
    n = rng.integers(1, 400, 4000)
    sums = lambda k: (len(n), n.sum(), k.sum(), (n * n).sum(), (k * k / n).sum())
    a, b = quality.beta_prior(*map(float, sums(rng.binomial(n, rng.beta(2, 8, len(n))))))
    assert (a / (a + b), a + b) == (pytest.approx(0.2, rel=0.05), pytest.approx(10, rel=0.15))
    assert sum(quality.beta_prior(*map(float, sums(rng.binomial(n, 0.2))))) > 500
    assert sum(quality.beta_prior(0, None, None, None, None)) == pytest.approx(1e6)
    assert sum(quality.beta_prior(1, 10.0, 3.0, 100.0, 0.9)) == pytest.approx(1e6)


# licences


def _base_places(t):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    return len(ws), [(i, k) for i in range(len(ws)) for k, p in phrases.items() if ws[i : i + len(p)] == p]


def test_licenses_brute_force(spark, small):
    texts = [r.text for r in small.toPandas().itertuples()]
    texts += [
        "All rights reserved, all RIGHTS reserved. cc by cc-by CC\nBY",
        "general public\xa0license",
        "Released under the MIT License.",
        "This work is licensed under the GNU General Public License, version 3.",
        "rights reserved all",
        None,
        "",
    ]
    d = spark.createDataFrame([_doc(i, t) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in licenses.scan_licenses(d).collect()}
    for i, t in enumerate(texts):
        n, places = _base_places(t)
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (n, len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({k for _, k in places}))
        assert 0.0 <= r["score"] <= 1.0
    at = len(texts) - 5
    assert got[at]["labels"] == "mit"
    assert got[at + 1]["labels"] == "gpl,gpl-3.0"


def _labels(ws, templates):
    """Labels without an index: every template at every start."""
    index = licenses.Index(templates, 0, {})
    return {t.label for k, t in enumerate(templates) if any(index.check(ws, k, start) for start in range(-index.drift[k], len(ws)))}


def test_license_labels_brute_force(spark):
    """Whole, edited, numbered and shortened licence texts inside other text, notices, and texts that only look like one."""
    rng = np.random.default_rng(9)
    own = [t for t in licenses.TEMPLATES if not t.full or len(t.text.split()) < 300]
    other = [f"w{i}" for i in range(500)]
    texts = []
    for t in own:
        ws = t.text.split()
        for form in range(5 if t.full else 2):
            body = list(ws)
            if form == 1:
                body = [w if rng.random() > 0.04 or w in " ".join(t.mandatory) else "edited" for w in body]
            if form == 2:
                body = [x for i, w in enumerate(body) for x in ([w, str(i)] if t.full and i % 25 == 24 else [w])]
            if form == 3:
                body = body[: len(body) // 2]
            if form == 4:
                body = list(rng.permutation(body))
            texts.append(" ".join([*rng.choice(other, rng.integers(0, 60)), *body, *rng.choice(other, rng.integers(0, 60))]))
    texts += ["the mit license is not meant here", "", " ".join(own[-1].text.split()[:20] * 10)]
    d = spark.createDataFrame([_doc(i, t) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: set(filter(None, r["labels"].split(","))) for r in licenses.scan_licenses(d, templates=tuple(own)).collect()}
    want = {i: _labels(licenses.split_words(t), tuple(own)) for i, t in enumerate(texts)}
    assert got == want
    assert {x for labels in want.values() for x in labels} == {t.label for t in own}


def test_license_full_texts(spark):
    full = [t for t in licenses.TEMPLATES if t.full]
    d = spark.createDataFrame([_doc(i, f"header line {i}\n" + t.text.upper() + "\nend") for i, t in enumerate(full)], DOCS)
    got = {r["doc_id"]: r for r in licenses.scan_licenses(d).collect()}
    for i, t in enumerate(full):
        assert t.label in got[i]["labels"].split(",") and got[i]["score"] == 1.0
        assert any(p["label"] == t.label and p["start"] == 3 for p in got[i]["places"])


def test_licenses_odd(odd, none):
    assert licenses.scan_licenses(odd).count() == odd.count()
    assert licenses.scan_licenses(none).count() == 0


# near duplicates


def _components(texts):
    sets = {}
    for i, t in texts:
        ws = re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "").strip(" \t\n\r\x0b\x0c"))
        ws = [w for w in ws if w]
        sets[i] = {tuple(ws[j : j + 5]) for j in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return {i: (len(sets[i]), label[i]) for i in ids}


def test_near_duplicates_brute_force(spark, small):
    texts = [(r.doc_id, r.text) for r in small.toPandas().itertuples()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(small).collect()}
    assert got == _components(texts)


def test_near_duplicates_hot_group(spark):
    """A chain of edits and a large group that shares a passage: no link is lost to the stars."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for k in range(150):
        ws = list(base)
        for j in rng.choice(120, 3, replace=False):
            ws[j] = f"e{k}_{j}"
        texts.append((k, " ".join(ws)))
    for k in range(150, 260):
        texts.append((k, " ".join(base[:60] + [f"u{k}_{i}" for i in range(60)])))
    texts += [(300 + k, " ".join(f"c{i}" for i in range(k, k + 60))) for k in range(0, 40, 4)]
    d = spark.createDataFrame([_doc(i, t) for i, t in texts], DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(d).collect()}
    assert got == _components(texts)


def test_near_duplicates_slot_filled(spark):
    """Thousands of texts of one template with 80 two-way slots, half of them copies with 10 slots turned: no link in large buckets is lost."""
    rng = np.random.default_rng(11)
    slots = rng.random((2000, 80)) < 0.21
    turned = rng.random((2000, 80)).argsort(axis=1) < 10
    texts = []
    for row in np.concatenate([slots, slots ^ turned]):
        ws = [f"b{i}" for i in range(403)]
        for j, v in enumerate(row):
            ws[3 + 5 * j] = f"s{j}_{int(v)}"
        texts.append(ws)
    numbers = {}
    m = np.zeros((len(texts), 1000), np.float32)
    for i, ws in enumerate(texts):
        for k in range(399):
            m[i, numbers.setdefault(tuple(ws[k : k + 5]), len(numbers))] = 1.0
    shared = m @ m.T
    label = np.arange(len(texts))
    for a, b in zip(*np.nonzero(100 * shared >= 75 * (798 - shared)), strict=True):
        if label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label[label == high] = low
    assert 100 < len(set(label)) < len(texts) - 100
    d = spark.createDataFrame([_doc(i, " ".join(ws)) for i, ws in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(d).collect()}
    lost = sum(got[i] != label[i] for i in range(len(texts)))
    assert lost == 0, f"{lost} of {len(texts)} rows differ; {len(set(got.values()))} components, {len(set(label))} by brute force"


@pytest.mark.parametrize("n", [500, pytest.param(3000, marks=pytest.mark.slow)])
def test_near_duplicates_shuffled_sentences(spark, n):
    """Texts of 48 of 60 fixed sentences in order: most share buckets, few are linked. No link is lost."""
    import random

    draw = random.Random(1)
    sentences = [" ".join(f"s{i}w{k}" for k in range(12)) for i in range(60)]
    texts = [sorted(draw.sample(range(60), 48)) for _ in range(n)]
    numbers = {}
    m = np.zeros((n, 60 * 8 + 4 * 60 * 13), np.float32)
    for i, own in enumerate(texts):
        ws = " ".join(sentences[k] for k in own).split()
        for k in range(len(ws) - 4):
            m[i, numbers.setdefault(tuple(ws[k : k + 5]), len(numbers))] = 1.0
    shared, size = m @ m.T, m.sum(axis=1)
    label = np.arange(n)
    for a, b in zip(*np.nonzero(100 * shared >= 75 * (size[:, None] + size[None, :] - shared)), strict=True):
        if label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label[label == high] = low
    d = spark.createDataFrame([_doc(i, " ".join(sentences[k] for k in own)) for i, own in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(d).collect()}
    assert 0 < n - len(set(label)) < n / 2
    assert sum(got[i] != label[i] for i in range(n)) == 0


def test_near_duplicates_open_groups_stay_narrow(spark, monkeypatch):
    """Groups whose members share many open buckets: edges and links stay below the members, and no link is lost."""
    from tessera.llm.common import Scratch

    rng = np.random.default_rng(7)
    buckets, sets, wanted = [], [], {}
    for start in (0, 1000):
        common = rng.integers(1, 2**62, 100)
        for node in range(start, start + 240):
            # The first half: all linked. The others share 60 of 100 values with them and are linked in pairs.
            own = node - start
            values = common if own < 120 else np.concatenate([common[:60], (own // 2) * 100 + start * 10**6 + np.arange(40)])
            sets.append((node, [int(v) for v in values]))
            wanted[node] = start if own < 120 else node - own % 2
        for key in range(start, start + 40):
            held = np.union1d(rng.choice(240, 90, replace=False), 120 + 2 * (key - start) + np.arange(2))
            buckets += [(key, int(start + k), 100) for k in held]
        # Every one meets its like in a bucket.
        buckets += [(start + 500, start + k, 100) for k in range(240)]
    made = []
    save = Scratch.save

    def counted(self, df, name):
        table = save(self, df, name)
        made.append((name, table.count()))
        return table

    monkeypatch.setattr(Scratch, "save", counted)
    labels = neardup._compare(
        Scratch(spark),
        spark.createDataFrame(buckets, "key long, node long, size int"),
        spark.createDataFrame(sets, "node long, hashes array<long>"),
        None,
        75,
    )
    got = {r["node"]: r["label"] for r in labels.collect()}
    assert {n: got.get(n, n) for n, _ in sets} == wanted
    assert sum(n for name, n in made if name == "links") <= len(sets)
    assert max(n for name, n in made if name == "edges") <= 2 * len(sets)


def test_near_duplicates_links_of_a_tile():
    """All pairs linked: a row a component, not a row a pair. Chains and cycles in any order are joined whole."""
    import pyarrow as pa

    n = 300
    tile = pa.table(
        {"comp": pa.array(range(n), pa.int64()), "right": [False] * n, "hashes": pa.array([[1, 2, 3]] * n, pa.list_(pa.int64()))}
    ).append_column("node", pa.array(range(n), pa.int64()))
    links = neardup._compare_tiles(75)(tile)
    assert links.num_rows == n - 1
    assert set(links["a"].to_pylist()) == {0} and links["b"].to_pylist() == list(range(1, n))
    order = np.random.default_rng(3).permutation(2000) * 7
    cut = np.delete(np.arange(1999), 999)
    a, b = neardup._forest(np.append(order[cut], order[0]), np.append(order[cut + 1], order[999]))
    parts = {int(min(order[:1000])): set(order[:1000].tolist()), int(min(order[1000:])): set(order[1000:].tolist())}
    got = {k: {k} for k in parts}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        got[x].add(y)
    assert got == parts and len(a) == 1998
    assert not len(neardup._forest(order[:0], order[:0])[0])


def test_near_duplicates_odd(odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert all(r["n_shingles"] == 0 and r["component_id"] == i and r["kept"] for i in (1, 2, 3) for r in by[i])
    assert {r["component_id"] for i in (5, 6, None) for r in by[i]} == {5}
    assert not by[None][0]["kept"]
    assert neardup.near_duplicates(none).count() == 0
    left = neardup.drop_near_duplicates(odd)
    assert left.columns == odd.columns
    assert left.where("text like 'one two%'").count() == 1
    assert left.where("doc_id = 7").count() == 2
    assert neardup.drop_near_duplicates(none).count() == 0


# language-model scores


def _cross_entropy(docs, folds):
    """The same models in plain Python: (tokens, score) by id, and the probabilities of a word after another; folds: of target ids."""
    tokens = {i: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] for i, t in docs}
    steps = {i: list(zip(["", *ws], [*ws, ""], strict=True)) if ws else [] for i, ws in tokens.items()}
    n, pn = collections.Counter(), collections.Counter()
    for own in steps.values():
        n.update(w for _, w in own)
        pn.update(own)
    all_n = sum(n.values())
    k1, k2 = lmscore.SINGLE_BACKOFF, lmscore.PAIR_BACKOFF

    def models(without):
        t, pt = collections.Counter(), collections.Counter()
        for i, f in folds.items():
            if f != without:
                t.update(w for _, w in steps.get(i, []))
                pt.update(steps.get(i, []))
        all_t = sum(t.values())

        def p(h, w, single, double, factor):
            one = (single[w] * factor + k1 * n[w] / all_n) / (all_t + k1)
            return (double[h, w] * factor + k2 * one) / (single[h] * factor + k2)

        return (lambda h, w: p(h, w, n, pn, all_t / all_n)), (lambda h, w: p(h, w, t, pt, 1.0))

    by_fold = {f: models(f) for f in {None, *folds.values()}}

    def score(i, own):
        background, target = by_fold[folds.get(i)]
        return sum(math.log(background(h, w)) - math.log(target(h, w)) for h, w in own) / len(own) if own else 0.0

    return {i: (len(tokens[i]), score(i, own)) for i, own in steps.items()}, by_fold, list(n)


@pytest.mark.parametrize("head", [None, (5, 5), (0, 0)])
def test_cross_entropy_brute_force(spark, small, head, monkeypatch):
    """Scores don't depend on how many hot words and pairs are settled apart, nor on how often steps are sent on."""
    if head:
        monkeypatch.setattr(lmscore, "HEAD_WORDS", head[0])
        monkeypatch.setattr(lmscore, "HEAD_PAIRS", head[1])
        monkeypatch.setattr(lmscore, "FLUSH_WORDS", 5000)
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    got = {r["doc_id"]: (r["n_tokens"], r["score"]) for r in lmscore.cross_entropy_difference(small, labels).collect()}
    folds = {r["doc_id"]: r["f"] for r in small.join(labels, "doc_id").select("doc_id", lmscore.fold_of(F.col("text")).alias("f")).collect()}
    want, models, vocabulary = _cross_entropy([(r.doc_id, r.text) for r in small.toPandas().itertuples()], folds)
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1], abs=1e-5) for i in want)
    for model in [m for f in (None, 0) for m in models[f]]:
        for h in ["", *vocabulary[1:400:40], "never seen"]:
            assert sum(model(h, w) for w in vocabulary) == pytest.approx(1)


def test_targets_do_not_know_themselves(spark):
    """Target texts of one kind score like unseen texts of that kind, copies of targets included; other texts score higher."""
    rng = np.random.default_rng(4)
    kinds = [[f"{k}{i}" for i in range(150)] for k in ("a", "b")]
    shared = [f"s{i}" for i in range(100)]
    text = lambda k: " ".join([*rng.choice(kinds[k], 40), *rng.choice(shared, 20)])
    good = [text(0) for _ in range(160)]
    rows = [_doc(i, t) for i, t in enumerate(good[:80] + good[:20] + good[80:] + [text(1) for _ in range(160)])]
    d = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["score"] for r in lmscore.cross_entropy_difference(d, d.where("doc_id < 100").select("doc_id")).collect()}
    seen, unseen, other = (np.array([got[i] for i in ids]) for ids in (range(100), range(100, 180), range(180, 340)))
    spread = seen.std() + unseen.std()
    assert abs(seen.mean() - unseen.mean()) < spread and other.min() > max(seen.max(), unseen.max())


def test_cross_entropy_sets_repeats_apart(spark):
    """A text outside the target scores higher the more often the corpus repeats it."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 300, 60)) for _ in range(200)]
    d = spark.createDataFrame([_doc(i, t) for i, t in enumerate([*texts, *texts[150:160]])], DOCS)
    got = {r["doc_id"]: r["score"] for r in lmscore.cross_entropy_difference(d, d.where("doc_id < 40").select("doc_id")).collect()}
    assert min(got[i] for i in range(150, 160)) > max(got[i] for i in range(160) if i < 150)


def test_cross_entropy_odd(odd, none):
    ids = odd.where("doc_id = 5").select("doc_id")
    got = {r["doc_id"]: r for r in lmscore.cross_entropy_difference(odd, ids).collect()}
    assert (got[1]["n_tokens"], got[1]["score"]) == (0, 0.0)
    # All its target documents are copies, so they have no others to be scored by.
    assert got[5]["score"] == 0.0
    assert lmscore.cross_entropy_difference(odd, ids).count() == odd.count()
    assert {r["score"] for r in lmscore.cross_entropy_difference(odd, ids.limit(0)).collect()} == {0.0}
    assert lmscore.cross_entropy_difference(none, ids).count() == 0


# language ID


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = llm_queries.queries()["op6_language_id"](spark, sf).join(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id"
    ).where("held_out and lang is not null").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97


def test_viterbi_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, k = rng.integers(1, 7), rng.integers(1, 4)
        emit, penalty = rng.normal(0, 3, (n, k)), float(rng.uniform(0.1, 6))
        cost = lambda p, e=emit, c=penalty: sum(e[i, x] for i, x in enumerate(p)) - c * sum(a != b for a, b in zip(p, p[1:], strict=False))
        best = max(cost(p) for p in np.ndindex(*[k] * n))
        assert cost(tuple(langid.spans(emit, penalty))) == pytest.approx(best)


def _count_languages(rows):
    """The model's tables in plain Python: kept words and trigrams with counts, totals, scripts of each language."""
    words, grams = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, t in rows:
        words[lang].update(langid.WORD.findall(t.lower()))
    for lang, own in words.items():
        for w, n in own.items():
            for i in range(len(w)):
                grams[lang][f" {w} "[i : i + 3]] += n

    return words, grams, {x: (sum(words[x].values()), sum(grams[x].values())) for x in words if words[x]}


def test_language_query_brute_force(spark, small):
    """The whole query in plain Python: counts, scores word by word, Viterbi over all states, letters by language."""
    docs = [(r.doc_id, r.text, r.lang) for r in small.toPandas().itertuples()]
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    words, grams, totals = _count_languages([(x, t) for i, t, x in docs if x is not None and t is not None and fold(i) != 1])
    languages = sorted(totals)
    n_words, n_grams = (len({k for own in table.values() for k in own}) for table in (words, grams))
    log = lambda n, total, size: math.log(n + 1) - math.log(total + 2 * max(1, size))
    seen = collections.defaultdict(collections.Counter)
    for x in languages:
        for w, n in words[x].items():
            seen[langid.script(w)][x] += n
    every = {x: sum(c[x] for c in seen.values()) for x in languages}
    allowed = {s: [x for x in languages if c[x] > 0.01 * every[x]] for s, c in seen.items()}

    def emit(w):
        if any(w in words[x] for x in languages):
            row = [log(words[x].get(w, 0), totals[x][0], n_words) for x in languages]
        else:
            row = [
                sum(log(grams[x].get(f" {w} "[i : i + 3], 0), totals[x][1], n_grams) for i in range(len(w))) / max(1.0, len(w) / 3)
                for x in languages
            ]
        ok = allowed.get(langid.script(w)) or languages
        return [max(v - max(row), -8.0) + (0.0 if x in ok else -1e3) for v, x in zip(row, languages, strict=True)]

    got = {r["doc_id"]: r for r in llm_queries.queries()["op6_language_id"](spark, SF).collect()}
    assert len(got) == len(docs)
    for i, t, _ in docs:
        ws = langid.WORD.findall((t or "").lower())
        assert got[i]["held_out"] == (fold(i) == 1)
        if not ws:
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["n_spans"]) == ("und", 0.0, 0)
            continue
        emissions = np.array([emit(w) for w in ws])
        change = langid.SWITCH * (1 - np.eye(len(languages)))
        value, back = emissions[0], []
        for e in emissions[1:]:
            steps = value[:, None] - change
            back.append(steps.argmax(axis=0))
            value = steps.max(axis=0) + e
        best, path = value.max(), [int(value.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        mine = langid.spans(emissions)
        reach = lambda p, e=emissions: e[np.arange(len(p)), p].sum() - langid.SWITCH * np.count_nonzero(np.diff(p))
        assert reach(np.array(mine)) == pytest.approx(best) == reach(np.array(path))
        letters = np.bincount(path, [len(w) for w in ws], len(languages))
        assert got[i]["lang_pred"] == languages[int(letters.argmax())]
        assert got[i]["score"] == pytest.approx(letters.max() / letters.sum(), abs=1e-9)
        assert got[i]["n_spans"] == 1 + np.count_nonzero(np.diff(path))


def test_many_languages(spark):
    """Hundreds of languages with words of their own, all features kept: each text is labelled by its words."""
    rng = np.random.default_rng(8)
    own = {f"l{k:03d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(40)] for k in range(300)}
    rows = [_doc(i, " ".join(rng.choice(own[x], 30)), x) for i, x in enumerate(x for x in own for _ in range(4))]
    d = spark.createDataFrame(rows, DOCS)
    model = langid.train(d, order=F.xxhash64("doc_id"))
    assert len(model.languages) == 300 and set(model.words) == {w for r in rows for w in r[1].split()}
    got = langid.detect(d, model, keep=("lang",)).toPandas()
    assert (got["lang"] == got["lang_pred"]).all() and (got["score"] == 1.0).all()


def test_language_ties(spark):
    """Two languages with the same words: the first by name wins, whatever the order of the rows."""
    d = spark.createDataFrame([_doc(i, "same words here", "zz" if i % 2 else "aa") for i in range(10)], DOCS)
    for rows in (d, d.orderBy(F.col("doc_id").desc())):
        model = langid.train(rows, order=F.xxhash64("doc_id"))
        assert {(r["lang_pred"], r["score"]) for r in langid.detect(rows, model).collect()} == {("aa", 1.0)}


def test_language_spans_and_odd(spark, odd, none):
    en, fr, ru = "the house and the garden of my friend", "la maison et le jardin de mon ami", "дом и сад моего друга"
    d = spark.createDataFrame([_doc(i, t, x) for i, (t, x) in enumerate([(en, "en"), (fr, "fr"), (ru, "ru")] * 4)], DOCS)
    model = langid.train(d, order=F.xxhash64("doc_id"))
    mixed = spark.createDataFrame([_doc(1, en + ". " + ru, None)], DOCS)
    r = langid.detect(mixed, model).first()
    assert [s["lang"] for s in r["spans"]] == ["en", "ru"]
    got = {r["doc_id"]: r for r in langid.detect(odd, model).collect()}
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (1, 2, 3, 9))
    assert langid.detect(odd, model).count() == odd.count()
    empty = langid.train(none, order=F.xxhash64("doc_id"))
    assert {r["lang_pred"] for r in langid.detect(odd, empty).collect()} == {"und"}
    assert langid.detect(none, model).count() == 0


# mixing


def _raked(table, targets, rounds=200):
    """Plain raking of {(source, lang, topic): tokens} to {place: {value: share}}."""
    w = {k: float(v) for k, v in table.items()}
    for _ in range(rounds):
        for i, target in targets.items():
            sums = collections.defaultdict(float)
            for k, v in w.items():
                sums[k[i]] += v
            w = {k: v * target.get(k[i], 0.0) / sums[k[i]] if sums[k[i]] else 0.0 for k, v in w.items()}
    return w


def test_mixing_meets_given_targets(spark):
    """Targets for all three dimensions, one of them a column: weights as by plain raking, expected tokens as the budget says."""
    rng = np.random.default_rng(4)
    places = [(s, x, t) for s in "abc" for x in ("en", "fr") for t in ("news", "code", "chat")]
    docs = [(i, *places[rng.choice(18, p=np.arange(1, 19) / 171)], int(rng.integers(1, 200))) for i in range(600)]
    d = spark.createDataFrame(
        [(i, "w " * n, x, s, t, "clash", 1) for i, s, x, t, n in docs],
        "doc_id long, text string, lang string, source string, subject string, row string, w int",
    )
    shares = {
        "source": {"a": 0.5, "b": 0.3, "c": 0.2},
        "lang": {"en": 0.6, "fr": 0.4, "xx": 0.0},
        "topic": {"news": 0.2, "code": 0.3, "chat": 0.5},
    }
    tables = {k: spark.createDataFrame(list(v.items()), "value string, share double") for k, v in shares.items()}
    got = mixing.mix(d, topic="subject", targets=tables, budget=0.6).toPandas()
    tokens = collections.Counter()
    for _, s, x, t, n in docs:
        tokens[s, x, t] += n
    want = _raked(tokens, dict(enumerate(shares.values())))
    for r in got.itertuples():
        assert r.mix_weight == pytest.approx(want[r.mix_source, r.mix_lang, r.mix_topic], abs=2e-6)
        assert (r.row, r.w, r.mix_tokens) == ("clash", 1, len(r.text.split()))
    assert (got.mix_tokens * got.mix_probability).sum() == pytest.approx(0.6 * got.mix_tokens.sum(), rel=1e-4)
    open_cells = got[got.mix_probability < 1]
    factor = open_cells.mix_probability * [
        tokens[r.mix_source, r.mix_lang, r.mix_topic] / want[r.mix_source, r.mix_lang, r.mix_topic] for r in open_cells.itertuples()
    ]
    assert factor.max() / factor.min() == pytest.approx(1, rel=1e-3)


def test_mixing_reports_targets_that_cant_be_met(spark):
    d = spark.createDataFrame([(1, "a b", "en", "x"), (2, "a b c", "fr", "y")], "doc_id long, text string, lang string, source string")
    tables = {
        k: spark.createDataFrame(v, "value string, share double")
        for k, v in (("source", [("x", 0.9), ("y", 0.1)]), ("lang", [("en", 0.1), ("fr", 0.9)]))
    }
    with pytest.warns(UserWarning, match="can't be met"):
        assert mixing.mix(d, targets=tables).count() == 2


def test_mixing_skips_unnamed_values(spark):
    d = spark.createDataFrame([(i, "a b c", "en", "xy"[i % 2]) for i in range(40)], "doc_id long, text string, lang string, source string")
    got = mixing.mix(
        d, targets={"source": spark.createDataFrame([("x", 1.0), ("z", 1.0)], "value string, share double")}, budget=0.5
    ).toPandas()
    assert got[got.source == "y"]["mix_probability"].max() == 0 and got[got.source == "x"]["mix_probability"].min() == 1


def test_mixing_odd(odd, none):
    got = mixing.mix(odd)
    assert got.count() == odd.count()
    assert got.where("mix_tokens = 0 and not mix_kept").count() == 0
    assert got.columns[: len(odd.columns)] == odd.columns
    assert mixing.mix(none).count() == 0


# search


def test_search_brute_force_ties_and_odd(spark, odd, none, monkeypatch):
    rng = np.random.default_rng(2)
    words = [f"t{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 40), p=(np.arange(30) + 1) / 465)) for _ in range(700)]
    d = spark.createDataFrame(
        [_doc(i, t) for i, t in enumerate(texts)] + [_doc(900 + i, "t1 t2 t3") for i in range(30)], DOCS
    ).repartition(3)
    q = spark.createDataFrame(
        [(1, "T1 t5 t5"), (2, "t0 t29 t28 t3 zzz"), (3, "unknown"), (4, None), (None, "t1")], "query_id long, text string"
    )
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in search.search(d, q).collect()}
    docs = {r["doc_id"]: r["text"].split() for r in d.collect()}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = collections.Counter(w for ws in docs.values() for w in set(ws))
    for qid, terms in ((1, ["t1", "t5"]), (2, ["t0", "t29", "t28", "t3"])):
        s = {}
        for i, ws in docs.items():
            tf = collections.Counter(ws)
            if any(tf[w] for w in terms):
                s[i] = round(
                    sum(
                        math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean))
                        for w in terms
                    ),
                    6,
                )
        want = sorted(s.items(), key=lambda x: (-x[1], x[0]))[:10]
        assert [got[qid, r][0] for r in range(1, 11)] == [i for i, _ in want]
        assert [got[qid, r][1] for r in range(1, 11)] == pytest.approx([x for _, x in want], abs=2e-6)
    assert {q for q, _ in got} == {1, 2}
    # In small blocks of queries and with ids of text: the same.
    monkeypatch.setattr(search, "QUERY_BLOCK", 1)
    monkeypatch.setattr(search, "SHARD_DOCS", 50)
    named = search.search(
        d.withColumn("doc_id", F.concat(F.lit("d"), F.lpad("doc_id", 4, "0"))), q.withColumn("query_id", F.concat(F.lit("q"), "query_id"))
    ).collect()
    assert {(int(r["query_id"][1:]), r["rank"]): (int(r["doc_id"][1:]), r["score"]) for r in named} == got
    assert search.search(odd, q.withColumn("text", F.lit("four three"))).where("query_id = 1").count() == 3
    assert search.search(none, q).count() == 0


def test_search_of_thousands_of_queries(spark, monkeypatch):
    """Every query against every document, in small shards and blocks of queries, as a product of matrices gives it."""
    monkeypatch.setattr(search, "QUERY_BLOCK", 700)
    monkeypatch.setattr(search, "SHARD_DOCS", 100)
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(800)]
    p = 1 / np.arange(5, 805)
    some = lambda n: rng.choice(800, n, p=p / p.sum())
    docs, queries = [some(int(rng.integers(1, 30))) for _ in range(900)], [some(int(rng.integers(1, 4))) for _ in range(3000)]
    d = spark.createDataFrame([_doc(i, " ".join(words[w] for w in ws)) for i, ws in enumerate(docs)], DOCS).repartition(4)
    q = spark.createDataFrame([(i, " ".join(words[w] for w in ws)) for i, ws in enumerate(queries)], "query_id long, text string")
    got = collections.defaultdict(list)
    for r in search.search(d, q).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    tf = np.stack([np.bincount(ws, minlength=800) for ws in docs]).astype(float)
    size, df = tf.sum(1), (tf > 0).sum(0)
    norm = tf + 1.2 * (0.25 + 0.75 * size / size.mean())[:, None]
    impact = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / norm
    for i, ws in enumerate(queries):
        s = np.round(impact[:, sorted(set(ws.tolist()))].sum(1), 6)
        want = np.lexsort((np.arange(len(s)), -s))[: min(10, np.count_nonzero(s))]
        assert [x for _, x in got[i]] == pytest.approx(s[want].tolist(), abs=2e-6)
        assert {k for k, x in got[i] if x > s[want[-1]] + 2e-6} == {int(k) for k in want if s[k] > s[want[-1]] + 2e-6} if len(want) else not got[i]


# line dedup


def test_line_dedup_odd(spark, odd, none):
    got = linededup.dedup_lines(odd)
    assert got.count() == odd.count()
    assert got.where("line_dropped > 0").count() == 0
    assert linededup.dedup_lines(none).count() == 0
    d = spark.createDataFrame([_doc(i, f"menu\n\nstory {i}\nmenu") for i in range(20)] + [_doc(50, "menu\nmenu")], DOCS)
    out = {r["doc_id"]: r for r in linededup.dedup_lines(d).collect()}
    assert (out[3]["text"], out[3]["line_total"], out[3]["line_dropped"]) == ("\nstory 3", 3, 2)
    assert (out[50]["text"], out[50]["line_dropped"]) == ("", 2)
    kept = linededup.dedup_lines(d, keep_boilerplate_pages=True).where("doc_id = 50").first()
    assert (kept["text"], kept["line_dropped"]) == ("menu\nmenu", 0)


# names


INNER = [
    "row",
    "text_",
    "_host",
    "_drop",
    "kept",
    "total",
    "left",
    "id",
    "n",
    "body",
    "w",
    "p",
    "_x",
    "_kx",
    "_id",
    "_again",
    "hi",
    "lo",
    "label",
    "node",
    "key",
    "tokens",
    "weight",
]


def test_columns_named_like_inner_ones_pass_through(spark):
    """Columns that are named like those of the operators' own tables come back as they were."""
    d = spark.createDataFrame(
        [(i, f"menu\nstory {i // 2} of a few words more", "en", "s", *[f"{c}{i}" for c in INNER]) for i in range(20)],
        ["doc_id", "text", "lang", "source", *INNER],
    )
    want = {r["doc_id"]: [r[c] for c in INNER] for r in d.collect()}
    for out in (mixing.mix(d), linededup.dedup_lines(d), neardup.drop_near_duplicates(d)):
        got = {r["doc_id"]: [r[c] for c in INNER] for r in out.collect()}
        assert len(got) >= 10 and all(got[i] == want[i] for i in got)


# BPE


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_bpe_round_trip_with_library(spark, small, odd, none, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    extra = [
        "I'LL don't x're 12³ ½ <|endoftext|>tail<|startoftext|>",
        "ΑΣ ΣΑΣ İstanbul ǅ ﬁ é",
        "".join(map(chr, range(1, 0x500))),
        "aaaa" * 500,
        "\x85  a\xa0b",
        "日本語テキスト 🙂🙂",
    ]
    d = small.select("doc_id", "text").union(odd.select("doc_id", "text")).union(
        spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    )
    want = collections.Counter()
    for r in d.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        plain = library.decode(ids, skip_special_tokens=False)
        want[
            r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()
        ] += 1
    assert collections.Counter(tuple(r) for r in bpe.encode_documents(d, vocabulary).collect()) == want
    full = bpe.encode_documents(odd, vocabulary, keep_ids=True, keep_text=True).where("doc_id = 7").first()
    assert full["decoded"] == library.decode(full["ids"], skip_special_tokens=False)
    assert bpe.encode_documents(none, vocabulary).count() == 0


def test_automaton_equals_merging():
    """Random merge lists: the automaton's tokens are those of applying the merges in order."""
    rng = np.random.default_rng(7)
    for _ in range(150):
        tokens, merges = list("abc"), []
        for _ in range(rng.integers(1, 12)):
            u, v = (tokens[i] for i in rng.integers(0, len(tokens), 2))
            if u + v not in tokens:
                tokens.append(u + v)
                merges.append((u, v))
        machine = bpe.Automaton(list("abc"), merges)
        rank = {m: i for i, m in enumerate(merges)}
        for _ in range(20):
            word = list(rng.choice(list("abc"), rng.integers(1, 14)))
            want = list(word)
            while True:
                found = min(((rank[p], i) for i, p in enumerate(zip(want, want[1:], strict=False)) if p in rank), default=None)
                if not found:
                    break
                i = found[1]
                want[i : i + 2] = [want[i] + want[i + 1]]
            assert machine.encode(word) == want
