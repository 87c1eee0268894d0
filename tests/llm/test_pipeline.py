"""The pipeline against its stages in plain Python."""

import collections
import hashlib
import re

import corpus_pipeline
from pyspark.sql import functions as F

from tessera.llm import langid, mixing
from tests.llm.test_operators import DOCS, INNER, LONG, SF, _components, _doc, _raked


def test_stages(spark):
    """run() equals brute-force versions of its filters over the whole small table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs.toPandas()
    model = langid.train(docs, order=F.xxhash64("doc_id"))
    sure = {r["doc_id"] for r in langid.detect(docs, model).where("lang_pred <> 'und' and score >= 0.5").collect()}
    now = now[now.doc_id.isin(sure)]

    pages, on = collections.Counter(now.source), collections.Counter()
    for r in now.itertuples():
        on.update((r.source, x) for x in {x for x in r.text.split("\n") if x.strip(" \t\n\r\x0b\x0c")})
    common = {k for k, n in on.items() if n >= 5 and n > 0.1 * pages[k[0]]}

    def clean(r):
        kept = [x for x in r.text.split("\n") if (r.source, x) not in common]
        return "\n".join(kept) if any(x.strip() for x in kept) else r.text

    texts = [(r.doc_id, clean(r)) for r in now.itertuples()]
    component = _components(texts)
    left = {i: t for i, t in texts if component[i][1] == i}

    kept = _mixed([(r.doc_id, left[r.doc_id], r.source, r.lang) for r in now.itertuples() if r.doc_id in left])

    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i in kept:
        ids = library.encode(left[i], add_special_tokens=False).ids
        plain = library.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
    assert 0.4 * len(left) < len(got) < len(left)


def _form(t, n):
    symbols, pipes = sum(t.count(c) for c in "#*$%&|<>"), t.count("|")
    return "table" if 10 * pipes > n else "symbols" if 10 * symbols > 3 * n else "short" if n < 50 else "long" if n >= 1000 else "prose"


def _mixed(docs):
    """Ids that mixing keeps, in plain Python: raking to flattened shares, one factor for all cells, a number from the id."""
    rows = []
    for i, t, source, lang in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        rows.append((i, n, (source or "", lang or "", _form(t or "", n))))
    tokens = collections.Counter()
    for _, n, cell in rows:
        tokens[cell] += n
    targets = {}
    for d in range(3):
        sums = collections.Counter()
        for cell, n in tokens.items():
            sums[cell[d]] += n
        whole = sum(v**mixing.TEMPERATURE for v in sums.values())
        targets[d] = {k: v**mixing.TEMPERATURE / whole for k, v in sums.items()}
    weight = _raked(tokens, targets)
    budget, full = mixing.BUDGET * sum(tokens.values()), set()
    while True:
        factor = (budget - sum(tokens[c] for c in full)) / sum(weight[c] for c in tokens if c not in full and weight[c])
        more = {c for c in tokens if c not in full and tokens[c] and weight[c] * factor >= tokens[c]}
        if not more:
            break
        full |= more
    p = {c: round(1.0 if c in full or not n else weight[c] * factor / n, 6) for c, n in tokens.items()}
    unit = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32
    return [i for i, n, cell in rows if n == 0 or unit(i) < p[cell]]


def test_stages_on_long_texts_ties_and_inner_names(spark):
    """A very long text, ties of copies, and columns named like the stages' own ones come through all stages."""
    prose = "the house and the garden of my friend are near the river and the old mill "
    rows = [
        (i, prose * (1 if i % 3 else 4) + " ".join(f"w{i}x{k}" for k in range(60)), "en", f"s{i % 2}", *[f"{c}{i}" for c in INNER])
        for i in range(30)
    ]
    rows += [(100 + i, LONG, "en", "s0", *[f"{c}{100 + i}" for c in INNER]) for i in range(3)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *INNER])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", *INNER]
    got = docs.collect()
    assert all([r[c] for c in INNER] == [f"{c}{r['doc_id']}" for c in INNER] for r in got)
    assert sum(r["text"] == LONG for r in got) <= 1 and len(got) > 5


def test_stages_keep_columns_and_stand_odd_tables(spark):
    odd = spark.createDataFrame(
        [
            _doc(1, None),
            _doc(2, ""),
            _doc(3, "the house and the garden", "en"),
            _doc(3, "the house and the garden", "en"),
            _doc(None, "la maison et le jardin", "fr"),
            _doc(4, "la maison et le jardin", None, None),
        ],
        DOCS,
    )
    for table in (odd, odd.limit(0)):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == odd.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
