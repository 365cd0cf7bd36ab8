"""Nearest neighbours, source divergence and spelling variants against plain versions; markup that never ends; packed payloads."""

from __future__ import annotations

import gzip
import itertools
import json
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from assaylake.llm import divergence, html_extract, neighbours, ngram_join, sharding, spelling, warc

SMALL = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=str)


# spelling variants


def near(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_words(docs) -> Counter:
    out: Counter = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return Counter({w: n for w, n in out.items() if n >= 2})


def plain_variants(docs) -> list[tuple]:
    n = plain_words(docs)
    links = {w: [x for x in n if near(w, x)] for w in n}
    best = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in links.items() if xs}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(links[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def spelled():
    g = random.Random(5)
    base = ["variant" + "".join(g.choice("aeiouéÿst") for _ in range(g.randint(0, 5))) for _ in range(12)] + ["Überlänge", "x" * 70, "x" * 69 + "y", "y" + "x" * 70, "z" * 64, "z" * 65]
    docs = []
    for i in range(300):
        words = []
        for _ in range(20):
            w = base[min(int(g.expovariate(0.5)), len(base) - 1)]
            if g.random() < 0.15:
                k = g.randrange(len(w))
                w = g.choice([w[:k] + w[k + 1 :], w[:k] + g.choice("aéß") + w[k:], w[:k] + g.choice("abþ") + w[k + 1 :]])
            words.append(w.upper() if g.random() < 0.1 else w)
        docs.append((i, g.choice([" ", "-", "1"]).join(words)))
    return [*docs, (None, "variants variants"), (300, None), (301, ""), (302, "short"), (5, docs[5][1])]


def test_variants_equal_a_plain_version(spark, spelled):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in spelled], "doc_id long, text string, word string, n string").repartition(5)
    got = rows(spelling.variants(df), "word", "form", "root", "n", "n_near", "form_n")
    assert got == plain_variants(spelled) and sum(r[1] is not None for r in got) > 20


def test_split_units_give_the_same_pairs(spark, spelled):
    n = plain_words(spelled)
    words = spark.createDataFrame(list(n.items()), "word string, n long").cache()
    whole, split = rows(spelling.near_words(words)), rows(spelling.near_words(words, unit=7))
    assert whole == split and {r[0]: r[1] for r in whole} == {w: k for w in n if (k := sum(near(w, x) for x in n))}


def test_no_words_give_no_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "a b c"), (3, "onlyonce")], "doc_id long, text string")
    assert spelling.variants(df).count() == 0 and spelling.variants(df.limit(0)).count() == 0


# source divergence


def plain_divergence(docs, least=10, top=10):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen, df, count = set(), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(low))
        seen.add((lang, source))
        df[lang].update(set(words))
        count[lang, source].update(words)
    out = []
    for lang in {x for x, _ in seen}:
        kept = [w for w, k in df[lang].items() if k >= least]
        own = {s: {w: c[w] for w in kept} for (x, s), c in count.items() if x == lang}
        own |= {s: dict.fromkeys(kept, 0) for x, s in seen if x == lang and s not in own}
        share = lambda c, n: 1 + 1000000000 * (c + 2) // (n + 2 * len(kept))
        p = {s: {w: share(c, sum(cs.values())) for w, c in cs.items()} for s, cs in own.items()}
        every = {w: sum(cs[w] for cs in own.values()) for w in kept}
        q = {w: share(c, sum(every.values())) for w, c in every.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in own if o != s]
            terms = [(w, f(p[s][w], q[w])) for w in kept if own[s][w] > 0 and p[s][w] > q[w]]
            for part, xs, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for k, (item, v) in enumerate(sorted(xs, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.append((lang, s, part, item, v, k + 1))
    return sorted(out, key=str)


def test_divergence_equals_a_plain_version(spark):
    g = random.Random(9)
    words = ["alpha", "Beta", "gämma", "日本", "x_y", "delta", "épsilon"] + [f"w{chr(97 + i)}" for i in range(20)]
    docs = [(" ".join(g.choice(words[: 5 + 3 * (i % 7)]) for _ in range(g.randint(0, 30))), g.choice(["en", "de", None]), g.choice(["a", "b", "c", None, "é"])) for i in range(200)]
    docs += [(None, "en", "empty"), ("12 34", "fr", "one"), ("alpha", "fr", "two"), ("", "xx", "alone"), docs[0], docs[0]]
    df = spark.createDataFrame([(*d, "n", "p") for d in docs], "text string, lang string, source string, term string, zero string").repartition(5)
    got = rows(divergence.divergence(df), "lang", "source", "part", "item", "value", "rank")
    assert got == plain_divergence(docs) and ("fr", "one", "pair", "two", 0, 1) in got
    assert divergence.divergence(df.limit(0)).count() == 0


def test_shares_of_huge_counts_are_exact(spark):
    from pyspark.sql import functions as F

    g = random.Random(4)
    cases = [(n := g.randrange(10**15), n + g.randrange(10**15), g.randrange(1, 10**9)) for _ in range(200)]
    df = spark.createDataFrame(cases, "n long, total long, terms long")
    for n, total, terms, p in df.select("*", divergence.share(F.col("n"), F.col("total"), F.col("terms")).alias("p")).collect():
        assert p == 1 + 1000000000 * (n + 2) // (total + 2 * terms)


# nearest neighbours


def plain_nearest(vectors, every=100, top=10):
    good = [(i, np.array(v, float)) for i, v in vectors if v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for a, (q, x) in enumerate(good):
        if q is not None and q % every == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i is None, i or 0) for b, (i, y) in enumerate(good) if a != b)[:top]
            out.setdefault(q, []).append([(k + 1, None if n else i, round(d, 9)) for k, (d, n, i) in enumerate(near)])
    return out


def test_neighbours_equal_brute_force_on_odd_rows(spark):
    g = np.random.default_rng(3)
    vectors = [(i, g.standard_normal(8).tolist()) for i in range(400)]
    hot = vectors[7][1]
    vectors += [(1000 + i, hot) for i in range(60)] + [(100, vectors[100][1]), (None, hot), (2000, None), (2100, [0.0] * 8), (2200, [float("nan")] * 8), (2300, [1.0, None] + [0.0] * 6), (2400, [float("inf")] * 8), (2500, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, node string")
    got = defaultdict(list)
    for r in neighbours.nearest(df).collect():
        got[r.query_id].append((r.rank, r.vec_id, round(r.score, 9)))
    vectors = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    want = plain_nearest(vectors)
    assert got.keys() == want.keys() and 2100 not in got
    found = sum(len({x[1] for x in got[q]} & {x[1] for x in c}) for q, cs in want.items() for c in cs[:1])
    assert found >= 0.9 * sum(len(cs[0]) for cs in want.values())
    for q, cs in want.items():
        assert len(got[q]) == sum(map(len, cs)) and (len(cs) > 1 or [x[0] for x in sorted(got[q])] == list(range(1, 11)))
    assert sorted(got[1000])[:3] == [(1, 7, 0.0), (2, 1001, 0.0), (3, 1002, 0.0)]


@pytest.mark.parametrize("vectors", [[], [(0, None)], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 0.0])]])
def test_few_vectors(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(df).collect())
    assert got == ([(0, 1, 1, 0.0), (0, 2, 2, 8**0.5)] if len(vectors) == 3 else [])


def test_recall_of_a_larger_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    c = duckdb.connect()
    c.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.1/embeddings.parquet'")
    want = {(q, v) for q, _, v, _ in c.execute(neighbours.OP11_SQL).fetchall()}
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(df).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.95 * len(want)


# what was quadratic


@pytest.mark.parametrize("unit", ["<a href ", "<title>", "<div class=ad>x", "<div>x", "<article>x", "<form>x", "<b>x</i>", "<p><div></p>x"])
def test_markup_that_never_ends_is_linear(unit):
    took = []
    for size in (50_000, 200_000):
        page, began = unit * (size // len(unit)), time.process_time()
        html_extract.main_text(page)
        ((fields, block),) = warc.read_records(warc.response_record(1, "http://a", page))
        warc.derive(fields, block)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5 and took[1] < 5


def test_links_are_those_of_elements():
    page = "<!-- <a href='no'> --><script>var x = \"<a href='no'>\"</script><title>A &amp; b</title><a class=x href='p?a=1&amp;b=2'>t</a><img src=i.png><link rel=x href=c.css><title>second</title><a>none</a>"
    ((fields, block),) = warc.read_records(warc.response_record(1, "http://h/d/", page))
    about = json.loads(warc.derive(fields, block)[0][1])
    assert about["title"] == "A & b"
    assert [(x["tag"], x["url"]) for x in about["links"]] == [("a", "http://h/d/p?a=1&b=2"), ("img", "http://h/d/i.png"), ("link", "http://h/d/c.css")]


@pytest.mark.parametrize("encoding", ["gzip", "deflate", "raw", "identity", "br"])
def test_payloads_are_unpacked(encoding):
    body = b"<title>T</title><p>Hello</p>"
    deflate = zlib.compressobj(wbits=-15)
    packed = {"gzip": gzip.compress(body), "deflate": zlib.compress(body), "raw": deflate.compress(body) + deflate.flush(), "identity": body, "br": b"\x0b\x02"}[encoding]
    chunks = b"".join(hex(len(packed[k : k + 7]))[2:].encode() + b";n=1\r\n" + packed[k : k + 7] + b"\r\n" for k in range(0, len(packed), 7)) + b"0\r\n\r\n"
    name = b"deflate" if encoding == "raw" else encoding.encode()
    for head, payload in ((b"", packed), (b"Transfer-Encoding: chunked\r\n", chunks)):
        meta, text = warc.derive([("WARC-Type", "response")], b"HTTP/1.1 200 OK\r\nContent-Encoding: " + name + b"\r\n" + head + b"\r\n" + payload)
        assert text[1] == (b"" if encoding == "br" else b"T\nHello")
        assert json.loads(meta[1]).get("encoding_unknown") == ("br" if encoding == "br" else None)


def test_members_of_a_hot_passage_that_cannot_link_make_no_pairs(spark, monkeypatch):
    g, made = random.Random(8), []
    hot = " ".join(f"h{i}" for i in range(39))
    docs = [(i, hot + " " + " ".join(f"o{i}x{k}" for k in range(11))) for i in range(400)] + [(900 + k, hot + f" a b c {k}") for k in range(3)]
    monkeypatch.setattr(ngram_join, "_near", lambda pairs, nodes, percent, f=ngram_join._near: (made.append(pairs.count()), f(pairs, nodes, percent))[1])
    out = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    words = {i: t.split() for i, t in docs}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert all(out[a] == out[b] for a, b in linked) and len(set(out.values())) == 401 and sum(made) < 8000, made


def test_sharding_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a", "b", "c", "d")], "doc_id long, __slot string, row string, slot string, `x.y` string")
    out = sharding.assign(df, "doc_id", sharding.shard_names(3), 17)
    assert out.columns == ["doc_id", "__slot", "row", "x.y", "slot", "shard"] and tuple(out.first())[:4] == (1, "a", "b", "d")
    assert sharding.assign(df.select("slot"), "slot", ["one"], 17).columns == ["slot", "shard"]
