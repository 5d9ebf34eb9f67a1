"""Fill-in-the-middle, URL filter and divergence audit against plain versions, and on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_documents import empty, odd, odd_texts  # noqa: F401
from tidemark.llm import divergence, infill, urls
from tidemark.llm import queries as q
from tidemark.llm.labelled_urls import LABELLED, SCHEMA

# --- fill in the middle


def filled(key, text, seed=7, rate=100, spm=50):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_equals_the_plain_version(spark, odd):  # noqa: F811
    more = ["a\r\nb\r\n", "<P", "S>", "x<P>y\nz", "<M>", "$1\\2\n$3 {2}+\n", "<\nS>\n<S\n", "\n\n\n\n", "ü😀\n😀\n" * 50, "no end " * 200_000, "l\n" * 60_000, "<<S\n>P>\nM>"] * 6
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string")
    both = odd.unionByName(extra, allowMissingColumns=True).withColumn("form", F.lit(3)).withColumn("n", F.lit("x")).withColumn("__llm_a", F.lit(1))
    out = infill.transform(both)
    assert out.columns == [c for c in both.columns if c not in ("form", "n")] + ["n", "form", "prefix_chars", "middle_chars", "output"]
    rows = out.withColumn("back", infill.restore("output", "form")).collect()
    assert len(rows) == both.count()
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == filled(r.doc_id, r.text), r.doc_id
        assert r.back == (r.text or "")
    assert len({r.form for r in rows}) == 3
    assert infill.transform(empty(odd)).count() == 0


def test_infill_rates_seed_and_units(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("one two  three\nfour ").alias("text"))
    rows = infill.transform(docs, seed=3, rate=40, spm_rate=100).collect()
    assert all((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == filled(r.doc_id, r.text, 3, 40, 100) for r in rows)
    assert 100 < sum(r.form == "spm" for r in rows) < 220 and not any(r.form == "psm" for r in rows)
    words = infill.transform(docs, unit=r"\S++\s*+").withColumn("back", infill.restore("output", "form")).collect()
    assert all(r.n == 4 and r.back == r.text for r in words) and len({r.prefix_chars for r in words}) == 5


# --- URL filter

ODD_URLS = [
    None, "", "no scheme", "http:/x", "://", "http://", "http://HOST.Example.ORG", "http://a.org/", "http://a.org?x", "HTTP://A.ORG#/y/", "x://y://z.org/fr/",
    "https://user:pw@shop.com:80/de/1", "http://com/de/", "http://xcom/de/", "http://org", "http://example.org/es/", "http://example.org/en/1", "http://notexample.org/en/1", "http://a.b.example.org/en/199?x=/es/",
    "http://ÄÖ.com/fr/ß", "http://a.com/FR/", "http://a.com/\n/fr/", "http://a.net/" + "x" * 300_000, "http://" + "h" * 300_000 + ".com/fr/", "http://a.net/😀", "http://twin.net/1", "http://twin.net/1",
]
RULES = [urls.Rule("org", "/", "allow"), urls.Rule("example.org", "/es/", "block"), urls.Rule("example.org", "/en/1", "block"), urls.Rule("com", "/fr/", "allow"), urls.Rule("com", "/de/", "block")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def ruled(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.host + r.path), r.verdict == "block"), default=None)


def grams(value, side):
    """{bucket: share}, one n-gram at a time."""
    marked = re.sub("[0-9]", "0", f"\x01{value}\x02")
    found = Counter()
    for n in urls.ORDERS:
        for i in range(len(marked) - n + 1):
            h = 0x811C9DC5 + 2 * n + side
            for ch in marked[i : i + n]:
                h = (h ^ ord(ch)) * 16777619 % (1 << 32)
            h ^= h >> 15
            h = h * 0x2C1B3C6D % (1 << 32)
            h ^= h >> 12
            found[h % urls.BUCKETS] += 1
    return {b: n / sum(found.values()) for b, n in found.items()}


def plain_score(model, host, path):
    z = model.bias + sum(model.weights[b] * share for side, v in enumerate((host, path)) for b, share in grams(v, side).items())
    return 1 / (1 + np.exp(-z))


@pytest.fixture(scope="module")
def url_model(spark):
    return urls.fit(spark.createDataFrame(LABELLED, SCHEMA))


def test_urls_equal_the_plain_version(spark, sf_dir, url_model):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    given = [(i, u, "h", 1, "r") for i, u in enumerate(ODD_URLS)] + [(1000 + r.page_id, r.url, None, None, None) for r in pages.collect()]
    df = spark.createDataFrame(given, "page_id long, url string, host string, score int, __x string").repartition(3)
    out = urls.judge(df, url_model, RULES).collect()
    assert Counter(r.page_id for r in out) == Counter(g[0] for g in given)
    for r in out:
        host, path = parts(r.url)
        rule = ruled(host, path, RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.host + rule.path), r.url
        if len(host + path) < 1000:
            assert abs(r.score - plain_score(url_model, host, path)) < 1e-9
        assert r.verdict == (rule.verdict if rule else "block" if r.score >= 0.5 else "allow")
    assert {r.verdict for r in out if r.rule is None} == {"allow", "block"}
    assert urls.judge(df.limit(0), url_model, RULES).count() == 0
    assert [r.verdict for r in urls.judge(df.filter("url = 'http://a.org/'"), url_model, [urls.Rule("org", "/", "allow"), urls.Rule("org", "/", "block")]).collect()] == ["block"]


def test_url_model_is_the_optimum_and_knows_unseen_hosts(spark, url_model):
    x = [(grams(parts(u)[0], 0), grams(parts(u)[1], 1), y) for u, y in LABELLED]
    slope, bias, ones = defaultdict(float), 0.0, sum(y for *_, y in x)
    for host, path, y in x:
        z = url_model.bias + sum(url_model.weights[b] * s for g in (host, path) for b, s in g.items())
        back = (1 / (1 + np.exp(-z)) - y) * 0.5 / (ones if y else len(x) - ones)
        bias += back
        for g in (host, path):
            for b, s in g.items():
                slope[b] += back * s
    assert abs(bias) < 1e-4 and max(abs(g + 2e-5 * url_model.weights[b]) for b, g in slope.items()) < 1e-4
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    known = {parts(u)[0] for u, _ in LABELLED}
    bad = re.compile("adult-x|spam-farm|cheap-pills|ads-track|casino-win|free-bets")
    judged = [r for r in urls.judge(pages, url_model).collect() if r.host not in known]
    assert len(judged) > 150 and all((r.verdict == "block") == bool(bad.search(r.host)) for r in judged)


def test_few_labelled_urls(spark):
    none = spark.createDataFrame([], SCHEMA)
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    scores = lambda rows: [r.score for r in urls.judge(pages, urls.fit(rows)).collect()]
    assert scores(none) == [0.5, 0.5]
    one = spark.createDataFrame([("http://b.net/", 1), (None, 0), ("http://c.net/", None)], SCHEMA)
    assert all(s > 0.5 for s in scores(one)) and len(scores(one)) == 2


# --- divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audited(rows, least=30, top=50):
    docs = [(lang or "", source or "", Counter(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen, groups = Counter(), defaultdict(Counter)
        for g, source, found in docs:
            if g == lang:
                seen.update(found.keys())
                groups[source].update(found)
        kept = [t for t, n in seen.items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        whole = share(sum(groups.values(), Counter()))
        shares = {s: share(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(o, sum(abs(shares[s][t] - shares[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, shares[s][t] - whole[t]) for t in kept if groups[s][t] and shares[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def collected(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r.rank) for r in df.collect())


@pytest.mark.parametrize(("least", "block", "rows"), [(1, 2, 30), (3, 3, 10_000), (2, 128, 50), (1000, 2, 30)])
def test_audit_equals_the_plain_version(spark, least, block, rows):
    rng = random.Random(least)
    words = ["a", "B", "b", "éa", "Éa", "É", "x", "ﬀ", "😀", "中文", "İ", "zz"] + [f"{a}{b}" for a in "abcdefgh" for b in "ijklm"]
    given = [(rng.choice(("en", "de", None, "")), rng.choice(("s1", "s2", "s3", "S3", "é", None, "s9")), "".join(rng.choice(words) + rng.choice(" \n\t0-_@[`{\x7f\x00\xa0\x85") for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    given += [("fr", "only", "x y"), ("it", "none", None), ("it", "blank", " 1 2"), ("en", "empty", ""), given[0], given[0], ("en", "s1", "long " * 400_000 + "é" * 3_000_000)]
    df = spark.createDataFrame([(*g, 1, 2, "t") for g in given], "lang string, source string, text string, n int, idx int, term string").repartition(4)
    assert collected(divergence.audit(df, least_docs=least, top=7, block=block, slice_rows=rows)) == audited(given, least, 7)


def test_audit_of_documents_and_of_none(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    assert collected(q.op13_divergence(spark, sf_dir)) == audited(rows)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = " ".join(odd_texts()[-1].split()[:4000] + ["wörd" * 50, "x1y"]).encode()
    whole = divergence.term_counts(text)
    monkeypatch.setattr(divergence, "PIECE_BYTES", 7)
    assert divergence.term_counts(text) == whole and whole[("wörd" * 50).encode()] == 1


def test_strips_do_not_change_a_block():
    rng = np.random.default_rng(0)
    rows = [("en", 0, 1, 0, i, None, None, 10 + i, 40) for i in range(4)]
    rows += [("en", 0, 1, 0, int(i), f"t{t}", int(rng.integers(1, 99)), 10 + int(i), 40) for t in range(40) for i in rng.choice(4, 2, replace=False)]
    names = ("lang", "x", "y", "slice", "idx", "term", "p", "base", "v")
    table = pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
    assert divergence._compare(2, 3)(table).equals(divergence._compare(2)(table))
