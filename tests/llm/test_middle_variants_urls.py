"""Fill-in-middle, spelling variants and URL filters against brute force."""

import hashlib
import re
import time
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import fim, queries, urls, variants

TEXTS = [None, "", "a", "ab", "héllo wörld 12\n\nnext line\n", "a<P>b", "<S", "x<" * 9, "<P", "😀 emoji 日本語\x00 nul", "word " * 9, "a\r\nb"] + [f"text {i} of some words, <{i}> more\n" * (i % 5) for i in range(300)]


def h(i):
    x = hashlib.sha256(f"1:{i}".encode()).hexdigest()
    return [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]


@pytest.mark.parametrize("unit", fim.UNITS)
def test_fim_cuts_and_restores(spark, unit):
    docs = spark.createDataFrame([(i, t, "own", i) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], "own", 0), (None, "null id", None, None)], "doc_id long, text string, fim string, n int")
    made = fim.transform(docs, unit=unit)
    rows = made.select("*", fim.restored(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
    assert len(rows) == len(TEXTS) + 2 and made.columns == ["doc_id", "text", "fim", "n"]
    forms = Counter()
    for r in rows:
        text, f = r["text"] or "", r["fim"]
        assert r["back"] == text
        ends = {"codepoint": list(range(len(text) + 1)), "line": [0, *(m.end() for m in re.finditer("[^\n]*\n|[^\n]+", text))]}.get(unit)
        assert ends is None or f["n"] == len(ends) - 1
        a, b, c, d = h("" if r["doc_id"] is None else r["doc_id"])
        forms[f["form"]] += 1
        if not text or any(m in text for m in fim.MARKS) or c % 100 >= 90:
            assert f["form"] == "plain" and f["output"] == text and f["prefix_chars"] is None and f["middle_chars"] is None
            continue
        assert f["form"] == ("spm" if d % 100 < 20 else "psm")
        x, y = f["prefix_chars"], f["prefix_chars"] + f["middle_chars"]
        if ends:
            x, y = (ends[k] for k in sorted((a % len(ends), b % len(ends))))
            assert (x, y - x) == (f["prefix_chars"], f["middle_chars"])
        prefix, middle, suffix = text[:x], text[x:y], text[y:]
        assert f["output"] == (f"<S>{suffix}<P>{prefix}<M>{middle}" if f["form"] == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}")
    assert min(forms["psm"], forms["spm"], forms["plain"]) > 5


def test_fim_of_words_cuts_between_them():
    codes = np.array([ord(c) for c in "two words, 12ab"], "<u4")
    assert fim.boundaries(codes, "word").tolist() == [0, 3, 4, 9, 10, 11, 13, 15]
    assert fim.boundaries(codes[:0], "word").tolist() == [0]


def test_fim_of_nothing_long_texts_and_bad_marks(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = "é" * 1_000_000 + " z" * 1_000_000
    began = time.time()
    docs = spark.createDataFrame([(1, long), (2, "<" * 1_000_000)], "doc_id long, text string")
    got = fim.transform(docs, unit="word", plain=0).select("fim.*", fim.restored(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
    assert [r["back"] for r in got] == [long, "<" * 1_000_000] and time.time() - began < 30
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>")):
        with pytest.raises(ValueError, match="marks"):
            fim.transform(docs, marks=marks)
    with pytest.raises(ValueError, match="unit"):
        fim.transform(docs, unit="page")


def near_words(found):
    """Words one edit apart, by all their edits."""
    letters = sorted({c for w in found for c in w})
    out = {}
    for w in found:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        out[w] = (edits & set(found)) - {w}
    return out


def expected(found, ratio=5):
    close, form = near_words(found), {}
    for w in found:
        best = min(close[w], key=lambda u: (-found[u], u), default=None)
        form[w] = best if best is not None and found[best] >= ratio * found[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (n, len(close[w]), form[w], found[form[w]] if form[w] else None, root(w)) for w, n in found.items()}


@pytest.mark.parametrize("seed,hot", [(1, 10_000), (2, 3), (3, 1)])
def test_variants_by_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(variants, "HOT", hot)
    draw = np.random.default_rng(seed)
    # Few letters, so that runs of one letter, ties and chains are common.
    found = {"".join(draw.choice(list("aabé"), draw.integers(1, 9))): int(5 ** draw.integers(0, 6) + draw.integers(0, 2)) for _ in range(600)}
    found |= {"aaaaaaaa": 7, "aaaaaaa": 40, "aaaaaa": 300, "aaaaabaa": 7}
    got = variants.group(spark.createDataFrame(list(found.items()), "word string, n long")).collect()
    want = expected(found)
    assert {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got} == want and len(got) == len(want)
    assert sum(x[4] != x[2] is not None for x in want.values()) > 10


def test_light_steps_are_few(spark):
    draw = np.random.default_rng(5)
    found = {"".join(draw.choice(list("abcdefgh"), draw.integers(6, 12))) for _ in range(3000)} | {"a" * k for k in range(6, 300)}
    got = variants.light_steps(spark.createDataFrame([(w,) for w in found], "word string")).collect()
    assert max(len(r["lights"]) for r in got) <= np.log2(len(found))


def test_words_of_texts(spark):
    texts = {i: f"Étranger étranger ÉTRANGER garden-garden Gardens x÷y×zÀßÿ STRASSE naïveté {'longer ' * (i % 3)}ßßßßßß 'tis_under_score" for i in range(250)}
    rows = [(i, t, 3, "w") for i, t in texts.items()] + [(900, None, 1, "w"), (901, "", 1, "w"), (None, "nullid " * 6, 1, "w"), (5, texts[5], 1, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, word string")
    for drop in (None, 7, 199):
        want = Counter()
        for i, t, *_ in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
                x = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                want[run[: x % len(run)] + run[x % len(run) + 1 :] if drop and x % drop == 0 else run] += 1
        want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
        assert {r["word"]: r["n"] for r in variants.words(docs, drop_of=drop).collect()} == want and len(want) > 8


def test_op12_of_planted_errors(spark, tmp_path):
    draw = np.random.default_rng(3)
    lexicon = ["".join(draw.choice(list("abcdefghijklmnopqrstuvwxyzéü"), draw.integers(6, 11))) for _ in range(60)]
    rows = [(i, " ".join(draw.choice(lexicon, 60))) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = Counter()
    for i, t in rows:
        for run in t.split():
            x = zlib.crc32(f"{i}:{run}".encode())
            found[run if x % 199 else run[: x % len(run)] + run[x % len(run) + 1 :]] += 1
    found = {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}
    got = queries.op12_spelling_variants(spark, str(tmp_path)).collect()
    want = expected(found)
    assert {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got} == want
    assert sum(w[2] is not None for w in want.values()) > 30


def test_variants_of_nothing_and_long_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert variants.variants(empty).count() == 0
    long = "ab" * 200_000
    docs = spark.createDataFrame([(i, w) for i in range(30) for w in (long, long[:-1], long + "c", long[:1000] + "x" + long[1001:])[: 4 if i < 5 else 1]], "doc_id long, text string")
    began = time.time()
    got = {r["word"]: r for r in variants.variants(docs).collect()}
    assert len(got) == 4 and all(r["root"] == long for r in got.values()) and got[long]["n_near"] == 3 and time.time() - began < 90
    with pytest.raises(ValueError, match="ratio"):
        variants.group(spark.createDataFrame([("a", 1)], "word string, n long"), ratio=1)


URLS = [None, "", "no host", "://", "http://", "https://a.net", "https://a.net/", "HTTP://X.NET/a", "http://EXAMPLE.net/en/1", "http://example.net/en", "http://b.example.net/en/", "http://badexample.net/en/", "http://q.example.com/de/x?y#z", "http://a.org/fr/", "http://a.org/FR/", "http://org/fr/1", "http://x.org?u=http://a.net/", "http://user@a.net:80/x", "x://ÄB.NET/ü#", "a://b://c.net/", "http://a.net\n/x", "http://.net/", "http://" + "a." * 50_000 + "net/" + "p/" * 50_000]


def by_hand(url):
    after = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m.group().lower(), re.match(r"[^/?#]*", after).group())
    path = re.match(r"[^?#]*", after[len(host) :]).group()
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    fits = [(len(a + p), a + p, v) for v, a, p in rules if (host == a or host.endswith("." + a)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_listed_rules(spark):
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(URLS)] + [(1, URLS[9], "own")], "page_id long, url string, judged string")
    rows = urls.judge(pages).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path, rule, verdict = by_hand(r["url"])
        assert (r["judged"]["host"], r["judged"]["path"], r["judged"]["rule"]) == (host, path, rule) and r["judged"]["verdict"] == (verdict or "allow")
    assert urls.judge(pages.limit(0)).count() == 0
    with pytest.raises(ValueError, match="verdict"):
        urls.judge(pages, listed=[("drop", "a", "/")])


def test_urls_and_texts_of_invalid_bytes(spark):
    d = spark.sql("SELECT id AS doc_id, cast(X'616263FF626364C3' AS string) AS text, cast(X'687474703A2F2F61FF2E6E65742F78' AS string) AS url, true AS block FROM range(30)")
    assert {(r["judged"]["host"], r["judged"]["rule"]) for r in urls.judge(d).collect()} == {("a\ufffd.net", "net/")}
    assert urls.mine(d).default == urls.BLOCK
    made = fim.transform(d, plain=0).select("fim.n", F.length(F.col("fim.output").cast("binary")).alias("bytes")).collect()
    assert {(r["n"], r["bytes"]) for r in made} == {(8, 17)}
    assert {r["word"]: r["n"] for r in variants.words(d, length=2).collect()} == {"abc": 30, "bcd": 30}


def labelled_urls():
    draw, rows = np.random.default_rng(11), []
    for i in range(600):
        host, lang, query = draw.choice(["shop", "news", "win", "blog"]), draw.choice(["en", "de"]), draw.choice(["", "?ref=x", "?aff=1"])
        bad = (host == "win" and query == "?aff=1") or (host == "shop" and lang == "de" and i % 10 < 8) or i % 25 == 0
        rows.append((f"http://{host}.site.info/{lang}/{i}{query}", bool(bad)))
    return [*rows, rows[0], (None, True), ("no host", True), (rows[1][0], None)]


def rules_by_hand(rows, support, confidence, lift):
    """All sets of tokens that are frequent enough with a label and foretell it, less those that a part of them betters."""
    baskets = [(frozenset(urls.tokens(u)), urls.BLOCK if b else urls.ALLOW) for u, b in rows if b is not None and urls.tokens(u)]
    n, share = len(baskets), Counter(v for _, v in baskets)
    most, all_, having = max(support, urls.EVIDENCE / len(baskets)) * n, Counter(), Counter()
    frequent = {t for t, k in Counter(t for b, _ in baskets for t in b).items() if k >= most}
    for basket, verdict in baskets:
        own = sorted(basket & frequent)
        for k in range(1, len(own) + 1):
            for part in combinations(own, k):
                all_[part] += 1
                having[part, verdict] += 1
    found = {(p, v): k / all_[p] for (p, v), k in having.items() if k >= most - 1e-9 and k / all_[p] >= confidence and k / all_[p] / (share[v] / n) >= lift}
    return {(p, v): c for (p, v), c in found.items() if not any((q, v) in found and found[q, v] >= c for k in range(1, len(p)) for q in combinations(p, k))}, share


def test_mined_rules_by_brute_force(spark):
    rows = labelled_urls()
    model = urls.mine(spark.createDataFrame([(u, b, "own") for u, b in rows], "url string, block boolean, tokens string"), support=0.02, confidence=0.6, lift=1.1)
    want, share = rules_by_hand(rows, 0.02, 0.6, 1.1)
    assert {(r.tokens, r.verdict): round(r.confidence, 9) for r in model.rules} == {k: round(c, 9) for k, c in want.items()} and len(want) > 5
    assert model.default == max(share, key=share.get) and any(r.verdict == urls.BLOCK and len(r.tokens) > 1 for r in model.rules)
    # The index finds what trying every rule finds.
    for u, _ in rows[:200]:
        own = set(urls.tokens(u))
        first = next((r for r in model.rules if own.issuperset(r.tokens)), None)
        assert model.fit(u) == first
    pages = spark.createDataFrame([(u,) for u, _ in rows], "url string")
    judged = {r["url"]: r["judged"] for r in urls.judge(pages, model, listed=[]).collect()}
    bad = [u for u, _ in rows if u and "win" in u and "aff" in u]
    assert bad and all(judged[u]["verdict"] == urls.BLOCK and judged[u]["confidence"] >= 0.6 for u in bad)
    assert all(judged[u]["verdict"] == (model.fit(u).verdict if model.fit(u) else model.default) for u in judged)


def wide_urls():
    draw, rows = np.random.default_rng(5), []
    for _ in range(90):
        own = [x for x in "abcdefghijkl" if draw.random() < 0.7]
        rows.append((f"http://h.info/?{'&'.join(own)}", bool({"c", "k"} <= set(own) or draw.random() < 0.2)))
    return rows


@pytest.mark.parametrize(("cells", "held"), [(1 << 20, 10_000), (300, 10_000), (1 << 20, 20)])
def test_urls_of_many_frequent_tokens(spark, monkeypatch, cells, held):
    rows = wide_urls()
    want, _ = rules_by_hand(rows, 0.15, 0.55, 1.1)
    assert max(len(urls.tokens(u)) for u, _ in rows) > 14 and len(want) > 40
    for name, value in (("CELLS", cells), ("RULES", held)):
        monkeypatch.setattr(urls, name, value)
    model = urls.mine(spark.createDataFrame(rows, "url string, block boolean").repartition(3), support=0.15, confidence=0.55, lift=1.1)
    assert bool(model.rest) == (held < 10_000) and len(model.rules) <= held
    if not model.rest:
        assert {(r.tokens, r.verdict): round(r.confidence, 9) for r in model.rules} == {k: round(c, 9) for k, c in want.items()}
    baskets = [(set(urls.tokens(u)), b) for u, b in rows]

    def first(own):
        fits = [(-c, -sum(set(p) <= t and b == (v == urls.BLOCK) for t, b in baskets) / len(rows), len(p), p, v) for (p, v), c in want.items() if set(p) <= own]
        return min(fits)[3:] if fits else None

    asked = [u for u, _ in rows] + [f"x://y/?{'&'.join(p)}" for p in combinations("abcdefghijkl", 2)] + [None, ""]
    for u, r in zip(asked, model.first(asked), strict=True):
        assert (r and (r.tokens, r.verdict)) == first(set(urls.tokens(u)))
    judged = {r["url"]: r["judged"] for r in urls.judge(spark.createDataFrame([(u,) for u in asked], "url string"), model, listed=[]).collect()}
    assert all(tuple(j["tokens"] or ()) == (model.fit(u).tokens if model.fit(u) else ()) for u, j in judged.items())


def test_over_a_thousand_frequent_tokens(spark):
    word = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    rows = [(f"http://h.info/?{'&'.join(word(i) + x for x in 'abcdef')}", i % 2 == 0) for i in range(200) for _ in range(10)]
    model = urls.mine(spark.createDataFrame(rows, "url string, block boolean"))
    assert {(r.tokens, r.verdict) for r in model.rules} == {((f"query {word(i)}{x}",), urls.ALLOW if i % 2 else urls.BLOCK) for i in range(200) for x in "abcdef"}
    assert all((r.verdict == urls.BLOCK) == b for (_, b), r in zip(rows, model.first([u for u, _ in rows]), strict=True))


def test_models_of_little(spark):
    schema = "url string, block boolean"
    assert urls.mine(spark.createDataFrame([], schema)).default == urls.ALLOW
    few = urls.mine(spark.createDataFrame([("http://a.b/c", True)] * 3 + [(None, True)], schema))
    assert few.rules == [] and few.default == urls.BLOCK
    assert urls.mine(spark.createDataFrame([(f"http://a.b/{'x&' * i}", i % 2 == 0) for i in range(40)], schema)).default == urls.ALLOW


def test_op13(spark, tmp_path):
    pages = [(i, f"http://{'win' if i % 4 == 0 else 'calm'}.site.info/x/{i}") for i in range(400)] + [(1000 + i, u) for i, u in enumerate(URLS)] + [(None, None)]
    spark.createDataFrame([(i, u, "<p>", "v") for i, u in pages], "page_id long, url string, html string, verdict string").write.parquet(f"{tmp_path}/pages.parquet")
    labels = [(i, 1, int(i % 4 == 0)) for i in range(0, 300)] + [(1, None, None), (None, 1, 1), (300, 0, None), (301, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op13_url_filters(spark, str(tmp_path)).collect()
    assert Counter(r["page_id"] for r in got) == Counter(i for i, _ in pages)
    for r in got:
        url = dict(pages)[r["page_id"]]
        host, path, rule, verdict = by_hand(url)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if "win" in host else "allow"))
