"""Each operator on small tables with nulls, empty and long texts, repeats and clashing extra columns, and against brute force."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest

from parley.llm import bpe, buckets, exact_dedup, graph, html_text, jaccard_join, language, mixing, near_vectors, passages, quality, queries, secrets, wordhash

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
random.seed(5)
WORDS = ["w%d" % i for i in range(3000)]
TALE = " ".join(random.choice(WORDS) for _ in range(120))


def some_words(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def edited(text, n):
    w = text.split()
    for i in random.sample(range(len(w)), n):
        w[i] = "x%d" % random.randrange(10**6)
    return " ".join(w)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (6, "One"), (7, TALE), (8, TALE), (9, edited(TALE, 2)), (10, some_words(20000)), (11, "日本語 テキスト"), (12, None)]


@pytest.fixture(scope="module")
def odd(spark):
    """With extra columns that have the names of columns made inside."""
    return spark.createDataFrame([(i, t, "en", None if i % 3 == 0 else "s", "k", 1.0, 2) for i, t in ODD], "doc_id bigint, text string, lang string, source string, key string, score double, n int")


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


def components_of(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("share", [graph.SHARE, 0, 60])
def test_components(spark, monkeypatch, share):
    monkeypatch.setattr(graph, "SHARE", share)
    n = 400
    links = [(i, i + 1) for i in range(0, 90)] + [(random.randrange(100, n), random.randrange(100, n)) for _ in range(150)] + [(99, 99), (5, None)]
    want = components_of(range(n), [x for x in links if None not in x])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got.get(i, i) == want[i] for i in range(n))
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).isEmpty()


def test_word_hashes():
    a, at = wordhash.texts_words(["b A", None, "zz a  B"])
    assert at.tolist() == [0, 2, 2, 5] and a[0] == a[4] and a[1] == a[3] and a[0] != a[1]


# 1


@pytest.mark.parametrize("block", [512, 4])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 24))
    rows, k = [], 0
    for i, b in enumerate(base):
        for e in (0, 0, 0.02, 0.08, 0.2):
            rows.append((k, (b + e * rng.normal(size=24)).tolist(), i % 3))
            k += 1
    for _ in range(60):  # a large group of near copies
        rows.append((k, (base[0] + 0.03 * rng.normal(size=24)).tolist(), 0))
        k += 1
    rows += [(k, None, 1), (k + 1, [0.0] * 24, 1), (k + 2, [None] + [1.0] * 23, 1), (k + 3, [float("nan")] * 24, 1), (k + 4, rows[0][1], None), (k + 5, [], 1), (k + 6, rows[0][1], 2), (k + 7, [float("inf")] * 24, 1), (k + 8, [1e200] * 24, 1), (k + 9, [1e-200] * 24, 1)]
    got = {r.vec_id: r for r in near_vectors.near_vectors(spark.createDataFrame([(*r, 7) for r in rows], "vec_id bigint, embedding array<double>, label int, rep int")).collect()}
    fine = [(i, np.array(v) / np.linalg.norm(v), y) for i, v, y in rows[:k]] + [(k + 6, np.array(rows[0][1]) / np.linalg.norm(rows[0][1]), 2), (k + 8, np.full(24, 24**-0.5), 1), (k + 9, np.full(24, 24**-0.5), 1)]
    links = [(a, b) for a, x, p in fine for b, y, q in fine if a < b and p == q and x @ y >= 0.98]
    want = components_of([r[0] for r in rows], links)
    for i, *_ in rows:
        assert got[i].n_links == sum(i in p for p in links) and got[i].component_id == want[i] and got[i].kept == (want[i] == i)
    assert near_vectors.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).isEmpty()


def test_near_vectors_of_odd_ids(spark):
    """An id in two labels joins nothing; null ids come after others; labels of any type."""
    x, y = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(1, x, "a"), (2, x, "a"), (1, x, "b"), (3, y, "b"), (None, x, "b"), (None, y, "a"), (None, y, "a"), (None, None, "a")]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label string")).collect())
    assert got == sorted([("1", 1, "1", True), ("2", 1, "1", False), ("1", 1, "1", True), ("3", 0, "3", True), ("None", 1, "1", False), ("None", 1, "None", True), ("None", 1, "None", True), ("None", 0, "None", True)])


def test_near_vectors_recall():
    """Buckets that pairs at the least cosine meet in, for several lengths."""
    rng = np.random.default_rng(4)
    for dim in (24, 64, 300):
        x = rng.normal(size=(2000, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(axis=1, keepdims=True) * x
        y = 0.98 * x + np.sqrt(1 - 0.98**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
        (ka, pa), (kb, pb) = near_vectors.bucket_keys(x, 5), near_vectors.bucket_keys(y, 5)
        met = (ka == kb) | (ka[:, :, None] == pb).any(axis=2) | (kb[:, :, None] == pa).any(axis=2)
        assert met.any(axis=1).mean() >= 0.99, dim


# 2


def test_passages(spark, odd, nothing):
    shared = some_words(60)
    texts = [some_words(80) + " " + shared + " " + some_words(50), shared.upper() + " " + some_words(200), some_words(300), some_words(90) + "\n" + some_words(13), shared + "\n" + shared]
    own = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = passages.repeated_passages(own).collect()
    assert {r.doc_id for r in rows} == {100, 101, 104}
    assert {r.doc_id for r in rows if not r.kept} >= {101, 104} and all(r.n_words >= passages.PARAGRAPH for r in rows)
    assert {r.doc_id for r in passages.repeated_passages(odd).collect()} == {7, 8, 9}
    assert passages.repeated_passages(nothing).isEmpty()
    assert {r.doc_id for r in passages.repeated_passages(own.unionByName(own).unionByName(spark.createDataFrame([(None, texts[0])], own.schema))).collect()} == {100, 101, 104}
    clash = spark.createDataFrame([(100 + i, t, "x", i) for i, t in enumerate(texts)], "doc_id bigint, text string, spans string, id int")
    cut = {r.doc_id: r.text for r in passages.without_repeats(clash).collect()}
    assert cut == {r.doc_id: r.text for r in passages.without_repeats(own).collect()} and passages.without_repeats(clash).columns == clash.columns
    assert cut[102] == texts[2] and cut[103] == texts[3] and len(cut[101].split()) <= 228


def test_passage_links_against_brute_force(spark, monkeypatch):
    """All pairs of paragraphs of two documents, in small and in large buckets: a tale's copies have words changed all over, so
    many variants of one paragraph meet, some only by way of others."""
    monkeypatch.setattr(passages, "SMALL", 4)
    monkeypatch.setattr("parley.llm.buckets.BLOCK", 16)
    rng = random.Random(7)
    tales = [[f"t{rng.randrange(10**6)}" for _ in range(90)] for _ in range(3)]
    texts = []
    for i in range(150):
        w = list(tales[i % 3])
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join([f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(40))] + w))
    doc, _, key, _, anchor, run = passages.paragraphs(texts)
    sets = {k: set(run[a : a + passages.RUNS].tolist()) for k, a in zip(key.tolist(), anchor, strict=True)}
    where = {k: set() for k in sets}
    for k, d in zip(key.tolist(), doc.tolist(), strict=True):
        where[k].add(d)
    links = [(a, b) for a in sets for b in sets if a < b and len(where[a] | where[b]) > 1 and 100 * len(sets[a] & sets[b]) >= passages.PERCENT * len(sets[a] | sets[b])]
    want = components_of(sorted(sets), links)
    got = {r.key: r for r in passages.paragraph_components(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")).collect()}
    assert got.keys() == sets.keys() and len(links) > 100
    assert all(want[r.component] == want[k] and r.low == min(where[k]) and r.high == max(where[k]) for k, r in got.items())
    assert sum(got[a].component == got[b].component for a, b in links) >= 0.97 * len(links)


def test_passage_parts():
    """Two similar sets have a part in common, whatever their sizes; similar() is the exact Jaccard similarity."""
    rng, many = random.Random(1), 0
    padded = lambda s: sorted([*s, *[min(s)] * (passages.RUNS - len(s))])
    for _ in range(3000):
        a = set(rng.sample(range(2**32), rng.randint(1, passages.RUNS)))
        b = set(rng.sample(sorted(a), max(1, len(a) - rng.randrange(4)))) | {rng.randrange(2**32) for _ in range(rng.randrange(4))}
        if len(b) > passages.RUNS:
            continue
        x, y = np.array([padded(a)], np.uint32), np.array([padded(b)], np.uint32)
        assert passages.similar(x, y)[0] == (100 * len(a & b) >= passages.PERCENT * len(a | b))
        if passages.similar(x, y)[0]:
            row, part, _ = passages.parts_of(np.concatenate([x, y]))
            many += 1
            assert set(part[row == 0]) & set(part[row == 1])
    assert many > 1000


def test_passage_meetings_pass_on_links_only():
    """Of a group of near copies that are no links nothing is passed on; of one that links, one row less than it has members."""
    any_ = lambda a, b: np.ones(np.broadcast_shapes(a["comp"].shape, b["comp"].shape), bool)
    for changed, want in ((4, 0), (1, 299)):
        base = np.arange(passages.RUNS, dtype=np.uint32)
        s = np.stack([np.sort(np.concatenate([base[changed:], 1000 + changed * i + np.arange(changed, dtype=np.uint32)])) for i in range(300)]).astype(np.uint32)
        block = {"key": np.arange(300), "comp": np.arange(300), "far": np.ones(300, bool), "s": s}
        a, b = buckets.links(block, block, any_, passages.similar)
        assert len(a) == len(b) == want


def test_passages_keep_one_copy(spark):
    """Overlapping paragraphs of a passage link with each other; the smallest document keeps them all."""
    rng = random.Random(3)
    fresh = lambda n: [f"k{rng.randrange(10**9)}" for _ in range(n)]
    shared, texts = [fresh(80) for _ in range(30)], []
    for s in shared:
        texts += [" ".join(fresh(40) + s + fresh(40)) for _ in range(3)]
    # the second passage overlaps the first in document 91; it stays in 90
    a, b = fresh(80), fresh(60)
    texts += [" ".join(fresh(30) + a[40:] + b), " ".join(a + b + fresh(30)), " ".join(fresh(20) + a)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = passages.repeated_passages(docs).collect()
    assert {r.doc_id for r in rows if r.kept} >= set(range(0, 90, 3))
    assert not [r for r in rows if r.doc_id < 90 and r.doc_id % 3 == 0 and not r.kept]
    cut = {r.doc_id: r.text for r in passages.without_repeats(docs).collect()}
    assert all(cut[i] == texts[i] for i in range(0, 91, 3)) and sum(len(cut[i].split()) for i in range(90) if i % 3) < 60 * 120
    left = {tuple(w[i : i + 5]) for w in (t.split() for t in cut.values()) for i in range(len(w) - 4)}
    assert all(tuple(s[i : i + 5]) in left for s in [*shared, a] for i in range(len(s) - 4))


# 3 and 5


def test_language(spark, odd, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    got = language.identify(docs, model).toPandas()
    held = got[got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)]
    assert (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all() and got.rejected.mean() < 0.01
    told = {r.doc_id: r for r in language.identify(odd, model, prefix="p_").collect()}
    assert [told[i].p_lang_pred for i in (1, 2, 3, 12)] == ["und"] * 4 and told[11].p_rejected and told[4].p_lang_pred in model.languages and told[4].score == 1.0
    assert language.identify(nothing, language.fit(nothing)).isEmpty()
    assert {r.lang_pred for r in language.identify(odd, language.fit(nothing)).collect()} == {"und"}


def test_quality(spark, odd, nothing):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = quality.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").toPandas()
    assert ((got.score >= 0.7) == got.quality).mean() > 0.9 and got.score.between(0, 1).all()
    assert all(0 <= r.fine <= 1 for r in quality.score(odd, model, out="fine").collect())
    assert quality.score(nothing, quality.fit(nothing, labels)).isEmpty()


# 4


def test_targets(spark):
    sizes = spark.createDataFrame([("b", 10), ("a", 100), (None, 50), ("c", 0), ("b", 30)], "source string, size bigint")
    got = {r.source: r.target for r in mixing.source_targets(sizes, 1.5, 2.0).collect()}
    left, weight, cap, want = 285.0, {"a": 3, "b": 1, "c": 2, None: 3}, {"a": 200, "b": 80, "c": 0, None: 100}, {}
    while True:  # the excess is shared again by weight until none is above
        share = {s: left * w / sum(weight[t] for t in weight if t not in want) for s, w in weight.items() if s not in want}
        over = [s for s in share if share[s] >= cap[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = cap[s]
            left -= cap[s]
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix(spark, odd, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got, again = (mixing.mix(docs).toPandas().sort_values("doc_id").reset_index(drop=True) for _ in range(2))
    assert got.equals(again) and (got.taken <= 2 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    source = docs.select("doc_id", "source").toPandas().merge(got, on="doc_id")
    off = source.groupby("source").agg(t=("taken", "sum"), w=("target", "first"), m=("size", "max"))
    assert ((off.t - off.w).abs() <= off.m).all()
    texts = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect()}
    assert all(texts[i] == n for i, n in zip(got.doc_id, got["size"], strict=True))
    some = {r.doc_id: r for r in mixing.mix(odd.unionByName(odd)).collect()}
    assert some[1].size == some[2].size == 0 == some[1].taken and mixing.mix(nothing).isEmpty()


# 6


def brute_spans(text):
    kinds = [
        (re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6, "assign"),
        (re.compile("AKIA[A-Z0-9]+"), 0, 20, "access"),
        (re.compile("[0-9a-f]+"), 0, 24, "hex"),
    ]
    found = sorted((m.start(), k, m.end()) for k, (p, g, least, _) in enumerate(kinds) for m in p.finditer(text or "") if len(m[g]) >= least)
    return ",".join(f"{kinds[k][3]}:{a}:{b}" for a, k, b in found)


def test_secrets(spark, odd, nothing):
    texts = [
        None, "", "secret=token:abcdefgh", "é password = 'abcdef' x PASSWD:abc12 api-key=zzzzzzz apikey=zzzzzzz API_KEY: \"q1w2e3r4\"", "AKIA" + "A" * 16 + " AKIAB AKIAXAKIA" + "Z" * 16,
        "0123456789abcdef01234567", "f" * 5000 + "g" + "a" * 23, "token=" + "ab12" * 9 + "\ntoken=" + "0" * 24, "password=passwords=abcdefg", "secretsecret: abcdef", "x" * 100000 + " secret=0123456",
    ]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[4], 1), (None, texts[2], 1), (None, texts[7], 1)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string, kinds int")).collect()
    want = sorted((str(i), hashlib.sha256(brute_spans(t).encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    assert all(r.spans == brute_spans(texts[r.doc_id]) for r in got if r.doc_id is not None and r.doc_id != 3)
    more = secrets.scan(spark.createDataFrame([(1, "ghp_" + "aB3" * 12 + " -----BEGIN RSA PRIVATE KEY-----")], "doc_id bigint, text string")).first()
    assert [x.kind for x in more.found] == ["forge", "pem"] and more.n_hex == 0
    assert secrets.scan(odd).count() == len(ODD) and secrets.scan(nothing).isEmpty()


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") == secrets.ANY
    assert secrets.trigram_query("abcd|xyz") == {frozenset({"abc", "bcd"}), frozenset({"xyz"})}
    assert secrets.trigram_query("a?bcd.*efg") == {frozenset({"bcd", "efg"})}


# 7


def test_html(spark):
    page = '<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Menu</ul></nav><div class="ad">Buy</div><main><h1>A &amp; B</h1><p>One<br>two &nbsp;three<p>é &lt;b&gt;<script>x("</p>")</script></main><section id="comments"><p>first!</p></section><form>q</form><footer>f'
    plain = "<body><div>About us and how to reach the people here</div><p>Only %s words</p></body>"
    rows = [(1, "http://a.b/1", page), (2, "http://a.b/2", None), (3, None, ""), (4, "x", "<p>"), *[(10 + i, f"http://c.d/{i}", plain % f"n{i} n{i + 9}") for i in range(4)], (20, "http://e.f/", "no < markup & none")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame([(*r, "h", 3) for r in rows], "page_id bigint, url string, html string, host string, n int")).collect()}
    assert len(got) == len(rows) and got[1].text == "A & B\n\nOne two three\n\né <b>" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == got[4].text == "" and got[10].text == "n0 n9 words" and got[20].text == "no < markup & none"
    assert html_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).isEmpty()


def test_html_marks():
    text = lambda page: html_text.main_texts([html_text.blocks(page)])[0]
    assert text('<div class="content no-sidebar"><p>kept here</p></div>') == "kept here"
    assert text('<article><p class="overflow-hidden">a</p><section id="search-results"><p>b</p></section><p>x <math><mi>y</mi></math></p></article>') == "a\n\nb\n\nx y"
    assert text('<article><p>a</p><div class="cookieBanner">b</div><div id="site-footer">c</div><ul class="related-posts"><li>d</ul><div class=ad-slot>e</div><div hidden>f</div><div class="share">g</div><p style="display: none">h</p></article>') == "a"
    assert text("<article><p title='a > b'>one<p title=\"x>y\">two < three &amp; <i>four</i>five</article>") == "one\n\ntwo < three & fourfive"
    assert text("<article>a<!-- b --><![CDATA[c]]><?php d ?>e<script>f</article>") == "ae"
    assert text("<article><p>a</x></p></div>b<li>c<li>d</article>") == "a\n\nb\n\nc\n\nd"


def test_html_broken_pages_take_linear_time():
    for page in ('<a "' * 250_000, '<a "' * 250_000 + ">", "<div>" * 100_000 + "</x>" * 100_000, "<b>" * 100_000 + "<p></p>" * 100_000, "<![CDATA[" * 100_000, "<" * 10**6, "<!--" * 250_000, "<p class='" * 100_000, "</" * 500_000, "<li><b>" * 100_000):
        began = time.process_time()
        html_text.blocks(page)
        assert time.process_time() - began < 5, page[:20]


def test_html_extraction_against_brute_force(spark):
    """Hosts of pages made of known blocks: what several pages share outside articles goes, all else stays, in order."""
    rng, rows, want = random.Random(11), [], {}
    for h in range(6):
        shared = [" ".join(f"s{h}x{i}y{j}" for j in range(12)) for i in range(3)]
        common = " ".join(f"q{h}z{j}" for j in range(20))
        for p in range(12):
            own = [" ".join(f"o{h}p{p}b{b}w{j}" for j in range(rng.randint(1, 15))) for b in range(rng.randint(1, 4))]
            marked = rng.random() < 0.5
            body = own + [common] * (marked and p % 2)
            inner = "".join(f"<p>{x}</p>" for x in body)
            html = f"<body><nav>m{h}</nav><div>{shared[0]}</div>" + (f"<article>{inner}</article>" if marked else f"<div>{inner}</div>") + "".join(f"<div>{x}</div>" for x in shared[1:]) + f"<footer>f{p}</footer></body>"
            rows.append((100 * h + p, f"https://h{h}.org/{p}", html))
            want[100 * h + p] = "\n\n".join(body)
    rows.append((rows[0][0], *rows[0][1:]))
    got = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(got) == len(rows) and all(r.text == want[r.page_id] for r in got)


def test_html_hot_host(spark):
    """A notice that a few pages of a section share goes, however many pages the host has."""
    notice = "<div>this notice stands on a few pages of one section only</div>"
    rows = [(i, f"http://hot.h/{i}", f"<body>{notice if i % 100 == 0 else ''}<p>own{i} text{i}</p></body>") for i in range(1000)]
    rows += [(2000 + i, f"http://small.h/{i}", f"<body>{notice}<p>own{i} text{i}</p></body>") for i in range(10)]
    rows += [(3000, "http://hot.h/x", f"<body><article>{notice}</article></body>"), (3001, "http://hot.h/y", None)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert len(got) == len(rows) and got[3000].startswith("this notice") and got[3001] == ""
    assert all(got[i] == f"own{i} text{i}" for i in range(1000)) and all(got[2000 + i] == f"own{i} text{i}" for i in range(10))


def test_repeated_runs():
    rng = np.random.default_rng(2)
    streams = [rng.integers(0, 4, 60) for _ in range(5)]
    got = html_text.repeated(streams, run=4, pages=3)
    runs = {}
    for p, s in enumerate(streams):
        for i in range(len(s) - 3):
            runs.setdefault(tuple(s[i : i + 4]), set()).add(p)
    for s, mask in zip(streams, got, strict=True):
        want = np.zeros(len(s), bool)
        for i in range(len(s) - 3):
            if len(runs[tuple(s[i : i + 4])]) >= 3:
                want[i : i + 4] = True
        assert (want == mask).all()


# 8


def test_bpe(spark, odd, nothing, monkeypatch):
    from tokenizers import Tokenizer

    library, automaton = Tokenizer.from_file(VOCABULARY), bpe.load(VOCABULARY)
    monkeypatch.setattr(bpe, "REMEMBER", 200)  # so that words are forgotten and met again
    monkeypatch.setattr(bpe, "WALKED", 7)
    encoder = bpe.Encoder(automaton)
    made = ["".join(random.choice(random.choice(["ab", "etaoin shr", "=-_*#", "0123456789", "éèñ漢😀", "\n\t  ", "'sdtre", " \x1c\x85\xa0\u200a\u200b\x00"])) for _ in range(random.randint(0, 50))) for _ in range(600)]
    made += ["<|endoftext|>hi<|endoftext|> <|endoftext|>", "a" * 3000, "ab" * 2000, "x" * 63 + " " + "y" * 64 + " " + "z" * 65]
    for first in range(0, len(made), 40):
        texts = made[first : first + 40]
        for text, got in zip(texts, encoder.encoded(texts), strict=True):
            assert [int(i) for i in got.split(",") if i] == library.encode(text, add_special_tokens=False).ids, text
            assert encoder.decoded(got) == text == automaton.decode([int(i) for i in got.split(",") if i])
    tokens = sorted(automaton.born)
    u, v = (np.array(random.choices(tokens, k=3000)) for _ in range(2))
    assert automaton.arcs(u, v).tolist() == automaton.arcs(u, v).tolist() == [automaton.arc(a, b, automaton.always) for a, b in zip(u.tolist(), v.tolist(), strict=True)]
    rows = {r.doc_id: r for r in bpe.encode(odd, VOCABULARY, ids=True).collect()}
    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert rows[i].ids == ids and rows[i].n_tokens == len(ids) and rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(nothing, VOCABULARY).isEmpty()
    again = bpe.encode(spark.createDataFrame([(None, "one"), (4, "one"), (4, "one")], "doc_id bigint, text string"), VOCABULARY).collect()
    assert sorted(str(r.doc_id) for r in again) == ["4", "4", "None"] and len({r.ids_sha256 for r in again}) == 1


# 9


def test_exact(spark, odd, nothing):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(odd).collect()}
    assert {i: got[i].keep_id for i, _ in ODD} == {1: 12, 2: 12, 3: 3, 4: 5, 5: 5, 6: 6, 7: 8, 8: 8, 9: 9, 10: 10, 11: 11, 12: 12}
    assert got[1].group_size == 3 and got[5].kept and not got[4].kept and got[1].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert exact_dedup.exact_dedup(odd, keep="min").where("kept").count() == 8 and exact_dedup.exact_dedup(nothing).isEmpty()
    assert sorted(r.doc_id for r in exact_dedup.without_copies(odd.unionByName(odd)).collect()) == [3, 5, 6, 8, 9, 10, 11, 12]
    many = spark.createDataFrame([(i, "same" if i % 3 else "t%d" % i) for i in range(3000)], "doc_id bigint, text string")
    told = exact_dedup.exact_dedup(many).toPandas()
    assert len(told) == 3000 and set(told[told.group_size > 1].keep_id) == {2999} and told.group_size.max() == 2000


# 10


def brute_links(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, components_of(sets, links)


@pytest.mark.parametrize(("width", "percent", "small", "heavy", "sent"), [(3, 90, 64, 64, 10**6), (5, 80, 3, 8, 10**6), (3, 90, 3, 2, 0)])
def test_jaccard(spark, odd, nothing, monkeypatch, width, percent, small, heavy, sent):
    for name, value in (("SMALL", small), ("BLOCK", 16), ("HEAVY", heavy), ("SENT", sent), ("PASSED", 8)):
        monkeypatch.setattr(jaccard_join, name, value)
    base, quoted = some_words(150), some_words(60)
    rows = [(100 + i, edited(base, random.randint(0, 9))) for i in range(60)] + [(200 + i, some_words(random.randint(1, 12))) for i in range(20)] + [r for r in ODD if r[0] != 10]
    rows += [(300, base.upper()), (301, base)] + [(400 + i, some_words(random.randint(5, 60)) + " " + quoted) for i in range(40)]
    got = jaccard_join.jaccard_components(spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, token int"), width=width, percent=percent).toPandas().set_index("doc_id")
    n, want = brute_links(rows, width, percent)
    assert got.n_shingles.to_dict() == n and got.component_id.to_dict() == want
    assert jaccard_join.jaccard_components(nothing).isEmpty()


def test_near_duplicates_of_odd_rows(spark, nothing):
    """Null ids, repeated ids and columns with the names of columns made inside; one row of each group stays."""
    base, other = some_words(150), some_words(150)
    rows = [(None, base), (7, edited(base, 1)), (None, edited(other, 1)), (None, other), (None, edited(other, 1)), (8, TALE), (8, edited(TALE, 1)), (9, None), (9, None), (None, ""), (2**60 + 1, some_words(40))]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id bigint, text string, gone_id string, row int, at int")
    told = jaccard_join.jaccard_components(docs).collect()
    assert sorted((r.component_id for r in told), key=str) == sorted([7, 7, None, None, None, 8, 8, 9, 9, None, 2**60 + 1], key=str)
    stay = jaccard_join.without_near_duplicates(docs)
    assert stay.columns == docs.columns
    left = sorted((str(r.doc_id), r.text or "") for r in stay.collect())
    assert len(left) == 7 and [i for i, _ in left].count("8") == 1 and [i for i, _ in left].count("9") == 2 and [i for i, _ in left].count("None") == 2 and ("7", rows[1][1]) in left
    assert jaccard_join.without_near_duplicates(nothing).isEmpty()


def test_workers_drop_what_others_kept(monkeypatch):
    """A worker that encoded before doesn't hold the encoder while it looks for near duplicates."""
    monkeypatch.setattr(bpe.SparkFiles, "get", lambda name: VOCABULARY)
    first = bpe._encoder("byte_bpe_50k.json")
    assert bpe._encoder("byte_bpe_50k.json") is first
    assert not list(jaccard_join._plausible(80)(iter([])))
    assert bpe._encoder("byte_bpe_50k.json") is not first


# SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE[name]).df()
    told = lambda f: sorted(tuple(str(v) for v in r) for r in f[sorted(f.columns)].itertuples(index=False))
    assert sorted(ours.columns) == sorted(theirs.columns) and told(ours) == told(theirs)


# the pipeline

CLASH = "told_rejected boolean, told__score string, sha string, size string, n string, id string, at string, row string, key string, mix_id int, kept_id int, spans int, identified int, gone_id int, gone_row int"


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with nulls, ties, repeated rows, a long text, and columns that have the names of columns made inside."""
    base = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else "s", len(t or "")) for i, t in ODD] + [(None, "one", "en", "s", 3), (None, edited(TALE, 1), "en", None, 1), (7, TALE, "en", "s", 1), (7, "another text of this id", "en", "s", 1)]
    extra = (True, "x", "sha", "size", "n", "id", "at", "row", "key", 1, 2, 3, 4, 5, 6)
    return spark.createDataFrame([(*r, *extra) for r in base], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASH}")


@pytest.mark.parametrize("name", ["language_id", "exact_dedup", "near_dedup", "source_mixing", "bpe_encoding"])
def test_stages_on_odd_rows(spark, clashing, name):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    made, none = stage(spark, clashing, SF), stage(spark, clashing.limit(0), SF)
    rows = [(r.doc_id, r.text) for r in clashing.select("doc_id", "text").collect()]
    if name == "bpe_encoding":
        assert made.count() == len(rows) and none.isEmpty()
        return
    assert made.columns == none.columns == clashing.columns and none.isEmpty()
    got = made.collect()
    left = sorted((str(r.doc_id), r.text or "") for r in got)
    assert {(r.told_rejected, r.sha, r.size, r.row, r.mix_id, r.gone_row) for r in got} == {(True, "sha", "size", "row", 1, 6)}
    if name == "language_id":
        assert set(left) <= {(str(i), t) for i, t in rows if t and any(c.isalpha() for c in t)}
    if name == "exact_dedup":
        want = {}
        for i, t in rows:
            want[t or ""] = max(want.get(t or "", -1), -1 if i is None else i)
        assert left == sorted(("None" if i < 0 else str(i), t) for t, i in want.items())
    if name == "near_dedup":
        assert len({t for _, t in left if t.strip()}) == sum(1 for _, t in left if t.strip() and t != TALE) + 1
        assert sum(t in (TALE, ODD[8][1], rows[-3][1]) or t == rows[len(ODD) + 1][1] for _, t in left) <= 2 and ("4", "one") in left and ("5", "one") not in left
    if name == "source_mixing":
        times = {r: left.count(r) for r in left}
        copies = {}
        for r in mixing.mix(clashing).collect():
            copies[str(r.doc_id), r["size"]] = max(r.copies, copies.get((str(r.doc_id), r["size"]), 0))
        of = {(str(i), t or ""): sum((i, t or "") == (j, u or "") for j, u in rows) for i, t in rows}
        assert all(n == of[r] * copies[r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))] for r, n in times.items())


def test_taken_odds(spark):
    """Over many seeds each document is taken as often as its source's rate, and each source's words stay near its target."""
    sizes = [3, 50, 7, 7, 120, 1, 15, 30, 80, 4, 9, 60] * 2
    docs = spark.createDataFrame([(i, some_words(n), "ab"[i % 2]) for i, n in enumerate(sizes)], "doc_id bigint, text string, source string").cache()
    runs = 30
    total = dict.fromkeys(range(len(sizes)), 0)
    for seed in range(runs):
        rows = mixing.mix(docs, seed=seed).collect()
        for s in {r.target for r in rows}:
            some = [r for r in rows if r.target == s]
            assert abs(sum(r.taken for r in some) - s) <= max(r["size"] for r in some)
        for r in rows:
            total[r.doc_id] += r.copies
            rate = r.target / r.source_size
            assert r.copies in (int(rate), int(rate) + 1)
    rates = {r.doc_id: r.target / r.source_size for r in rows}
    off = [total[i] / runs - rates[i] for i in total if sizes[i] > 4]
    assert abs(np.mean(off)) < 0.1 and max(map(abs, off)) < 0.45


def test_language_against_brute_force(spark):
    """Dense vectors and one cosine after the other."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    rows = [r.text for r in docs.select("text").limit(60).collect()] + ["", None, "ß 漢字 é", "a"]
    base, mask = int(wordhash.BASE), 2**64 - 1
    for text, (lang, score, _) in zip(rows, model.nearest(rows), strict=True):
        clean = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
        clean = re.sub(" +", " ", clean)
        if clean == " ":
            assert (lang, score) == ("und", 0.0)
            continue
        v = np.zeros(len(model.idf))
        for n in language.LENGTHS:
            for i in range(len(clean) - n + 1):
                h = 0
                for c in clean[i : i + n]:
                    h = (h + ord(c) + 1) * base & mask
                v[((h ^ h >> 29) * base & mask) >> 64 - language.DIM_BITS | 0 if n == 1 else (((h ^ h >> 29) * base & mask) >> 64 - language.DIM_BITS) + (n - 1) * (1 << language.DIM_BITS)] += 1
        v = np.log1p(v) * model.idf
        cos = [float(v @ c / np.linalg.norm(v) / np.linalg.norm(c)) for c in model.centroids.T]
        assert abs(max(cos) - score) < 1e-3 and model.languages[model.owner[int(np.argmax(cos))]] == lang


def test_quality_against_brute_force(spark):
    """One feature after the other, and the mean of their weights."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = [r.text for r in docs.select("text").limit(20).collect()] + ["", None, " \n", "a a b"]
    base, mask = int(wordhash.BASE), 2**64 - 1
    bucket = lambda h: ((h ^ h >> 29) * base & mask) >> 64 - quality.BUCKET_BITS
    mixed = lambda x: int(wordhash.mix64(np.array([x], np.uint64))[0])
    for text, score in zip(rows, model.scores(rows), strict=True):
        raw = re.sub(rb"[\x09-\x0d]", b" ", (text or "").encode())
        words = raw.split()
        total = [model.weight[bucket(int(wordhash.range_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]))] for w in words]
        total += [model.weight[bucket(mixed(int(quality.SAME if a == b else quality.OTHER)))] for a, b in zip(words, words[1:], strict=False)]
        padded = b" " + raw + b" "
        for n in quality.LENGTHS if words else ():
            for i in range(len(padded) - n + 1):
                h = 0
                for c in padded[i : i + n]:
                    h = (h + c + 1) * base & mask
                total.append(model.weight[bucket(h + n & mask)])
        z = (sum(total) / len(total) if total else 0.0) + model.bias
        assert abs(1 / (1 + np.exp(-z)) - score) < 1e-9


def test_many_trigrams(spark):
    """More rules than one number has bits for."""
    words = ["".join(random.choice("bcdfgkmnp") for _ in range(9)) for _ in range(40)]
    rules = tuple(secrets.Rule(f"k{i}", f"{w}[0-9]+", 0, 10) for i, w in enumerate(words))
    docs = spark.createDataFrame([(i, f"x {w}{i} {w.upper()}7 {words[i - 1]}") for i, w in enumerate(words)], "doc_id bigint, text string")
    got = {r.doc_id: [f.kind for f in r.found] for r in secrets.scan(docs, more=rules).collect()}
    assert got == {i: [f"k{i}"] for i in range(40)}




def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF)
        assert kept.columns == columns, name
        if name == "exact_dedup":
            assert kept.select("text").distinct().count() == kept.count() == before.select("text").distinct().count()
    assert corpus_pipeline.run(spark, SF).count() > 0
