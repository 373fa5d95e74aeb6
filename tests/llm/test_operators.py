"""Small fixtures with hand-made or brute-force results, and the defined odd cases of every operator."""

import collections
import hashlib
import html.parser
import itertools
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuespark.llm import decontaminate, embedding_dedup, html as html_op, jaccard, line_dedup, packing, quality, sharding, suffix_dedup, url_filter
from cuespark.llm.common import connected_components

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (None, "null id text"), (5, "long " * 30_000), (6, "same"), (7, "same"), (8, "é ü 漢字")]


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, 3), (3, 9), (7, 7), (2, None), (9, 5)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {k: 100 for k in range(100, 161)} | {5: 3, 3: 3, 9: 3}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 1 quality


def _labelled(n=600):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    good = lambda: " ".join(word() for _ in range(60)) + "."
    bad = [lambda: " ".join(word() + "###" for _ in range(50)), lambda: good().upper(), lambda: " | ".join(word() for _ in range(50)), lambda: "the " * 80]
    return [(k, good() if k % 4 else rng.choice(bad)(), int(k % 4 > 0)) for k in range(n)]


def test_rules_learn_and_hold_out(spark, docs):
    data = _labelled()
    labels = spark.createDataFrame([(i, q) for i, _, q in data], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.quality_scores(docs([(i, t) for i, t, _ in data]), labels).collect()}
    held = {i for i, _, _ in data if zlib.crc32(str(i).encode()) % 3 == 1}
    assert {i for i, r in got.items() if r["held_out"]} == held
    assert np.mean([got[i]["predicted"] == q for i, _, q in data if i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_quality_clashing_columns(spark, docs):
    data = _labelled(200)
    labels = spark.createDataFrame([(i, q) for i, _, q in data], "doc_id long, quality int")
    table = docs([(i, t) for i, t, _ in data]).withColumn("y", F.lit("y")).withColumn("__s", F.lit("s"))
    scored = quality.with_score(table, quality.fit_rules(table, labels))
    assert scored.columns == [*table.columns, "_score"] and scored.where("score = 1 and y = 'y' and __s = 's' and _score between 0 and 1").count() == 200


def test_compiled_rules_against_their_own_reading(spark, docs):
    """The column expression, held against the rules evaluated in Python over the statistics."""
    data = _labelled(200)
    labels = spark.createDataFrame([(i, q) for i, _, q in data], "doc_id long, quality int")
    table = docs([(i, t) for i, t, _ in data], extra=False)
    rules = quality.fit_rules(table, labels)
    stats = table.select("doc_id", *[c.alias(k) for k, c in quality.statistics(F.col("text")).items()])
    got = {r["doc_id"]: r["score"] for r in quality.with_score(table, rules).collect()}
    assert rules.terms
    for r in stats.collect():
        z = rules.intercept + sum(w for w, tests in rules.terms if all((r[n] > cut) == above for n, above, cut in tests))
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-z))) < 1e-9


def test_quality_odd_cases(spark, docs):
    labels = spark.createDataFrame([(1, None), (2, 1), (None, 0), (3, 1)], "doc_id long, quality int")
    got = quality.quality_scores(docs(ODD), labels)
    assert got.count() == len(ODD) and got.where("score is null").count() == 0
    assert quality.quality_scores(docs([]), labels).count() == 0


# --- 2 suffixes


def _brute_suffix(texts, length=200):
    count = collections.Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_suffixes_against_brute_force(docs, small, monkeypatch):
    if small:  # many batches and buckets
        monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 4000)
        monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 500)
    rng = random.Random(3)
    fresh = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base = [fresh(1500) for _ in range(4)]
    texts = ["", fresh(199), base[0], base[0], base[0][:700] + fresh(50) + base[0][700:], base[1][300:520] + fresh(30), base[1], fresh(3000)]
    texts += [base[2][a : a + n] + fresh(20) + base[3][b : b + 260] for a, n, b in [(0, 230, 5), (13, 201, 77), (500, 199, 900), (499, 202, 901)]]
    texts += [base[2], base[3], "ab" * 300, "é" * 150 + fresh(80), "é" * 150]
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(docs(list(enumerate(texts)))).collect()}
    for k, want in enumerate(_brute_suffix([t.encode() for t in texts])):
        assert got[k] == want, k


def test_suffix_odd_cases(docs):
    got = suffix_dedup.remove_repeats(docs(ODD), with_text=False)
    assert got.count() == len(ODD)
    assert got.where("doc_id in (1, 2) and n_bytes = 0 and n_removed = 0").count() == 2
    assert got.where("doc_id = 5").first()["n_removed"] == 150_000  # every string recurs in the same document
    assert suffix_dedup.remove_repeats(docs([])).count() == 0


# --- 3 urls


def test_url_rules_and_propagation(spark):
    link = lambda h: f'<a class=x href="https://{h}/a">t</a>'
    pages = [
        (1, "https://WWW.example.com/en/1?x#y", link("hub.org")),
        (2, "http://m.example.com/en/2", ""),
        (3, "http://a.net/es/1", link("friend.org")),
        (4, "http://near.org/x", link("a.net") * 3),
        (5, "http://hub.org", None),
        (6, None, ""),
        (7, "no scheme", ""),
        (8, "http://com/", ""),
        (9, "http://far.org/y", link("near.org")),
    ]
    got = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert (got[2]["rule"], got[2]["verdict"]) == ("example.com/en/", "block")
    assert (got[3]["rule"], got[3]["verdict"]) == ("net/es/", "block")
    assert got[4]["rule"] is None and got[4]["verdict"] == "block"  # links to a blocked host
    assert got[5]["verdict"] == "allow" and got[5]["trust"] > 0 and got[5]["path"] == ""
    assert all((got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == ("", "", None, "allow") for k in (6, 7))
    assert got[8]["rule"] == "com/"
    assert 0 < got[9]["distrust"] < got[4]["distrust"]
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_url_clashing_columns(spark):
    got = url_filter.filter_urls(spark.createDataFrame([(1, "http://a.com/x", "", "t", 5)], "page_id long, url string, html string, trust string, Host int"))
    assert got.columns == ["page_id", "url", "_trust", "_Host", "host", "path", "rule", "verdict", "trust", "distrust"]
    assert tuple(got.first())[2:6] == ("t", 5, "a.com", "/x")


def test_propagation_against_dense_iteration(spark):
    rng = np.random.default_rng(1)
    hosts = [f"h{k}" for k in range(12)]
    links = {(int(a), int(b)): int(n) for a, b, n in zip(*rng.integers(0, 12, (2, 40)), rng.integers(1, 5, 40), strict=True) if a != b}
    trust, distrust = rng.random(12), rng.random(12)
    w = np.zeros((12, 12))
    for (a, b), n in links.items():
        w[a, b] = n
    out, into = w / np.maximum(w.sum(1, keepdims=True), 1), (w / np.maximum(w.sum(0, keepdims=True), 1)).T
    t, d = trust * 0.15, distrust * 0.15
    for _ in range(150):
        t, d = trust * 0.15 + 0.85 * t @ out, distrust * 0.15 + 0.85 * d @ into
    seeds = spark.createDataFrame([(h, float(a), float(b)) for h, a, b in zip(hosts, trust, distrust, strict=True)], "host string, trust double, distrust double")
    edges = spark.createDataFrame([(hosts[a], hosts[b], n) for (a, b), n in links.items()], "src string, dst string, n long")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.propagate(seeds, edges, tolerance=1e-7).collect()}
    assert np.allclose([got[h] for h in hosts], np.stack([t, d], 1), atol=1e-6)


# --- 4 jaccard


def _brute_jaccard(texts, width, num):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    return [(len(s), find(parent, k)) for k, s in enumerate(sets)]


@pytest.mark.parametrize("width,num,rows_a_tile", [(4, 85, 4096), (5, 80, 4)])
def test_jaccard_against_brute_force(docs, width, num, rows_a_tile):
    rng = random.Random(width)
    word = lambda: f"w{rng.randint(0, 3000)}"
    passage = [word() for _ in range(25)]
    texts = []
    for n in (3, 4, 9, 10, 12, 30, 60, 120, 300):
        base = [word() for _ in range(n)]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 8):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w if rng.random() < 0.7 else w + passage))
    texts += ["", None, "A b C d e", "a B c D e", "a  b\tc\nd e"]
    rng.shuffle(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs(list(enumerate(texts))), width, num, rows_a_tile).collect()}
    assert got == dict(enumerate(_brute_jaccard(texts, width, num)))


def test_jaccard_odd_cases(docs):
    got = {r["doc_id"]: tuple(r)[1:] for r in jaccard.jaccard_components(docs(ODD)).collect()}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3) and got[7] == (1, 6) and got[None] == (1, None) and got[5][0] == 1
    assert jaccard.jaccard_components(docs([])).count() == 0


def test_jaccard_threshold_is_checked():
    for num in (66, 101, 0):
        with pytest.raises(ValueError, match="threshold"):
            jaccard.Threshold(num)
    assert jaccard.Threshold(67).num == 67


# --- 5 html


class _Article(html.parser.HTMLParser):
    """The text of <article>, block by block, as its own reading of simple pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.on, self.parts = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.on += tag == "article"
        self.parts.extend([""] if tag in ("p", "h1", "article") else [])

    def handle_endtag(self, tag):
        self.on -= tag == "article"
        self.parts.extend([""] if tag in ("p", "h1", "article") else [])

    def handle_data(self, data):
        if self.on:
            self.parts[-1] += data

    def text(self):
        return "\n".join(x for x in (" ".join(p.split()) for p in self.parts) if x)


def test_html_against_a_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html_op.extract_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        p = _Article()
        p.feed(r["html"].replace("<br>", " "))
        p.close()
        if r["html"].endswith("</html>"):
            assert r["text"] == p.text() and r["n_chars"] == len(r["text"])


def test_html_blocks():
    assert html_op.main_text(None) == "" and html_op.main_text("") == ""
    page = """<body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><main><article><h1>T&auml;st &amp; more</h1>
      <p>One<b> two</b>\n three&nbsp;four<p>Five<script>var x="<p>no</p>";</script></p><div class="share-buttons">Tweet</div>
      <section id="comments"><p>Great post!</p></section><form>Mail <input></form></article></main><aside>Side</aside><footer>(c)</footer>"""
    assert html_op.main_text(page) == "Täst & more\nOne two three four\nFive"
    plain = "<div><a href=1>a b</a> <a href=2>c d</a></div><p>" + "this is the text of a page that has no article and it is long enough to be read by all of us, " * 2 + "</p><p>short end</p>"
    assert html_op.main_text(plain).endswith("by all of us,\nshort end") and "a b" not in html_op.main_text(plain)
    assert html_op.main_text("<article><p>cut <b>off</arti") == "cut off"


def test_html_article_is_a_teaser_or_holds_link_lists():
    body = "this is the text of a page that has it in plain elements and it is long enough to be read by all of us"
    teaser = f"<article><h2>Read next</h2><p>A short card</p></article><div>{body}, first.</div><div>{body}, second.</div>"
    assert html_op.main_text(teaser).endswith(f"{body}, first.\n{body}, second.")
    listed = f"<article><h1>Title</h1><p>{body}.</p><p>{'<a href=x>Another story of this site</a> ' * 4}</p><p>{body}!</p></article><div>{body[:80]}</div>"
    assert html_op.main_text(listed) == f"Title\n{body}.\n{body}!"
    foreign = f"<article><h1>標題</h1><p>{'漢字' * 80}</p></article><div>{body}</div>"
    assert html_op.main_text(foreign) == "標題\n" + "漢字" * 80


def test_html_comments_after_a_short_article():
    body = "This is the text of a short article that was written for all of us who want to read it to the end, and it is not long at all, but it is there."
    comment = "I have read this and I think that it is not what they would have written if they had asked all of us about it at the time. "
    page = f"<article><h1>Head</h1><p>{body}</p></article><div><p>{comment * 2}</p><p>{comment * 3}</p></div>"
    assert html_op.main_text(page) == f"Head\n{body}"
    # two articles with less than what stands beside them are teasers
    cards = f"<article><p>{body}</p></article><article><p>{body}!</p></article><div><p>{comment.strip()}</p><p>{comment * 2} Ends.</p></div>"
    assert html_op.main_text(cards).endswith("Ends.")
    banner = f"<article><h1>Head</h1><div class='banner'>{body}</div><div class='ad banner'>{body}</div></article>"
    assert html_op.main_text(banner) == f"Head\n{body}"


def test_html_other_languages():
    vietnamese = "Thành phố vừa công bố kế hoạch mở rộng tuyến đường sắt đô thị qua ba quận phía đông, dự kiến khởi công trong quý tới sau khi hoàn tất giải phóng mặt bằng, theo lời chủ tịch."
    chinese = "市政府昨天宣布将延长东部三个区的城市轨道交通线路，预计下季度在完成土地征收后开工建设，" * 5
    for prose in (vietnamese, chinese):
        page = f"<div><a href=/>Menu</a> <a href=/x>Mục lục</a></div><h1>Tin</h1><p>{prose}</p><p>Ngắn.</p><p>{prose}</p><ul><li><a href=/y>{'Liên kết ' * 20}</a></li></ul>"
        assert html_op.main_text(page) == f"Tin\n{prose}\nNgắn.\n{prose}"


def test_html_attributes():
    """Names are not looked for in values, and a class counts as a whole."""
    for attribute in ('title="a hidden gem"', 'data-id="comments-count"', 'class="social-history"', 'alt="class=ad"', 'data-hidden=x'):
        assert html_op.main_text(f"<article><p>One</p><div {attribute}>Two</div></article>") == "One\nTwo", attribute
    for attribute in ("hidden", 'CLASS="x share-buttons"', "class=ad", "id='comments'", 'style="display: none"', 'aria-hidden="true"', "class=ad-slot-2"):
        assert html_op.main_text(f"<article><p>One</p><div {attribute}>Two</div></article>") == "One", attribute


def test_html_odd_tables(spark):
    kind = "page_id long, url string, html string"
    assert html_op.extract_text(spark.createDataFrame([], kind)).count() == 0
    long = "<article>" + "<p>word and word of the page</p>" * 20_000 + "</article>"
    got = html_op.extract_text(spark.createDataFrame([(1, "u", long), (2, "v", "<article>x</article>"), (2, "v", "<article>x</article>"), (None, None, None)], kind)).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (1, 20_000 * 26 - 1), (2, 1), (2, 1)]


def test_html_clashing_columns(spark):
    f = spark.createDataFrame([(1, "u", "<article>x</article>", "kept")], "page_id long, url string, html string, text string")
    assert [tuple(r) for r in html_op.extract_text(f).collect()] == [(1, "u", "kept", "x", 1)]


# --- 6 embeddings


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE_ROWS", 40)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 32))
    x = np.concatenate([base + rng.standard_normal((12, 32)) * s for s in (0, 0, 0.05, 0.1, 0.2, 0.25, 0.3)] + [rng.standard_normal((100, 32))]).astype(np.float32)
    label = np.arange(len(x)) % 12 % 3
    data = [(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, label, strict=True))]
    odd = [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] + [1.0] * 31, 1), (903, x[0].tolist(), None), (904, [1.0, 2.0], 0), (None, x[0].tolist(), 0), (905, [None] + [1.0] * 31, 0)]
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.embedding_components(spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    parent = list(range(len(x)))
    for a, b in zip(*np.nonzero(link), strict=True):
        p, q = find(parent, a), find(parent, b)
        parent[max(p, q)] = min(p, q)
    want = np.array([find(parent, k) for k in range(len(x))])
    assert sum(got[k][0] for k in range(len(x))) >= 0.97 * link.sum() and all(got[k][0] <= link[k].sum() for k in range(len(x)))
    assert np.mean([got[k][1] == want[k] for k in range(len(x))]) > 0.97
    assert all(got[k][2] == (got[k][1] == k) for k in range(len(x)))
    assert all(got[k] == (0, k, True) for k in (900, 901, 902, 903, 904, 905))


def test_planted_pairs_meet_at_six_bits(spark):
    """With as many vectors as take six bits a bucket, the pairs just over the threshold are found, and nothing else."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((12_000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    turn = rng.standard_normal((2_000, 64))
    turn -= (turn * base[:2_000]).sum(1, keepdims=True) * base[:2_000]
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    cosine = rng.uniform(0.931, 0.95, (2_000, 1))
    x = np.concatenate([base, cosine * base[:2_000] + np.sqrt(1 - cosine**2) * turn])
    assert embedding_dedup.plan_tables(len(x))[0] == 6
    table = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float64())), "label": np.zeros(len(x), np.int32)})
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_components(spark.createDataFrame(table)).collect()}
    found = sum(got[12_000 + k]["component_id"] == k and got[k]["n_links"] == 1 for k in range(2_000))
    assert found >= 1_980 and all(got[k]["n_links"] == 0 for k in range(2_000, 12_000))


# --- 7 sharding


def test_shards(docs):
    texts = ODD + [(k, f"text {k}") for k in range(100, 160)] + [(100, "text 100")] * 40
    out = sharding.external_shuffle(docs(texts), 8, bucket_bytes=600).collect()
    assert len(out) == len(texts) and {"shard", "_shard", "Slot", "_slot"} <= set(out[0].__fields__)
    by = collections.defaultdict(list)
    for r in out:
        by[r["_shard"]].append(r["_slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    digest = {r["doc_id"]: r for r in sharding.shard_digest(docs(ODD)).collect()}
    assert digest[1]["size"] == 1 and digest[1]["text_crc32"] == 0 and digest[8]["text_crc32"] == zlib.crc32(ODD[-1][1].encode())
    assert sharding.external_shuffle(docs([])).count() == 0
    named = docs([(1, "a"), (2, "b")]).selectExpr("*", "1 as mark", "2 as bucket", "3 as place", "4 as __n", "5 as base")
    out = sharding.external_shuffle(named)
    assert out.columns == [*named.columns, "_shard", "_slot"] and out.where("mark = 1 and bucket = 2 and place = 3 and __n = 4 and base = 5").count() == 2


# --- 8 decontamination


def test_leaks(spark, docs, sentences):
    bench = spark.createDataFrame([(k, s) for k, s in enumerate(sentences)] + [(8, None), (9, ""), (None, "x y z")], "item_id long, text string")
    a, b = sentences[:2]
    edited = b.replace("different", "new").replace("price", "cost")
    texts = [(10, f"Intro words. {a.upper()}! and then more"), (11, "before " + edited + " after it"), (12, "an innocent text about rivers and walls"), (13, " ".join(a.split()[:8]))] + ODD
    got = rows(decontaminate.leaks(docs(texts), bench), "doc_id", "item_id", "distance")
    assert got == [(10, 0, 0), (11, 1, 2)]
    clean = decontaminate.clean_documents(docs(texts), bench)
    assert clean.count() == len(texts) - 2 and clean.columns == docs([]).columns


def _noisy_words(rng, items, share):
    """Each item with that share of its words edited, between words of its own."""
    texts = []
    for w in items:
        x = list(map(int, w))
        for _ in range(int(share * len(w) + 1e-9)):
            p, o = rng.randrange(len(x)), rng.random()
            x[p : p + (o < 0.66)] = [rng.getrandbits(64)] if o > 0.33 else []
        texts.append([rng.getrandbits(64) for _ in range(20)] + x + [rng.getrandbits(64) for _ in range(20)])
    row = np.concatenate([np.full(len(t), k) for k, t in enumerate(texts)])
    return row, np.array([v for t in texts for v in t], np.uint64)


def test_leak_recall_at_the_limit(monkeypatch):
    rng = random.Random(3)
    items = [np.array([rng.getrandbits(64) for _ in range(rng.randint(4, 60))], np.uint64) for _ in range(400)]
    row, h = _noisy_words(rng, items, 0.2)
    wanted = set()  # brute force: each item against all words of each text, in plain arrays
    for k, w in enumerate(items):
        d, _ = decontaminate.edit_distance(w[None, :], np.array([len(w)]), h[row == k][None, :], np.array([(row == k).sum()]))
        wanted |= {(k, k)} if d[0] <= int(0.2 * len(w) + 1e-9) else set()
    found = {(a, b) for a, b, *_ in decontaminate.Items(np.arange(400), items).leaks(row, h, 400)}
    assert len(wanted) == 400 and found <= wanted and len(found) >= 0.97 * len(wanted)
    # without the samples only the short items are left
    monkeypatch.setattr(decontaminate.Items, "_sampled", lambda self: [])
    few = {(a, b) for a, b, *_ in decontaminate.Items(np.arange(400), items).leaks(row, h, 400)}
    assert few == {(k, k) for k, w in enumerate(items) if len(w) < decontaminate.GRAM_ITEM}


def test_leaks_by_brute_force(spark, docs):
    """All texts against all items, with a plain edit distance of their words and letters."""
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioumnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 6, 9, 15, 22, 30, 41, 55)]
    texts = []
    for k in range(60):
        t = list(items[k % 8])
        for p in range(len(t)):
            if rng.random() < (0, 0.03, 0.06, 0.12, 0.3)[k % 5]:
                t[p] = rng.choice("xyz")
        texts.append((k, " ".join([*rng.choices(words, k=15), "".join(t), *rng.choices(words, k=15)])))

    def apart(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    def leak(s, t):
        n, off = len(s.split()), apart(s.split(), t.split())
        return off <= int(0.2 * n + 1e-9) or (n >= 8 and off <= 0.7 * n and apart(s, t) <= 0.1 * len(s))

    pairs = {(k, i) for k, t in texts for i, s in enumerate(items) if leak(s, t)}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = set(rows(decontaminate.leaks(docs(texts), bench), "doc_id", "item_id"))
    assert len(pairs) > 30 and got <= pairs and len(got) >= 0.97 * len(pairs), sorted(pairs - got)


def test_leaks_of_long_items_and_texts(spark, docs):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(3000))
    bench = spark.createDataFrame([(0, long), (1, long)], "item_id long, text string")
    got = rows(decontaminate.leaks(docs([(1, "start " + long + " end"), (2, long[: len(long) // 2])]), bench), "doc_id", "item_id", "distance")
    assert got == [(1, 0, 0), (1, 1, 0)]


def test_leaks_odd_tables(spark, docs, sentences):
    bench = spark.createDataFrame([(0, sentences[0])], "item_id long, text string")
    table = docs([(1, sentences[0]), (2, "clean")]).withColumn("__t", F.lit(1)).withColumn("t", F.lit(2))
    marked = decontaminate.with_leaks(table, bench)
    assert marked.columns == [*table.columns, "_leaks"] and marked.where("leaks = 3 and __t = 1 and t = 2").count() == 2
    assert decontaminate.clean_documents(table, bench).columns == table.columns
    assert decontaminate.leaks(docs([]), bench).count() == 0 and decontaminate.leaks(docs([(1, "x")]), bench.limit(0)).count() == 0


def test_items_of_very_different_lengths():
    """A long item among many short ones takes its own words only, and is found."""
    rng = np.random.default_rng(8)
    words = [rng.integers(1, 1 << 62, n).astype(np.uint64) for n in [8] * 20_000 + [20_000]]
    tracemalloc.start()
    items = decontaminate.Items(np.arange(len(words)), words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    long = words[-1].copy()
    long[rng.choice(len(long), 200, replace=False)] = 7
    text = np.concatenate([rng.integers(1, 1 << 62, 300).astype(np.uint64), long, words[5], rng.integers(1, 1 << 62, 300).astype(np.uint64)])
    got = {(i, s, n, d) for _, i, s, n, d in items.leaks(np.zeros(len(text), np.int64), text, 1)}
    assert got == {(20_000, 300, 20_000, 200), (5, 20_300, 8, 0)}


# --- 9 packing


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    texts = ODD + [(20, "a  b\n\n c\td <|endoftext|> it's"), (21, "line one\nline two"), (21, "line one\nline two")]
    pieces = packing.pack(docs(texts), length=64)
    out = pieces.collect()
    ids = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        ids[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all([o for o, _ in v] == list(np.cumsum([0] + [n for _, n in v])[:-1]) for v in ids.values())
    full = [sum(n for _, n in v) for v in ids.values()]
    assert sorted(ids) == list(range(len(ids))) and sum(n < 64 for n in full) <= 1 and max(full) <= 64
    for i, text in texts:
        want = t.encode(text or "", add_special_tokens=False).ids + [1]
        mine = sorted((r["start"], r["ids"]) for r in out if r["doc_id"] == i and r["doc_tokens"] == len(want))
        times = 2 if i == 21 else 1
        assert np.frombuffer(b"".join(x for _, x in mine[::times]), "<u4").tolist() == want or times == 2
    assert packing.sequences(pieces).count() == len(ids)
    assert packing.pack(docs([])).count() == 0


def test_added_tokens_as_the_vocabulary_has_them():
    w = packing.WordTokenizer(packing.default_tokenizer())
    texts = ["plain", "hello <|endoftext|> x", "a<|endoftext|>b\nc", "<|endoftext|>"]
    assert np.frombuffer(w.encode(texts)[1], w.dtype).tolist() == [31373, 220, 50256, 2124]
    assert [np.frombuffer(x, w.dtype).tolist() for x in w.encode(texts)] == [e.ids for e in w.inner.encode_batch(texts, add_special_tokens=False)]


def test_tokenizer_cuts_like_the_whole_text():
    w = packing.WordTokenizer(packing.default_tokenizer())
    rng = random.Random(1)
    texts = ["".join(rng.choice(" \n\t ab'sé1.,    \x0b ") for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    want = [e.ids for e in w.inner.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, w.dtype).tolist() for x in w.encode(texts)] == want


def test_words_are_encoded_when_first_asked_for():
    """A word's letters are encoded once, whatever marks stand after it; only words that a text asks for are remembered."""
    w = packing.WordTokenizer(packing.default_tokenizer())
    asked = ["naïve", "naïve,", "naïve.", "b2b", "naïve"]
    got = [np.frombuffer(w.later[x], w.dtype).tolist() for x in asked]
    assert got == [w.inner.encode(" " + x, add_special_tokens=False).ids for x in asked]
    assert set(w.later) == set(asked) and not w.first and set(w.tails) == {"", ",", "."}
    with pytest.raises(KeyError):
        w.later["a\tb"]


def test_hilbert_curve_visits_neighbours():
    points = np.array(list(itertools.product(range(8), repeat=3)))
    key = packing.hilbert_key(points, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(key)], axis=0)).sum(1) == 1).all()


# --- 10 lines


def test_lines(docs, sentences):
    a, b, c, d = sentences
    near = a.replace("lazy", "hazy")
    texts = [(1, f"{a}\n{b}\nshort"), (2, f"{near}\nshort\n{c}"), (3, f"  {b.upper()}  \n{d}"), (4, f"{d}\n{d}")] + [(k + 10 if k else None, t) for k, t in ODD]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(texts)).collect()}
    assert out[1]["text"] == f"{a}\n{b}\nshort" and out[1]["_n_lines"] == 3 and out[1]["n_lines"] == 2
    assert out[2]["text"] == f"short\n{c}" and out[2]["n_removed"] == 1
    assert out[3]["text"] == d and out[4]["text"] == "" and out[4]["n_removed"] == 2
    assert out[11]["text"] is None and out[None]["text"] == "null id text" and out[15]["text"] == "long " * 30_000
    assert line_dedup.dedup_lines(docs([])).count() == 0


def test_line_recall(docs):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 8)))
    lines = []
    for n in (6, 12, 30, 60, 120):
        for _ in range(12):
            base = [word() for _ in range(n)]
            for edits in range(3):
                w = list(base)
                for _ in range(edits * n // 30):
                    w[rng.randrange(n)] = word()
                lines.append(" ".join(w))
    sets = [{x[k : k + 5] for k in range(max(1, len(x) - 4))} for x in lines]
    parent = list(range(len(lines)))
    for a, b in itertools.combinations(range(len(lines)), 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    want = {k for k, x in enumerate(lines) if len(x) >= 24 and find(parent, k) != k}
    got = {r["doc_id"] for r in line_dedup.dedup_lines(docs(list(enumerate(lines)))).where("n_removed = 1").collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_line_recall_in_crowded_bands(docs, monkeypatch):
    """Lines of one frame meet in the same bands; each has one near copy there."""
    monkeypatch.setattr(line_dedup, "TILE", 16)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 6)))
    frame, pairs = [word() for _ in range(11)], []
    grams = lambda x: {x[k : k + 5] for k in range(len(x) - 4)}
    while len(pairs) < 400:
        w = frame + [word() for _ in range(7)]
        v = list(w)
        v[11 + rng.randrange(7)] = word()
        a, b = " ".join(w), " ".join(v)
        if max(len(a), len(b)) < line_dedup.LONG_CHARS and 0.8 <= len(grams(a) & grams(b)) / len(grams(a) | grams(b)) < 1:
            pairs.append((a, b))
    lines = [a for a, _ in pairs] + [b for _, b in pairs]
    got = {r["doc_id"] for r in line_dedup.dedup_lines(docs(list(enumerate(lines)))).where("n_removed = 1").collect()}
    assert got <= set(range(400, 800)) and len(got) >= 0.99 * 400


def test_line_counts_and_not_lengths_bound_the_similarity(docs):
    """Equal sets of shingles are similar whatever the lengths."""
    unit = "abcdefghijklmnopqrstuvwxyz0123456789"
    lines = [unit * 2, unit * 3]
    assert [r["n_removed"] for r in line_dedup.dedup_lines(docs(list(enumerate(lines)))).orderBy("doc_id").collect()][1] == 1


def test_crossing_pairs_are_all_pairs_across_components(spark):
    rng = random.Random(2)
    members = [(k, n, c) for k in range(3) for n, c in [(100 * k + j, rng.choice([7, 8, 9, 100 * k + j])) for j in range(60)]]
    inside = spark.createDataFrame(members, "key long, node long, comp long")
    bits = inside.select("node", F.lit(9).alias("m"), F.array_repeat(F.lit(0).cast("long"), line_dedup.WORDS).alias("bits"))
    want = {(a[1], b[1]) for a, b in itertools.combinations(members, 2) if a[0] == b[0] and a[2] != b[2]}
    for tile in (4, 1000):
        found = [tuple(sorted(r)) for r in line_dedup.crossing_pairs(inside, bits, 0.8, tile).collect()]
        assert len(found) == len(set(found)) and set(found) == want


def test_jaccard_sketches_bound_the_overlap():
    """A sketch never shows more differing elements than there are, tells sets apart that met by chance, and takes a small part of the set."""
    rng = np.random.default_rng(5)
    t = jaccard.Threshold(85)
    for m, edits in ((3, 1), (60, 4), (500, 30), (700, 700), (1023, 1023)):
        x = np.unique(rng.integers(0, 1 << 63, m).astype(np.uint64))
        y = np.unique(np.concatenate([x[edits:], rng.integers(0, 1 << 63, edits + m // 9).astype(np.uint64)]))
        rows, n = np.repeat([0, 1], [len(x), len(y)]), np.array([len(x), len(y)])
        data, size = jaccard.sketches(rows, np.concatenate([x, y]), n)
        one, other = (np.frombuffer(part.tobytes(), np.uint64) for part in np.split(data, [size[0]]))
        differ = jaccard.differing(one, other)
        assert differ <= len(np.setxor1d(x, y)) and size.sum() * 8 <= 2 * max(64, n.max()) * 2
        if edits == m and m > 60:
            assert (n.sum() - differ) // 2 < int(t.least_overlap(n.sum()))


def test_line_sketches_tell_long_lines_apart(spark):
    """900 shingles fill the words of a sketch; parities still differ."""
    rng = random.Random(3)
    lines = [(k, "".join(rng.choice("abcdefghijklmnop ") for _ in range(900))) for k in range(4)]
    lines.append((4, lines[0][1][:400] + "#" + lines[0][1][401:]))
    bits = spark.createDataFrame(lines, "node long, line string").select("node", F.lit(890).alias("m"), line_dedup._bitmap(line_dedup._grams(F.col("line"), 5)).alias("bits"))
    inside = spark.createDataFrame([(key, k, k) for key in (1, 2) for k in range(5)], "key long, node long, comp long")
    assert [tuple(r) for r in line_dedup.crossing_pairs(inside, bits, 0.8).collect()] == [(0, 4)]
