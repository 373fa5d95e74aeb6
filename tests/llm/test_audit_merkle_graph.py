"""Operators 11 to 13 against brute force, in their odd cases too."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from cuespark.llm import filter_audit, hnsw, merkle, queries

SF = "/root/testdata/sf0.001"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- 13 Merkle manifest


def plain_tree(rows):
    """{row place: (leaf, subroot, root, proof, folded, verified)}, one level at a time over whole lists."""
    framed = lambda *v: "".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in v)
    leaf = [H(framed(i, source, lang, n, text)) for i, text, lang, source, n in rows]
    changed = [leaf[k] if i is None or n is None or zlib.crc32(str(i).encode()) % 7 else H(framed(i, source, lang, n + 1, text)) for k, (i, text, lang, source, n) in enumerate(rows)]
    parts = collections.defaultdict(list)
    for k, r in enumerate(rows):
        parts[r[2]].append(k)
    order = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))

    def climb(row):
        """Every level of a tree and the path of each leaf, as (left, right) siblings."""
        paths, at = [[] for _ in row], list(range(len(row)))
        while len(row) > 1:
            for p, a in zip(paths, at, strict=True):
                p.append((row[a - 1], "") if a % 2 else ("", row[a + 1] if a + 1 < len(row) else ""))
            row, at = [H(*row[k : k + 2]) for k in range(0, len(row), 2)], [a // 2 for a in at]
        return row[0], paths

    roots, paths = {}, {}
    for x in order:
        mine = sorted(parts[x], key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, leaf[k]))
        roots[x], own = climb([leaf[k] for k in mine])
        paths |= dict(zip(mine, own, strict=True))
    root, tops = climb([roots[x] for x in order])
    out = []
    for k, r in enumerate(rows):
        path, now = paths[k] + tops[order.index(r[2])], changed[k]
        for a, b in path:
            now = H(a, now, b)
        out.append((r[0], leaf[k], roots[r[2]], root, H(*[a + b for a, b in path]), now, now == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("levels, many", [(2, 1), (1, 2), (2, 3), (1, 37), (2, 64), (10, 37)])
def test_merkle(spark, levels, many):
    rng = random.Random(many)
    rows = [(k * 3, f"text {k}", rng.choice(["en", "vi", "é"]), "s", rng.choice([k, None])) for k in range(many)]
    if many > 3:
        rows += [(None, None, None, None, None), (None, "", None, "", 0), (5, "lone", "zz", "s", 1), rows[0], rows[0], (3, "other text of id 3", rows[1][2], None, 2**63 - 1)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as part", "1 as rank", "2 as Root")
    got = sorted(map(tuple, merkle.document_proofs(frame, levels).collect()), key=repr)
    assert got == plain_tree(rows)
    assert not all(r[-1] for r in got) or many <= 3


def test_merkle_empty_and_nodes(spark):
    assert merkle.document_proofs(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(k, "t", "en", "s", 1) for k in range(11)]
    _, tables = merkle.manifest(merkle.document_leaves(spark.createDataFrame(rows, SCHEMA)), "doc_id")
    nodes = [r for r in tables[0].collect()]
    # each level's intervals tile the leaves, and every interval lies inside one of the level above
    for level in range(1, 5):
        at = sorted((r.lo, r.hi) for r in nodes if r.level == level)
        assert at[0][0] == 0 and at[-1][1] == 11 and all(a[1] == b[0] for a, b in itertools.pairwise(at))
        assert all(any(u.lo <= lo and hi <= u.hi for u in nodes if u.level == level + 1) for lo, hi in at) or level == 4


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_merkle_manifest"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    rows = lambda f: sorted(f[sorted(want.columns)].itertuples(index=False, name=None))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


# --- 12 filter audit


def plain_audit(docs, labels):
    first, out = {}, {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    flagged = []
    for i, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {c for c, hit in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            bool(re.search("[#$%&*|]", t)), i is not None and i > first[t],
        ), strict=True) if hit}
        of = [x for x in labels if x[0] is not None and x[0] == i]
        flagged.append((lang or "", fails, any(x[1] == 1 for x in of), any(x[2] == 1 for x in of)))
    for part in {x[0] for x in flagged}:
        mine, shapley = [x[1:] for x in flagged if x[0] == part], collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[0]]
                left = [x for x in left if c not in x[0]]
                shapley[c] += len(gone)
                redundant = sum(c in x[0] and bool(x[0] & set(order[: step - 1])) for x in mine)
                out[part, order, step] = [len(left), len(gone), redundant, sum(x[0] == {c} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def test_audit(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 3000)
    monkeypatch.setattr(filter_audit, "BUCKET_WORDS", 500)
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma#", "DELTA", "é漢字", "x", "ｗide", "tab"]
    text = lambda: rng.choice([" ", "\t", "\n", "\x0b", "\x85", " "]).join(rng.choice(words) + str(rng.randint(0, 400)) for _ in range(rng.choice([1, 40, 99, 100, 130])))
    docs = [(k, text(), rng.choice(["en", "vi", None, ""])) for k in range(60)]
    docs += [(100 + k, "the same text " * 40, "en") for k in range(30)] + [(100, "the same text " * 40, "en"), (None, "the same text " * 40, "en")]
    docs += [(200, None, "en"), (201, "", None), (None, None, "en"), (203, " \t", "vi"), (204, "long Word " * 30_000, "vi"), (205, "A" * 9 + "b" * 81, "vi"), (206, "A" * 9 + "b" * 80, "vi")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 130, 2)] + [(100, 1, 0), (None, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "'x' as part", "1 as flags", "2 as Shard", "3 as n")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as text")
    got = filter_audit.audit(frame, marks).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert sorted(map(tuple, got.collect())) == plain_audit(docs, labels)
    assert filter_audit.audit(frame.limit(0), marks).count() == 0


@pytest.mark.parametrize("bucket", [1, 1 << 20])
def test_matrix(spark, monkeypatch, bucket):
    """The global ids stand for the words: the matrix gives back each document's counts."""
    monkeypatch.setattr(filter_audit, "BUCKET_WORDS", bucket)
    texts = {1: "a b a c", 2: None, 3: "c c\tb", 4: "z"}
    frame = spark.createDataFrame([(i, t, "p") for i, t in texts.items()], "doc_id long, text string, part string").repartition(3)
    matrix, dictionary = filter_audit.document_terms(frame)
    name = {r["id"]: bytes(r["word"]).decode() for r in dictionary.collect()}
    assert len(name) == 4
    for r in matrix.collect():
        starts, columns = np.frombuffer(r["starts"], np.int64), np.frombuffer(r["columns"], np.int64)
        counts = np.frombuffer(r["counts"], f"u{r['wide_n']}")
        for k, i in enumerate(r["doc_id"]):
            row = slice(starts[k], starts[k + 1])
            assert {name[c]: n for c, n in zip(columns[row], counts[row], strict=True)} == collections.Counter((texts[i] or "").split())


# --- 11 small-world graphs


def brute(rows, k, is_query):
    out = {}
    for q, v in rows:
        if is_query(q):
            best = collections.defaultdict(lambda: -np.inf)
            for i, w in rows:
                if i != q and len(w) == len(v):
                    best[i] = max(best[i], float(np.cumsum(np.array(v, float) * np.array(w, float))[-1]))
            for i, s in best.items():
                out.setdefault(q, {})[i] = max(s, out.get(q, {}).get(i, -np.inf))
    return {q: sorted(((-s, i) for i, s in x.items()))[:k] for q, x in out.items()}


def test_graph_recall(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "FIRST_BYTES", 4096)
    monkeypatch.setattr(hnsw, "CHUNK", 100)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 24)) * rng.uniform(0.2, 3, (4000, 1))
    frame = spark.createDataFrame([(int(k), [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in hnsw.neighbour_rows(frame).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r)
    assert set(got) == set(range(0, 4000, 20))
    hits = 0
    for q, found in got.items():
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert [r["score"] for r in found] == [float(np.cumsum(x[q] * x[r["vec_id"]])[-1]) for r in found]
        assert found == sorted(found, key=lambda r: (-r["score"], r["vec_id"]))
        hits += len({r["vec_id"] for r in found} & set(np.argsort(-np.where(np.arange(4000) == q, -np.inf, x @ x[q]))[:20]))
    assert hits / (20 * len(got)) > 0.95


def test_graph_finds_less_without_links(spark):
    """The links do the work: a graph without them answers from its entry alone."""
    x = hnsw.lifted(np.random.default_rng(1).standard_normal((3000, 16)))
    g = hnsw.build(x)
    true = np.argsort(-(x[:50] @ x.T), axis=1)[:, :10]
    recall = lambda: np.mean([np.isin(t, f).mean() for t, f in zip(true, hnsw.search(g, x[:50], 80), strict=True)])
    assert recall() > 0.95
    assert len(g.upper) >= 1 and all((g.ground >= 0).sum(1) > 0)
    g.ground[:] = -1
    assert recall() < 0.05


def test_graph_odd_rows(spark):
    same = [0.5, -0.5]
    rows = [(20 * k, same) for k in range(40)] + [(7, [1.0, 0.0]), (7, [1.0, 0.0]), (9, [2.0, 1.0]), (9, [-5.0, 5.0]), (41, [1.0, 2.0, 3.0]), (60_000, [3.0, 0.0, -1.0])]
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (20_000, None)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "'x' as dim", "1 as shard", "2 as rank")
    want = brute(sorted(set((i, tuple(v)) for i, v in rows)), 20, lambda i: i % 20 == 0)
    got = collections.defaultdict(list)
    for r in hnsw.neighbour_rows(frame).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-r["score"], r["vec_id"]))
    assert dict(got) == want
    assert hnsw.neighbour_rows(frame.limit(0)).count() == 0
