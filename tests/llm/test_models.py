"""NN-descent against brute force, HTML extraction on held-out pages, trees and tree decoding."""
import itertools
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from sparquill.llm import html_extract as E
from sparquill.llm import nn_descent as N
from sparquill.llm.boosting import Boosted

SF = "/root/testdata/sf0.01"


def brute_pairs(ids, x, t=N.THRESHOLD):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(x @ x.T >= t)
    return {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in zip(a, b) if ids[i] != ids[j]}


def near(df, report=None):
    made = N.classes(df)
    return {(r["vec_a"], r["vec_b"]): r["cosine"] for r in N.near_pairs(made[1], report=report).collect()}


def test_nn_descent_recall(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((900, 32))
    crowd = rng.standard_normal(32) + 0.05 * rng.standard_normal((90, 32))  # saturates lists of 8 and of 32
    twins = base[:150] + 0.1 * rng.standard_normal((150, 32))
    x = np.concatenate([base, crowd, twins]).astype(np.float32)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    report = {}
    got = near(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4), report)
    want = brute_pairs(list(range(len(x))), x)
    assert len(want) > 4000 and len(want & set(got)) >= 0.97 * len(want) and set(got) <= want
    assert min(got.values()) >= N.THRESHOLD - 1e-5 and report["found"] >= N.RECALL * report["true"]


def test_nn_descent_counts_links_of_copies(spark):
    """Every vector's links against brute force, exact copies of a near crowd included."""
    rng = np.random.default_rng(7)
    base = rng.standard_normal((300, 16))
    crowd = rng.standard_normal(16) + 0.05 * rng.standard_normal((40, 16))
    x = np.concatenate([base, crowd, np.repeat(crowd[:3], 50, axis=0), np.repeat(base[:1], 80, axis=0)]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = {r["vec_id"]: (r["class_id"], r["links"]) for r in N.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= N.THRESHOLD).sum(axis=1) - 1
    assert sorted(got) == list(range(len(x)))
    assert sum(got[i][1] == want[i] for i in got) >= 0.97 * len(x) and all(got[i][1] <= want[i] for i in got)
    assert {got[i][0] for i in range(490, 570)} == {0} and {got[i][0] for i in range(340, 390)} == {300}


def test_nn_descent_joins_all_of_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(N, "CHUNK", 8)
    monkeypatch.setattr(N, "CROWD", 1)
    x = np.random.default_rng(3).standard_normal((201, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    vectors = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "id long, vec binary")
    graph = spark.createDataFrame([(i, 8, [] if i == 0 else [(0.5, 0, True)]) for i in range(201)], f"u long, k int, nb {N._NB}")
    after = {r["u"]: r["nb"] for r in N._round(graph, vectors, 1, N.THRESHOLD).collect()}
    assert sum(len(after[i]) > 1 for i in range(1, 201)) >= 195  # each was compared with a chunk, not only a few of them


def test_nn_descent_far_neighbours_open_joins():
    found = pa.array([[{"s": 0.1 + i / 100, "v": i} for i in range(12)]], pa.list_(pa.struct([("s", pa.float32()), ("v", pa.int64())])))
    none = pa.array([[]], pa.list_(pa.struct([("s", pa.float32()), ("v", pa.int64()), ("f", pa.bool_())])))
    batch = pa.RecordBatch.from_arrays([pa.array([99]), pa.array([N.NEIGHBOURS], pa.int32()), none, found], ["u", "k", "nb", "found"])
    out = next(N._merge(N.THRESHOLD)(iter([batch]))).to_pylist()[0]
    assert [e["f"] for e in out["nb"]] == [True] * N.NEIGHBOURS


def test_nn_descent_audit_counts_vectors(spark, monkeypatch):
    """One group of many pairs that the graph has, many lone pairs that it hasn't: only the mean over vectors shows them."""
    monkeypatch.setattr(N, "AUDIT", 16)
    monkeypatch.setattr(N, "PAIRED", 1000)
    x = np.zeros((60, 32), np.float32)
    x[:40, 0] = 1
    for i in range(10):
        x[40 + 2 * i : 42 + 2 * i, 1 + i] = 1
    vectors = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "id long, vec binary")
    graph = spark.createDataFrame([(i, [(1.0, j, False) for j in range(40) if j != i] if i < 40 else []) for i in range(60)], f"u long, nb {N._NB}")
    true, found, paired, share = N._audited(graph, vectors, 60, N.THRESHOLD, 0)
    assert (true, found, paired) == (40 * 39 + 20, 40 * 39, 60) and share == pytest.approx(40 / 60)
    assert found >= N.RECALL * true and share < N.RECALL


def test_nn_descent_edge_rows(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, None, 0), (4, [], 0), (5, [0.0, 0.0], 0), (6, [1.0, None], 0), (7, [float("nan"), 1.0], 0), (None, [1.0, 0.0], 0), (8, [1.0, 0.0, 0.0], 0), (9, [0.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, vec int")
    got = sorted(tuple(r) for r in N.near_vectors(df).collect())
    assert got == [(1, 1, 1), (2, 1, 1), *((i, i, 0) for i in range(3, 10))]
    assert N.near_vectors(df.limit(0)).count() == 0 and N.near_vectors(df.where("vec_id = 3")).count() == 1


def f1(a, b):
    a, b = Counter(E._WORD.findall(a)), Counter(E._WORD.findall(b))
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_html_held_out_accuracy(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    gold = {r["page_id"]: r["text"] for r in E.gold_of(pages, docs).collect()}
    rows = pages.orderBy("page_id").collect()
    model = E.fit([r["html"] for r in rows[:120]], [gold.get(r["page_id"]) for r in rows[:120]])
    held = [r for r in rows[120:] if r["page_id"] in gold]
    scores = [f1(E.extract_one(p := E.Page(r["html"]), model.log_odds(p.features())), gold[r["page_id"]]) for r in held]
    assert len(held) > 80 and np.mean(scores) > 0.93 and np.quantile(scores, 0.1) > 0.85


PAGE = "<html><head><title>t</title></head><body><nav><a href=/x>Menu</a></nav><article class='post'><h1>Title</h1><p>Some words of text, long enough to count.<p>More &amp; more.<br>Next</article><footer>c</footer></body></html>"


def test_html_edge_rows(spark):
    rows = [(1, PAGE, "a"), (2, None, "a"), (3, "", "a"), (None, PAGE, "a"), (1, PAGE, "a"), (4, "no markup at all", "a"), (5, "</p></div><<<>>&&& <b", "a"), (6, "<p>" * 3000 + "deep" + "</p>" * 10, "a"), (7, "<script>var x='<p>no</p>'</script>", "a"), (8, "<div>" * 2000 + "x" * 200_000, "a")] + [(100 + i, PAGE, "a") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = E.extract(df, df.where("page_id >= 100").selectExpr("page_id", "'Title Some words of text, long enough to count. More more. Next' AS text"), ["page_id"]).collect()
    assert E.extract(df, None, ["page_id"]).count() == len(rows)
    assert len(out) == len(rows)
    by = {r["page_id"]: r["text"] for r in out}
    assert by[2] is None and by[3] == "" and by[7] == "" and "More & more." in by[1] and "Menu" not in by[1]
    assert E.extract(df.limit(0), None, ["page_id"]).count() == 0


def test_decoding_is_the_best_consistent_labelling():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(2, 9))
        parents = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        score = rng.standard_normal(n)
        kept = E.decode(score, parents)
        assert all(not kept[i] or kept[parents[i]] for i in range(1, n))
        allowed = [k for k in itertools.product([0, 1], repeat=n - 1) if all(not k[i - 1] or parents[i] == 0 or k[parents[i] - 1] for i in range(1, n))]
        assert np.isclose((score[1:] * kept[1:]).sum(), max((score[1:] * np.array(k)).sum() for k in allowed))


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = Boosted().fit(x[:1500], y[:1500])
    assert ((m.log_odds(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_unclosed_paragraphs_do_not_nest():
    page = E.Page("<div><p>one<p>two<ul><li>a<li>b</ul></div><p>three")
    depth = [0] * len(page.tags)
    for i, p in enumerate(page.parents):
        depth[i] = depth[p] + 1 if p >= 0 else 0
    assert [d for d, t in zip(depth, page.tags) if t == "p"] == [2, 2, 1] and len(re.findall("li", " ".join(page.tags))) == 2


def test_stray_tags_take_linear_time():
    import time

    t = time.perf_counter()
    page = E.Page("<b>" * 40_000 + "</x>" * 40_000 + "<div>" * 20_000 + "</span>" * 20_000 + "<p>a" * 20_000)
    assert len(page.tags) == 80_001 and time.perf_counter() - t < 8


def test_stray_ends_leave_blocks_open():
    page = E.Page("<b><div>one</b>two</div>three")
    assert [page.tags[i] for i, t in page.pieces if t] == ["div", "div", "b"]
