"""Rules that SQL over the tables doesn't reach, with values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.functions import html, text as T, tree
from docloom.operators import batching, events as E, graph, messages as M, retrieval as R, skew
from docloom.sources import readers, store
from docloom.streaming import event_stream


def api(text):
    return tree.demote_api_headers(text)


def test_api_headers():
    assert api("## Get\n### HTTP 请求\nx\n### 响应\ny") == "## Get\n**HTTP 请求**\nx\n**响应**\ny"
    assert api("## Get\n### HTTP Request\nx") == "## Get\n### HTTP Request\nx"  # one kind only
    assert api("## Get\n### HTTP\n### HTTP 参数") == "## Get\n### HTTP\n### HTTP 参数"  # two names, one kind
    assert api("## A\n### `get` B\n#### Parameters\n#### Response\n## C") == "## A\n### `get` B\n**Parameters**\n**Response**\n## C"
    assert api("### A\n### 参数\n### **响应**\n### B\n#### 参数") == "### A\n**参数**\n****响应****\n### B\n#### 参数"
    assert api("## A\n### Parameters list\n### Response body") == "## A\n### Parameters list\n### Response body"  # no exact match
    assert api("# A\n## 参数\n## 响应") == "# A\n## 参数\n## 响应"  # nothing is open


def nodes_of(body, **sizes):
    return {n.title: n for n in tree.TreeBuilder(**sizes).build("h1\nh2\nh3\nh4\n" + body, "D")}


def test_tree_shape():
    words = "w " * 300
    n = nodes_of(f"intro\n# A [HLINK: u#a]\n{words}\n## A1\n{words}\n# A\n{words}\n### skipped\nz\n# 接下来\nsee [ANCHOR: t, HLINK: u2]\n", low=10, core=20, most=400)
    assert list(n) == ["D", "D_A", "D_A_A1", "D_A_2"]
    assert n["D"].child_ids == [n["D_A"].pk, n["D_A_2"].pk] and n["D"].nav_next_step == "see t" and n["D"].outlinks == {"t": ["u2"]}
    assert n["D_A"].entry_urls == ["u#a"] and n["D_A"].node_type == "section" and n["D_A_2"].node_type == "leaf"
    assert n["D_A"].right_sibling == n["D_A_2"].pk and n["D_A_2"].left_sibling == n["D_A"].pk and n["D_A"].left_sibling == ""
    assert n["D"].text.startswith("h1\nh2\nh3\nh4") and n["D_A"].pk == tree.node_id("D_A")


def test_small_neighbours_merge():
    body = "# A\n" + "a " * 8 + "\n# B\n" + "b " * 8 + "\n# C\n" + "c " * 8
    n = nodes_of(body, low=15, core=25, most=30)  # ten tokens each: two fit, three don't
    assert [x.title for x in n.values() if x.merged] == ["D_B~C"] or [x.title for x in n.values() if x.merged] == ["D_A~B"]
    total = sum(x.token_count for x in n.values() if x.node_type == "leaf")
    assert total == 30


def test_long_leaf_becomes_container():
    body = "# A\n" + "".join(f"\n**Part {i}**\n" + "word " * 40 for i in range(4))
    n = nodes_of(body, low=5, core=20, most=60)
    a = n["D_A"]
    assert a.node_type == "container" and a.token_count == 0 and a.text == "# A"
    parts = [x for x in n.values() if x.parent_id == a.pk]
    assert len(parts) >= 4 and all((x.from_split or x.merged) and x.token_count <= 60 and x.left_sibling == "" for x in parts)


def test_segments():
    assert batching.segments([100, 100, 100], 150, 250) in ([(0, 1), (1, 3)], [(0, 2), (2, 3)])
    assert batching.segments([5], 10, 20) == [(0, 1)]
    assert batching.segments([10, 10, 10, 10], 20, 40) == [(0, 2), (2, 4)]  # ties take the shortest last segment
    with pytest.raises(ValueError):
        batching.segments([30], 10, 20)


def test_blocks_and_links(spark):
    df = spark.createDataFrame([("a ```x\ny``` b :::note\nt::: c ```z",), ("",), (None,)], "t string")
    text, blocks = T.lifted_blocks("t")
    got = df.select(text.alias("x"), blocks.alias("b")).collect()
    assert got[0].x == "a @@BLOCK_0@@ b @@BLOCK_1@@ c ```z" and got[0].b == ["```x\ny```", ":::note\nt:::"]
    back = df.select(text.alias("x"), blocks.alias("b")).select(T.restored("x", "b").alias("r")).collect()
    assert [r.r for r in back] == [df.collect()[0].t, "", None]
    clean, links = T.exit_links("t")
    e = spark.createDataFrame([("See\n[ANCHOR: a b, HLINK: u1] and [ANCHOR: a b, HLINK: u2]　x",), (None,)], "t string").select(clean.alias("c"), links.alias("l")).collect()
    assert e[0].c == "See a b and a b x" and e[0].l == {"a b": ["u1", "u2"]} and e[1].c == "" and e[1].l == {}


def test_html():
    page = """<html><head><title>Pods | Kubernetes</title></head><body><main><nav><ol><li><a href="/d">Docs</a></li></ol></nav>
    <div class="toolbar">no</div><h1 id="top">Pods</h1><h3>概要</h3><h3>Use <code>x</code></h3><p>Go <a href="/n#f">there</a> <a href="mailto:x">mail</a></p>
    <div class="alert alert-info">Mind <b>this</b></div><pre><code data-lang="yaml">a: 1
b: 2</code></pre><table><tr><th>K</th><th>V</th></tr><tr><td><ul><li>p</li><li>q</li></ul></td><td>l1<br>l2</td></tr></table><tt>a<tt></tt></tt><h2>反馈</h2>gone</main></body></html>"""
    md = html.convert(page, "https://h.test/docs/p/")
    assert md.startswith("# Pods\n[HLINK: https://h.test/docs/p/]\nDocs\n\n# Pods [HLINK: https://h.test/docs/p/#top]\n")
    assert "**概要**" in md and "## Use `x`" in md and "[ANCHOR: there, HLINK: https://h.test/n#f]" in md and "[ANCHOR: mail" not in md
    assert ":::alert alert-info\nMind **this**\n:::" in md and "```yaml\na: 1\nb: 2\n```" in md
    assert "* p<br> * q" in md and "l1<br>l2" in md and "gone" not in md and "no" not in md.split("\n")[4]
    assert html.convert("<p>x", "u") == "" and html.convert(None, "u") == ""
    assert html.header_levels([1, 3, 2, 4, 1, 3]) == [1, 2, 2, 3, 1, 2]
    nav = '<ul><li><label><a><span>Top</span></a></label><ul><li><a href="/a/b"><span>A/B</span></a></li></ul></li></ul>'
    assert html.span_path(nav, "https://h.test/a/b", "https://h.test") == "Top_A和B" and html.span_path("<p>", "u", "") == "unknown"
    alert = html.parse('<div class="alert x"><p>a</p><h2>b</h2><p>c</p></div><p>d</p>')
    html.move_out_of_alerts(alert)
    assert [c.tag for c in alert.children] == ["div", "h2", "p", "p"]
    assert html.move_text("a B c D", "B", "D", 0) == "a  c D B" and html.move_text("a", "x", "y") == "a"


def test_new_urls(spark):
    page = '<ul class="nav ul-1"><li><a href="/d/a">A</a><a href="/d/a#x">f</a><a href="/d/_print/">p</a></li></ul><ul><li><a href="/d/z">no</a></li></ul>'
    df = spark.createDataFrame([(page, "https://h.test/d/b/")], "h string, u string")
    assert df.select(html.new_urls(F.col("h"), F.col("u"), "https://h.test/d", ("_print",)).alias("n")).first().n == ["https://h.test/d/a"]


def test_token_batches(spark):
    sizes = [60, 200, 30, 20, 50]
    df = spark.createDataFrame([("g", i, t) for i, t in enumerate(sizes)], "g string, o long, t long")
    got = {r.o: r.batch for r in batching.token_batches(df, "g", "o", "t", 100).collect()}
    assert got == {1: 0, 0: 1, 2: 1, 3: 2, 4: 2}  # the oversized one first, the open batch stays open
    got = {r.o: r.batch for r in batching.padded_batches(df, "g", "o", "t", 120).collect()}
    assert got == {1: 0, 0: 1, 4: 1, 2: 2, 3: 2}


def test_token_batches_over_long_orders(spark):
    """Batches run on past 10,000: against a plain loop, with unique numbers and no batch above the budget but single items."""
    rows = [(g, o, 5 + o * 37 % 60 if o % 97 else 130) for g in ("a", "b") for o in range(9_000, 31_000, 7 if g == "a" else 11)]
    got = {(r.g, r.o): r.batch for r in batching.token_batches(spark.createDataFrame(rows, "g string, o long, t long"), "g", "o", "t", 100).collect()}
    want, sums = {}, {}
    for g in ("a", "b"):
        opened, total, number = [], 0, 0
        for _, o, t in sorted(r for r in rows if r[0] == g):
            if t > 100:
                want[g, o], number = number, number + 1
                continue
            if total + t > 100 and opened:
                want |= {(g, x): number for x in opened}
                opened, total, number = [], 0, number + 1
            opened, total = [*opened, o], total + t
        want |= {(g, x): number for x in opened}
    assert got == want
    for g, o, t in rows:
        sums.setdefault((g, got[g, o]), []).append(t)
    assert all(sum(x) <= 100 or len(x) == 1 for x in sums.values())



def test_pod_state_and_owner(spark):
    s = spark.createDataFrame([([("a", "Error", 1, None), ("b", None, None, "BackOff"), ("c", "OOMKilled", 137, None), ("d", "Error", 2, None)],), ([("a", None, None, "BackOff"), ("b", "Error", 1, None)],), ([],)], "s array<struct<name:string,terminated_reason:string,exit_code:int,waiting_reason:string>>")
    detail, short = E.pod_state(F.col("s"))
    got = s.select(detail.alias("d"), short.alias("s")).collect()
    assert got[0].d.startswith("[a] Terminated: Error (ExitCode: 1) | [b] Waiting: BackOff") and [g.s for g in got] == ["Error/OOMKilled", "BackOff/Error", ""]
    c = spark.createDataFrame([(1, "u", "ADDED", "Pod", "p", "n", [("x", "RS", False), ("y", "Job", True)]), (2, "u", "SCALED", "Pod", "p", "n", None), (1, "v", "ADDED", "Pod", "q", "n", []), (2, "v", "DELETED", "Pod", "q", "n", [])], "seq long, uid string, change_type string, obj_kind string, name string, namespace string, owner_references array<struct<uid:string,kind:string,controller:boolean>>")
    t = E.resource_texts(c).orderBy("uid", "seq").collect()
    assert t[0].parent_uid == "y" and "已上线/部署" in t[0].specific_text and "Action: SCALED" in t[1].specific_text and t[1].abstract_text == "Pod None in n"
    assert [(r.uid, r.seq) for r in E.topology(c).collect()] == [("u", 2)]


def test_ttl(spark):
    df = spark.createDataFrame([("k", t, i) for i, t in enumerate([0, 30, 59, 60, 119, 120, 300, 0])] + [("k", None, 99)], "k string, t long, i long")
    assert sorted(r.i for r in E.suppress_repeats(df, "t", "i", 60, ["k"]).collect()) == [0, 3, 5, 6, 99]


def test_stream_keeps_state_between_batches(spark, tmp_path):
    rows = lambda *ts: spark.createDataFrame([(i, t, "n", "Pod", "x", None, "m") for i, t in ts], "event_no long, at long, namespace string, obj_kind string, name string, reason string, message string")
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for part in (rows((1, 100), (2, 130)), rows((3, 155), (4, 170))):
        part.write.mode("append").parquet(src)
        q = event_stream.suppress_repeats(event_stream.watch(spark, src, part.schema)).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r.event_no for r in spark.read.parquet(out).collect()) == [1, 4]


def test_stream_keeps_few_rows_of_state(spark, tmp_path, monkeypatch):
    """Many keys share a row of state and keep apart; as the filter over a table."""
    monkeypatch.setattr(event_stream, "SHARDS", 3)
    kind = "event_no long, at long, namespace string, obj_kind string, name string, reason string, message string"
    rows = spark.createDataFrame([(i, 100 + (i * 37) % 400, [None, "", "n", "-"][i % 4], "Pod", f"x{i % 9}", None, "m") for i in range(300)], kind)
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    rows.write.parquet(src)
    q = event_stream.suppress_repeats(event_stream.watch(spark, src, rows.schema)).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.event_no for r in spark.read.parquet(out).collect()) == sorted(r.event_no for r in E.suppress_repeats(rows, "at", "event_no").collect())
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 3


def test_stream_forgets_silent_keys(spark, tmp_path):
    """With lateness a key's number goes when the watermark has passed its silence; what is heard stays the same."""
    rows = lambda *ts: spark.createDataFrame([(i, t, "n", "Pod", n, None, "m") for i, t, n in ts], "event_no long, at long, namespace string, obj_kind string, name string, reason string, message string")
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    left = []
    for part in (rows((1, 100, "a"), (2, 130, "a")), rows((3, 150, "a"), (4, 1000, "b")), rows((5, 1010, "a"), (6, 1030, "b"), (7, 9000, "c"))):
        part.write.mode("append").parquet(src)
        q = event_stream.suppress_repeats(event_stream.watch(spark, src, part.schema), lateness="20 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination(120)
        left.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert sorted(r.event_no for r in spark.read.parquet(out).collect()) == [1, 4, 5, 7]
    assert left[-1] == 1


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    """A stored stream that fails in the middle of a batch goes on from its checkpoint: nothing is lost or stored twice."""
    kind = "event_no long, at long, namespace string, obj_kind string, name string, reason string, message string, timestamp_str string"
    rows = lambda *ts: spark.createDataFrame([(i, t, "n", "Pod", f"x{i % 2}", "Failed", "token lost", str(t)) for i, t in ts], kind)
    static = spark.createDataFrame([("s1", "T", "token lost and found"), ("s2", "U", "nothing here")], "pk string, title string, text string")
    src, ck = str(tmp_path / "src"), str(tmp_path / "ck")
    s = store.NodeStore(spark, f"file://{tmp_path}/nodes")

    def run(target):
        stream = event_stream.suppress_repeats(event_stream.watch(spark, src, rows((1, 1)).schema))
        event_stream.textify_and_store(stream, target, static, ck).awaitTermination(180)

    class Broken(store.NodeStore):
        def upsert(self, *args):
            raise OSError("disk full")

    rows((1, 100), (2, 101), (3, 130)).write.mode("append").parquet(src)
    run(s)
    rows((5, 170), (6, 400)).write.mode("append").parquet(src)
    with pytest.raises(Exception, match="disk full"):
        run(Broken(spark, s.root))
    run(s)
    got = {r.title: (r.timestamp, r.parent_id) for r in s.read().collect()}
    assert got == {"Alert: Pod x1 - Failed": (170, "s1"), "Alert: Pod x0 - Failed": (400, "s1")}


def test_store(spark, tmp_path):
    s = store.NodeStore(spark, f"file://{tmp_path}/nodes")
    s.recreate()
    df = lambda *r: spark.createDataFrame(list(r), "pk string, ts long, v string")
    s.append(df(("a", 1, "x")), "p")
    s.upsert(df(("a", 2, "y"), ("a", 3, "z"), ("b", 1, "w")), "p", "ts")
    s.append(df(("c", 1, "q")), "other")
    assert sorted((r.pk, r.v, r.partition_name) for r in s.read().collect()) == [("a", "z", "p"), ("b", "w", "p"), ("c", "q", "other")]
    s.delete(df(("a", 0, ""), ("none", 0, "")))
    assert sorted(r.pk for r in s.read("p").collect()) == ["b"]


def test_store_touches_only_its_buckets(spark, tmp_path):
    """An upsert leaves other buckets' files as they are, old generations go, a second writer fails, a lost pointer isn't needed."""
    s = store.NodeStore(spark, f"file://{tmp_path}/nodes", buckets=8)
    s.upsert(spark.range(200).selectExpr("cast(id as string) pk", "id ts"), "p", "ts")
    before = s._pointer()["p"]["buckets"]
    s.upsert(spark.createDataFrame([("7", 1000)], "pk string, ts long"), "p", "ts")
    after = s._pointer()["p"]["buckets"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert s.read("p").count() == 200 and s.read("p").filter("ts = 1000").count() == 1
    other = store.NodeStore(spark, s.root, buckets=8)
    number, pointer = other._last()
    s.append(spark.createDataFrame([("x", 1)], "pk string, ts long"), "q")
    with pytest.raises(RuntimeError):
        other._swap(pointer, number)
    for i in range(5):
        s.upsert(spark.createDataFrame([("7", 2000 + i)], "pk string, ts long"), "p", "ts")
    assert len(s._pointers()) == store.KEEP and len(list((tmp_path / "nodes" / "p").iterdir())) <= store.KEEP + 1
    assert s.load("p").filter("ts = 2004").count() == 1


def test_store_takes_new_columns(spark, tmp_path):
    """Rows of a later batch may have more columns, of any name; older rows have null there."""
    s = store.NodeStore(spark, f"file://{tmp_path}/nodes", buckets=4)
    s.upsert(spark.createDataFrame([("a", 1), ("b", 1)], "pk string, ts long"), "p", "ts")
    s.upsert(spark.createDataFrame([("b", 2, {"k": [1]}), ("c", 2, None)], "pk string, ts long, `odd name` map<string,array<int>>"), "p", "ts")
    assert {(r.pk, r.ts, str(r["odd name"])) for r in s.read().collect()} == {("a", 1, "None"), ("b", 2, "{'k': [1]}"), ("c", 2, "None")}


def test_search_index(spark, tmp_path):
    s = store.NodeStore(spark, f"file://{tmp_path}/nodes")
    s.append(spark.createDataFrame([("a", {1: 0.9, 2: 0.1}), ("b", {2: 0.5}), ("c", {}), ("d", None)], "pk string, m map<int,double>"), "p")
    q = spark.createDataFrame([(1, {2: 1.0})], "query_id long, m map<int,double>")
    hits = lambda ratio: [(r.pk, r.score) for r in store.search_index(q, s.index("m", ratio), "pk", "m", 5).orderBy("rank").collect()]
    assert hits(0.0) == [("b", 0.5), ("a", 0.1)] and hits(0.5) == [("b", 0.5)]


def test_readers(spark, tmp_path):
    (tmp_path / "a b.md").write_text("1\n2\n3\n4\n5\n6")
    (tmp_path / "c.txt").write_text("no")
    got = readers.header_and_body(readers.markdown_directory(spark, str(tmp_path))).collect()
    assert [(r.name, r.header, r.body) for r in got] == [("a b", "1\n2\n3\n4", "5\n6")]
    assert [(r.line_no, r.value) for r in readers.log_lines(spark, str(tmp_path / "c.txt")).collect()] == [(0, "no")]
    (tmp_path / "s.json").write_text(json.dumps({"mcpServers": {"x": {"command": "c", "args": ["1"]}}}))
    assert [(r.name, r.command, r.args) for r in readers.settings(spark, str(tmp_path / "s.json")).collect()] == [("x", "c", ["1"])]
    assert readers.store_filter('a == "x[1]" && !(b in [1, 2]) || c != 3') .split() == "a == 'x[1]' and not (b in (1, 2)) or c != 3".split()


def test_retrieval_edges(spark):
    nodes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [2.0, 0.0]), (7, [0.0, 1.0])], "k long, v array<float>")
    q = spark.createDataFrame([(10, [3.0, 0.0]), (11, None), (12, [0.0, 0.0])], "query_id long, v array<float>")
    assert [(r.query_id, r.k, r.score, r["rank"]) for r in R.dense_search(q, nodes, "k", "v", 2).orderBy("rank").collect()] == [(10, 1, 1.0, 1), (10, 6, 1.0, 2)]
    assert R.dense_search(q, nodes.limit(0), "k", "v", 2).count() == 0
    a = nodes.select(R.cosine(F.col("v"), F.array(F.lit(1.0), F.lit(0.0))).alias("c"), "k").orderBy("k").collect()
    assert [r.c for r in a][:3] == [1.0, 0.0, None]
    m = spark.createDataFrame([([0, 2, 3], [5, 7, 1], [0.5, 0.25, 1.0])], "p array<int>, i array<int>, d array<double>")
    assert m.select(R.csr_maps(F.col("p"), F.col("i"), F.col("d")).alias("m")).first().m == [{5: 0.5, 7: 0.25}, {1: 1.0}]
    v = spark.createDataFrame([("a b c",), ("",), (None,)], "t string").select(R.hashed_vector("t", 8).alias("v")).collect()
    assert abs(sum(x * x for x in v[0].v) - 1) < 1e-9 and set(v[1].v) == {0.0} and set(v[2].v) == {0.0}
    c = spark.createDataFrame([("q", "a", "link", 2), ("q", "b", "anchor", 3), ("q", "a", "anchor", 5), ("q", None, "anchor", 1), ("q", "b", "parent", 4)], "query_id string, pk string, source_type string, seq long")
    assert sorted((r.pk, r.position, r.source_type) for r in R.priority_merge(c).collect()) == [("a", 2, "anchor"), ("b", 3, "anchor")]


def test_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    monkeypatch.setattr(skew, "MAX_HOT", 20)
    left = spark.range(100).selectExpr("id", "case when id < 60 then 'hot' when id < 65 then null else cast(id as string) end as k")
    right = spark.createDataFrame([("hot", 1), ("70", 2)], "k string, v int")
    got = skew.lookup_join(left, right, "k", 100).groupBy("v").count().collect()
    assert {r.v: r["count"] for r in got} == {1: 60, 2: 1, None: 39}


def test_windows_over_ranges(spark, monkeypatch):
    """Neighbours, numbers of equal titles and runs of a hot group, cut into ranges of three order numbers, as without a cut."""
    rows = [("p", f"k{i:02d}", i, "t" if i % 3 else None, i % 5 != 2) for i in range(40)] + [("q", f"z{i}", i * 7, "t", i != 3) for i in range(6)] + [("r", "one", 5, "u", True)]
    df = spark.createDataFrame(rows, "parent string, k string, o long, title string, m boolean")

    def results():
        return (sorted(map(tuple, graph.sibling_links(df, "parent", "k", "o").collect())), sorted((r.k, r.unique_title or "") for r in graph.number_titles(df, "parent", "title", "o").collect()),
                sorted((r.k, r.run) for r in batching.leaf_runs(df, "parent", "o", F.col("m")).collect()))

    whole = results()
    monkeypatch.setattr(skew, "RANGE", 3)
    assert results() == whole
    assert ("k01", "k00", "k02") in whole[0] and ("one", "", "") in whole[0] and ("k02", "t_2") in whole[1]
    assert dict(whole[2])["k01"] == dict(whole[2])["k00"] == 1 and dict(whole[2])["k02"] == 2 and dict(whole[2])["k03"] == dict(whole[2])["k06"] == 3


def test_graph(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    starts = spark.createDataFrame([("a",)], "url string")
    assert {(r.url, r.depth) for r in graph.frontier(links, starts).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_equal_names_build_one_row_each(spark):
    """Two documents of one name: a pk has one row, the last source's; encoders and the token counter can be replaced."""
    from docloom.plans import pipeline

    head = "h\nh\nh\nh\n"
    docs = spark.createDataFrame([("s1", "D", head + "a a b"), ("s2", "D", head + "a c [ANCHOR: t, HLINK: u#x]"), ("s3", "E", head.replace("h", "[HLINK: u]", 1) + "# A\nx\n# A\nx"), ("s4", "E2", None)], "source string, name string, text string")
    rows = pipeline.build_nodes(docs).collect()
    assert len({r.pk for r in rows}) == len(rows)
    d = next(r for r in rows if r.title == "D")
    assert d.source == "s2" and abs(sum(d.sparse_vector.values()) - 1) < 1e-9
    e = next(r for r in rows if r.title == "E")
    assert [(x.text, x.url, x.pk, x.type) for x in d.related_links] == [("t", "u#x", e.pk, "internal")]
    own = pipeline.Encoders(lambda c: F.array(F.length(c).cast("double")), lambda c: F.create_map(F.lit(1), F.length(c).cast("double")), len)
    d = next(r for r in pipeline.build_nodes(docs, encoders=own).collect() if r.title == "D")
    assert d.vector == [float(len(d.text))] and d.title_sparse == {1: 1.0} and d.token_count == len(d.text)


def test_dynamic_track_by_operation(spark):
    from docloom.plans import pipeline

    nodes = spark.createDataFrame(
        [("a", "static_knowledge", "A", "pod fails", [1.0, 0.0], {1: 1.0}, None, "leaf"), ("e", "dynamic_events", "E", "pod fails now", [1.0, 0.1], {1: 1.0}, [("g", "", "a", "static_anchor")], "dynamic_event")],
        "pk string, partition_name string, title string, text string, vector array<double>, sparse_vector map<int,double>, related_links array<struct<text:string,url:string,pk:string,type:string>>, node_type string")
    nodes = nodes.withColumns({"summary_vector": F.col("vector"), "title_sparse": F.col("sparse_vector"), "left_sibling": F.lit(""), "right_sibling": F.lit("")})
    q = spark.createDataFrame([(1, "pod", "diagnose", [1.0, 0.0], {1: 1.0}), (2, "pod", "explain", [1.0, 0.0], {1: 1.0})], "query_id long, text string, operation string, vector array<double>, sparse_vector map<int,double>")
    got = {(r.query_id, r.pk, r.source_type) for r in pipeline.retrieve(q, nodes, frozenset(["diagnose"])).collect()}
    assert got == {(1, "e", "dynamic_event"), (1, "a", "anchor"), (2, "a", "anchor")}


def test_messages(spark):
    t = spark.createDataFrame([("c", i, r, f"m{i}") for i, r in enumerate(["system", "user", "assistant", "user", "assistant"])], "conv_id string, turn long, role string, text string")
    assert [m.turn for m in M.gather(t, last=2).first().messages] == [3, 4]
    assert M.last_answer(t, is_call=F.col("text") == "m4").first().text == "m2"
    ctx = M.gather(t).select(M.with_context(F.col("messages"), "env", "env!").alias("m")).first().m
    assert ctx[0].text == "env!" and len(ctx) == 6
    v = spark.createDataFrame([(("s", "Q", "L", [("p", "Pod")]),), (None,)], "a struct<technical_summary:string,target_operation:string,risk_level:string,entities:array<struct<name:string,type:string>>>").select(M.analysis_view(F.col("a")).alias("v")).collect()
    assert v[0].v.endswith('[{"name": "p", "type": "Pod"}]') and v[1].v == "None"


def test_fill_forward_over_ranges(spark, monkeypatch):
    from docloom.operators import crawl_log

    monkeypatch.setattr(crawl_log, "RANGE", 4)
    rows = [(i, {1: "a", 10: "b", 17: "c"}.get(i), i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "o long, v string, g int")
    got = {r.o: r.f for r in crawl_log.fill_forward(df, "o", "v", "f").collect()}
    assert got == {i: None if i < 1 else "a" if i < 10 else "b" if i < 17 else "c" for i in range(20)}
    got = {r.o: r.f for r in crawl_log.fill_forward(df, "o", "v", "f", by="g").collect()}
    assert got == {i: ("b" if i >= 10 else None) if i % 2 == 0 else None if i < 1 else "a" if i < 17 else "c" for i in range(20)}


def test_sql_functions(spark):
    import uuid

    from docloom.functions import registry

    assert set(registry.register(spark)) == set(registry.FUNCTIONS) and "doc_cosine(" in registry.describe()
    row = spark.sql("select doc_node_id('表 a') n, doc_event_id('') e, doc_token_count('a b，字字') t, doc_cosine(array(1D, 0D), array(2D, 2D)) c, doc_cosine(array(0D), array(1D)) z, doc_clean_url(' http://x/. ') u").first()
    assert (row.n, row.e) == (str(uuid.uuid5(uuid.NAMESPACE_URL, "表 a")), str(uuid.uuid5(uuid.NAMESPACE_OID, "")))
    assert (row.t, round(row.c, 6), row.z, row.u) == (5, 0.707107, 0.0, "http://x/")


def test_pods_and_plans(spark):
    ev = spark.createDataFrame([("n", "a", "Pod"), ("n", "b", "Pod"), ("n", "a", "Job"), (None, "c", "Pod")], "namespace string, name string, obj_kind string")
    pods = spark.createDataFrame([("n", "a", [("c1", "Error", 1, None)], False), ("n", "b", None, True)], "namespace string, name string, statuses array<struct<name:string,terminated_reason:string,exit_code:int,waiting_reason:string>>, deleted boolean")
    got = {(r.name, r.obj_kind): (r.detail, r.short_state) for r in E.enrich_pods(ev, pods).collect()}
    assert got == {("a", "Pod"): ("[c1] Terminated: Error (ExitCode: 1)", "Error"), ("b", "Pod"): ("[Pod已删除]", "Deleted"), ("a", "Job"): ("", ""), ("c", "Pod"): ("", "")}
    plan = spark.createDataFrame([(("Retrieve", ["x", "y"], None, None, None),), (None,)], "p struct<action:string,search_queries:array<string>,tool_name:string,tool_args:string,final_answer:string>")
    assert [r.v for r in plan.select(M.plan_view(F.col("p")).alias("v")).collect()] == ["   - 动作类型: Retrieve\n   - Query 1: x\n   - Query 2: y", "None"]
