"""Rules on literal inputs: small documents, pages and records, held against rows that the rules give when worked out by hand.

Queries over the tables run the same operators; these cover what SQL can't derive from the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import html, text as T, tree
from docloom.operators import events as E, messages as M, retrieval as R

_W = lambda word, n: " ".join([word] * n)
_HEAD = "h\nh\nh\nh\n"
#: name, text; parsed with sizes 4, 12 and 20
_DOCUMENTS = (
    ("shape", f"top [HLINK: u/a]\nh\nh\nh\nintro\n# One [HLINK: u/a#one]\n{_W('a', 13)}\n## Sub\n{_W('b', 12)} [ANCHOR: to b, HLINK: u/b]\n# One\n```\n# no heading\n```\n{_W('c', 11)}\n### skipped\nd\n# 接下来\nread [ANCHOR: more, HLINK: u/c]\n# 另请参见\nrest"),
    ("merged", f"{_HEAD}# P\np\n# Q\nq\n# R\n{_W('r', 14)}\n# S\ns"),
    ("long", f"{_HEAD}# L\n{_W('k', 9)}\n**First**\n{_W('l', 12)}\n**Second**\n{_W('m', 12)}\n\\--flag x\n{_W('n', 12)}\n"),
    ("sentences", f"{_HEAD}# Z\n{_W('sun', 8)}. {_W('sun', 8)}. {_W('moon', 8)}. {_W('moon', 8)}."),
    ("child", f"{_HEAD}# Outer\no\n## Inner\ni\n# Next\n{_W('n', 14)}"),
    ("api", f"{_HEAD}# Api\n## Get it\n### HTTP 请求\nGET\n### 响应\nok\n## Put it\n### HTTP Request\nPUT"),
    ("empty", ""),
    ("short", "only\nthree\nlines"),
)
#: title, parent's title, type, level, tokens, from_split, merged, text, left title, right title, urls, links, navigation
_NODES = (
    ("shape", "", "root", 0, 4, False, False, "top \nh\nh\nhintro", "", "", "u/a", "more>u/c", "read more|rest"),
    ("shape_One", "shape", "section", 1, 15, False, False, "# One " + _W("a", 13), "", "shape_One_2", "u/a#one", "", "|"),
    ("shape_One_Sub", "shape_One", "leaf", 2, 17, False, False, "## Sub " + _W("b", 12) + " to b", "", "", "", "to b>u/b", "|"),
    ("shape_One_2", "shape", "container", 1, 0, False, False, "# One", "shape_One", "", "", "", "|"),
    ("shape_One_2_part1", "shape_One_2", "leaf", 2, 27, True, False, "# One ``` # no heading ``` " + _W("c", 11) + " ### skipped d", "", "", "", "", "|"),
    ("merged", "", "root", 0, 4, False, False, "h\nh\nh\nh", "", "", "", "", "|"),
    ("merged_P~Q", "merged", "leaf", 1, 6, False, True, "# P p\n# Q q", "", "merged_R", "", "", "|"),
    ("merged_R", "merged", "leaf", 1, 16, False, False, "# R " + _W("r", 14), "merged_P~Q", "merged_S", "", "", "|"),
    ("merged_S", "merged", "leaf", 1, 3, False, False, "# S s", "merged_R", "", "", "", "|"),
    ("long", "", "root", 0, 4, False, False, "h\nh\nh\nh", "", "", "", "", "|"),
    ("long_L", "long", "container", 1, 0, False, False, "# L", "", "", "", "", "|"),
    ("long_L_part1", "long_L", "leaf", 2, 11, True, False, "# L " + _W("k", 9), "", "", "", "", "|"),
    ("long_L_part2", "long_L", "leaf", 2, 17, True, False, "**First** " + _W("l", 12), "", "", "", "", "|"),
    ("long_L_part3", "long_L", "leaf", 2, 17, True, False, "**Second** " + _W("m", 12), "", "", "", "", "|"),
    ("long_L_part4", "long_L", "leaf", 2, 17, True, False, "\\--flag x " + _W("n", 12), "", "", "", "", "|"),
    ("sentences", "", "root", 0, 4, False, False, "h\nh\nh\nh", "", "", "", "", "|"),
    ("sentences_Z", "sentences", "container", 1, 0, False, False, "# Z", "", "", "", "", "|"),
    ("sentences_Z_part1", "sentences_Z", "leaf", 2, 20, True, False, f"# Z {_W('sun', 8)}. {_W('sun', 8)}.", "", "", "", "", "|"),
    ("sentences_Z_part2", "sentences_Z", "leaf", 2, 18, True, False, f"{_W('moon', 8)}. {_W('moon', 8)}.", "", "", "", "", "|"),
    ("child", "", "root", 0, 4, False, False, "h\nh\nh\nh", "", "", "", "", "|"),
    ("child_Outer", "child", "leaf", 1, 7, False, False, "# Outer o\n## Inner i", "", "child_Next", "", "", "|"),
    ("child_Next", "child", "leaf", 1, 16, False, False, "# Next " + _W("n", 14), "child_Outer", "", "", "", "|"),
    ("api", "", "root", 0, 4, False, False, "h\nh\nh\nh", "", "", "", "", "|"),
    ("api_Api", "api", "section", 1, 2, False, False, "# Api", "", "", "", "", "|"),
    ("api_Api_Get it", "api_Api", "leaf", 2, 19, False, False, "## Get it **HTTP 请求** GET **响应** ok", "", "api_Api_Put it", "", "", "|"),
    ("api_Api_Put it", "api_Api", "leaf", 2, 10, False, False, "## Put it\n### HTTP Request PUT", "api_Api_Get it", "", "", "", "|"),
    ("empty", "", "root", 0, 0, False, False, "", "", "", "", "", "|"),
    ("short", "", "root", 0, 3, False, False, "only\nthree\nlines", "", "", "", "", "|"),
)


def tree_cases(spark, d):
    """Nodes of documents that show each rule of the tree parser."""
    docs = spark.createDataFrame([(n, n, t) for n, t in _DOCUMENTS], "source string, name string, text string")
    nodes = tree.parse_documents(docs, 4, 12, 20)
    title = nodes.select(F.col("pk").alias("k"), F.col("title").alias("t"))
    for c in ("parent_id", "left_sibling", "right_sibling"):
        nodes = nodes.join(title.withColumnsRenamed({"k": c, "t": f"{c}_title"}), c, "left")
    named = lambda c: F.coalesce(f"{c}_title", F.lit("")).alias(c)
    links = F.array_join(F.transform(F.map_entries("outlinks"), lambda e: F.concat(e["key"], F.lit(">"), F.array_join(e["value"], " "))), ",")
    return nodes.select("title", named("parent_id"), "node_type", "level", "token_count", "from_split", "merged", "text", named("left_sibling"), named("right_sibling"), F.array_join("entry_urls", " ").alias("urls"), links.alias("links"), F.concat_ws("|", "nav_next_step", "nav_see_also").alias("nav"))


#: name, header document, what becomes of it
_HEADERS = (
    ("three parts", "## Make\n### HTTP 请求\na\n### 参数\nb\n### 响应\nc", "## Make\n**HTTP 请求**\na\n**参数**\nb\n**响应**\nc"),
    ("deeper opening", "## Ops\n### List\n#### Parameters\n#### Response\n### Watch\n#### Parameters", "## Ops\n### List\n**Parameters**\n**Response**\n### Watch\n#### Parameters"),
    ("one kind", "## Make\n### HTTP 请求\n### HTTP 参数", "## Make\n### HTTP 请求\n### HTTP 参数"),
    ("marks in names", "## A\n### **`参数`**\n### `响应`", "## A\n****`参数`****\n**`响应`**"),
    ("keyword of the same level stays inside", "## A\n## 参数\n## 响应\n## B", "## A\n**参数**\n**响应**\n## B"),
    ("no exact name", "## A\n### 参数说明\n### Response body", "## A\n### 参数说明\n### Response body"),
    ("level one opens nothing", "# A\n# 参数\n# 响应", "# A\n# 参数\n# 响应"),
    ("two blocks", "## A\n### HTTP\n### Response\n## B\n### HTTP\n### Response", "## A\n**HTTP**\n**Response**\n## B\n**HTTP**\n**Response**"),
)


def header_cases(spark, d):
    """Headers of interface descriptions that become bold lines."""
    demote = F.pandas_udf(lambda texts: texts.map(tree.demote_api_headers), "string")
    return spark.createDataFrame([(n, t) for n, t, _ in _HEADERS], "name string, text string").select("name", demote("text").alias("text"))


_PAGE = lambda body: f"<html><head><title>T | Kubernetes</title></head><body><main>{body}</main></body></html>"
_TOP = "# T\n[HLINK: https://h.test/d/p/]\n"
#: name, page, Markdown
_PAGES = (
    ("noise", _PAGE("<div class='toolbar'>bar</div><div id='third-party-content-disclaimer'>ad</div><div class='pagehead'>ph</div><p>kept</p><h2>反馈</h2><p>asked</p>"), _TOP + "\n\nkept\n\n"),
    ("breadcrumb", _PAGE("<nav><ol><li><a href='/d'>Docs</a></li><li><a href='/d/x'>Part</a></li></ol></nav><p>x</p>"), _TOP + "Docs / Part\n\nx\n"),
    ("alert", _PAGE("<div class='alert alert-warning'><h4>Mind</h4><p>this <b>now</b></p></div><p>after</p>"), _TOP + "\n\n\n:::alert alert-warning\n#### Mind\n\nthis **now**\n:::\n\n\nafter\n"),
    ("code", _PAGE("<pre><code data-lang='yaml'>a: 1\nb:  2</code></pre><p>end</p>"), _TOP + "\n\n\n```yaml\na: 1\nb:  2\n```\nend\n"),
    ("table", _PAGE("<table><tr><th>K</th><th>V</th></tr><tr><td>a<br>b</td><td><ul><li>p</li><li>q</li></ul></td></tr><tr><td><pre>l1\nl2</pre></td><td>c</td></tr></table>"), _TOP + "\n\nK| V \n---|---\na<br>b| * p<br> * q \nl1<br>l2| c \n"),
    ("nested code", _PAGE("<p>Use <code>a<code>b</code>c</code> and <tt></tt>d</p>"), _TOP + "\n\nUse `abc` and d\n"),
    ("markers", _PAGE("<h2 id='one'>One</h2><p>Go <a href='/n#f'>there</a>, <a href='mailto:x@y'>mail</a>, <a href='#one'>up</a></p>"), _TOP + "\n\n## One [HLINK: https://h.test/d/p/#one]\n\nGo [ANCHOR: there, HLINK: https://h.test/n#f], mail, [ANCHOR: up, HLINK: https://h.test/d/p/#one]\n"),
    ("misnested", _PAGE("<div class='alert alert-info'><p>in</p><h2>Out</h2><p>moved</p></div><p>last</p>"), _TOP + "\n\n\n:::alert alert-info\nin\n:::\n\n\n## Out\n\nmoved\n\nlast\n"),
    ("headers", _PAGE("<h1>A</h1><h4>B</h4><h3>C</h3><h5>概要</h5><h6>D</h6>"), _TOP + "\n\n# A\n\n## B\n\n## C\n\n**概要**\n\n#### D\n"),
    ("no content", "<html><body><p>x</p></body></html>", ""),
    ("nothing", None, ""),
)


def html_cases(spark, d):
    """Pages that show each rule of the conversion."""
    pages = spark.createDataFrame([(n, p) for n, p, _ in _PAGES], "name string, page string")
    return pages.select("name", html.convert_column(F.col("page"), F.lit("https://h.test/d/p/")).alias("markdown"))


_STATE = "array<struct<name:string,terminated_reason:string,exit_code:int,waiting_reason:string>>"
#: container states; detail, short form
_PODS = (
    ([("a", "Error", 1, None), ("b", None, None, "BackOff"), ("c", "OOMKilled", 137, None), ("d", "Error", 2, None)], "[a] Terminated: Error (ExitCode: 1) | [b] Waiting: BackOff | [c] Terminated: OOMKilled (ExitCode: 137) | [d] Terminated: Error (ExitCode: 2)", "Error/OOMKilled"),
    ([("a", None, None, "BackOff"), ("b", "Error", 1, None)], "[a] Waiting: BackOff | [b] Terminated: Error (ExitCode: 1)", "BackOff/Error"),
    ([("a", None, None, None)], "", ""),
    ([], "", ""),
)


def pod_cases(spark, d):
    rows = spark.createDataFrame([(i, s) for i, (s, *_) in enumerate(_PODS)], f"case_no int, s {_STATE}")
    detail, short = E.pod_state(F.col("s"))
    return rows.select("case_no", detail.alias("detail"), short.alias("short_state"))


def view_cases(spark, d):
    """Text views of plans, analyses and evaluations."""
    plans = spark.createDataFrame([("retrieve", ("Retrieve", ["x", "y"], None, None, None)), ("tool", ("Tool_Use", None, "get", "{}", None)), ("answer", ("Direct_Answer", None, None, None, "done")), ("none", None)], "name string, p struct<action:string,search_queries:array<string>,tool_name:string,tool_args:string,final_answer:string>")
    checks = spark.createDataFrame([("check", ("pass", "well")), ("no check", None)], "name string, e struct<status:string,feedback:string>")
    return plans.select("name", M.plan_view(F.col("p")).alias("view")).unionByName(checks.select("name", M.evaluation_view(F.col("e")).alias("view")))


def matrix_cases(spark, d):
    """Rows of compressed sparse matrices as maps, in long form."""
    m = spark.createDataFrame([(1, [0, 2, 2, 3], [5, 7, 1], [0.5, 0.25, 1.0]), (2, [0], [], [])], "matrix int, p array<int>, i array<int>, d array<double>")
    rows = m.select("matrix", F.posexplode(R.csr_maps(F.col("p"), F.col("i"), F.col("d"))).alias("line", "m"))
    return rows.select("matrix", "line", F.explode("m").alias("term", "weight"))


def decode_cases(spark, d):
    """Bytes of files as text: UTF-8, else the fallback code page."""
    rows = spark.createDataFrame([("utf8", "表 é".encode()), ("latin", "é".encode("latin-1")), ("empty", b"")], "name string, b binary")
    return rows.select("name", T.utf8("b").alias("text"))


QUERIES = {f.__name__: f for f in (tree_cases, header_cases, html_cases, pod_cases, view_cases, matrix_cases, decode_cases)}


def _literal(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v).lower() if isinstance(v, bool) else "NULL" if v is None else str(v)


def _values(names: str, rows) -> str:
    """SQL that gives the rows; names in quotes where SQL has another use for them."""
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") t({names})"


SQL = {
    "tree_cases": _values('title, parent_id, node_type, "level", token_count, from_split, merged, "text", left_sibling, right_sibling, urls, links, nav', _NODES),
    "header_cases": _values('name, "text"', [(n, x) for n, _, x in _HEADERS]),
    "html_cases": _values("name, markdown", [(n, x) for n, _, x in _PAGES]),
    "pod_cases": _values("case_no, detail, short_state", [(i, x, y) for i, (_, x, y) in enumerate(_PODS)]),
    "view_cases": _values('name, "view"', [
        ("retrieve", "   - 动作类型: Retrieve\n   - Query 1: x\n   - Query 2: y"), ("tool", "   - 动作类型: Tool_Use\n   - 调用工具: get\n   - 工具参数: {}"), ("answer", "   - 动作类型: Direct_Answer\n   - 最后回答: done"), ("none", "None"),
        ("check", "   - 评估状态: pass\n   - 反馈信息: well"), ("no check", "None")]),
    "matrix_cases": _values("matrix, line, term, weight", [(1, 0, 5, 0.5), (1, 0, 7, 0.25), (1, 2, 1, 1.0)]).replace("SELECT *", "SELECT matrix, line, term, weight::DOUBLE AS weight"),
    "decode_cases": _values('name, "text"', [("utf8", "表 é"), ("latin", "é"), ("empty", "")]),
}
