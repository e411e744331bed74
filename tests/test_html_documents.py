"""The HTML query over whole texts: every document's text reaches the converter, and every kind of element is at work."""

import re
from html import unescape

from docloom.plans import graph_queries as G

DIR = "/root/testdata/sf0.001"


def test_whole_texts_are_converted(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").filter("text is not null").collect()}
    got = {r.doc_id: r.markdown for r in G.html_documents(spark, DIR).collect()}
    assert set(got) == set(docs)
    squeeze = lambda t: re.sub(r"[\s]+", "", t)
    plain = [i for i, t in docs.items() if not re.search(r"[<>&]|```|-{3}|## 反馈|:---", t)]
    assert len(plain) > len(docs) / 4
    for i in plain:  # without markup the text comes out as it went in but for blanks
        assert squeeze(unescape(docs[i])) in squeeze(got[i]), i
    for i in plain:
        line = docs[i].split("\n")[0].strip()
        assert f"# T {i}\n" in got[i] and ":::alert alert-info" in got[i] and "\n---|---" in got[i] and f"```yaml\nname: {line}".rstrip() in got[i], got[i]
        assert re.search(f":::\n+## After {i}\n+moved\n", got[i]) and "`ab`" in got[i] and "* a<br> * b" in got[i] and "x<br>y" in got[i]
        assert "## Deep" in got[i] and "## Less deep" in got[i] and "**概要**" in got[i]
