"""Readers of format subsets: fields with offsets, refusals, rewriting."""

import pytest

from veilspan.operators import subsets


@pytest.mark.parametrize(("format_", "text", "fields"), [
    ("YAML", "a:\n  b: 1 # c\n  list:\n    - x\n    - k: 'v w'\nd: \"q\"", {"a.b": "1", "a.list.0": "x", "a.list.1.k": "v w", "d": "q"}),
    ("TOML", "t = 1\n[a.b]\nk = \"v\" # c\nx.y = true", {"t": "1", "a.b.k": "v", "a.b.x.y": "true"}),
    ("XML", "<?xml version='1.0'?><a x=\"1\"><b> t </b><c y='2'/></a>", {"a.@x": "1", "a.b": "t", "a.c.@y": "2"}),
    ("CONNECTION_STRING", "Server=db;User Id=sa;Password={a;b};", {"Server": "db", "User Id": "sa", "Password": "a;b"}),
    ("JSON", '{"a": ["x", 2]}', {"a.0": "x", "a.1": "2"}),
])
def test_fields_have_their_place(format_, text, fields):
    status, why, got = subsets.read(text, format_)
    assert (status, why) == ("COMPLETE", []) and {".".join(f[0]): f[1] for f in got} == fields
    assert all(text[f[2] : f[3]] == f[1] for f in got)


@pytest.mark.parametrize(("format_", "text", "status"), [
    ("YAML", "a: &x 1", "UNSUPPORTED"), ("YAML", "a: 1\na: 2", "FAILURE"), ("YAML", "\ta: 1", "FAILURE"), ("TOML", "a = [1]", "UNSUPPORTED"), ("TOML", "a = 1\na = 2", "FAILURE"), ("TOML", "a", "FAILURE"),
    ("XML", "<!DOCTYPE a><a/>", "UNSUPPORTED"), ("XML", "<a>t<b/></a>", "UNSUPPORTED"), ("XML", "<a><b></a>", "FAILURE"), ("CONNECTION_STRING", "a", "FAILURE"), ("JSON", None, "FAILURE"),
])
def test_refusals(format_, text, status):
    assert subsets.read(text, format_)[0] == status and subsets.read(text, format_)[2] == []


def test_rewrite_changes_only_its_field(spark):
    text = '{"user": "bob", "n": 1}'
    assert subsets.rewritten(text, "JSON", {("user",): 'a"b'}) == ("COMPLETE", '{"user": "a\\"b", "n": 1}')
    assert subsets.rewritten(text, "JSON", {("n",): "x"})[0] == "UNSUPPORTED" and subsets.rewritten(text, "JSON", {("z",): "x"})[0] == "FAILURE"
    assert subsets.rewritten("a: b\nc: d", "YAML", {("c",): "e f"}) == ("COMPLETE", "a: b\nc: e f")
    texts = spark.createDataFrame([(1, text), (2, "{}")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, ["user"], "eve")], "doc_id long, path array<string>, replacement string")
    assert sorted((r.doc_id, r.text) for r in subsets.rewrite(texts, "JSON", edits).collect()) == [(1, '{"user": "eve", "n": 1}'), (2, "{}")]
    assert subsets.fields(texts, "JSON").count() == 3
