"""Landed pages: markup to raw items, raw items to entries; broken and empty pages."""

from glyphmill.operators import pages
from glyphmill.sources.files import page_links

PAGE = """<html><h2>Functions</h2>
<div class="x reference-item" id="lib-foo"><h3 class="reference-item__header">lib.foo(src, n) → int</h3><div class="reference-item__content">
<div class="reference-item__syntax">lib.foo(src, n) → int</div><div class="reference-item__syntax">lib.foo(src) → int</div>
<p>First &lt;b&gt; <b>text</b>.<br>More.</p><div class="reference-item__text"> </div>
<div class="reference-item__sub-header">Arguments</div><p>src (series float) The source.</p><p>n (int) Optional. Default is 14.</p><p>not a parameter</p>
<div class="reference-item__sub-header">Returns</div><p>An int.</p><p>Or na.</p>
<div class="reference-item__sub-header">Remarks</div><p>It is obsolete.</p>
<pre class="reference-item__example"><code> x = lib.foo(a &amp; b)
</code></pre>
<div class="reference-item__sub-header">See also</div><div class="reference-item__see-also"><a href="/ref/#fun_lib.bar"> lib.bar </a><a href="#"></a></div>
</div></div>
<div class="reference-item" id="type_pt"><h3 class="reference-item__header">pt&lt;T&gt;</h3><div class="reference-item__content"><div class="reference-item__sub-header">Fields</div><p>x (float) Across</p>
<div class="reference-item__sub-header">Methods</div><p>pt.move(x)</p><p>no method</p></div></div>
<h2></h2><div class="reference-item"><h3 class="reference-item__header">hline</h3><div class="reference-item__content"></div></div>
<div class="reference-item"><h3 class="reference-item__header">nowhere</h3><div class="reference-item__content"></div></div>
<div class="reference-item"><h3 class="reference-item__header"></h3><div class="reference-item__content"><p>lost</div>"""


def read(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "page_id bigint, html string")
    index = spark.createDataFrame([("fun_hline", "hline()", "function"), ("x", "nowhere", "unknown")], "fragment string, display_name string, category string")
    return pages.entries_of(pages.raw_items(df), index, "https://h.example/")


def test_page_entries(spark):
    got = {r.name: r for r in read(spark, PAGE).collect()}
    assert set(got) == {"lib.foo", "pt", "hline"}
    foo = got["lib.foo"]
    assert (foo.category, foo.namespace, foo.id, foo.url) == ("function", "lib", "fun_lib.bar", "https://h.example/#fun_lib.bar")  # the first anchor of the item tells the fragment
    assert (foo.syntax, foo.overloads, foo.description) == ("lib.foo(src, n) → int", ["lib.foo(src) → int"], "First <b> text.More.")
    assert [(p.name, p.type, p.optional, p.default) for p in foo.parameters] == [("src", "series float", False, None), ("n", "int", True, "14")]
    assert (foo.returns, foo.remarks, foo.deprecated, foo.examples, foo.see_also) == ("An int.\nOr na.", "It is obsolete.", True, ["x = lib.foo(a & b)"], ["lib.bar"])
    assert (got["pt"].category, [tuple(f) for f in got["pt"].type_fields], got["pt"].type_methods, got["pt"].description) == ("type", [("x", "float", "Across")], ["pt.move"], None)
    assert (got["hline"].category, got["hline"].id, got["hline"].url, got["hline"].deprecated) == ("function", "function_hline", None, False)


def test_odd_pages(spark):
    assert read(spark, None, "", "no markup", "<div", "<h2>Functions</h2><div class='reference-item'>").count() == 0
    nested = '<h2>types</h2><div class="reference-item"><h3 class="reference-item__header">a</h3><div class="reference-item__content"><div class="text"><div><p>in <i>deep</i></p></div></div>' + "<div>" * 3000
    assert [(r.name, r.description) for r in read(spark, nested).collect()] == [("a", "in deep")]


def test_links_are_unescaped(spark):
    df = spark.createDataFrame([("""<a href="r#op_&lt;"><b>&lt;=</b></a><a href='r#fun_a.b'>a.b()</a><a href="r#zzz">z</a>""",), (None,), ("",)], "html string")
    assert {(r.display_name, r.category, r.namespace) for r in page_links(df).collect()} == {("<=", "operator", None), ("a.b()", "function", "a")}
