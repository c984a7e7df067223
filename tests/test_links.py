"""Links of Markdown, by the examples of its specification."""

import pytest

from mnemospark.functions.links import links, markdown_links

CASES = [
    ('[link](/uri "title")', [("/uri", "link")]),
    ("[link](/uri)", [("/uri", "link")]),
    ("[](./target.md)", [("./target.md", "")]),
    ("[link]()", [("", "link")]),
    ("[link](<>)", [("", "link")]),
    ("[link](/my uri)", []),
    ("[link](</my uri>)", [("/my uri", "link")]),
    ("[link](foo\nbar)", []),
    ("[a](<b)c>)", [("b)c", "a")]),
    (r"[link](<foo\>)", []),
    (r"[link](\(foo\))", [("(foo)", "link")]),
    ("[link](foo(and(bar)))", [("foo(and(bar))", "link")]),
    ("[link](foo(and(bar))", []),
    (r"[link](foo\(and\(bar\))", [("foo(and(bar)", "link")]),
    ("[link](<foo(and(bar)>)", [("foo(and(bar)", "link")]),
    ("[link](#fragment)", [("#fragment", "link")]),
    (r"[link](foo\bar)", [("foo\\bar", "link")]),
    ("[link](foo%20b&auml;)", [("foo%20bä", "link")]),
    ('[link]("title")', [('"title"', "link")]),
    ("[link](/url 'title')", [("/url", "link")]),
    ("[link](/url (title))", [("/url", "link")]),
    ('[link](/url "title "and" title")', []),
    ("[link] (/uri)", []),
    ("[link [foo [bar]]](/uri)", [("/uri", "link [foo [bar]]")]),
    ("[link] bar](/uri)", []),
    ("[link [bar](/uri)", [("/uri", "bar")]),
    (r"[link \[bar](/uri)", [("/uri", "link [bar")]),
    ("[link *foo **bar** `#`*](/uri)", [("/uri", "link foo bar #")]),
    ("[![moon](moon.jpg)](/uri)", [("/uri", "moon")]),
    ("[foo [bar](/uri)](/uri)", [("/uri", "bar")]),
    ("![[[foo](uri1)](uri2)](uri3)", [("uri1", "foo")]),
    ("[foo`](/uri)`", []),
    ("[foo<https://example.com/?search=](uri)>", [("https://example.com/?search=](uri)", "https://example.com/?search=](uri)")]),
    ('[foo][bar]\n\n[bar]: /url "title"', [("/url", "foo")]),
    ("[link [foo [bar]]][ref]\n\n[ref]: /uri", [("/uri", "link [foo [bar]]")]),
    ("[foo [bar](/uri)][ref]\n\n[ref]: /uri", [("/uri", "bar"), ("/uri", "ref")]),
    ("[foo][BaR]\n\n[bar]: /url", [("/url", "foo")]),
    ("[Foo\n  bar]: /url\n\n[Baz][Foo bar]", [("/url", "Baz")]),
    ("[foo] [bar]\n\n[bar]: /url", [("/url", "bar")]),
    ("[foo]: /url1\n\n[foo]: /url2\n\n[bar][foo]", [("/url1", "bar")]),
    ("[foo][]\n\n[foo]: /url", [("/url", "foo")]),
    ("[foo]\n\n[foo]: <my url>", [("my url", "foo")]),
    ("[foo](not a link)\n\n[foo]: /url1", [("/url1", "foo")]),
    ("[foo][bar][baz]\n\n[baz]: /url", [("/url", "bar")]),
    ("[foo][bar][baz]\n\n[baz]: /url1\n[bar]: /url2", [("/url2", "foo"), ("/url1", "baz")]),
    ("\\[foo]\n\n[foo]: /url", []),
    ("![foo][bar]\n\n[bar]: /url", []),
    ("<https://foo.bar.baz/test?q=hello&id=22>", [("https://foo.bar.baz/test?q=hello&id=22", "https://foo.bar.baz/test?q=hello&id=22")]),
    ("<foo@bar.example.com>", [("mailto:foo@bar.example.com", "foo@bar.example.com")]),
    ("<https://foo.bar/baz bim>", []),
    ("< https://foo.bar >", []),
    ("`[code](x)` and ``[a`b](y)``", []),
    ("```\n[code](x)\n```\n[out](y)", [("y", "out")]),
    ("~~~ md\n[code](x)\n~~\n~~~~\n[out](y)", [("y", "out")]),
    ("    [code](x)\n\ntext\n    [goes on](y)", [("y", "goes on")]),
    ("- [one](a)\n- [two](b)\n> [three](c)\n# [four](d)", [("a", "one"), ("b", "two"), ("c", "three"), ("d", "four")]),
    ("[open\n\n](x)", []),
    ('<a title="[x](y)">[in](z)</a>', [("z", "in")]),
    ("See [one](/memories/a.md), [`two`](b.md), and [web](https://example.com).", [("/memories/a.md", "one"), ("b.md", "two"), ("https://example.com", "web")]),
]


@pytest.mark.parametrize("text, want", CASES)
def test_links(text, want):
    assert markdown_links(text) == want


def test_links_as_a_column(spark):
    df = spark.createDataFrame([("[a](b) [c](d)",), (None,), ("",), ("[" * 3000 + "](x)" * 3,)], "body string")
    got = [[tuple(x) for x in r[0]] for r in df.select(links("body")).collect()]
    assert got[0] == [("b", "a", 0), ("d", "c", 1)] and got[1:3] == [[], []] and len(got[3]) == 1
