import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemospark.functions import text as X
from mnemospark.sources.documents import parse_document, render_document


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("body", "title", "description"),
    [
        ("Build cache: keep it on the shared volume", "Build cache", "keep it on the shared volume"),
        ("# Short heading\n- first point here", "Short heading", "first point here"),
        ("only a line", "only a line", None),
        ("Sub: too short a subject", "Sub: too short a subject", None),
        ("It failed. Reason here: the disk was full", "It failed. Reason here: the disk was full", None),
        ("x" * 130, None, "x" * 130),
        ("", None, None),
        (None, None, None),
    ],
)
def test_title_description(spark, body, title, description):
    got = one(spark, X.title_description, body)
    assert (got["title"], got["description"]) == (title, description)


def test_truncate_words(spark):
    assert one(spark, lambda c: X.truncate_words(c, 10), "short") == "short"
    assert one(spark, lambda c: X.truncate_words(c, 10), "hello, wonderful world") == "hello…"
    assert one(spark, lambda c: X.truncate_words(c, 10), "abcdefghijklmno") == "abcdefghij…"


def test_source_citations(spark):
    got = one(spark, X.source_citations, "see `src/a.rs`, (https://x.org/y). mod.rs src/a.rs /etc/.hidden.md docs/b.md! u://x/c.py src/data.bin")
    # marks around a token go first, then sentence ends; a mark inside those stays
    assert got == ["https://x.org/y)", "src/a.rs", "docs/b.md"]
    assert len(one(spark, X.source_citations, " ".join(f"d/f{i}.py" for i in range(20)))) == 8


def test_fences_amendments_and_idents(spark):
    assert one(spark, X.strip_code_fence, "```markdown\nbody\n```") == "body"
    assert one(spark, X.next_amendment, "x\n## Ammendment 3\ny\n## Ammendment 11\n") == 12
    assert one(spark, X.project_ident, "git@host.org:team/Repo.git") == "repo"
    assert one(spark, X.percent_encode, "a b/c~d*") == "a%20b%2Fc~d%2A"
    assert one(spark, lambda c: X.percent_decode(X.percent_encode(c)), "é+ 1%") == "é+ 1%"
    assert one(spark, X.first_present, '{"prompt": "  ", "input": "hi"}') == "hi"


def test_links(spark):
    got = one(spark, X.inline_links, "a [one](x.md) and ![img](y.png) <https://z.org> [`two`](/memories/abc.md#h)")
    assert [(r["target"], r["label"], r["ordinal"]) for r in got] == [("x.md", "one", 0), ("https://z.org", "https://z.org", 1), ("/memories/abc.md#h", "two", 2)]
    refs = {"/memories/abc.md#h": "abc", "../memories/q.md": "q", "memory://project/p/id1": "id1", "n.md?x": "n", "a/b.md": None, "https://z.org": None}
    for ref, want in refs.items():
        assert one(spark, X.reference_id, ref) == want


def test_segments_follow_headings():
    body = "# One\n" + "a" * 1400 + "\n## Two\n" + "b" * 2000
    got = X.segment_markdown(body)
    assert [(k, h, len(t)) for k, h, t in got] == [(0, "One", 1406), (1, "One / Two", 1600), (2, "One / Two", 407)]
    assert X.segment_markdown(None) == [] and X.segment_markdown("x") == [(0, None, "x")]


@given(st.text(alphabet="ab# \n", max_size=4000))
def test_segments_cover_the_body(body):
    got = X.segment_markdown(body)
    if len(body) <= X.SHORT_BODY:
        assert [t for *_, t in got] == [body]
    else:
        joined = "".join("".join(t for *_, t in got).split())
        assert joined == "".join(body.split())
        assert all(len(t) <= X.SEGMENT_CHARS for *_, t in got)


def test_porter_words():
    pairs = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "agreed": "agre", "happy": "happi", "sky": "sky", "adjustable": "adjust", "controll": "control", "naïve": "naiv", "generalizations": "gener"}
    assert {w: X.porter_words(w)[0] for w in pairs} == pairs


def test_documents_parse_and_render():
    text = "---\ntype: Agent Memory\ntitle: Größe\ntags: [b, a]\nowner: me\n---\nbody\n---\nmore"
    got = parse_document(text)
    assert (got["type"], got["title"], got["tags"], got["body"], got["error"]) == ("Agent Memory", "Größe", ["b", "a"], "body\n---\nmore", None)
    assert got["extensions"] == '{"owner": "me"}'
    again = parse_document(render_document(got))
    assert again == got
    for bad in (None, "no frontmatter", "---\ntype: x\nno end", "---\n- a\n---\n", "---\ntitle: x\n---\n", "---\na: &x [1]\nb: [" + "*x," * 70 + "]\ntype: t\n---\n", "---\ntype: [\n---\n", "---\nd: " + "[" * 40 + "]" * 40 + "\ntype: x\n---\n"):
        assert parse_document(bad)["error"]


def test_segments_break_at_newlines_only():
    body = "intro" + "x" * X.SHORT_BODY + "\u2028# no heading\x0c# none either\r\n# Heading\r\nown text"
    got = X.segment_markdown(body)
    assert [h for _, h, _ in got][-1] == "Heading" and "# no heading" in got[-2][2] and "# none either" in got[-2][2]
    assert all(h in (None, "Heading") for _, h, _ in got)


def test_only_64_kib_of_a_body_are_scanned(spark):
    rows = [("é" * 40_000 + "\nNext line",), (" \n" * 40_000 + "Late title",), ("Short\nline",), (None,)]
    got = [r["x"] for r in spark.createDataFrame(rows, "body string").select(X.title_description(F.col("body")).alias("x")).collect()]
    assert got[0]["title"] is None and got[0]["description"].startswith("é")
    assert (got[1]["title"], got[1]["description"]) == (None, None) and (got[2]["title"], got[2]["description"]) == ("Short", "line")
