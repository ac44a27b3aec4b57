"""The registered queries on the smallest tables, and main texts of whole pages."""

import html
import re
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from wardcast.llm import oracles, queries
from wardcast.llm.html_text import main_text

SF_DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")
PROSE = (
    "The quick brown fox and the lazy dog were in the garden for a long time, and they had all of it to "
    "themselves until it was dark and cold and the owner of the house came back with the keys. "
)


@tables
@pytest.mark.parametrize("name", sorted(oracles.all_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SF_DIR).toArrow(), con.sql(oracles.all_sql()[name]).to_arrow_table()
    assert {f.name: str(f.type) for f in ours.schema} == {f.name: str(f.type) for f in theirs.schema}
    rows = lambda t: sorted(zip(*[t[c].to_pylist() for c in sorted(t.column_names)]), key=str)
    assert rows(ours) == rows(theirs) and ours.num_rows > 0


@tables
def test_articles_are_found_whole(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    for r in queries.op7_html_text(spark, SF_DIR).collect():
        article = " ".join(re.findall("<article>(.*?)</article>", pages[r["page_id"]], re.S))
        plain = re.sub("</?(?:b|i|a|em|strong)>", "", re.sub("</?(?:p|h1|br|li|ul)>", " ", article))
        assert r["text"] == " ".join(html.unescape(plain).split())
        assert r["n_chars"] == len(r["text"])


@tables
def test_audit_query_finds_what_was_damaged(spark):
    import zlib

    ids = [r["page_id"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()]
    at = [zlib.crc32(str(i).encode()) % 50 for i in ids]
    kinds = [r["kind"] for r in queries.op3_fixity_audit(spark, SF_DIR).collect()]
    assert (kinds.count("changed"), kinds.count("missing"), kinds.count("added")) == (at.count(7), at.count(11), at.count(13))


@tables
def test_pipeline(spark):
    """Every stage takes effect on what the one before left."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    counts = []
    for name, function in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, function(spark, docs, SF_DIR).cache()
        counts.append(docs.count())
        assert docs.columns == before.columns
        if name == "mixing":
            assert counts[-1] < 2 * counts[-2]
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()}
        else:
            assert docs.exceptAll(before).isEmpty() and counts[-1] > 0
    records = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert sorted(r["slot"] for r in records.select("slot").collect()) == list(range(records.count()))


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<nav><a href=/>Home</a></nav><article><h1>T</h1><p>{PROSE}<p>Be.</article><footer>x</footer>", f"T {PROSE}Be."),
        (f"<header>Site</header><h1>Head</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p>", f"Head {PROSE}Short. {PROSE}"),
        (f"<p>{PROSE}</p><div id='comments'><p>{PROSE}</p></div>", PROSE),
        (f"<div class='cookie-notice'>{PROSE}</div><p>{PROSE}</p><aside>{PROSE}</aside><form>{PROSE}</form>", PROSE),
        (f"<article><p>a &amp; b&lt;c <span class=ad>x <span>y</span> z</span>d</p><p>{PROSE}</p></article>", f"a & b<c d {PROSE}"),
        (f"<script>if (a</p>b) '<p>'</script><style>p{{}}</style><!-- <p>no</p> --><p>{PROSE}", PROSE),
        (f"<p title='a>b'>{PROSE}</p>", PROSE),
        (f"<ul><li><a href=a>{PROSE}</a></li></ul><p>{PROSE}</p>", PROSE),
        ("", ""),
        (None, ""),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == " ".join(text.split())


@pytest.mark.parametrize(
    "page",
    [
        f"<html class=has-cookie-banner><body class='single right-sidebar'><p>{PROSE}</p></body></html>",
        f"<article aria-hidden='false'><p>{PROSE}</p></article>",
        f"<p title='hidden gems'>{PROSE}</p>",
        f"<p data-class=menu data-style='display:none'>{PROSE}</p>",
        f"<main id=search><article class='post comment share'><p>{PROSE}</p></article></main>",
        f"<div class='wrap with-sidebar sidebar-left'><p>{PROSE}</p></div>",
        f"<p>{PROSE}</p><div hidden>{PROSE}</div><div HIDDEN=''>{PROSE}</div><article style='display: none'>{PROSE}</article>",
        f"<p>{PROSE}</p><div id=right-sidebar>{PROSE}</div><div class='box sidebar'>{PROSE}</div><div class='a' role=search>{PROSE}</div>",
    ],
)
def test_marks_are_attributes_of_their_own_name(page):
    assert main_text(page) == " ".join(PROSE.split())


MENU = "<ul class=menu><li><a href=/>Home</a><li><a href=/a>About</a></ul>"
RUSSIAN = "Река поднималась целую неделю, и жители города устали ждать перемен. Утром они вышли посмотреть, что осталось от старого моста. "
FINNISH = "Joki oli ollut korkealla koko viikon ja kaupungin asukkaat olivat väsyneet odottamaan muutosta. Aamulla he lähtivät katsomaan mitä sillasta oli jäljellä. "
CHINESE = "河水已经涨了一个星期，城里的人们都很疲倦。早上他们出门去看，父辈们修建的那座桥还剩下什么。孩子们跟在后面，谁也没有说话。"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body>{MENU}<form id=aspnetForm><div><p>{PROSE}</p></div></form><footer>x</footer>", PROSE),
        (f"<body>{MENU}<form id=aspnetForm><article><p>{PROSE}</p></article><label>Search <input></label></form>", PROSE),
        (f"<article><p>{PROSE}</p><form><p>{PROSE}</p></form></article><form>{PROSE}</form>", PROSE),
        (f"<div class=content-sidebar-wrap><main><article><p>{PROSE}</p></article></main><div class=sidebar>{PROSE}</div></div>", PROSE),
        (f"<article><p>{PROSE}</p></article><div id=comments><article><p>{PROSE * 3}</p></article></div>", PROSE),
        (f"{MENU}<div><p>{RUSSIAN * 2}</p></div>", RUSSIAN * 2),
        (f"{MENU}<div><p>{FINNISH * 2}</p></div>", FINNISH * 2),
        (f"{MENU}<div><p>{CHINESE * 2}</p></div>", CHINESE * 2),
        (f"<article><p>{PROSE}<p class='notice-board-story'>{PROSE * 2}<p class='cookie-notice'>{PROSE * 2}</article>", PROSE * 3),
        (f"<article><p>{PROSE}</p><p>© {PROSE * 2}</p><p>© 2024 Firm</p></article>", f"{PROSE} © {PROSE * 2}"),
        (
            f"<article><p>{PROSE}<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>{{x}}</annotation></semantics>"
            "</math> holds.</p></article>", f"{PROSE}x=2 holds.",
        ),
    ],
)
def test_marks_do_not_empty_the_article(page, text):
    assert main_text(page) == " ".join(text.split())


def test_nested_marks_take_linear_time():
    for page in ("<div class=ad>x" * 30_000, "<article>x" * 30_000, "<form>x" * 30_000, "<main><div class=ad>x" * 15_000):
        main_text(page)


def test_attributes_take_linear_time():
    for own in ("a=\"b' " * 60_000, "a-" * 60_000, "no-" * 60_000, "a " * 60_000 + "=" + " " * 60_000):
        main_text(f"<div {own}>x</div><div class='{own}'>x</div><div class={own}>x</div>")


def test_broken_pages_take_linear_time():
    for page in ("<div>" * 30_000, "<a b='" * 30_000, "<p>a<" * 30_000, "<!--" * 30_000, "</p>" * 30_000, "<script>" * 30_000):
        main_text(page + "x")
