"""Every operator on odd rows and on an empty table: no crash, a row for each document, and the stated results."""

import pytest

from ledgerline.llm import chat, decontam, lm, matroska, mixing, quality, simhash, token_count, urls, wavelet

N = 54


def bench(spark, rows=((1, "one two three"), (2, None), (None, "w1 w2"), (3, ""), (1, "four five"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def labels(spark, n=40):
    return spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(n)] + [(None, 1, 0), (3, None, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")


PER_DOCUMENT = {
    "simhash": simhash.near_duplicates,
    "media": matroska.store_and_digest,
    "tokens": wavelet.tokenize,
    "counts": token_count.count_tokens,
    "mixing": mixing.mix_report,
    "lm": lm.score,
    "decontamination": lambda d: decontam.contamination(d, bench(d.sparkSession)),
    "quality": lambda d: quality.score(d, quality.fit(d, labels(d.sparkSession))),
}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_odd_documents(name, odd_docs):
    rows = PER_DOCUMENT[name](odd_docs).collect()
    assert len(rows) == odd_docs.count() == N
    assert sum(r.doc_id is None for r in rows) == 2


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_no_documents(name, no_docs):
    assert PER_DOCUMENT[name](no_docs).collect() == []


FILTERS = {
    "decontaminate": lambda d: decontam.decontaminate(d, bench(d.sparkSession)),
    "cut": lambda d: decontam.decontaminate(d, bench(d.sparkSession), remove="spans"),
    "no items": lambda d: decontam.decontaminate(d, bench(d.sparkSession, [(1, None)])),
    "one of each": simhash.one_of_each,
    "keep good": lambda d: quality.keep_good(d, quality.fit(d, labels(d.sparkSession))),
    "mix": mixing.mix,
}


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns(name, odd_docs, no_docs):
    out = FILTERS[name](odd_docs)
    assert out.columns == odd_docs.columns and out.dtypes == odd_docs.dtypes
    assert {tuple(r) for r in out.drop("text").collect()} <= {tuple(r) for r in odd_docs.drop("text").collect()}
    assert FILTERS[name](no_docs).collect() == []


def test_one_of_each_on_odd_documents(odd_docs):
    kept = simhash.one_of_each(odd_docs).collect()
    ids = [r.doc_id for r in kept]
    # Wordless texts are copies of one another; 1, 104 (twice) and 105 differ in case alone; 5 came twice.
    assert ids.count(1) == 1 and 104 not in ids and 105 not in ids and ids.count(5) == 1
    assert [i for i in ids if i in (100, 101, 102)] == [100]
    assert ids.count(None) == 1  # "no id here"; the null text is a copy of 100's


def test_urls_of_any_kind(spark):
    pages = spark.createDataFrame(
        [(1, None, None), (2, "", ""), (3, "no scheme", "x"), (4, "HTTP://WWW.Example.COM/en/a?b#c", None), (4, "HTTP://WWW.Example.COM/en/a?b#c", None), (None, "http://x.net/fr/", "<html>"), (6, "://", ""), (7, "http://example.com", "")],
        "page_id long, url string, html string",
    )
    rows = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert rows == {
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "www.example.com", "/en/a", "www.example.com/en/", "allow"),
        (None, "x.net", "/fr/", "net/fr/", "block"), (6, "", "", None, "allow"), (7, "example.com", "", None, "allow"),
    }
    assert urls.judge(pages).count() == 8
    assert urls.judge(pages.limit(0)).collect() == []


def test_chats_of_any_kind(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (4, 0, "user", None), (5, 0, "user", ""), (None, 0, "user", "n"), (6, None, None, None), (7, 0, "user", "a"), (7, 0, "user", "a")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.n_turns, r.n_copies, r.text) for r in chat.format_chats(c).collect()}
    assert got == {
        (1, 2, 2, "<|user|>\na\n<|bot|>\nb\n"), (4, 1, 1, "<|user|>\n\n"), (5, 1, 1, "<|user|>\n\n"), (None, 1, 1, "<|user|>\nn\n"), (6, 1, 1, "<||>\n\n"), (7, 2, 1, "<|user|>\na\n<|user|>\na\n"),
    }
    assert chat.format_chats(c.limit(0)).collect() == []
    assert {(r.conv_id, r.n_turns, r.n_copies) for r in chat.maximal(c).collect()} == {g[:3] for g in got}


def test_chat_turns_that_differ_in_text_alone(spark):
    """Turns of one number and role stand in order of their texts, so the shorter conversation is a prefix of the longer one if its turn comes first."""
    for one, two in (("a", "b"), ("b", "a"), ("x", "xx"), ("B", "a")):
        c = spark.createDataFrame([(1, 0, "user", one), (2, 0, "user", one), (2, 0, "user", two)], "conv_id long, turn long, role string, text string")
        assert {r.conv_id for r in chat.format_chats(c).collect()} == ({2} if one < two else {1, 2})


def test_a_chat_of_very_many_turns_and_clashing_columns(spark):
    turns = spark.range(30_000).selectExpr("1L as conv_id", "id as turn", "'user' as role", "'t' as text", "0 as k", "'x' as n", "1.5 as h0", "'y' as length", "7L as id")
    some = turns.where("turn < 29000").withColumn("conv_id", turns["conv_id"] + 1)
    rows = chat.format_chats(turns.union(some)).collect()
    assert [(r.conv_id, r.n_turns, len(r.text)) for r in rows] == [(1, 30_000, 30_000 * len("<|user|>\nt\n"))]


def test_url_pages_with_clashing_columns_and_long_urls(spark):
    long_ = "http://a.net/fr/" + "x" * 100_000
    pages = spark.createDataFrame([(1, long_, None, "h", "r", "k"), (2, None, None, "h", "r", "k")], "page_id long, url string, html string, host string, rule string, key string")
    assert {(r.page_id, r.host, len(r.path), r.verdict) for r in urls.judge(pages).collect()} == {(1, "a.net", 100_004, "block"), (2, "", 0, "allow")}
    many = spark.createDataFrame([("block", "net", f"/{i}") for i in range(300)] + [("allow", "a.net", "/17/")], "action string, host string, path string")
    asked = spark.createDataFrame([(i, f"http://a.net/{i}/p", None) for i in range(30)], "page_id long, url string, html string")
    got = {r.page_id: r.rule for r in urls.judge(asked, many).collect()}
    assert got == {i: "a.net/17/" if i == 17 else f"net/{i}" for i in range(30)}


def test_links_of_many_kinds(spark):
    from pyspark.sql import functions as F

    rows = [("/a/../b/./c", "/b/c"), ("../x", "/d/x"), ("y?p=/../q", "/d/e/y"), ("?q=1&amp;r=2", "/d/e/f"), ("..", "/d/"), ("/..", "/"), ("./", "/d/e/"), ("#top", "/d/e/f")]
    df = spark.createDataFrame([(k,) for k, _ in rows], "link string")
    made = df.select(urls._absolute(F.col("link"), F.lit("https://Site.org/d/e/f?z")).alias("to"), "link").select("link", urls.path_of(F.col("to")).alias("path"), urls.key_of(F.col("to")).alias("key")).collect()
    assert [(r.link, r.path) for r in made] == rows
    assert [r.key for r in made if r.link.startswith("?")] == ["site.org/d/e/f?q=1&r=2"]


def test_other_ways_beyond_broadcasts(spark, monkeypatch, odd_docs):
    """The ways that tables take which are too large to broadcast give the same rows."""
    plain = lambda df: sorted(map(repr, df.collect()))
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.net/{'fr' if i % 2 else 'x'}/{i}", None) for i in range(40)] + [(99, None, None)], "page_id long, url string, html string")
    asked = {
        "mixing": lambda: mixing.mix_report(odd_docs),
        "decontamination": lambda: decontam.contamination(odd_docs, bench(spark)),
        "urls": lambda: urls.judge(pages),
        "near-dedup": lambda: simhash.one_of_each(odd_docs).select("doc_id"),
    }
    want = {name: plain(f()) for name, f in asked.items()}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    for module in (decontam, urls, simhash):
        monkeypatch.setattr(module, "MAX_BROADCAST", 0)
    for name, f in asked.items():
        assert plain(f()) == want[name], name
