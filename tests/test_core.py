"""Functions and operators of the core on hand-made rows and against plain-Python models."""

import random
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from libranta.functions import text
from libranta.operators import dedup, docs, enrich, graph, pages, search
from libranta.plans import queries as plans
from libranta.sources import parsers
from libranta.streaming import state

PAPER = "seq long, id string, title string, doi string, year int, abstract string, authors array<string>, university string, pdf_url string, url string, handle_url string, citation_count long, matched_query string"


def paper(seq, **more):
    row = dict(seq=seq, id=f"i{seq}", title=None, doi=None, year=None, abstract=None, authors=None, university=None, pdf_url=None, url=None, handle_url=None, citation_count=None, matched_query="q") | more
    return tuple(row.values())


def kept(spark, rows):
    return sorted(r["seq"] for r in dedup.search_dedup(spark.createDataFrame(rows, PAPER)).collect())


def test_greedy_dedup_is_not_transitive(spark):
    assert kept(spark, [paper(1, doi="d1", title="t1 one"), paper(2, doi="d1", title="t2 two"), paper(3, doi="d2", title="t2 two")]) == [1, 3]
    assert kept(spark, [paper(1, doi="d1", title="t1 one"), paper(2, doi="d2", title="t1 one"), paper(3, doi="d2", title="t3 three")]) == [1, 3]


def test_greedy_dedup_edges(spark):
    assert kept(spark, [paper(1, title="数据集")]) == []
    assert kept(spark, [paper(1, title="Sin título"), paper(2, title="Sin titulo")]) == [1]
    assert kept(spark, [paper(1, doi="https://doi.org/10.1/x", title="a"), paper(2, doi="10.1/x", title="b")]) == [1, 2]
    assert dedup.search_dedup(spark.createDataFrame([], PAPER)).count() == 0


def test_greedy_dedup_against_model(spark):
    rng = random.Random(3)
    rows = [paper(i, doi=rng.choice([None, *[f"d{k}" for k in range(25)]]), title=f"title {rng.randrange(30)}", matched_query=f"q{rng.randrange(3)}", id=f"i{rng.randrange(90)}") for i in range(150)]
    want, seen = set(), {}
    for r in sorted(rows):
        d1, d2, uid = seen.setdefault(r[12], (set(), set(), set()))
        k1, k2 = r[3] or "", r[2]
        if (k1 and k1 in d1) or k2 in d2:
            continue
        d1.add(k1)
        d2.add(k2)
        if r[1] not in uid:
            want.add(r[0])
        uid.add(r[1])
    assert set(kept(spark, rows)) == want


def test_batch_dedup(spark):
    rows = [paper(1, doi="https://doi.org/10.1/x", matched_query="a"), paper(2, doi="10.1/X", university="u", matched_query="b"), paper(3, title="short", id="z"), paper(4, id=""), paper(5, title="a long enough title", year=2001)]
    got = {r["key"]: (r["winner"], r["first"], r["queries"]) for r in dedup.batch_dedup(spark.createDataFrame(rows, PAPER)).collect()}
    assert got == {"doi:10.1/x": (2, 1, "a|b"), "id:z": (3, 3, "q"), "title:a long enough title:2001": (5, 5, "q")}


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    root = list(range(200))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {n: find(n) for e in edges if e[0] != e[1] for n in e}
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_folding_agrees_with_unicodedata(spark):
    letters = [chr(c) for c in range(0xC0, 0x180)]
    got = [r["x"] for r in spark.createDataFrame([(c,) for c in letters], "c string").select(text.unaccented(F.col("c")).alias("x")).collect()]
    assert got == ["".join(d for d in unicodedata.normalize("NFD", c) if not unicodedata.combining(d)) for c in letters]


@pytest.mark.parametrize(("spec", "want"), [("1-5", [0, 1, 2, 3, 4]), ("1,3,7", [0, 2, 6]), ("last3", [7, 8, 9]), ("first5", [0, 1, 2, 3, 4]), ("last", [7, 8, 9]), ("0", []), ("8-20", [7, 8, 9]), ("x", []), ("3,1,3", [0, 2])])
def test_page_ranges(spark, spec, want):
    assert spark.createDataFrame([(spec,)], "s string").select(text.page_list(F.col("s"), F.lit(10)).alias("p")).first()["p"] == want


def test_record_id_against_model(spark):
    def model(url, title):
        h = 0
        for c in f"{url}|{title}".lower():
            h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
        h, out = abs(h), ""
        while h:
            h, d = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
        return "rec_" + (out or "0")

    rows = [("https://a.example/1", "One"), ("http://b.example/item/2", "A longer title, 2 parts"), ("", "")]
    got = [r["x"] for r in spark.createDataFrame(rows, "u string, t string").select(text.record_id(F.col("u"), F.col("t")).alias("x")).collect()]
    assert got == [model(*r) for r in rows]


def test_inverted_index_gaps(spark):
    got = spark.sql("select map('a', array(0, 3), 'b', array(1)) m").select(text.inverted_text(F.col("m")).alias("x")).first()["x"]
    assert got == "a b  a"


def test_smart_cut_and_formulas(spark):
    frame = spark.createDataFrame([("x" * 80 + "\n# h\n" + "y" * 60, "$$a+b$$ t \\(c\\) $$ a+b $$")], "t string, f string")
    assert frame.select(text.cut_smartly(F.col("t"), 100).alias("x")).first()["x"] == "x" * 80 + "\n\n[... Contenido truncado. 65 caracteres restantes ...]"
    assert frame.select(text.cut_smartly(F.col("t"), 500).alias("x")).first()["x"] == "x" * 80 + "\n# h\n" + "y" * 60
    assert frame.select(pages.formulas(F.col("f")).alias("x")).first()["x"] == ["$$a+b$$", "$$ a+b $$", "$a+b$", "$ t \\(c\\) $", "$ a+b $", "\\(c\\)"] or frame.select(pages.formulas(F.lit("$a$ \\(c\\) $a$")).alias("x")).first()["x"] == ["$a$", "\\(c\\)"]


def test_segments_by_route(spark):
    body = "Introduction\none\nMethods\ntwo\nMethods\nthree\nx\nx\nx\nMethods\nfour\n" + "Results " + "r" * 100 + "\nConclusions"
    rows = [(1, body), (2, "# Abstract\na\n## Methods\nb\nresults of all"), (3, None), (4, ""), (5, "no header here at all, only words")]
    frame = spark.createDataFrame([(k, t, "x") for k, t in rows], "k long, t string, name string")
    names = lambda route: {k: [(r["name"].split(" ")[0], r["content"]) for r in sorted(docs.segments(frame, "k", "t", route).where(f"k = {k}").collect(), key=lambda r: r["pos"])] for k in (1, 2, 3, 4, 5)}
    analysis = names("analysis")
    assert [n for n, _ in analysis[1]] == ["Introducción", "Metodología", "Metodología", "Conclusiones"]  # the second Methods stands two lines below the first; a line of over 99 characters is no header
    assert analysis[1][1][1].startswith("Methods\ntwo\nMethods\nthree") and analysis[1][-1][1] == "Conclusions"
    assert [n for n, _ in names("detect")[2]] == ["Resumen", "Metodología"] and [n for n, _ in names("summary")[2]] == ["Resumen", "Metodología", "Resultados"]
    assert analysis[3] == analysis[4] == analysis[5] == []
    assert docs.segments(frame.limit(0), "k", "t").count() == 0
    whole = docs.analysis(frame, "k", "t").orderBy("k").collect()
    assert [(r["k"], r["total_sections"]) for r in whole] == [(1, 4), (2, 3), (4, 0), (5, 0)] and whole[0]["categories"] == "intro|methods|conclusion"


def test_extracted_section_answers_to_words(spark):
    frame = spark.createDataFrame([(1, "Resultados\nuno\nMethods\ndos\nFindings\ntres"), (2, "nada"), (3, None)], "k long, t string")
    rows = {r["k"]: r for r in docs.extracted_section(frame, "k", "t", "Resultados").collect()}
    assert rows[1]["content"] == "Resultados\nuno\n\n---\n\nFindings\ntres" and rows[1]["available"] == "Resultados / Results|Metodología / Methods"
    assert not rows[2]["found"] and rows[2]["available"] == "" and set(rows) == {1, 2}


def test_citations_without_numbers(spark):
    frame = spark.createDataFrame([(1, "x\nReferences\nTorbe, A. (2010). On the water of the hill.\nshort 2011\nQuilca (no year) wrote something long"), (2, "References\n[1] Lindo A. 2001 on all of it\n[2] x")], "k long, t string")
    got = {(r["k"], r["index"]): (r["authors"], r["year"]) for r in docs.citations(frame, "k", "t").collect()}
    assert got == {(1, 1): ("Torbe", "2010"), (2, 1): ("Lindo A", "2001")}


def test_greedy_rounds_with_a_hot_key(spark):
    rows = [paper(k, doi=f"d{k % 7}", title="Sin título") for k in range(40)] + [paper(100 + k, doi=f"e{k}", title="Sin título") for k in range(30)] + [paper(200, doi="d3", title="another one")]
    assert kept(spark, rows) == [0, 200]


def test_components_of_a_long_chain_and_of_a_star(spark):
    chain = [(k, k + 1) for k in range(400)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5), (None, 3)]
    roots = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert set(roots.values()) == {0, 1000} and roots[400] == 0 and roots[1299] == 1000
    with pytest.raises(RuntimeError):
        graph.components(spark.createDataFrame(chain, "a long, b long"), most=1)


def test_cache_with_a_capacity():
    reads = [(k, f"k{k}") for k in range(6)] + [(6, "k0"), (7, "k5"), (400, "k5")]
    hits = state.bounded_cache(reads, ttl=300, most=4, share=0.5)
    assert hits == [False] * 6 + [False, True, False]  # k0 went with the oldest half; k5 stayed until its time was over


def test_query_variations(spark):
    asked = ["machine learning para el agua de los valles", "corta", "", None]
    rows = [r["v"] for r in spark.createDataFrame([(a,) for a in asked], "q string").select(text.query_variations(F.col("q")).alias("v")).collect()]
    assert rows[0][0] == asked[0] and "machine learning agua valles" not in rows[0] and len(rows[0]) <= 4
    assert rows[1] == ["corta"] and rows[2] == [""]


def test_bitstream_links_and_their_fallback(spark):
    base = "https://r.example/handle/10/7"
    html = "<a href='/bitstream/1/a.pdf'>x</a><a href='b.pdf?y=1'>x</a><a href='/bitstream/1/a.pdf'>x</a>"
    got = [r["x"] for r in spark.createDataFrame([(html, base), ("none", base), ("", "")], "h string, b string").select(pages.bitstreams(F.col("h"), F.col("b")).alias("x")).collect()]
    assert got == [["https://r.example/bitstream/1/a.pdf", "https://r.example/handle/10/b.pdf?y=1"], ["https://r.example/bitstream/handle/10/7/1/Tesis.pdf"], []]


def test_patterns_are_bounded(spark, monkeypatch):
    frame = spark.createDataFrame([(1, "see 10/7"), (2, "none"), (3, None)], "k long, u string")
    dims = spark.createDataFrame([("10/", 2, "b"), ("10/7", 1, "a")], "pattern string, ord int, name string")
    assert {r["k"]: r["match"] and r["match"]["name"] for r in enrich.first_contained(frame, "u", dims).collect()} == {1: "a", 2: None, 3: None}
    monkeypatch.setattr(enrich, "MOST_PATTERNS", 1)
    with pytest.raises(ValueError):
        enrich.first_contained(frame, "u", dims)


def test_every_parser_takes_garbage_and_nothing(spark):
    frame = spark.createDataFrame([("<html>no</html>",), ("{",), ("[]",), ("{}",), ("",), (None,)], "raw string")
    for name, parser in parsers.PARSERS.items():
        assert parser(frame).columns == list(parsers.FIELDS), name
        assert parser(frame).count() == 0, name


def test_meta_tags(spark):
    html = "<meta content='2020-01-02' name='citation_date'><meta name=\"citation_author\" content=\"Ana\"><META NAME=\"dc.creator\" CONTENT=\"Ana\"><meta name='description' content='%s'><title>T &amp; U | Repositorio</title>" % ("d" * 51)
    row = pages.metadata(spark.createDataFrame([(1, html), (2, None), (3, "")], "k long, h string"), "k", "h").orderBy("k").collect()
    assert (row[0]["title"], row[0]["year"], row[0]["authors"], len(row[0]["abstract"])) == ("T & U", 2020, "Ana", 51)
    assert row[1]["title"] is None


def test_sources_expand(spark):
    assert len(search.expanded(["iberoamerica"])) == 17
    assert search.expanded(["España", "nobody"]) == ["espana", "nobody"]
    members = search.group_members(spark).where("grp = 'iberoamerica'").collect()
    assert len(members) == 17


def test_year_filter(spark):
    rows = spark.createDataFrame([(None,), (0,), (2005,), (2015,)], "y int")
    assert rows.where(search.in_years(F.col("y"), 2010, None)).count() == 3
    assert rows.where(search.in_years(F.col("y"), None, None)).count() == 4


def test_language_boundary(spark):
    frame = spark.createDataFrame([("de la el the and",), ("de la el the",), ("enérgico the",)], "t string")
    assert [r["x"] for r in frame.select(docs.language(F.col("t")).alias("x")).collect()] == ["mixed", "es", "mixed"]  # an accent ends an ASCII word, so "en" is found in the first word


def test_parsers_tolerate_garbage(spark):
    raw = [("noise {\"data\": [{\"paperId\": \"1\", \"title\": \"T\", \"year\": 2001}]} tail",), ("not json",), (None,)]
    got = parsers.semantic(spark.createDataFrame(raw, "raw string")).collect()
    assert [(r["id"], r["year"]) for r in got] == [("1", 2001)]
    feed = "<feed><entry><id>a1</id><title>T &amp;\n U</title><published>2020-01-01</published><author><name>Ana</name></author></entry></feed>"
    row = parsers.arxiv(spark.createDataFrame([(feed,)], "raw string")).first()
    assert (row["title"], row["year"], row["authors"]) == ("T &  U", 2020, ["arXiv Author"])


def test_state_machines(spark):
    minute = 60_000_000
    rows = [(1, 0, "error"), (1, 1, "error"), (1, 2, "error"), (1, 3, "view"), (1, 20, "error"), (2, 0, "view")]
    frame = spark.createDataFrame([(k, i, m * minute, e) for i, (k, m, e) in enumerate(rows)], "k long, i long, m long, e string").withColumn("ts", F.timestamp_micros("m"))
    got = [(r["failures"], r["open"]) for r in state.breaker(frame, "k", "ts", "i", "e = 'error'").orderBy("i").collect()]
    assert got == [(1, False), (2, False), (3, True), (0, False), (1, False), (0, False)]
    hits = [r["hit"] for r in state.cached(frame, "k", "ts", "i").orderBy("i").collect()]
    assert hits == [False, True, True, True, False, False]
    starts = [r["start"] for r in state.rate_limited(frame, "k", "ts", "i", 2 * minute).orderBy("i").collect()]
    assert [s // minute for s in starts] == [0, 2, 4, 6, 20, 0]


def test_a_queue_of_many_calls_on_one_day(spark):
    got = state.serial_queue(spark.range(3000).select("id", F.timestamp_micros(F.col("id")).alias("ts")), "ts", "id")
    assert [r["start"] for r in got.orderBy("id").collect()] == [2_000_000 * k for k in range(3000)]


def test_cache_stream(spark, tmp_path):
    rows = [(1, i, 0) for i in range(3)]
    frame = spark.createDataFrame([(1, m) for _, m, _ in rows], "k long, m long").withColumn("ts", F.timestamp_seconds((F.col("m") + 1000) * 60))
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = state.cached_stream(stream, "k", "ts").writeStream.format("memory").queryName("cache_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("cache_out").groupBy("key").agg(F.sum("hits").alias("h"), F.sum("misses").alias("m")).collect()
    assert [(r["key"], r["h"], r["m"]) for r in got] == [(1, 2, 1)]


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    link = duckdb.connect()
    link.execute("set timezone = 'UTC'")
    for t in ("papers", "repo_records", "scraped_pages", "pdf_texts", "markdown_results", "documents", "source_catalog", "events"):
        link.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    cursor = link.execute(plans.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    order = sorted(names)
    want = sorted((tuple(dict(zip(names, r, strict=True))[c] for c in order) for r in cursor.fetchall()), key=repr)
    frame = plans.queries()[name](spark, folder)
    assert sorted(frame.columns) == order
    assert sorted((tuple(r[c] for c in order) for r in frame.collect()), key=repr) == want
