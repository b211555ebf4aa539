"""What the page and calendar jobs need to stay quick on large tables, with the rows they gave before."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.arrays import dedupe_array
from tidemark.functions.markup import tags_of
from tidemark.functions.text import normalize_space
from tidemark.functions.urls import absolute_url, valid_image_url
from tidemark.operators import extract, outline
from tidemark.plans import ordered_queries, page_queries
from tidemark.streaming import streams

PLAIN = """<!DOCTYPE html><html><body class="a b"><!-- <p>no</p> --><h3>Pontos &amp; mais</h3><div data-x=1>
<span class='type'>Metrô</span><img src="/a.jpg"><br/></div><script>if (a < b) x("</p>")</script><P>fim</P></body></html>"""
ODD = ["<", "< p>", "<!-->", "<?x?>", "<!x>", '<p a = "1">', '<p a="1"b="2">', "<script>", "</scrıpt>", "<a\xa0b>", "<img src=a/>", "&lt", "<x"]


class Library(outline.Outline):
    def _plain(self, html):
        return 0


def _parts(page):
    return page.parts, page.pieces


def test_plain_markup_needs_no_library_parser():
    page = outline.Outline.__new__(outline.Outline)
    outline.Outline.__init__(page, PLAIN)
    page.parts, page.pieces, page.open = [outline.Part("", {}, -1, 0)], [], [0]
    assert page._plain(PLAIN) == len(PLAIN)


def test_outline_is_that_of_the_library_parser():
    pick = random.Random(3)
    for _ in range(500):
        at = pick.randrange(len(PLAIN))
        html = PLAIN[:at] + pick.choice(ODD) + PLAIN[at + pick.randrange(3):]
        assert _parts(outline.Outline(html)) == _parts(Library(html))


LISTING = """<!DOCTYPE html><html><body class="a"><h1>Casa</h1><!-- <div> --><style>b{}</style><div><h3>Pontos de <b>Interesse</b></h3>
<div><span class="type">Metrô</span> <SPAN CLASS=name>Estação &amp; 1</SPAN><i class='distance'>1,5 km</i><br/></div>
<div><b class="type">Parque</b><script>x("</div>")</script></div></div><i class="type"></i>
<div><h2>Detalhes</h2><ul><li>Varanda<li>Sol &nbsp; bom</ul><p>Fim</p></div></body></html>"""


@pytest.fixture
def no_library(monkeypatch):
    def fail(self, html):
        raise AssertionError("read by the library's parser")

    monkeypatch.setattr(outline.Outline, "feed", fail)


def test_points_of_plain_pages_are_read_from_lists(no_library):
    page = outline.flat(LISTING)
    assert outline.points(page, "pontos de interesse") == [("Metrô", "Estação & 1", "1,5 km", False), ("Parque", None, None, False)]


def test_sections_of_plain_pages_are_read_from_lists(no_library):
    page = outline.flat(LISTING)
    assert outline.section(page, "DETALHES") == ("Fim", ["Varanda", "Sol bom"])
    assert outline.section(page, "Pontos de interesse")[1] == ["Pontos de", "Interesse", "Metrô", "Estação & 1", "1,5 km", "Parque"]
    assert outline.section(page, "nada") is None


def test_lists_are_those_of_the_outline():
    pick, read = random.Random(4), 0
    tags = [*ODD, "<!--", "-->", "</script >", "<style>", "</li>", "</div>", "<div/>", "<BR>", "<b title='a>b'>", "<b title='<!-- -->'>", "&nbsp;", " "]
    for _ in range(1500):
        html = pick.choice([PLAIN, LISTING])
        for _ in range(pick.randrange(1, 4)):
            at = pick.randrange(len(html))
            html = html[:at] + pick.choice(tags) + html[at + pick.randrange(3):]
        page, parts, pieces = outline.flat(html), *_parts(outline.Outline(html))
        read += outline._skimmed(html) is not None
        assert page.texts == [p.text for p in pieces] and page.inside == [p.inside for p in pieces]
        for n, part in enumerate(parts):
            assert (page.tags[n], page.attributes(n), page.around[n], page.first[n], page.last[n]) == (part.tag, part.attrs, part.around, part.first, part.last)
            outside = [k for k in range(n + 1, len(parts)) if parts[k].around < n]
            assert page.until[n] == min(outside, default=len(parts))
    assert 100 < read < 1400


def test_blocks_that_do_not_end_are_looked_for_once():
    for html in ("<script>" * 50000, "<!--" * 50000, "<style x>" * 50000):
        assert outline._skimmed(html) is None


def test_rows_of_pages_keep_their_keys(spark):
    pages = spark.createDataFrame([(None, LISTING), (2**60 + 1, LISTING), (3, None), (4, "<p>x")], "page_id bigint, html string")
    rows = [(r.page_id, r.position, r.name, r.distance_meters) for r in extract.nearby_points(pages.coalesce(1)).collect()]
    assert rows == [(k, *r) for k in (None, 2**60 + 1) for r in ((1, "Estação & 1", 1500), (2, None, None))]


@pytest.mark.parametrize("frame", [
    lambda s, d: page_queries.listing_pages(s, d), lambda s, d: ordered_queries.jobs(s, d).select("job_id")], ids=["pages", "jobs"])
def test_rows_of_one_row_group_are_dealt_to_all_cores(spark, frame, tmp_path):
    spark.range(40).select(
        F.col("id").alias("o_orderkey"), F.lit(1.5).alias("o_totalprice"), F.lit("O").alias("o_orderstatus"), F.lit("2").alias("o_orderpriority"),
        F.col("id").alias("o_custkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(40).selectExpr("id AS s_suppkey", "CAST(id AS STRING) AS s_name", "CAST(0 AS INT) AS s_nationkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(1).selectExpr("CAST(id AS INT) AS n_nationkey", "'x' AS n_name", "0 AS n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    rows = frame(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert rows.count() == 40


def test_an_address_is_worked_out_once(spark):
    resolved = spark.createDataFrame([("a",)], "u string").select(absolute_url(F.reverse(F.concat("u", "u")), "https://x.test/").alias("url"))
    plan = resolved._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(") == 1


def test_only_tags_that_can_name_an_address_are_taken(spark):
    html = """<p class=x><a HREF = '/1'><!-- <a href=/no> --><b href><img alt="src" data-big=/2><a <i src=/3><script src=/no></script><u xhref=/no><br>"""
    tags = spark.createDataFrame([(html,)], "h string").select(tags_of("h", "href|src|data-[a-z]+")).first()[0]
    assert tags == ["<a HREF = '/1'>", "<img alt=\"src\" data-big=/2>", "<a <i src=/3>"]


def test_plain_addresses_are_what_resolving_gives(spark):
    given = ["/a/b.jpg", "/a/?utm_source=%zz&&gclid", "/a?", "/a?utm_sourcex=1", "/a?gclid=1&q=2", "/a/../b", "/a/./b?fbclid", "/.a/b", "//h.test/a", "/a#gclid", " /a\n", "/a b",
             "data:x", "HTTPS://h.test/a b", "https://h.test/a?gclid=1", "é/ü", "/é?gclid=2", "?gclid=3", "", None, "/x" * 50000 + "?gclid=4"]
    want = ["/a/b.jpg", "/a/", "/a", "/a?utm_sourcex=1", "/a?q=2", "/b", "/a/b", "/.a/b", "https://h.test/a", "/a#gclid", "/a", "/a b",
            "data:x", "HTTPS://h.test/a b", "https://h.test/a", "/d/é/ü", "/é", "/d/e", None, None, "/x" * 50000]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(given)], "i int, u string").select("i", absolute_url("u", "https://x.test/d/e").alias("url"))
    assert [r.url for r in sorted(rows.collect())] == [f"https://x.test{u}" if u and u.startswith("/") else u for u in want]


def test_pictures_are_told_by_their_path(spark):
    given = ["/a.JPG", "/a.jpg?x", "/a.webp#x", "//h.jpg", "//h.test/a.png", "https://h.jpg", "https://h.test/a.jpeg", "a.jpg:b", "/a?b.jpg", "/a.jpg/b", "a:b.png", ".jpg", None]
    rows = spark.createDataFrame([(u,) for u in given], "u string").filter(valid_image_url("u").isNotNull()).collect()
    assert {r.u for r in rows} == {"/a.JPG", "/a.jpg?x", "/a.webp#x", "//h.test/a.png", "https://h.test/a.jpeg", "a:b.png", ".jpg"}


def test_a_picture_may_be_named_by_references(spark):
    pages = spark.createDataFrame([(1, "<img src='/a&#46;j&#112;g'><img src='/b&amp;.PNG'><img src=/c.gif srcset='/d.png 1x, /e 2x'>")], "page_id int, html string")
    assert extract.links_and_images(pages, "https://x.test").first().images == ["https://x.test/a.jpg", "https://x.test/b&.PNG"]


def test_every_unicode_space_is_one_blank(spark):
    kinds = [c for c in map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
    rows = spark.createDataFrame([(f"a{k}b {k} c{k}",) for k in kinds], "t string")
    assert {r[0] for r in rows.select(normalize_space("t")).collect()} == {"a b c"}


def test_plain_repeats_are_not_sorted(spark):
    rows = spark.createDataFrame([(["B", " a ", "b", None, "", "A", "B", "a"],)], "t array<string>").select(dedupe_array("t").alias("t"))
    assert rows.first()["t"] == ["B", "a"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" in plan and "array_sort" not in plan


class _State:
    exists, hasTimedOut = False, False

    def update(self, value):
        self.value = value


@pytest.mark.parametrize("tie", [[2, 1, 3, 0, 5], ["c", "b", "d", "a", "f"]])
def test_cooldown_takes_the_first_alert_of_a_time(tie):
    rows = pd.DataFrame({"key": ["k"] * 5, "tie": tie, "ts": pd.to_datetime([10, 10, 70, 5, 65], unit="m")})
    follow = streams._cooldown(["key"], "ts", "tie", ["key", "tie", "ts"], 60 * 60_000_000, False)
    kept = pd.concat(follow(("k",), iter([rows[:3], rows[3:]]), state := _State()))
    assert kept["tie"].tolist() == [tie[3], tie[4]] and kept["key"].tolist() == ["k", "k"]
    assert state.value == (65 * 60_000_000,)
    assert np.array_equal(streams._ranked(pd.Series(["b", None, "a"])), [1, 3, 0])
