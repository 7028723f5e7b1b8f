"""Rules read off their public definitions, beside plain Python."""

import html
import random

from pyspark.sql import functions as F

from vacantis.functions import dates as dt, text as tx
from vacantis.operators import extract as ex, upserts as up
from vacantis.sources.tables import read_feed_items


def test_character_references_equal_the_standard_library(spark):
    rng = random.Random(1)
    names = sorted(html.entities.html5)
    texts = ["", "no reference", "&", "&&;", "&;", "&#;", "&#x;", "&amp;amp;", None, "&#65", "&#x41;", "&#1114112;", "&#99999999999;", "&#13;", "&#11;",
             "&#xFDD0;", "&#0065;", "&notin;&notinx;&not", "a &lt b"]
    texts += [f"x &{rng.choice(names)} y &#{rng.randrange(70000)}; z &#x{rng.randrange(1 << 17):x}" for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select("id", tx.unescape_entities("t").alias("u"))
    for r in rows.collect():
        want = texts[r.id] and html.unescape(texts[r.id])
        assert r.u == want, texts[r.id]


def test_lenient_dates(spark):
    forms = {"Jan 5 2024": "2024-01-05 00:00:00", "5 January 2024 10:00": "2024-01-05 10:00:00", "2024/01/05": "2024-01-05 00:00:00",
             "January 5, 2024 10:00 AM": "2024-01-05 10:00:00", "01-05-2024": "2024-01-05 00:00:00", "May 3, 2024": "2024-05-03 00:00:00",
             "31/12/2023": "2023-12-31 00:00:00", "12/31/2023": "2023-12-31 00:00:00", "Jan 5, 2024 1:07 pm": "2024-01-05 13:07:00",
             "2024-01-05 07:30": "2024-01-05 07:30:00", "soon": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in forms], "t string")
    got = df.select("t", F.date_format(dt.parse_date("t"), "yyyy-MM-dd HH:mm:ss").alias("d")).collect()
    assert {r.t: r.d for r in got} == forms


def test_atom_and_rss_links(spark, tmp_path):
    (tmp_path / "atom.xml").write_text('<feed><entry><title>T</title><link rel="self" href="https://x/self"/><link href="https://x/1"/></entry>'
                                       '<entry><title>U</title></entry></feed>')
    (tmp_path / "rss.xml").write_text("<rss><channel><item><title>R</title><link> https://x/2 </link></item></channel></rss>")
    atom = {r.title: r.link for r in read_feed_items(spark, str(tmp_path / "atom.xml"), "f", "entry").collect()}
    rss = {r.title: r.link for r in read_feed_items(spark, str(tmp_path / "rss.xml"), "f").collect()}
    assert atom == {"T": "https://x/1", "U": None} and rss == {"R": "https://x/2"}


def test_script_lists_end_at_their_own_bracket(spark):
    bodies = ['jobs = [{"title":"A]","tags":["x",["y"]]},{"title":"B \\"q\\""}]; z = [1]', 'jobs = [{"title":"C"', "none", None]
    df = spark.createDataFrame([(i, "jobvite", b) for i, b in enumerate(bodies)], "page_id int, ats_type string, html string")
    assert [(r.page_id, r.title) for r in ex.extract_script_jobs(df).orderBy("page_id", "position").collect()] == [(0, "A]"), (0, 'B "q"')]


def test_writes_fold_repeated_keys(spark):
    t = spark.createDataFrame([(1, "old"), (4, "keep")], "k int, v string")
    u = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1), (2, "y", 1), (None, "n", 1), (None, "n", 1)], "k int, v string, at int")
    once = up.upsert(t, u, ["k"], ["v"], order=["at"])
    assert sorted(map(tuple, once.collect()), key=str) == [(1, "b"), (2, "y"), (4, "keep"), (None, "n"), (None, "n")]
    known = u.filter("k IS NOT NULL")
    twice = up.upsert(up.upsert(t, known, ["k"], ["v"], order=["at"]), known, ["k"], ["v"], order=["at"])
    assert sorted(map(tuple, twice.collect())) == [(1, "b"), (2, "y"), (4, "keep")]
    added = up.insert_ignore(t, u.drop("at"), ["k"])
    assert sorted(map(tuple, added.collect()), key=str) == [(1, "old"), (2, "x"), (4, "keep"), (None, "n"), (None, "n")]
