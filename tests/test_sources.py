"""File readers and writers."""

import json

from pyspark.sql import functions as F

from vacantis.operators import dom
from vacantis.sources import tables as st

RSS = """<rss><channel><item><title> Acme raises $5 million </title><description>d</description><link>https://n/1</link><pubDate>Fri, 05 Jan 2024 08:00:00 +0000</pubDate></item>
<item><title>Other</title><content:encoded xmlns:content="x">body</content:encoded><link>https://n/2</link></item></channel></rss>"""


def test_feed_items(spark, tmp_path):
    (tmp_path / "f.xml").write_text(RSS)
    rows = st.read_feed_items(spark, str(tmp_path), "News").orderBy("link").collect()
    assert [(r.title, r.description, r.link) for r in rows] == [("Acme raises $5 million", "d", "https://n/1"), ("Other", "body", "https://n/2")]


def test_payload_files(spark, tmp_path):
    d = tmp_path / "ats_type=lever" / "ats_identifier=acme"
    d.mkdir(parents=True)
    (d / "1.json").write_text('[{"text":"Dev",\n"id":"7"}]')
    from vacantis.operators.extract import extract_payload_jobs

    row = extract_payload_jobs(st.read_payload_files(spark, str(tmp_path))).collect()[0]
    assert (row.title, row.url) == ("Dev", "https://jobs.lever.co/acme/7")


def test_typed_table_and_version(spark, tmp_path):
    df = spark.createDataFrame([("1", "Acme")], "id string, name string")
    path = st.write_version(df, str(tmp_path), "1")
    assert st.read_table(spark, "companies", path).select("id", "name", "domain").collect()[0].domain is None


def test_report(spark, tmp_path):
    rows = spark.createDataFrame([("a", False)], "company string, success boolean")
    st.write_report(rows, rows.groupBy("success").count(), str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r" / "failures")).first()[0]) == {"company": "a", "success": False}


def test_payload_files_are_written_by_many_tasks(spark, tmp_path):
    from vacantis.operators.extract import extract_payload_jobs

    docs = spark.range(0, 60, 1, 1).selectExpr("'lever' AS ats_type", "concat('s', id) AS ats_identifier", """concat('[{"text":"Job ', id, '"}]') AS value""")
    st.write_payload_files(docs, f"{tmp_path}/p")
    files = list(tmp_path.glob("p/ats_type=*/ats_identifier=*/part-*"))
    assert len(files) == 60 and len({f.name.split("-")[1] for f in files}) > 1  # the number of the task
    assert sorted(r.title for r in extract_payload_jobs(st.read_payload_files(spark, f"{tmp_path}/p")).collect()) == sorted(f"Job {i}" for i in range(60))


def test_repeated_blocks_of_a_page(spark):
    html = "".join(f'<div class="row"><h4>Developer number {i}</h4><a href="/x{i}">go</a></div>' for i in range(3))
    p = spark.createDataFrame([(1, "https://a.example/y", html), (2, "https://a.example/y", "<p>nothing</p>")], "page_id int, url string, html string")
    rows = dom.extract_generic(p).orderBy("position").collect()
    assert [(r.strategy, r.title, r.url) for r in rows] == [("blocks", f"Developer number {i}", f"https://a.example/x{i}") for i in range(3)]


def test_text_lines_skip_noise(spark):
    p = spark.createDataFrame([("<script>x</script><nav>menu</nav><p>One <b>two</b></p><div class='footer'>f</div>",)], "html string")
    assert p.select(dom.simplify_html("html")).first()[0] == "One\ntwo"


def test_page_extraction_is_linear_in_cards(spark):
    """Four times the cards take well under the sixteen-fold time of pairing each with each."""
    import time

    def page(n):
        return "".join(f'<div class="job"><h3>Developer number {i}</h3><span class="location">Town</span><a href="/j/{i}">x</a></div>' for i in range(n))

    took = {}
    for n in (500, 500, 2000):  # the first run compiles
        p = spark.createDataFrame([(1, "https://a.example/y", page(n))], "page_id int, url string, html string")
        begin = time.perf_counter()
        rows = dom.extract_generic(p).collect()
        took[n] = time.perf_counter() - begin
        assert len(rows) == n and rows[-1].title == f"Developer number {n - 1}" and rows[-1].url.endswith(f"/j/{n - 1}")
    assert took[2000] < 8 * took[500] + 2


def test_first_link_of_an_address_decides(spark):
    html = '<a href="/jobs/12">Backend Developer</a><a href="/jobs/12">Apply now here</a><a href="/jobs/3">Frontend Developer</a>'
    p = spark.createDataFrame([(1, "https://a.example/y", html)], "page_id int, url string, html string")
    assert [r.title for r in dom.extract_generic(p).orderBy("position").collect()] == ["Backend Developer", "Frontend Developer"]
