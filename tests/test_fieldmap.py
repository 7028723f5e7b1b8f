"""The payload field map as rows: a platform that no code knows, priorities, and odd documents."""

from vacantis.operators import extract as ex


def test_a_new_platform_is_rows(spark):
    rows = [("acme", "jobs", 0, "openings"), ("acme", "jobs", 1, "$"), ("acme", "title", 1, "name"), ("acme", "title", 0, "headline"), ("acme", "url", 0, "url https://acme.example/{ident}/{no}"),
            ("acme", "location", 0, "csc town - land|country"), ("acme", "department", 0, "names teams label"), ("acme", "salary", 0, "range pay.low pay.high pay.unit"),
            ("acme", "remote", 0, "flags.remote"), ("acme", "type", 0, "each kinds"), ("acme", "posted", 0, "it's.a \\ day")]
    table = spark.createDataFrame(rows, ex.FIELD_MAP)
    docs = [("c", "acme", "me", '{"openings":[{"headline":"One","name":"no","no":7,"town":"Rome","country":"IT","teams":[{"label":"A"},{"label":"B"}],"pay":{"low":1000,"high":2000,"unit":"EUR"},'
             '"flags":{"remote":true},"kinds":["x",{"name":"y"}],"it\'s":{"a \\\\ day":"d"}},{"name":"Two"},{"no":1}]}'),
            ("d", "acme", None, '[{"name":"Root","headline":""}]'), ("e", "lever", "x", '[{"text":"not known here"}]'), ("f", "acme", "x", "<html>"), ("g", "acme", "x", None), ("h", None, "x", "[]")]
    payloads = spark.createDataFrame(docs, "company_id string, ats_type string, ats_identifier string, body string")
    got = [(r.company_id, r.position, r.title, r.url, r.location, r.department, r.salary, r.remote, r.type) for r in ex.extract_payload_jobs(payloads, table).orderBy("company_id", "position").collect()]
    assert got == [("c", 0, "One", "https://acme.example/me/7", "Rome, IT", "A, B", "EUR 1,000 - 2,000", True, "x, y"),
                   ("c", 1, "Two", None, None, None, None, None, None), ("d", 0, "Root", None, None, None, None, None, None)]
    known = ex.extract_payload_jobs(payloads).select("company_id", "title").collect()
    assert [tuple(r) for r in known] == [("e", "not known here")]
    assert ex.extract_payload_jobs(payloads, table.limit(0)).collect() == []


def test_the_field_map_reads_as_rows_of_the_known_platforms(spark):
    rows = ex.field_map_rows()
    assert len({r[0] for r in rows}) == 25 and ex.specs_of(rows) == ex._KNOWN and ex.specs_of(reversed(rows)).count('"kind"') == ex._KNOWN.count('"kind"')
