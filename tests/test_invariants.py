"""Invariants, brute-force comparisons and plan checks."""

import random

import pytest
from pyspark.sql import functions as F

from vacantis.bindings import AS_OF, bind
from vacantis.functions import text as tx
from vacantis.operators import joins as jn, upserts as up, windows as wn
from vacantis.plans import embed as em, matching as mt
from vacantis.plans.normalize import normalize_jobs
from vacantis.streaming import streams as sm

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def people_and_jobs(spark, n_jobs=600):
    """One family and level hold most jobs; some candidates and jobs leave things open."""
    rng = random.Random(5)
    fams, levels = ["data", "design", "sales"], ["junior", "mid", "senior", "staff"]
    some = lambda xs: rng.sample(xs, rng.randint(0, len(xs)))
    cands = [(i, some(fams), rng.choice([*levels, None, "guru"]), some(["remote", "hybrid"]), rng.choice([None, 0, 90]),
              some(["chef"]), some(["Python", "sql", "go"]), some(["berlin", "us"]), True) for i in range(25)]
    jobs = [(i, "Chef" if i % 50 == 0 else "Job", rng.choice(["data"] * 8 + ["sales", None]), rng.choice([None, "x"]),
             rng.choice(["mid"] * 6 + ["senior", None, "guru"]), rng.choice(["remote", "onsite", None]), rng.choice([None, 50, 100]),
             rng.choice([None, 60, 120]), some(["python", "sql", "java"]), some(["Berlin, DE", "US"]), rng.choice([None, 0.0, 0.1, 0.5, 0.9, 1.0]), i % 7 != 0)
            for i in range(n_jobs)]
    c = spark.createDataFrame(cands, "id int, role_families array<string>, seniority string, location_types array<string>, min_salary bigint, "
                              "exclusions array<string>, skills array<string>, locations array<string>, is_active boolean")
    j = spark.createDataFrame(jobs, "id int, title string, role_family string, role_specialization string, seniority string, location_type string, "
                              "min_salary bigint, max_salary bigint, skills array<string>, locations array<string>, freshness_score double, is_active boolean")
    return c, j, cands, jobs


def score_all(cands, jobs):
    order = ["intern", "junior", "mid", "senior", "staff", "principal", "director", "vp", "c_level"]
    out = {}
    for cid, cf, cs, cl, cm, cx, ck, clo, _ in cands:
        rows = []
        for jid, title, jf, js, jl, jt, jmin, jmax, jk, jlo, fresh, live in jobs:
            if not live or (cf and jf and jf not in cf):
                continue
            if cs in order and jl in order and abs(order.index(cs) - order.index(jl)) > 1:
                continue
            if (cl and jt and jt not in cl) or (cm and jmax and jmax < cm * 0.8):
                continue
            if any(x.lower() in title.lower() or x.lower() in [s.lower() for s in jk] for x in cx):
                continue
            a, b = {s.lower() for s in ck}, {s.lower() for s in jk}
            skill = len(a & b) / len(a | b) if a and b else 0.5
            la, lb = {s.lower() for s in clo}, {s.lower() for s in jlo}
            place = 0.5 if not la or not lb else 1.0 if la & lb else 0.7 if any(x in y or y in x for x in la for y in lb) else 0.3
            s = min(1.0, (skill * .3 + (fresh or 0.5) * .3 + 0.5 * .2 + place * .1 + (0.8 if js else 0.5) * .1) * 1.1)
            if s >= 0.4:
                rows.append((-round(s, 9), jid))
        out[cid] = [(j, -s) for s, j in sorted(rows)]
    return out


def test_unknown_families_share_few_keys_and_match_exactly(spark):
    c, j, cands, jobs = people_and_jobs(spark, 120)
    j = j.withColumn("role_family", F.when(F.col("id") % 2 == 0, F.concat(F.lit("made up "), F.col("id") % 40)).otherwise(F.col("role_family")))
    c = c.withColumn("role_families", F.when(F.col("id") % 3 == 0, F.array(F.concat(F.lit("made up "), F.col("id") * 2), F.lit("data"), F.lit(None).cast("string"))).otherwise(F.col("role_families")))
    plain = {(a.id, b.id) for a in c.collect() for b in j.collect()
             if a.is_active and b.is_active and (not a.role_families or b.role_family is None or b.role_family in a.role_families)}
    pairs = {(r.candidate_id, r.job_id) for r in mt.match_pairs(c, j).collect()}
    assert pairs <= plain and any(b % 2 == 0 and a % 3 == 0 for a, b in pairs)
    wide = mt.match_pairs(c.withColumn("role_families", F.array().cast("array<string>")), j)
    assert {p for p in plain if p in {(r.candidate_id, r.job_id) for r in wide.collect()}} == pairs
    assert mt._cells(mt._job_side(j)).select("key").distinct().count() < 2 * (mt.OTHER_FAMILIES + 20) * 12


def test_grouped_pairs_add_up_to_all_pairs(spark):
    """Nulls, repeated ids, equal pay and exclusions that bar by title or skill, or might; before, every pair was laid out to be counted."""
    c, j, *_ = people_and_jobs(spark, 300)
    when = lambda cond, value, name: F.when(F.expr(cond), value).otherwise(F.col(name))
    texts = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    j = j.withColumns({"role_family": when("id % 7 = 0", F.concat(F.lit("made up "), F.col("id") % 3), "role_family"), "id": when("id % 50 = 1", F.lit(None).cast("long"), "id"),
                       "skills": when("id % 13 = 0", texts("python", None), "skills"), "max_salary": when("id % 5 = 0", F.lit(80).cast("long"), "max_salary")})
    c = c.unionByName(c.filter("id % 4 = 0")).withColumns({
        "min_salary": when("id % 3 = 0", F.lit(100).cast("long"), "min_salary"), "id": when("id % 6 = 5", F.lit(None).cast("long"), "id"),
        "exclusions": when("id % 8 = 3", texts("Python", "engineer"), "exclusions")}).withColumn("exclusions", when("id = 9", texts("x", None), "exclusions"))
    want = mt.match_pairs(c, j).groupBy("candidate_id").agg(F.count("*"), F.sum("job_id"))
    groups = mt.match_pairs(c, j, grouped=True)
    got = groups.groupBy("candidate_id").agg(F.sum("jobs"), F.sum("job_sum"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and want.count() > 5
    wider = j.unionByName(j).unionByName(j)
    assert mt.match_pairs(c, wider, grouped=True).count() == groups.count() < mt.match_pairs(c, wider).count() / 3


@pytest.mark.parametrize("k", [3, 40])
def test_refreshed_lists_equal_matching_anew(spark, k):
    c, j, _, jobs = people_and_jobs(spark, 300)
    rng = random.Random(k)
    for share in (0.02, 0.3):
        ids = [r[0] for r in jobs]
        changed = set(rng.sample(ids, int(len(ids) * share)))
        gone = {i for i in changed if i % 3 == 0}
        after = j.filter(~F.col("id").isin(list(gone))).withColumn("freshness_score", F.when(F.col("id").isin(list(changed)), F.lit(rng.random())).otherwise(F.col("freshness_score")))
        people = c.filter("id <> 4").withColumn("skills", F.when(F.col("id") % 11 == 5, F.array(F.lit("java"))).otherwise(F.col("skills")))
        cd, jd = mt.changed_ids(c, people), mt.changed_ids(j, after)
        assert {r.id for r in jd.collect()} <= changed and {r.id for r in cd.collect()} <= {4, 5, 16}
        show = lambda df: sorted((r.candidate_id, r["rank"], r.job_id, round(r.score, 9)) for r in df.collect())
        got = show(mt.refresh_pairs(mt.best_pairs(c, j, k=k), people, after, cd, jd, k=k))
        assert got == show(mt.best_pairs(people, after, k=k))


@pytest.mark.parametrize("k", [3, 40, 1000])
def test_best_pairs_equal_scoring_everything(spark, k):
    c, j, cands, jobs = people_and_jobs(spark)
    want = score_all(cands, jobs)
    got = {}
    for r in mt.best_pairs(c, j, k=k).select("candidate_id", "job_id", "score", "rank").orderBy("candidate_id", "rank").collect():
        got.setdefault(r[0], []).append((r[1], round(r[2], 9)))
    for cid, rows in want.items():
        # equal scores may differ in their last bits between the two programs: compare as sets of scores and of jobs above the cut
        mine = got.get(cid, [])
        assert [s for _, s in mine] == [s for _, s in rows[:k]]
        cut = rows[:k][-1][1] if rows else 0
        assert {x for x, s in mine if s > cut} == {x for x, s in rows if s > cut}
        assert len(mine) == len(set(mine))


def test_few_pairs_are_compared_in_full(spark):
    """Pairs that the numbers of both sides rule out never reach the lists; before, every pair of a candidate's bands did."""
    c, j, *_ = people_and_jobs(spark, 400)
    seen = mt._candidate_side(c).withColumn("floor", F.lit(0.75) - mt._EPS)
    keyed = mt._job_side(j)
    met = mt._met(seen, keyed, mt._cells(keyed))
    every = mt._laid_out(seen, mt._cells(keyed)).join(mt._salted(keyed, mt._cells(keyed)), ["key", "band", "salt"])
    reach = lambda pairs: {(r.candidate_id, r.job_id) for r in mt._weighed(mt._constraints(pairs)).filter("most >= floor").collect()}
    assert reach(met) == reach(every) and reach(met)
    assert met.count() < every.count()


def test_match_plan_has_no_cross_join_and_no_python(spark):
    c, j, _, _ = people_and_jobs(spark, 50)
    p = plan(mt.match_candidates(c, j, AS_OF, k=5))
    assert "CartesianProduct" not in p and "NestedLoop" not in p and "EvalPython" not in p
    assert "WindowGroupLimit" in p


def test_normalize_is_one_narrow_pass(spark):
    p = plan(normalize_jobs(bind(spark, SF, "jobs_raw"), AS_OF))
    assert "EvalPython" not in p and "Exchange" not in p


def test_filters_reach_the_scan(spark):
    feed = jn.job_feed(bind(spark, SF, "jobs"), bind(spark, SF, "companies")).select("id", "company_name")
    p = plan(feed)
    assert "PushedFilters: [IsNotNull(o_orderstatus), Not(EqualTo(o_orderstatus,F))" in p
    assert "o_totalprice" not in p


def test_upsert_is_idempotent(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "k int, v string, w int")
    u = spark.createDataFrame([(2, None, 9), (3, "c", 9)], "k int, v string, w int")
    once = up.upsert(t, u, ["k"], ["v"])
    twice = up.upsert(once, u, ["k"], ["v"])
    want = {(1, "a", 1), (2, None, None), (3, "c", 9)}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}


def test_reconcile_covers_stored_keys_once(spark):
    jobs = bind(spark, SF, "jobs").filter("is_active")
    r = jn.reconcile(jobs, bind(spark, SF, "live"))
    n = r.groupBy("status").count().collect()
    counts = {x[0]: x[1] for x in n}
    assert counts["delist"] + counts["verify"] == jobs.count()


@pytest.mark.parametrize("bucket", ["minute", "hour", "day", "year"])
def test_change_detection_does_not_depend_on_the_bucket(spark, bucket):
    rng = random.Random(1)
    rows = [(1 if rng.random() < 0.7 else rng.randint(2, 4), i, rng.choice("ab"), f"2024-01-{1 + i // 20:02d} {rng.randint(0, 23):02d}:00:00") for i in range(200)]
    df = spark.createDataFrame(rows, "company_id int, id int, html_hash string, at string").withColumn("crawled_at", F.col("at").cast("timestamp"))
    kept, _ = wn.changed_snapshots(df, bucket=bucket)
    want, last = set(), {}
    for c, i, h, _ in sorted(rows, key=lambda r: (r[3], r[1])):
        if last.get(c) != h:
            want.add(i)
        last[c] = h
    assert {r[0] for r in kept.select("id").collect()} == want


def test_stream_in_two_batches_equals_batch(spark, tmp_path):
    src = bind(spark, SF, "snapshots").select("company_id", "id", "html", "crawled_at")
    early, late = src.filter("id < 500"), src.filter("id >= 500")
    early.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    late.coalesce(1).write.parquet(f"{tmp_path}/in/b")
    stream = (spark.readStream.schema(src.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1)
              .option("latestFirst", False).parquet(f"{tmp_path}/in"))
    got = {r[0] for r in sm.run_changes(stream).select("id").collect()}
    kept, _ = wn.changed_snapshots(src.withColumn("html_hash", tx.content_hash("html")))
    assert got == {r[0] for r in kept.select("id").collect()}


def test_late_snapshots_within_the_delay_give_the_batch_result(spark, tmp_path):
    from vacantis.streaming import state

    rng = random.Random(8)
    rows = [(c, c * 1000 + i, rng.choice("ab"), f"2024-01-{1 + i // 6:02d} {rng.randrange(24):02d}:{rng.randrange(60):02d}:00") for c in range(5) for i in range(60)]
    df = spark.createDataFrame(rows, "company_id long, id long, html_hash string, at string").withColumn("crawled_at", F.col("at").cast("timestamp")).drop("at")
    want = {r.id for r in wn.changed_snapshots(df)[0].select("id").collect()}
    odd = spark.createDataFrame([(None, 1, "x"), (7, None, "x"), (7, 9, None)], "company_id long, id long, html_hash string").withColumn(
        "crawled_at", F.lit("2024-01-02").cast("timestamp")).unionByName(df.limit(1).withColumn("crawled_at", F.lit(None).cast("timestamp")))
    shuffled = sorted(rows, key=lambda r: (r[3][:10], rng.random()))
    parts = [shuffled[i:i + 100] for i in range(0, 300, 100)]
    parts[1], parts[2] = parts[2][:25] + parts[1][25:], parts[1][:25] + parts[2][25:]  # some come too early, some late
    source = f"{tmp_path}/in"
    odd.coalesce(1).write.parquet(source)
    kept = state.changed_pages(spark.readStream.schema(state.SNAPSHOT).parquet(source), "9 days")

    def drain():  # every run begins anew from the checkpoint
        sm.start(kept, f"{tmp_path}/cp", path=f"{tmp_path}/out").awaitTermination()
        return [(r.company_id, r.id) for r in spark.read.schema(state.SNAPSHOT).parquet(f"{tmp_path}/out").collect()]

    for part in parts:
        df.filter(F.col("id").isin([r[1] for r in part])).coalesce(1).write.mode("append").parquet(source)
        so_far = drain()
    assert 0 < len(so_far) < len(want)
    df.limit(1).withColumn("id", F.lit(-1).cast("long")).withColumn("crawled_at", F.lit("2023-12-01").cast("timestamp")).write.mode("append").parquet(source)  # too late
    state.end_marker(spark).write.mode("append").parquet(source)
    got = drain()
    assert len(got) == len(set(got)) and {i for c, i in got if c != 7} == want and (7, 9) in got and len(got) == len(want) + 1


def test_a_batch_of_snapshots_is_one_call_to_the_state():
    from types import SimpleNamespace

    from vacantis.streaming.state import _Changes

    calls = []

    class Held:
        rows = []
        exists = lambda self: bool(self.rows)
        get = lambda self: self.rows[0] if self.one else iter(self.rows)

        def __init__(self, one):
            self.one = one

        def appendList(self, rows):
            calls.append(len(rows))
            self.rows = [*self.rows, *rows]

        def put(self, rows):
            calls.append(len(rows))
            self.rows = rows

        def update(self, row):
            self.rows = [row]

        def clear(self):
            self.rows = []

    handle = SimpleNamespace(getValueState=lambda *a: Held(True), getListState=lambda *a: Held(False), registerTimer=lambda t: None, deleteTimer=lambda t: None)
    rows = [SimpleNamespace(at=k * 1000, id=k, html_hash="ab"[k // 3 % 2]) for k in range(1, 50)]
    now = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    p = _Changes()
    p.init(handle)
    assert list(p.handleInputRows((7,), iter(rows[::-1]), now(0))) == [] and calls == [49]
    first = [r.id for r in p.handleExpiredTimer((7,), now(20), None)]
    later = [r.id for r in p.handleExpiredTimer((7,), now(60), None)]
    assert first == [1, *range(3, 20, 3)] and later == list(range(21, 50, 3)) and calls == [49, 30]


def pieces_of(text, size, overlap, look_back):
    """The chunker's rule over plain positions."""
    if len(text) <= size:
        return [text]
    starts, cuts = [0], []
    while starts:
        s = starts.pop()
        spaces = [k for k in range(s + size - look_back, s + size) if k < len(text) and text[k] == " "]
        cuts.append((s, spaces[-1] if spaces and s + size < len(text) else s + size))
        starts += [b - overlap for b in [cuts[-1][1]] if b - overlap < len(text)]
    return [p for p in (text[a:b].strip() for a, b in cuts) if p]


def test_chunks_follow_the_rule(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abcé  \n") for _ in range(rng.randint(0, 400)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " " * 300), (103, "x" * 300), (104, "\U0001F600 " * 150)]
    df = spark.createDataFrame(rows, "id int, t string")
    for size, overlap, back in ((60, 10, 20), (41, 0, 1), (90, 30, 40)):
        for r in df.select("id", "t", em.chunks("t", size, overlap, back).alias("c")).collect():
            assert r.c == ([] if r.t is None else pieces_of(r.t, size, overlap, back)), (r.id, size)
    plan = df.select(em.chunks("t"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_embedding_is_the_mean_of_its_chunks(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    df = spark.createDataFrame([(1, long), (2, "short text"), (3, None)], "id int, t string")
    out = {r[0]: r[1] for r in em.embedded(df, "id", "t", 16).collect()}
    embed = em.hashing_embedder(16)
    assert out[1] == pytest.approx(embed(pieces_of(long, 6000, 500, 200)).mean(axis=0).tolist(), abs=1e-6)
    assert out[2] == pytest.approx(embed(["short text"])[0].tolist(), abs=1e-6)
    assert out[3] is None


def test_discovery_stream_writes_what_the_batch_plan_finds(spark, tmp_path):
    from vacantis.bindings import AS_OF_EVENTS, load
    from vacantis.plans.discover import route

    found = bind(spark, SF, "discovered")
    companies, queue = bind(spark, SF, "companies"), bind(spark, SF, "queue").filter("created_at >= '2024-01-25'")
    found.coalesce(1).write.parquet(f"{tmp_path}/in")

    def save(new, queued, routed, batch_id):
        routed.select("row_id", "outcome").write.mode("overwrite").parquet(f"{tmp_path}/out/part={batch_id}")

    run = sm.discover_batch(lambda: companies, lambda: queue, save, AS_OF_EVENTS)
    stream = spark.readStream.schema(found.schema).parquet(f"{tmp_path}/in")
    sm.start(stream, f"{tmp_path}/cp", batch=run).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("row_id", "outcome").collect()}
    assert got == {tuple(r) for r in route(found, companies, queue).select("row_id", "outcome").collect()}


def test_engagement_stream_marks_matches(spark, tmp_path):
    m = spark.createDataFrame([(1, 10), (2, 20)], "candidate_id int, job_id int").withColumn(
        "shown_at", F.lit(None).cast("timestamp")).withColumn("clicked_at", F.lit(None).cast("timestamp"))
    e = spark.createDataFrame([(1, 10, "shown", "2024-01-02"), (1, 10, "shown", "2024-01-01"), (1, 10, "clicked", "2024-01-03"),
                               (1, 10, "clicked", "2024-01-04")], "candidate_id int, job_id int, kind string, d string")
    e = e.withColumn("at", F.col("d").cast("timestamp"))
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = sm.run_engagement(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in"), m).collect()
    out = {r[0]: (str(r[2])[:10], str(r[3])[:10]) for r in got}
    assert out == {1: ("2024-01-01", "2024-01-04"), 2: ("None", "None")}


def test_checkpoint_folder_comes_from_the_session(spark):
    from vacantis.session import new_folder, shared_folder

    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_folder(spark) == named
    assert shared_folder(spark) == shared_folder(spark) and new_folder(spark, "x").startswith(shared_folder(spark))
