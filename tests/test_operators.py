"""Cases that the driver's tables don't hold: nulls, ties, repeats, empty tables."""

from pyspark.sql import functions as F

from tracewright.operators import aggregates as A
from tracewright.operators import joins as J
from tracewright.operators import reshape as R
from tracewright.operators import windows as W
from tracewright.plans import analyses, events
from tracewright.plans.registry import Registry, fitting_plugins


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_flagged_and_excluded(spark):
    left = spark.createDataFrame([(1, "A"), (2, None), (3, "B"), (3, "B")], "i int, h string")
    members = spark.createDataFrame([("A",), ("A",), (None,)], "h string")
    for limit in (0, 10):
        assert rows(J.flagged(left, F.col("h"), members, F.col("h"), "known", rows=limit)) == [(1, "A", "Matching"), (2, None, "Not Matching"), (3, "B", "Not Matching"), (3, "B", "Not Matching")]
    rules = spark.createDataFrame([("d", None), (None, "t"), ("e", "u")], "db string, tab string")
    data = spark.createDataFrame([("d", "x"), ("x", "t"), ("e", "u"), ("e", "v"), (None, None)], "db string, tab string")
    assert rows(J.excluded(data, rules, [["db"], ["tab"], ["db", "tab"]])) == [("e", "v"), (None, None)]


def test_first_match_and_zip(spark):
    files = spark.createDataFrame([(1, "/data/app/x/y"), (2, "/data/z"), (3, None), (4, "/other/q")], "id int, path string")
    patterns = spark.createDataFrame([("/data/", "low", 2), ("/data/app/", "high", 1)], "prefix string, pack string, rank int")
    got = J.first_match(files, "path", patterns, "prefix", "rank", "id", (2, 3))
    assert {r["id"]: r["matched_pack"] for r in got.collect()} == {1: "high", 2: "low", 3: None, 4: None}
    a, b = spark.createDataFrame([("g", 1), ("g", 2)], "g string, x int"), spark.createDataFrame([("g", 9)], "g string, y int")
    assert rows(J.zipped(a, b, [F.col("x")], [F.col("y")], ["g"])) == [("g", 1, 9)]


def test_upsert(spark):
    base = spark.createDataFrame([("one", "a"), ("two", "b"), ("two", "c")], "k string, v string")
    changes = spark.createDataFrame([("one", "x"), ("two", "y"), ("new", "z"), ("new", "z")], "k string, v string")
    assert rows(J.upserted(base, changes, "k")) == [("new", "z", 0), ("one", "x", 1), ("two", "b", 1), ("two", "c", 1)]


def test_windows(spark):
    log = spark.createDataFrame([("v", i, "same" if i in (1, 30) else "o", i == 1) for i in range(1, 31)] + [("v", 26, "same", False)], "par string, n int, lcn string, init boolean")
    got = W.looked_back(log.filter("n <= 26"), ["par"], [F.col("n"), F.col("lcn")], 25, "lcn", F.col("init"), "n", "hit").filter("n = 26 and lcn = 'same'").first()
    assert got["hit"] is None  # 26 rows back
    got = W.looked_back(log.filter("n <= 25 or lcn = 'same'").filter("n < 27"), ["par"], [F.col("n"), F.col("lcn")], 25, "lcn", F.col("init"), "n", "hit").filter("n = 26").first()
    assert got["hit"] == 1
    assert tuple(spark.range(1).select(W.run_cells(F.lit("2118aa34")).alias("r")).first()["r"]) == (0x18, 0x34AA)
    lines = spark.createDataFrame([("f", 1, "a"), ("f", 2, " b"), ("f", 3, "c")], "f string, n int, t string")
    assert rows(W.merged_lines(lines, ["f"], "n", "t", ~F.col("t").startswith(" "))) == [("f", 1, "a  b"), ("f", 3, "c")]


def test_reshape(spark):
    tree = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("d", "zz", "D"), ("x", "y", "X"), ("y", "x", "Y")], "k string, p string, n string")
    assert {r["k"]: r["path"] for r in R.paths(tree, "k", "p", "n").collect()} == {"a": "A", "b": "A/B", "c": "A/B/C", "d": "D"}
    marks = '{"roots": {"name": "bar", "children": [{"name": "x", "children": [{"name": "deep"}]}, {"name": "y"}]}}'
    frame = spark.createDataFrame([(1, marks), (2, None), (3, "{bad")], "i int, j string")
    assert [(r["path"], r["depth"]) for r in R.tree_rows(frame, ["i"], "j", "children", "name", "roots").collect()] == [("/bar", 0), ("/bar/x", 1), ("/bar/x/deep", 2), ("/bar/y", 1)]
    times = spark.createDataFrame([(1, "2020-01-01 00:00:00", " "), (2, "1601-01-01 00:00:00", None)], "i int, a string, b string")
    assert rows(R.labelled_times(times, ["i"], {"A": F.col("a"), "B": F.col("b")})) == [(1, "A", "2020-01-01 00:00:00")]
    a, b = spark.createDataFrame([("p", 1)], "g string, x int"), spark.createDataFrame([("p", 2), ("q", 3)], "g string, x int")
    assert rows(R.by_priority([a, b], ["g"])) == [("p", 1), ("q", 3)]


def test_dense_grids_of_nothing(spark):
    none = spark.createDataFrame([], "t string")
    counts = A.count_by_prefix(none, F.col("t"), 7)
    assert A.dense_months(counts).count() == 0 and A.dense_minutes(counts).count() == 0
    two = spark.createDataFrame([("2020-03-01 00:00:00",), ("2021-03-01 00:00:00",), (None,), ("x",)], "t string")
    assert A.dense_months(A.count_by_prefix(two, F.col("t"), 7)).filter("cnt > 0").count() == 2


def test_event_categories(spark):
    xml = '<Data Name="TargetUserName">bob</Data>'
    frame = spark.createDataFrame([("4624", "Security.evtx", xml), ("6005", "system.evtx", None), ("4624", "Other.evtx", xml), ("4688", None, xml), ("11707", None, "")], "event_id string, source string, data string")
    got = {(r["event_id"], r["category"], r["description"], (r["values"] or {}).get("TargetUserName")) for r in events.categorised(frame).collect()}
    assert got == {("4624", "logonoff", "Log On", "bob"), ("6005", "pc_onoff", "PC On", None), ("11707", "msi_installer", "msi_installer", None)}


def test_analyses(spark):
    tags = "par_id string, case_id string, evd_id string"
    calls = spark.createDataFrame([("p", "c", "e", "2024-01-01T00:00:00", "61", "Incoming", "1")], f"{tags}, date string, duration string, type string, number string")
    sms = spark.createDataFrame([("p", "c", "e", "2024-01-01T00:00:00", "Sent", "9", "hello")], f"{tags}, date string, direction string, address string, body string")
    line = analyses.timeline({"calls": calls, "sms": sms})
    assert {(r["event_type"], r["duration"], r["description"]) for r in line.collect()} == {("Call", "0:01:01", "to:1, call_type:Incoming"), ("Message(SMS)", "00:00:00", "from:, to:9, content:hello")}
    assert {(r["kind"], r["direction"], r["message"]) for r in analyses.communication({"calls": calls, "sms": sms}).collect()} == {("Call", "Incoming", ""), ("SMS", "Outgoing", "llo")}
    records = spark.createDataFrame([(1, 10), (2, 20)], "reference bigint, size bigint")
    changes = spark.createDataFrame([(1, "DATA_EXTEND CLOSE"), (1, "FILE_DELETE CLOSE"), (1, "FILE_CREATE DATA_EXTEND"), (3, "X CLOSE")], "reference bigint, reason string")
    assert {(r["reference"], r["change"], r["size"]) for r in analyses.journal_history(records, changes).collect()} == {(1, "FILE_DELETE", "10"), (1, "FILE_CREATE", "10"), (2, "MFT_FILE_CREATE", "20"), (3, "", "?")}
    files = spark.createDataFrame([(1, 5, 1, 5, 2), (7, 1, 1, 1, 1), (None, 1, 1, 1, 1), (1, 11644473605, 0, 3, 0)], "type int, mtime bigint, mtime_nano int, ctime bigint, ctime_nano int")
    assert rows(analyses.file_history(files).select("is_copied", "mtime_text")) == [("N", "1970-01-01T00:00:05.0Z"), ("Y", "1970-01-01T00:00:05.1Z")]
    prefetch = spark.createDataFrame([("p", "c", "e", "A.EXE", "/a", "2020-01-01 00:00:00", "2021-01-01 00:00:00,1960-01-01 00:00:00, ")], f"{tags}, name string, path string, created string, run_times string")
    assert analyses.app_history({"prefetch": prefetch}).count() == 2


def test_registry():
    r = Registry()
    for n in ("a", "b", "c"):
        r.add(n, len)
    assert r.selected("a,!b") == ["a"] and r.selected("!b") == ["a", "c"] and r.selected(None) == ["a", "b", "c"] and r.selected("C/part") == ["c"] and r.plugins("c/part,a", "c") == ["part"]
    try:
        r.add("A", len)
        raise AssertionError("taken twice")
    except KeyError:
        pass
    assert fitting_plugins({"x": {"t"}, "y": {"t", "u"}}, {"t"}) == ["x"]


def test_browser(spark):
    from tracewright.plans import browser as B

    urls = spark.createDataFrame([(1, "https://www.google.com/q", "T", 13277989822083577), (2, "https://a.test", None, 0)], "id int, url string, title string, last_visit_time bigint")
    terms = spark.createDataFrame([(1, "x"), (9, "lost")], "url_id int, term string")
    assert rows(B.search_terms(terms, urls)) == [("x", "https://www.google.com/q", "Google", "2021-10-06T10:30:22.083577")]
    visits = spark.createDataFrame([(1, 1, 0, 7, 1, 0, 0), (2, 2, 1, 8, 0x30000000, 13277989822083577, 61_000_000)], "id int, url int, from_visit int, segment_id int, transition bigint, visit_time bigint, visit_duration bigint")
    got = {r["id"]: r for r in B.visit_history(visits, urls, spark.createDataFrame([(7, "s")], "id int, name string")).collect()}
    assert (got[1]["from_url"], got[1]["segment"], got[1]["visited"], got[1]["core"]) == ("", "s", "", "typed")
    assert (got[2]["from_url"], got[2]["title"], got[2]["segment"], got[2]["qualifiers"], got[2]["duration"]) == ("https://www.google.com/q", "", "", "chain_start|chain_end", "0:01:01")
    places = spark.createDataFrame([(1, "u1", "t")], "id int, url string, title string")
    steps = spark.createDataFrame([(1, 1, 0, 1, 1609493672426000), (2, 1, 1, 99, 5)], "id int, place_id int, from_visit int, visit_type int, visit_date bigint")
    assert {(r["id"], r["from_url"], r["kind"]) for r in B.place_history(steps, places).collect()} == {(1, "0", "Link"), (2, "u1", "99")}
    targets = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], "place_id int, target_id int, target string")
    details = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 3, "p"), (2, 4, "q")], "place_id int, detail_id int, detail string")
    assert rows(B.downloads(targets, details)) == [(1, "a", "x"), (1, "b", "y"), (2, "c", "p"), (2, "c", "q")]
    profile = spark.createDataFrame([("p", '{"roots": {"bookmark_bar": {"name": "bar", "children": [{"name": "n"}]}}, "zoom": {"a.test": 2}}')], "profile string, j string")
    assert [r["path"] for r in B.bookmarks(profile, "j").collect()] == ["/bar", "/bar/n"] and rows(B.site_settings(profile, "j", "$.zoom")) == [("p", "a.test", "2")]
    assert B.cookies(spark.createDataFrame([("h", "n")], "host_key string, name string")).first()["same_site"] == ""
    icon = B.icons(spark.createDataFrame([("pg", 1), ("px", 2)], "page_url string, icon_id int"), spark.createDataFrame([(1, "i")], "id int, url string"), spark.createDataFrame([(1, 16, 16)], "icon_id int, width int, height int"))
    assert rows(icon) == [("pg", "i", 16, 16), ("px", None, None, None)]


def test_mobile(spark):
    from tracewright.plans import mobile as M

    addresses = spark.createDataFrame([(1, 0x89, "f2", 2), (1, 0x89, "f1", 1), (1, 0x97, "t", 3)], "msg_id int, type int, address string, _id int")
    got = M.mms(spark.createDataFrame([(1, 10), (2, 20)], "_id int, date bigint"), addresses, spark.createDataFrame([(1, "text/plain", "hi")], "mid int, ct string, text string"))
    assert {(r["_id"], r["from"], r["to"], r["cc"], r["text"]) for r in got.collect()} == {(1, "f1", "t", None, "hi"), (2, None, None, None, None)}
    assert {r["kind"] for r in M.calls(spark.createDataFrame([("1", 3, 0, 5), ("1", 77, 0, 5)], "number string, type int, date bigint, duration int")).collect()} == {"Missed", "77"}
    assert M.sms(spark.createDataFrame([("a", 2, 0, "b")], "address string, type int, date bigint, body string").select("*")).first()["at"] is None
    files = spark.createDataFrame([(1, "/data/data/x.y/db/a"), (2, "/data/user/0/x.y/f"), (3, "/sys/f")], "row_id int, path string")
    apps = spark.createDataFrame([(10, "x.y"), (11, "x.y")], "uid int, package string")
    assert {r["row_id"]: r["matched_package"] for r in M.files_of_apps(files, apps).collect()} == {1: "x.y", 2: "x.y", 3: None}


def test_classifier(spark):
    from tracewright.plans import classifier as C

    docs = spark.createDataFrame([(i, ("red apple pie" if i % 2 else "blue sea wave") + f" {i}", "food" if i % 2 else "water") for i in range(60)] + [(99, None, None)], "id int, t string, label string")
    model = C.train(docs, "t", "label", "id")
    pairs = docs.join(C.classify(docs, model, "id", "t"), "id").filter("label is not null")
    assert C.figures(C.confusion(pairs, "label", "predicted"), "label", "predicted").first()["f1"] == 1.0
    from pyspark.sql import functions as F
    assert spark.range(1).select(C.padded(F.array(F.lit("b")), 3).alias("x")).first()["x"] == ["", "", "b"]
