"""Rules against rows worked out by hand from their definitions."""

import pytest
from pyspark.sql import functions as F

from sparkquarry.functions import contacts as c
from sparkquarry.functions import dates, js, pages, search
from sparkquarry.functions import names as n
from sparkquarry.operators import gates as g
from sparkquarry.operators import records as rec


def told(spark, function, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("function", "rows"),
    [
        (n.dedupe_name, {"A&B Foods PLC": "a and b foods", "ULC Steel Co.": "ulc steel", " X﻿Ltd": "x", None: "", "Éclair Inc": "clair"}),
        (n.census_name, {"The Maple Products Group of Ontario Ltd.": "maple of", "Tom &amp; Co": "tom and", "": ""}),
        (n.search_name, {"The Maple ULC, LLC": "maple", "Grand Plc": "grand plc"}),
        (n.company_key, {"A &#38; B&nbsp;C": "a b c", "R&amp;D": "r d"}),
        (n.person_key, {"Steve B. O'Hara": "steven hara", "bob": "robert", "Rob Roy": "robert roy"}),
        (n.address_key, {"10 North Mill Road, Guelph, ON N1K 1B8 Canada": "10 n mill rd guelph", "Ontario Street": "st"}),
        (n.phone_key, {"+1 (519) 555-0100": "5195550100", "555-0100": "", None: "", "9 1 519 555 0100": "5195550100"}),
        (n.phone_dashed, {"15195550100": "519-555-0100", "25195550100": "", "519.555.0100": "519-555-0100"}),
        (n.domain_key, {"see x; www.A.example.com/p": "a.example.com", "https://linkedin.com/in/x": "", "http://u@B.example:80?q": "b.example", "none": "", "ca.linkedin.com": "ca.linkedin.com"}),
        (n.saved_name, {"About - Maple ,": "Maple", "Location-X": "X"}),
        (pages.company_name, {"Welcome Maple &#8211; Our story of bread": "Maple", "Maple | Bread": "Maple", "Home": ""}),
        (pages.sentence, {"Fine bread. Read more here": "Fine bread.", "A |  B": "A"}),
        (pages.title_case, {"grand-river o'hara": "Grand-River O'Hara"}),
        (pages.slug, {" Plant manager: A & B! ": "plant-manager-a-b"}),
        (pages.city_of_address, {"1 Mill Rd, Guelph, Ontario, X": "Guelph", "Ontario": "", "Guelph": ""}),
        (pages.city, {"near St. Catharines": "St. Catharines", "nowhere": ""}),
        (dates.hint, {"on Sept. 3, 2024 or 2025": "Sept. 3, 2024", "in 2025": "2025", "in 2019": ""}),
        (c.person_name, {"jane doe - Owner": "Jane Doe", "Jane Doe email x": "Jane Doe", "the company": "", "Plant Team": ""}),
        (c.name_in_profile, {"Jane Doe - Owner - X | LinkedIn": "Jane Doe", "Contact Us": ""}),
        (c.linkedin_url, {"https://www.linkedin.com/in/x/?a=1#b": "https://www.linkedin.com/in/x", "https://linkedin.com/company/x": ""}),
        (rec.plain_date, {"2024-05-31": "2024-05-31", "2024-5-1": ""}),
    ],
)
def test_texts(spark, function, rows):
    assert told(spark, function, *rows) == list(rows.values())


def test_blanks_and_edges_are_those_of_javascript(spark):
    assert told(spark, js.clean, " a ﻿b\n", None) == ["a b", ""]
    assert told(spark, lambda x: js.test(x, r"\bet\b"), "été et", "étet", "et\n") == [True, False, True]
    assert told(spark, lambda x: js.sub(x, r"x$", "y"), "x\n", "x") == ["x\n", "y"]


#: Candidates of our own for the seven cases of the gate, and what must be decided.
CASES = [
    ("Shield Pest Control", "food plant in Sampletown Ontario", "Shield Pest Control", ["Pest control for food processing plants.", "Address: 8 Sample Cres, Sampletown, ON. Phone: 416-555-0100."], False),
    ("Bun House | Neighbourhood Bakery Cafe", "bakery in Sampletown Ontario", "Bun House", ["Find a cafe near me. Cakes and coffee."], False),
    ("Easy Loaf Recipe", "meat plant in Sampletown Ontario", "Easy Loaf Recipe", ["Recipe article with steps.", "No company name, no facility."], False),
    ("Example Paving Group", "hot mix asphalt plant in Sampletown Ontario", "Plants", ["Example Paving operates four hot mix asphalt production facilities.", "Yard: 85 Sample Avenue, Sampletown, ON M1V 4S9. Asphalt plant and aggregate supply."], True),
    ("Example Composites", "composites in Sampletown Ontario", "Example Composites", ["Manufactures fiberglass parts by industrial molding.", "Facility: 12 Forge Road, Sampletown, Ontario. Phone: 519-555-0100."], True),
    ("Example Steel", "steel fabrication in Sampletown Ontario", "Example Steel", ["Steel fabrication plant. Products include beams.", "Facility: 10 Sample Road, Sampletown, ON. Phone: 555-010-0100."], True),
    ("Example Supply", "supplier in Sampletown Ontario", "Example Supply", ["Industrial products and plant equipment, production supplies."], False),
]


def test_gates_decide_the_seven_cases(spark):
    rows = [(i, h, q, t, "https://x.example/", s, e) for i, (h, q, t, s, e) in enumerate(CASES)]
    table = spark.createDataFrame(rows, "i int, h string, q string, t string, u string, s array<string>, e boolean")
    got = table.select("i", "e", g.verify_plant(*[F.col(x) for x in "hqtus"]).alias("v")).orderBy("i").collect()
    assert [r["v"]["qualified"] for r in got] == [r["e"] for r in got]
    assert got[0]["v"]["reject_reason"] == "Not proven to be the operator of a manufacturing or processing plant."
    assert got[2]["v"]["reject_reason"] == "Not proven to be an actual company." and got[6]["v"]["reject_reason"] == "No confirmed facility address in the target area."
    asphalt = got[3]["v"]
    assert asphalt["facility"]["city"] == "Sampletown" and asphalt["end_products"] == ["hot mix asphalt", "aggregates"] and asphalt["confidence"] == "medium"
    assert got[5]["v"]["facility"]["phone"] == "555-010-0100" and got[4]["v"]["production_related_names"] == ["composites manufacturing facility", "manufacturing facility"]
    none = spark.range(1).select(g.verify_plant(*[F.lit(None).cast("string")] * 4, F.lit(None).cast("array<string>")).alias("v")).first()["v"]
    assert not none["qualified"] and none["end_products"] == []


def test_sections_and_fields(spark):
    known = ("recent signals / changes / hiring?",)
    put = lambda x: rec.with_section(x, "recent hiring / expansion signals", F.lit("new $1"), known)
    assert told(spark, put, "a\n\n**Recent signals / changes / hiring?**\nold\nmore\n\n**proof**\nx", "a", None) == [
        "a\n\n**recent hiring / expansion signals**\nnew $1\n\n**proof**\nx", "a\n\n**recent hiring / expansion signals**\nnew $1", "**recent hiring / expansion signals**\nnew $1",
    ]
    assert told(spark, lambda x: rec.notes_field(x, "Website"), "A: b\nwebsite:  c d \n", "x Website: y") == ["c d", ""]
    assert told(spark, lambda x: rec.evidence(x, 2), "Our plant makes fine sausages every day. Short plant. Our plant makes fine sausages every day. The address of the mill is well known here! Third facility sentence that is long enough.") == [
        ["Our plant makes fine sausages every day.", "The address of the mill is well known here!"]
    ]


def test_redirects(spark):
    import base64

    coded = "a1" + base64.urlsafe_b64encode(b"https://b.example/?x=1").decode().rstrip("=")
    assert told(spark, lambda u: search.unwrap(u, "bing"), f"https://www.bing.com/ck/a?p=1&u={coded}", "https://c.example/", "https://www.bing.com/ck/a?p=1") == ["https://b.example/?x=1", "https://c.example/", ""]
    assert told(spark, lambda u: search.unwrap(u, "duckduckgo"), "//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.example%2F&rut=1", "https://a.example/x") == ["https://a.example/", "https://a.example/x"]
    assert told(spark, lambda u: search.unwrap(u, "yahoo"), "https://r.search.yahoo.com/_y/RU=https%3a%2f%2fy.example%2f/RK=2/RS=z", "https://r.search.yahoo.com/?RU=https%3A%2F%2Fz.example", "https://q.example/") == [
        "https://y.example/", "https://z.example", "https://q.example/",
    ]


def test_links_of_a_page(spark):
    html = "<a href='/shop'>s</a><a href=\"https://www.A.example/our-team?x\">t</a><a href='people/x'>p</a><a href='https://b.example/team'>o</a><a href='/shop'>s</a> https://ca.linkedin.com/in/q&quot;, <a href='#x'>"
    row = spark.createDataFrame([(html,)], "h string").select(pages.telling_links(F.col("h"), F.lit("https://www.a.example/dir/page")).alias("l"), pages.profile_links(F.col("h")).alias("p")).first()
    assert row["l"] == ["https://www.A.example/our-team?x", "https://www.a.example/dir/people/x", "https://www.a.example/shop"]
    assert row["p"] == ["https://ca.linkedin.com/in/q"]


def test_files(spark, tmp_path):
    from sparkquarry.sources import files

    assert list(files.csv_rows('ab"c,d"e,"x""y"\r\n\n"a\nb",\r')) == [["abc,de", 'x"y'], [""], ["a\nb", ""]]
    (tmp_path / "r.csv").write_text("﻿Food licence number,Legal name\n1, A  Ltd \n\n")
    assert [tuple(r) for r in files.read_registry(spark, str(tmp_path / "r.csv")).collect()] == [("1", "A Ltd", "", "", ""), ("", "", "", "", "")]
    assert files.read_csv(spark, str(tmp_path / "r.csv"), "research").count() == 1
    assert [r["legal_name"] for r in files.read_saved_leads(spark, str(tmp_path / "none.csv"), str(tmp_path / "r.csv")).collect()] == ["A  Ltd"]
    assert files.read_saved_leads(spark, str(tmp_path / "none.csv")).columns[0] == "company"
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("---\nNAME: One\nsubject: S: x\n---\n\nbody\n")
    (tmp_path / "t" / "b.txt").write_text("---\nno end")
    assert sorted(map(tuple, files.read_templates(spark, str(tmp_path / "t")).collect())) == [("a.txt", "One", "", "S: x", "body"), ("b.txt", "b.txt", "", "", "---\nno end")]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "1.json").write_text('{"createdAt": 1000, "query": "q", "results": []}')
    day = 86_400_000
    assert [files.read_search_cache(spark, str(tmp_path / "c"), now).count() for now in (1000 + 7 * day - 1, 1000 + 7 * day)] == [1, 0]
    log = spark.createDataFrame([("2024-01-02T1", "sent-pending-bounce"), ("2024-01-02T2", "failed"), ("2024-01-03", "sent-pending-bounce")], "ts string, result string")
    files.append_log(log, str(tmp_path / "log"))
    files.append_log(log, str(tmp_path / "log"))
    (tmp_path / "log" / "broken.json").write_text("{oops\n")
    assert files.sends_of_day(files.read_log(spark, str(tmp_path / "log"), "ts string, result string"), "2024-01-02").first()["n"] == 2
    files.write_csv(spark.createDataFrame([("a,b", "", 'q"')], "x string, y string, z string").coalesce(1), str(tmp_path / "out"), ("z", "x"), only=True, line_end="\r\n")
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == 'z,x\r\n"q""","a,b"\r\n'
    files.write_report(log.limit(1), log, str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep" / "results")).count() == 3


def test_roles_and_pasted_contacts(spark):
    assert told(spark, c.role_text, "Plant Manager at X Foods", "as Owner and", "About Jo: phone number. Jo is currently a Head Brewer at X", "experience: QA Manager - ZoomInfo x", "Brewing Assist.") == [
        "Plant Manager", "Owner", "Head Brewer at X", "QA Manager", "Brewing Assistant",
    ]
    row = spark.createDataFrame([("1. Jane Doe\tPlant Manager at X | jim roe   Owner   Sales Team | nobody",)], "v string")
    assert [tuple(r) for r in row.select(c.pasted_contacts(F.col("v"), F.lit("u")).alias("x")).first()["x"]] == [("Jane Doe", "Plant Manager", "u"), ("Jim Roe", "Owner", "u")]
    assert told(spark, lambda x: rec.number(x, 7.0), "", " 3.5 ", "a", None, "1e3") == [0.0, 3.5, 7.0, 7.0, 1000.0]


def test_periods_stream_as_in_batch(spark, tmp_path):
    from sparkquarry.streaming.events import busy_periods, log_counts

    rows = [("a", f"2024-01-01 00:{m:02}:00", line) for m, line in ((0, "Search: x"), (5, " Skipped: y | z"), (30, "Added row 1: q"))] + [("b", "2024-01-01 00:01:00", "Skipped: late")]
    lines = spark.createDataFrame(rows, "run string, ts string, line string").selectExpr("run", "cast(ts as timestamp) ts", "line")
    assert sorted((r["run"], r["lines"]) for r in busy_periods(lines).collect()) == [("a", 1), ("a", 2), ("b", 1)]
    lines.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
    for name, make in (("periods", busy_periods), ("log_counts", log_counts)):
        query = make(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert sorted(spark.table(name).collect()) == sorted(make(lines).collect())
