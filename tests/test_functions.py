from datetime import date

from pyspark.sql import functions as F

from rolecall import dims
from rolecall.functions import bands, dates, html, text, vectors
from rolecall.operators import filters

AS_OF = "2001-09-01"


def test_parse_band(each):
    levels = ["5-8 Yrs", "10+ Yrs", "Entry level", "Mid-Senior level", "Director", None, "5 - 8 Yrs", "1-3 and 4+"]
    got = [(b["min"], b["max"]) for b in each(bands.parse_band, levels)]
    assert got == [(5, 8), (10, 20), (0, 2), (3, 10), (0, 10), (0, 10), (0, 10), (1, 3)]


def test_bands_overlap(each):
    fresher = lambda c: bands.bands_overlap(c, F.lit("Fresher"))
    experienced = lambda c: bands.bands_overlap(c, F.lit("experienced"))
    assert each(fresher, ["2-5 Yrs", "5-8 Yrs", None, ""]) == [True, False, False, False]
    assert each(experienced, ["2-5 Yrs", "0-2 Yrs"]) == [True, False]
    assert each(lambda c: bands.bands_overlap(c, F.lit("")), ["2-5 Yrs"]) == [False]


def test_experience_filter(each):
    levels = ["1-3 Yrs", "10-15 Yrs", "Not Available", None]
    assert each(lambda c: filters.experience_filter(c, F.lit("Fresher")), levels) == [True, False, False, False]
    assert each(lambda c: filters.experience_filter(c, F.lit("EXPERIENCED")), levels) == [False, True, True, False]
    assert each(lambda c: filters.experience_filter(c, F.lit("Any")), levels) == [True] * 4


def test_like_keeps_wildcards_and_survives_backslashes(each):
    roles = lambda *r: F.array(*map(F.lit, r))
    titles = ["Full Stack Developer Remote", "Fullstack"]
    assert each(lambda t: filters.title_matches_any(t, roles("full_stack_developer")), titles) == [True, False]
    assert each(lambda t: filters.title_matches_any(t, F.array().cast("array<string>")), titles) == [True, True]
    pattern = lambda p: filters.contains_like(F.lit("50% off c\\d"), p)
    assert each(pattern, ["0\\% OFF", "0_ off", "0x off", "\\", "d\\"]) == [True, True, False, True, True]
    assert each(filters.has_location, ["  ", "", None, "x"]) == [False, False, False, True]


def test_normalise_level(spark):
    rows = [("LinkedIn", "Associate"), ("Naukri", "Associate"), ("LinkedIn", "5-8 Yrs"), ("LinkedIn", None)]
    df = spark.createDataFrame(rows, "source string, level string")
    got = [r.x for r in df.select(bands.normalise_level(F.col("source"), F.col("level")).alias("x")).collect()]
    assert got == ["2-5 Yrs", "Associate", "5-8 Yrs", None]


def test_posted_dates(each):
    texts = ["just now", "5 hours ago", "today", "yesterday", "3 days ago", "30+ days ago", "2 weeks ago",
             "1 month ago", "a day ago", "1 year ago", "Not Available", None]
    back = [(date(2001, 9, 1) - d).days for d in each(lambda c: dates.parse_posted(c, AS_OF), texts)]
    assert back == [0, 0, 0, 1, 3, 30, 14, 30, 0, 0, 0, 0]


def test_days_since_and_labels(each):
    days = each(lambda c: dates.days_since(c, AS_OF), ["2001-07-23", "2001-09-02", "oops", None])
    assert days == [40, 0, 0, 0]
    labels = each(dates.age_label, [0, 1, 2, 7, 14, 21, 28, None], "int")
    assert [x.removeprefix("Posted ") for x in labels] == [
        "today", "yesterday", "2 days ago", "a week ago", "2 weeks ago", "3 weeks ago", "a month ago", "recently",
    ]


def test_experience_spans(each):
    texts = [
        "work experience january 2019 - march 2021",
        "june 2001 - present",
        "march 2021 - january 2021",
        "jan 2020 - feb 2020",
        "may 1999 - may 2000 work experience may 2000 - july 2000 work experience june 2000 - june 2010",
    ]
    months = lambda strict: lambda c: dates.total_months(dates.month_spans(c, AS_OF, strict))
    assert each(months(False), texts) == [26, 3, 0, 1, 2]
    assert each(months(True), texts) == [26, 3, 0, 0, 2]
    details = each(lambda c: dates.experience_details(dates.month_spans(c, AS_OF)), texts[:3])
    assert [d[0]["duration"] for d in details] == ["2 years", "3 months", "10 months"]
    assert each(bands.categorise, [1.0, 1.01], "double") == ["Fresher", "Experienced"]


def test_contacts(each):
    texts = ["mail a.b-c@x.co now", "+919876543210", "(040) 123-4567", "none", "a@@b@c", "x" * 50000]
    assert each(text.email, texts) == ["a.b-c@x.co", "Not found", "Not found", "Not found", "b@c", "Not found"]
    assert each(text.phone, texts)[1:4] == ["+919876543210", "(040) 123-4567", "Not found"]
    assert each(text.person_name, ["jane doe - x\ny", "", "--\nz"]) == ["jane doe", "Unknown", "Unknown"]


def test_role_phrases_are_linear_in_the_text(each):
    texts = ["senior data engineer, interned", "software engineering", "word " * 30000, "qa engineer2 data\nanalyst"]
    assert each(text.role_phrases, texts) == [["senior data engineer"], [], [], ["data analyst"]]


def test_education(each):
    got = each(text.education, ["b.tech computer science, 2015", "m.sc", "bachelor of arts college of x 1990 - 1994"])
    assert [[tuple(e) for e in x] for x in got] == [
        [("b.tech", "computer science")],
        [("m.sc", "Unknown")],
        [("bachelor of", "arts")],
    ]


def test_numbers_and_job_types(each):
    assert each(text.first_number, ["Over 200 applicants", "1,234 applicants", "none", None, "12,5"]) == [200, 1234, 0, 0, 12]
    texts = ["Employment Type: Full Time, Permanent", "a contract role", "none", "Not Available"]
    assert each(text.job_type_from_text, texts) == ["Full Time", "contract", "Not Available", "Not Available"]
    assert each(text.slug, ["Data Engineer"]) == ["data_engineer"]
    assert each(text.search_term, ["data_engineer"]) == ["data%20engineer"]


def test_labels(each):
    assert each(text.score_label, [12.345, None], "double") == ["12.35", "0.00"]
    assert each(text.overflow_label, [["a"] * 7, ["a"] * 5], "array<string>") == ["+2 more", None]
    assert each(text.joined_skills, [["a", "b"], []], "array<string>") == ["a, b", "Not Available"]


def test_cosine(spark):
    rows = [([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    score = F.round(vectors.cosine_percent(a, b, vectors.norm(a), vectors.norm(b)), 6)
    assert [r.s for r in df.select(score.alias("s")).collect()] == [100.0, 0.0, 0.0]


def test_vectors_from_json(each):
    assert each(vectors.from_json, ["[1, 2.5]", "oops", None]) == [[1.0, 2.5], None, None]
    usable = lambda c: vectors.is_usable(c, 2)
    assert each(usable, [[1.0, 2.0], [1.0], [float("nan"), 1.0], [None, 1.0], None], "array<double>") == [True] + [False] * 4
    back = lambda c: vectors.from_json(vectors.to_json(c, F.lit("text")))
    assert each(back, [[0.1, -2.5]], "array<float>") == [[0.10000000149011612, -2.5]]


def test_bonus(spark):
    df = spark.createDataFrame([(50.0, 3), (95.0, 5), (50.0, 9), (-5.0, 0)], "s double, n int")
    got = [r.x for r in df.select(vectors.with_bonus(F.col("s"), F.col("n")).alias("x")).collect()]
    assert got == [62, 100, 70, -5]


def test_html(each):
    page = (
        '<h1 class="A t">no</h1><h1 class="t">a &amp;lt; &#8364;&#x20AC;<b>x</b></h1>'
        '<div class="q d">1<div>2<DIV>3</DIV></div>4</div>5<div class="open">6<p>7'
    )
    assert each(lambda c: html.text_of(html.inner(html.after(c, "div", "d"), "div")), [page]) == ["1234"]
    assert each(lambda c: html.text_of(html.inner(html.after(c, "h1", "t"), "h1")), [page]) == ["no"]
    assert each(lambda c: html.after(c, "h1", "a"), [page]) == [None]
    assert each(lambda c: html.text_of(html.inner(html.after(c, "div", "open"), "div")), [page]) == ["67"]
    assert each(html.decode_entities, ["&amp;lt; &#8364;&#x20AC; &#39;&bogus; &"]) == ["&lt; €€ '&bogus; &"]
    assert each(html.visible, ["a<!-- <b> --><script>x</script><STYLE>y</STYLE>b"]) == ["ab"]


def test_read_texts(spark):
    page = '<span class="a">one</span><a class="b"> <i>two</i>&nbsp;</a><span class="c"></span>'
    fields = {
        "first": [("a", "z"), ("span", "y"), ("span", "a")],
        "second": [("a", "b")],
        "empty": [("span", "c"), ("span", "a")],
        "none": [("p", "x")],
    }
    row = html.read_texts(spark.createDataFrame([(page,)], "html string"), "html", fields).first()
    assert (row["first"], row["second"], row["empty"], row["none"]) == ("one", "two", "", None)


def test_seed_dimensions():
    skills = dims.seed_skills()
    assert len(skills) >= 60 and len({s.lower() for s in skills}) < len(skills)
    roles = dims.role_skills()
    assert len(roles) == 10
    assert {s for _, needed in roles for s in needed} - {s.lower() for s in skills}
