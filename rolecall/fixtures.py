"""Postings, candidates, resumes and pages derived from the TPC-H-like test tables.

Tests, benchmark and the query registry run the jobs on these frames. Each is
defined a second time in SQL (``checks/oracle.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dims
from .functions.dates import MONTHS

AS_OF = "2001-09-01"
TITLES = [role for role, _ in dims.role_skills()] + ["Senior Python Developer", "Sales Manager"]
SOURCES = ["LinkedIn", "Naukri", "Indeed"]
LEVELS = [*dims.LEVEL_BANDS, "0-2 Yrs", "1-3 Yrs", "5-8 Yrs", "10+ Yrs", "Fresher", "Not Available", None]
JOB_TYPES = ["Full Time", "Contract", "Internship", "", "Not Available", None]
POSTED = [
    "just now", "5 hours ago", "today", "yesterday", "3 days ago",
    "30+ days ago", "2 weeks ago", "1 month ago", "a day ago", "1 year ago",
    "99999999 months ago", "200000000 days ago",
]
FORM_LEVELS = ["Fresher", "Experienced", "", None]
ROLE_LINES = [
    "senior data engineer, interned at acme",
    "python developer and data analyst",
    "software engineering student",
    "full-stack developer; machine learning engineer",
    "lead architect 2nd level\nintern",
]
EDUCATION = [
    "b.tech computer science, 2015",
    "bachelor of arts university of mumbai",
    "m.sc physics; ph.d statistics 1990 - 1994",
    "master of business administration college of delhi",
    "",
]


def skill_list() -> list[str]:
    """The distinct lower-cased seed skills."""
    return list(dict.fromkeys(s.lower() for s in dims.seed_skills()))


TABLES = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def row_count(df: DataFrame) -> Column:
    """The number of rows as a scalar subquery."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


#: Rows of one task where much is computed inside each row.
TASK_ROWS = 5000


def dealt(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """``df`` in tasks of about ``rows`` rows. A small file with many rows is read by one task, which would do all
    that follows inside the rows; narrow rows are dealt before they grow."""
    return df.repartition(max(1, -(-df.count() // rows)))


def pick(values: list, index: Column) -> Column:
    """``values[index % len(values)]``."""
    quoted = ["cast(null as string)" if v is None else "'" + v.replace("'", "\\'") + "'" for v in values]
    literal = F.expr(f"array({', '.join(quoted)})")
    return F.element_at(literal, (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def _text(col: Column) -> Column:
    return col.cast("string")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posting table plus ``posted_text``; one row per order."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n_vectors = vectors.count()
    k = F.col("id")
    skills = skill_list()
    s1, s2, s3 = (pick(skills, k * m) for m in (1, 7, 13))
    job_type = pick(JOB_TYPES, F.floor(k / 5))
    wording = F.concat(
        F.lit("We need "), "s1", F.lit(", "), "s2", F.lit(" and "), "s3", F.lit("; "), "s1",
        F.lit(" daily. Employment Type: "), F.coalesce("job_type", F.lit("Permanent")),
    )
    description = F.when(k % 29 == 0, "Not Available").when(k % 31 == 0, "").otherwise(wording)
    listed = F.concat_ws(", ", "s1", "s2", "s3")
    base = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("id"),
            F.col("c_name").alias("company"),
            F.col("n_name").alias("location"),
            "o_custkey",
            "o_totalprice",
            "o_orderdate",
        )
        .withColumn("s1", s1)
        .withColumn("s2", s2)
        .withColumn("s3", s3)
        .withColumn("job_type", job_type)
        .withColumn("job_description", description)
        .join(vectors, k % n_vectors == F.col("vec_id"))
    )
    return base.select(
        "id",
        pick(TITLES, k).alias("job_title"),
        "company",
        "location",
        F.when(k % 4 == 0, "Not disclosed")
        .otherwise(F.concat(F.lit("INR "), _text(F.floor("o_totalprice"))))
        .alias("salary"),
        F.when(k % 37 == 0, "").when(k % 41 == 0, "Not Available").otherwise(listed).alias("skills_required"),
        F.concat(F.lit("https://jobs.example.com/"), _text(k)).alias("job_link"),
        F.to_date("o_orderdate").alias("posted_date"),
        F.when(k % 17 != 0, (F.col("o_custkey") % 50).cast("int")).alias("applicants"),
        pick(SOURCES, F.floor(k / 12)).alias("source"),
        pick(LEVELS, k).alias("experience_level"),
        F.lower(F.replace(pick(TITLES, k), F.lit(" "), F.lit("_"))).alias("role"),
        "job_description",
        "job_type",
        F.when(F.col("job_description") != "Not Available", F.col("embedding")).alias("embedding"),
        F.col("o_orderdate").cast("timestamp").alias("scraped_at"),
        pick(POSTED, k).alias("posted_text"),
    )


def candidate_skills(k: Column) -> Column:
    skills = skill_list()
    steps = [(1, 0), (3, 1), (5, 2), (11, 3), (17, 4)]
    all_five = [pick(skills, k * m + a) for m, a in steps]
    return F.array_distinct(F.when(k % 7 == 0, F.array(*all_five[:2])).otherwise(F.array(*all_five)))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate per customer; ``resume_text`` is '' for every thirteenth."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n_vectors = vectors.count()
    k = F.col("c_custkey")
    roles = [role.lower().replace(" ", "_") for role, _ in dims.role_skills()]
    return (
        table(spark, sf_dir, "customer")
        .join(vectors, k % n_vectors == F.col("vec_id"))
        .select(
            k.alias("candidate_id"),
            F.when(k % 10 == 0, "").otherwise(F.concat(F.lit(" Nation_"), _text(F.col("c_nationkey")))).alias("pref_location"),
            pick(FORM_LEVELS, k).alias("form_level"),
            F.when(k % 2 == 0, "Fresher").otherwise("Experienced").alias("parsed_level"),
            candidate_skills(k).alias("skills"),
            F.when(k % 9 == 0, F.array().cast("array<string>"))
            .otherwise(F.array_distinct(F.array(pick(roles, k), pick(roles, k * 3 + 1), pick(roles, k * 7 + 2))))
            .alias("best_job_roles"),
            "embedding",
            F.when(k % 13 == 0, "").otherwise("text").alias("resume_text"),
        )
    )


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    year = (k % 10 + 1990).cast("int")
    first = F.concat(pick(MONTHS, k), F.lit(" "), _text(year), F.lit(" - "), pick(MONTHS, k * 5 + 3), F.lit(" "),
                     _text(year + (k % 4).cast("int")))
    second = (
        F.when(k % 3 == 0, "\njune 2001 - present")
        .when(k % 3 == 1, "\njan 2000 - feb 2001, acme")
        .otherwise("")
    )
    text = F.concat(
        F.lower(F.replace("c_name", F.lit("#"), F.lit(" "))), F.lit(" - profile\n"),
        F.lit("user"), _text(k), F.lit("@mail.example.com\n"),
        F.lit("phone: 9"), F.lpad(_text(k), 9, "0"), F.lit("\n"),
        pick(ROLE_LINES, k), F.lit("\nskills: "), F.array_join(candidate_skills(k), ", "),
        F.lit("\nwork experience "), first, second, F.lit("\n"),
        pick(EDUCATION, k),
    )
    return dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name")).select(k.alias("candidate_id"), text.alias("text"))


def _tagged(tag: str, cls: str, text: Column) -> Column:
    return F.concat(F.lit(f'<{tag} class="x {cls} y" id="i">\n '), text, F.lit(f" </{tag}>"))


def posting_pages(posts: DataFrame) -> DataFrame:
    """A detail page per posting: ``id % 2`` picks the selector, ``id % 11 = 0`` leaves fields out."""
    k = F.col("id")
    first = k % 2 == 0
    either = lambda tag1, c1, tag2, c2, text: F.when(first, _tagged(tag1, c1, text)).otherwise(_tagged(tag2, c2, text))
    left_out = lambda html: F.when(k % 11 == 0, "").otherwise(html)
    title = F.when(
        first, F.concat(F.lit('<h1 class="top-card-layout__title">'), "job_title", F.lit("</h1>"))
    ).otherwise(F.concat(F.lit("<H1>"), "job_title", F.lit("</H1>")))
    company = F.when(k % 5 == 0, F.concat("company", F.lit(" &amp; Sons"))).otherwise(F.col("company"))
    body = F.concat(F.lit("<div><p>"), "job_description", F.lit("</p></div><p><b>Join<br>us</b></div>"))
    described = F.when(
        first, F.concat(F.lit('<div class="show-more-less-html__markup">'), body)
    ).otherwise(F.concat(F.lit("<div class='jobs-description__content z'>"), body))
    applicants = F.coalesce(F.concat(F.lit("Over "), F.format_number(F.col("applicants") * 37, 0), F.lit(" applicants")), F.lit("Be first"))
    item = lambda label, value: F.concat(
        F.lit('<li class="description__job-criteria-item"><h3 class="description__job-criteria-subheader">'),
        F.lit(label),
        F.lit('</h3><span class="description__job-criteria-text">'),
        value,
        F.lit("</span></li>"),
    )
    criteria = F.concat(
        F.lit("<ul>"),
        item("Seniority level", F.coalesce("experience_level", F.lit(""))),
        item("Employment type", F.coalesce("job_type", F.lit(""))),
        F.lit("</ul>"),
    )
    html = F.concat(
        F.lit("<html><head><style>h1{x}</style></head><body><!-- <h1>no</h1> -->"),
        F.when(k % 5 == 0, "<script>var a='<h1 class=\"top-card-layout__title\">no</h1>';</script>").otherwise(""),
        title,
        either("a", "topcard__org-name-link", "span", "topcard__flavor", company),
        left_out(either("span", "topcard__flavor--bullet", "span", "jobs-unified-top-card__bullet", F.col("location"))),
        either("span", "posted-time-ago__text", "span", "jobs-unified-top-card__posted-date", F.col("posted_text")),
        F.when(k % 3 == 0, F.concat(F.lit("<p>"), applicants, F.lit("</p>"))).otherwise(
            either("span", "num-applicants__caption", "span", "jobs-unified-top-card__applicant-count", applicants)
        ),
        left_out(either("span", "topcard__flavor--salary", "span", "jobs-unified-top-card__salary", F.col("salary"))),
        left_out(described),
        left_out(criteria),
        F.lit("</body></html>"),
    )
    return posts.select(k.alias("page_id"), F.col("job_link").alias("url"), "role", html.alias("html"))


LISTING_PAGE = 720


def _listed(posts: DataFrame) -> DataFrame:
    return posts.filter(F.col("source") == "Naukri")


def listing_pages(posts: DataFrame) -> DataFrame:
    """Listing pages of about 20 cards; ``id % 23 = 0`` gives a card without a title."""
    k = F.col("id")
    span = lambda cls, text: F.concat(F.lit(f'<span class="{cls}">'), text, F.lit("</span>"))
    tag = lambda text: F.concat(F.lit('<li class="dot tag-li">'), text, F.lit("</li>"))
    title = F.concat(F.lit('<a class="title" href="'), "job_link", F.lit('">'), "job_title", F.lit("</a>"))
    tags = F.concat(*[tag(x) for x in (F.upper("role"), F.lit("SQL "), F.col("role"), F.lit("sql"))])
    card = F.concat(
        F.lit('<div class="srp-jobtuple-wrapper" data-x="1"><div class="row">'),
        F.when(k % 23 == 0, "").otherwise(title),
        F.when(k % 11 == 0, "").otherwise(F.concat(F.lit('<a class="comp-name">'), "company", F.lit("</a>"))),
        F.lit("</div><ul>"),
        F.when(k % 7 == 0, "").otherwise(tags),
        F.lit("</ul>"),
        span("locWdth", F.col("location")),
        F.when(k % 11 == 0, "").otherwise(span("sal", F.col("salary"))),
        F.coalesce(span("exp", F.col("experience_level")), F.lit("")),
        F.when(k % 19 == 0, "").otherwise(span("job-post-day", F.col("posted_text"))),
        F.lit("</div>"),
    )
    page = F.floor(k / LISTING_PAGE)
    cards = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "card"))), lambda c: c["card"]), "\n")
    # About 20 cards per (page, role) by construction.
    return (
        _listed(posts)
        .withColumn("card", card)
        .groupBy(page.cast("long").alias("page"), F.replace("role", F.lit("_"), F.lit("-")).alias("role"))
        .agg(F.min("id").alias("page_id"), F.concat(F.lit("<html><body>"), cards, F.lit("</body></html>")).alias("html"))
    )


def search_pages(posts: DataFrame) -> DataFrame:
    """Search pages with a link per posting: ``id % 13 = 0`` gives an empty one, ``id % 7 = 0`` one that other pages hold too."""
    k = F.col("id")
    shared = F.concat(F.lit("https://jobs.example.com/"), _text(k - k % (5 * LISTING_PAGE)))
    url = F.when(k % 13 == 0, "").when(k % 7 == 0, shared).otherwise(F.col("job_link"))
    card = F.concat(
        F.lit('<div class="x base-card"><a class="base-card__full-link" href="'), url, F.lit('">'), "job_title", F.lit("</a></div>")
    )
    cards = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "card"))), lambda c: c["card"]), "\n")
    page = (F.floor(k / LISTING_PAGE) + 1).cast("long")
    return (
        posts.withColumn("card", card)
        .groupBy(page.alias("page"), "role")
        .agg(F.min("id").alias("page_id"), F.concat(F.lit("<html><body>"), cards, F.lit("</body></html>")).alias("html"))
    )


def listing_details(posts: DataFrame) -> DataFrame:
    """The cards' own pages; ``id % 3 = 0`` has none."""
    k = F.col("id")
    label = F.concat(
        F.lit('<div><label>Applicants: </label><span class="n"><b>'), F.coalesce(_text(F.col("applicants")), F.lit("few")),
        F.lit("</b></span></div>"),
    )
    section = F.concat(
        F.lit('<section class="styles_job-desc-container__txpYf"><section>'), "job_description", F.lit("</section></section>")
    )
    return (
        _listed(posts)
        .filter(k % 3 != 0)
        .select(F.col("job_link").alias("url"), F.concat(F.lit("<html>"), section, label, F.lit("</html>")).alias("html"))
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads: a path per document with one of four endings, none at every nineteenth."""
    d = F.col("doc_id")
    path = F.concat(F.lit("f"), _text(d), pick([".pdf", ".DOCX", ".doc", ".txt"], d))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(d % 19 == 0, "").otherwise(path).alias("path"),
        (F.col("n_chars") * 1000).alias("length"),
    )
