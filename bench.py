"""Headline jobs over the derived tables; prints one JSON line.

The derived tables are written once (``setup``); every job then reads them and
its whole result is computed (``noop`` sink).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from rolecall import dims, fixtures as fx  # noqa: E402
from rolecall.operators import ids, search, skills as sk  # noqa: E402
from rolecall.operators.dedupe import append_ignore  # noqa: E402
from rolecall.plans import ingest, maintain, present, profile, recommend  # noqa: E402
from rolecall.session import build_session, fresh_dir, staged  # noqa: E402
from rolecall.sources import pages  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = build_session(
        "bench",
        master=f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "20g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    begin = time.time()
    posts = staged(fx.postings(spark, SF_DIR).repartition(int(CPUS)), "postings")
    people = staged(fx.candidates(spark, SF_DIR), "candidates")
    resumes = staged(fx.resumes(spark, SF_DIR).repartition(int(CPUS)), "resumes")
    detail = staged(fx.posting_pages(posts), "detail")
    listings = staged(fx.listing_pages(posts), "listings")
    details = staged(fx.listing_details(posts), "details")
    results = staged(recommend.recommend(people, posts, fx.AS_OF, dims.skills_frame(spark)), "results")
    skills, roles = dims.skills_frame(spark), dims.role_skills_frame(spark)
    docs = fx.table(spark, SF_DIR, "documents")
    # the seed skills and pairs of them: as many hits as the seed list alone, from 2,000 phrases
    seeds = fx.skill_list()
    many = dims.skills_frame(spark, [*seeds, *(f"{a} {b}" for a in seeds for b in seeds)][:2000])
    folder = fresh_dir(spark, "features")
    recommend.write_features(posts, folder, skills)
    features = spark.read.parquet(folder)
    early = F.col("posted_date") < F.lit("1998-04-01").cast("date")
    plain = posts.drop("posted_text")
    setup = time.time() - begin

    jobs = {
        "search_postings": lambda: search.search_postings(posts, recommend.asking(people)),
        "search_one": lambda: search.search_one(posts, "nation_1", "Experienced", ["data_engineer"]),
        "recommend": lambda: recommend.recommend(people, posts, fx.AS_OF, skills),
        "recommend_one": lambda: recommend.recommend_from_features(
            people.filter("candidate_id = 7"), features, fx.AS_OF, "nation_1", "Experienced", ["data_engineer"]
        ),
        "recommend_one_next": lambda: recommend.recommend_from_features(
            people.filter("candidate_id = 8"), features, fx.AS_OF, "nation_2", "Experienced", ["data_analyst"]
        ),
        "recommend_one_unprepared": lambda: recommend.recommend_one(
            people.filter("candidate_id = 7"), posts, fx.AS_OF, skills, "nation_1", "Experienced", ["data_engineer"]
        ),
        "candidate_status": lambda: recommend.candidate_status(people, posts),
        "profile": lambda: profile.profile(resumes, fx.AS_OF, skills, roles),
        "extract_skills": lambda: sk.extract_skills(docs, skills, "text", "doc_id"),
        "extract_skills_2000": lambda: sk.extract_skills(docs, many, "text", "doc_id"),
        "maintain": lambda: maintain.maintain(plain),
        "renumber": lambda: ids.renumber(plain),
        "append_ignore": lambda: append_ignore(plain.filter(early), plain.filter(~early), "id"),
        "detail_pages": lambda: pages.extract_detail_pages(detail, skills, fx.AS_OF),
        "ingest": lambda: ingest.ingest(plain.filter(early), detail, listings, details, skills, fx.AS_OF),
        "present": lambda: present.present(results, "match-high"),
    }
    times = {}
    for name, job in jobs.items():
        start = time.time()
        job().write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    sf = re.search(r"sf([\d.]+)", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "headline_jobs_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf.group(1)) if sf else SF_DIR,
                "setup_sec": round(setup, 3),
                "candidates_per_sec": round(people.count() / times["recommend"], 1),
            }
        )
    )


if __name__ == "__main__":
    main()
