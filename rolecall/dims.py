"""Small dimensions. Every operator takes them as parameters; these are the defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seed dictionary; pass a frame of your own with a ``skill`` column for a larger one.
#: It holds nested phrases, phrases with signs in and around them, capitals and a repeat.
SEED_SKILLS = [
    "c", "c++", "++", "c#", ".net", "go", "r", "java", "python", "javascript", "typescript", "kotlin", "bash",
    "html", "css", "react", "react.js", "vue.js", "node.js", "angular", "graphql", "rest", "rest apis", "websockets",
    "sql", "mysql", "postgresql", "mongodb", "redis", "snowflake", "spark", "kafka", "airflow", "etl",
    "pandas", "numpy", "statistics", "machine learning", "deep learning", "nlp",
    "natural language processing", "natural language processing (nlp)", "data analysis", "data visualization",
    "tableau", "power bi", "excel", "aws", "aws glue", "azure", "docker", "kubernetes", "terraform", "linux",
    "ci/cd", "git", "git & github", "monitoring", "agile", "scrum", "testing", "unit testing", "selenium",
    "code review", "project management", "communication", "Public Speaking", "Technical Writing", "figma", "git",
]

#: Role -> required skills, in order (the order breaks ties). "Game Developer" and "Mobile Developer" need
#: skills that the dictionary doesn't hold; "Release Manager" and "Test Engineer" tie; one requirement is listed twice.
ROLE_SKILLS = {
    "Data Engineer": ["python", "sql", "spark", "kafka", "airflow", "etl", "aws glue", "snowflake"],
    "Data Analyst": ["sql", "excel", "tableau", "power bi", "statistics", "data analysis", "data visualization"],
    "Language Engineer": ["python", "nlp", "natural language processing", "deep learning", "machine learning", "numpy"],
    "Web Developer": ["html", "css", "javascript", "react", "node.js", "rest apis", "graphql", "html"],
    "Interface Designer": ["figma", "html", "css", "communication", "typescript"],
    "Platform Engineer": ["linux", "docker", "kubernetes", "terraform", "monitoring", "ci/cd", "bash", "azure"],
    "Release Manager": ["git", "ci/cd", "scrum", "agile"],
    "Test Engineer": ["git", "ci/cd", "testing", "selenium"],
    "Game Developer": ["c++", "c#", "shader design", "physics engines"],
    "Mobile Developer": ["kotlin", "java", "app stores", "redis", "websockets"],
}

# Skills and roles added when too few were found.
DEFAULT_SKILLS = ["python", "java", "javascript", "sql", "html", "css"]
DEFAULT_ROLES = ["software_engineer", "full_stack_developer"]

# Level label of the detail-page source -> band of years.
LEVEL_SOURCE = "LinkedIn"
LEVEL_BANDS = {
    "Entry level": "0-2 Yrs",
    "Associate": "2-5 Yrs",
    "Mid-Senior level": "5-8 Yrs",
    "Director": "8-12 Yrs",
    "Executive (VP, C-Level)": "12-20 Yrs",
    "Not Applicable": "0-10 Yrs",
}


def seed_skills() -> list[str]:
    """The seed dictionary as written, duplicates and capitals included."""
    return list(SEED_SKILLS)


def role_skills() -> list[tuple[str, list[str]]]:
    """Roles and their required skills in tie-breaking order."""
    return list(ROLE_SKILLS.items())


def skills_frame(spark: SparkSession, skills: list[str] | None = None) -> DataFrame:
    """``skill, ord, first_word``: lower-cased, each phrase once, first place kept."""
    listed = seed_skills() if skills is None else skills
    phrases = list(dict.fromkeys(s.lower() for s in listed))
    rows = spark.createDataFrame(list(zip(phrases, range(len(phrases)))), "skill string, ord int")
    return rows.withColumn("first_word", F.regexp_extract("skill", r"[\p{L}\p{N}_]+", 0))


def role_skills_frame(spark: SparkSession) -> DataFrame:
    """``role, role_ord, skill``."""
    rows = [(role, i, skill) for i, (role, skills) in enumerate(role_skills()) for skill in skills]
    return spark.createDataFrame(rows, "role string, role_ord int, skill string")


def level_frame(spark: SparkSession) -> DataFrame:
    """``source, label, band`` with lower-cased lookup columns."""
    rows = [(LEVEL_SOURCE.lower(), label.lower(), band) for label, band in LEVEL_BANDS.items()]
    return spark.createDataFrame(rows, "source string, label string, band string")
