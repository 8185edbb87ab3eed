"""The corpus of subjects over the driver's tables, and readers for files of subjects, profiles and responses.

The tables hold no professional prose, so `subjects` composes one text for each customer from invented
fragments, chosen by the key modulo pairwise coprime or mixed numbers, with names and figures from the
tables. The SQL is plain enough to run unchanged in DuckDB, so both sides of a comparison read one corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimstead.sources.shared import spread

NOW_YEAR = 2026

FIRST = ["Alma", "Bertil", "Célia", "Dagny", "Egon", "Frida", "Gustav", "Hanne", "Ivar", "Jorun", "Klaas", "Lieve", "Mirek"]
LAST = ["Abelsen", "Bramwell", "Cordova", "Dierickx", "Engström", "Fairholme", "Gorski", "Haldane", "Idris", "Jurgens", "Kestler", "Lindqvist", "Marchetti", "Nordahl", "Oakeshott", "Petrossian", "Quist"]

#: Column expression parts: {n} the name, {k} the key in seven digits, {f} its last five, {h} its second to fourth, {g} its last three, {c} the nation, {b} the balance's whole part.
FRAGMENTS: list[list[str]] = [
    [  # titles
        "", "Dr. {n} leads a small team. ", "Grants were coordinated by Dr. Somebody Else. ", "Prof. {n} speaks often. ", "{n} lives in {c}. ",
    ],
    [  # roles
        "Founder of Aldervane Systems. ", "CEO of Brightmoor Labs. ", "Software engineer and technical lead. ", "Policy officer and board member. ", "Portfolio manager, later fund manager. ",
        "President of Corvel Foundation. ", "Physician and clinician. ", "Head of Research at Dunmere Group. ", "", "Managing Director of Elmquist Holding. ", "Lawyer and legal counsel. ",
    ],
    [  # what is claimed
        "We build machine learning hardware and satellite robotics. ", "Offers asset management and venture capital to {c}. ", "Delivers clinical treatment and patient care. ", "Works on policy reform and public affairs. ",
        "I do not build artificial intelligence or hardware. ", "Brand strategy and content strategy for retailers. ", "", "Genomics and biotechnology with a clinical study. ", "Litigation and contract law. ",
    ],
    [  # training
        "", "Holds an MSc in Electrical Engineering, University of Brabel. ", "PhD in Physics from Technische Hochschule Oststadt. ", "MBA from Norfield School of Commerce. ", "Studied public policy and graduated in 2009. ",
        "BSc Marketing, Lindwall College. ", "Bachelor of Laws, trained as a lawyer at a court. ", "Master of Fine Arts from Academy of Lindwall. ",
    ],
    [  # deals
        "In partnership with Aldervane Systems. ", "Partners with Fenwick Group, collaborating with Garrow Labs, alliance with Hollin Works and agreement with Istra Media. ", "MoU signed, NDA in place, letter of intent and term sheet. ",
        "Grant funded by the state, a contract and a purchase order. ", "", "Technology partner with a joint paper. ", "There is no partnership with Kestrel Group and no contract. ",
    ],
    [  # money
        "Currently raising a seed round. ", "Seeking investment with {b} customers and 2.5m revenue. ", "We have no customers and no revenue. ", "Raising, with active users. ", "Open to investors, 0 clients. ", "",
    ],
    [  # language
        "A visionary, disruptive, world-class and holistic moonshot with synergy. ", "", "A paradigm shift in seamless logistics. ", "Never disruptive. ",
    ],
    [  # identifiers
        "See https://doi.org/10.1234/abc.{k} for details. ", "Preprint at arxiv.org/abs/2101.{f}. ", "Profile orcid.org/0000-0002-9{h}-9{g}. ", "Code at github.com/user{k}/tools. ", "Trial NCT0{k}. ", "Patent US {k} B2. ",
        "Our peer-reviewed and FDA cleared work. ", "ISO 9001 certified. ", "Still in development and stealth. ", "", "Code at github.com/user{k}. ", "", "Working on a roadmap. ",
    ],
    [  # time
        "Has 15 years of experience. ", "Over forty years of experience since 2015. ", "Graduated 1998, with twelve years in banking. ", "Full deployment is targeted for 2035. ", "Active since 2041. ", "", "Started in 2007 and 2011. ",
    ],
    [  # recognition
        "Featured in Forbes. ", "", "Awarded twice and keynote speaker. ", "Not featured in Forbes. ", "Guest of the Oststadt Institute for a while. ",
    ],
]
URLS = ["", "https://www.medium.com/@a{k}", "https://news.example.org/story/{k}", "https://spokeo.com/n{k}", "https://uk.linkedin.com/in/a-{k}", "", "http://vox.com/a/{k}"]
_KEY_STRIDE = [1, 1, 1, 1, 1, 1, 1, 1, 1, 7]


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _filled(fragment: str) -> str:
    """A fragment as a SQL string expression."""
    holes = {"{n}": "name", "{k}": "code", "{f}": "substr(code, 3, 5)", "{h}": "substr(code, 2, 3)", "{g}": "substr(code, 5, 3)", "{c}": "nation", "{b}": "balance"}
    parts, rest = [], fragment
    while rest:
        at = min((rest.index(h) for h in holes if h in rest), default=len(rest))
        if at:
            parts.append(_quoted(rest[:at]))
        if at < len(rest):
            parts.append(holes[rest[at : at + 3]])
        rest = rest[at + 3 :]
    return "concat(" + ", ".join(parts or ["''"]) + ")"


def _choice(options: list[str], key: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {_filled(x)}" for i, x in enumerate(options))
    return f"CASE ({key}) % {len(options)} {whens} END"


def subjects_sql() -> str:
    """subject_id, subject_name, text, source_url (null: none), verified; for Spark and DuckDB alike."""
    names = f"concat({_choice(FIRST, 'c_custkey')}, ' ', {_choice(LAST, 'c_custkey')})"
    text = "concat(" + ", ".join(_choice(f, f"c_custkey // {s}" if s > 1 else "c_custkey").replace("c_custkey // 7", "(c_custkey - c_custkey % 7)") for f, s in zip(FRAGMENTS, _KEY_STRIDE, strict=True)) + ")"
    code = "CAST(1000000 + c_custkey AS STRING)"
    inner = f"SELECT CAST(c_custkey AS BIGINT) AS subject_id, {names} AS name, {code} AS code, lower(n_name) AS nation, CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS STRING) AS balance, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey"
    inner = inner.replace("c_custkey FROM", "c_custkey AS c_custkey FROM")
    return (
        f"SELECT subject_id, name AS subject_name, trim({text}) AS text, nullif({_choice(URLS, 'c_custkey')}, '') AS source_url, c_custkey % 2 = 0 AS verified FROM ({inner}) base"
    )


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "customer", "nation")
    return spread(spark.sql(subjects_sql()))


# What the registries said about the corpus's identifiers: two fifths belong to the subject, a fifth to another,
# a fifth doesn't exist, a fifth was unreachable, by the last three digits of the subject's key in the identifier.
_BODIES = {
    "doi": """concat('{"message":{"title":["On ',code,'"],"author":[{"given":"',given,'","family":"',family,'"}]}}')""",
    "arxiv": """concat('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1</id><title>On ',code,'</title><author><name>',given,' ',family,'</name></author></entry></feed>')""",
    "orcid": """concat('{"name":{"given-names":{"value":"',given,'"},"family-name":{"value":"',family,'"}}}')""",
    "github": """concat('{"stargazers_count":3,"size":1,"owner":{"login":"user',code,'"},"name":"',given,' ',family,'","public_repos":4,"followers":9}')""",
    "nct": """concat('{"protocolSection":{"identificationModule":{"briefTitle":"Trial ',code,'"},"statusModule":{"overallStatus":"COMPLETED"}}}')""",
    "patent": """concat('<html><title>',code,' device</title><dd itemprop="inventor">',given,' ',family,'</dd></html>')""",
}


#: Institutions of the corpus: status of the answer and the name that is listed.
_LISTED = {
    "University of Brabel": (200, "University of Brabel, North Campus"), "Technische Hochschule": (503, None), "Norfield School of Commerce": (200, "Nowhere School"),
    "Lindwall College": (404, None), "Academy of Lindwall": (200, "Lindwall Academy"),
}
_ITEMS = """concat('{"items":[{"id":"r0","names":[{"value":"Institute of Other Things"}]},{"id":"r1","names":[{"value":"',listed,'"}]}]}')"""


def registry_response(claims: DataFrame) -> DataFrame:
    """claims (subject_name, subtype, value) -> registry, key, http_status, body."""
    names = F.split("subject_name", " ")
    rows = claims.where(F.col("subtype").isin(*_BODIES, "degree_institution")).select("subtype", "value", "subject_name").dropDuplicates(["subtype", "value"])
    digits = F.regexp_replace(F.regexp_replace("value", " B2$", ""), "[^0-9]", "")
    part = F.expr("try_cast(right(digits, 3) as int) div 5 % 5")
    own = F.col("part") < 2
    listed = lambda i: F.coalesce(*(F.when(F.col("value") == v, F.lit(x[i])) for v, x in _LISTED.items()))
    rows = rows.withColumn("digits", digits).withColumn("part", part)
    rows = rows.withColumns({"given": F.when(own, names[0]).otherwise("Oda"), "family": F.when(own, names[1]).otherwise("Ruiz"), "code": F.col("value"), "listed": listed(1)})
    school = F.col("subtype") == "degree_institution"
    body = F.coalesce(F.when(school, F.expr(_ITEMS)), *(F.when(F.col("subtype") == k, F.expr(v)) for k, v in _BODIES.items()))
    status = F.when(school, listed(0)).when(F.col("part") == 3, 404).when(F.col("part") == 4, 503).otherwise(200)
    return rows.select(F.when(school, "ror").otherwise(F.col("subtype")).alias("registry"), F.col("value").alias("key"), status.alias("http_status"), F.when(status == 200, body).alias("body"))


# ── readers ──────────────────────────────────────────────────────────────

PROFILE = (
    "name string, headline string, about string, location string, source string, skills array<string>, "
    "experiences array<struct<title:string, company:string, date_range:string, duration:string, location:string, description:string>>, "
    "educations array<struct<institution:string, degree:string, field_of_study:string, field:string, years:string, description:string>>"
)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A subject for each file: target is the file's stem."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.select(F.url_decode(stem).alias("target"), F.col("value").alias("text"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """{name or target, text}: one subject a line; the name falls back to the target, then to `unknown`."""
    rows = spark.read.schema("name string, target string, text string").json(path)
    return rows.select(F.coalesce(F.nullif("name", F.lit("")), "target", F.lit("unknown")).alias("target"), "text")


def tsv_lines(lines: DataFrame) -> DataFrame:
    """value: name, tab, text; split at the first tab, blank lines left out, no text is null."""
    parts = F.split("value", "\t", 2)
    text = F.nullif(F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), F.lit(""))
    return lines.where(F.trim("value") != "").select(F.trim(parts[0]).alias("target"), text.alias("text"))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return tsv_lines(spark.read.text(path))


def profiles_of(lines: DataFrame) -> DataFrame:
    """value: a profile as JSON -> profile struct. `field` stands in for a missing field_of_study."""
    p = F.from_json("value", PROFILE)
    study = F.transform(p["educations"], lambda e: e.withField("field_of_study", F.coalesce(e["field_of_study"], e["field"])).dropFields("field"))
    return lines.select(p.withField("educations", study).alias("profile"))


def fresh(cache: DataFrame, now: str, days: int) -> DataFrame:
    """Rows of a lookup cache (key, body, ok, fetched_at) that still hold: answered, and not older than days."""
    return cache.where(F.col("ok") & (F.col("fetched_at") > F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days))))


def merged_cache(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache with new answers: the latest for each key, failures never kept."""
    rows = cache.unionByName(answers).where("ok")
    return rows.groupBy("key").agg(F.max_by(F.struct("body", "ok", "fetched_at"), "fetched_at").alias("x")).select("key", "x.*")
