"""Operators on small invented texts, with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from claimstead.functions import banks, terms, text
from claimstead.operators import claims as cl
from claimstead.operators import domains as dm
from claimstead.operators import flags as fl
from claimstead.operators import names as nm
from claimstead.operators import paste as ps
from claimstead.operators import profiles as pf
from claimstead.operators import scoring as sc
from claimstead.plans.audit import audit
from claimstead.sources import corpus as co


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "text string").select(expression(F.col("text")).alias("x")).first().x


@pytest.mark.parametrize(
    ("said", "term", "denied"),
    [
        ("We have no customers", "customers", True), ("No old systems. We serve customers", "customers", False), ("our lack of debt helped revenue", "revenue", False),
        ("unlike rivals we have revenue", "revenue", False), ("lack of revenue", "revenue", True), ("We don't have any paying clients", "clients", True), ("x " * 120 + "not one two three four five six customers", "customers", False),
    ],
)
def test_negation(spark, said, term, denied):
    found = one(spark, said, lambda t: F.transform(terms.matches(t, terms.pattern_of(term)), lambda m: terms.negated(t, m["start"])))
    assert found == [denied]


def test_terms_are_whole_words(spark):
    assert one(spark, "said email EDGE-AI ai.", lambda t: terms.find_terms(t, ["ai", "edge ai", "mail"])) == ["ai", "edge ai"]
    assert one(spark, "no revenue. Many customers", lambda t: terms.find_terms(t, ["revenue", "customers"], asserted=True)) == ["customers"]
    x = one(spark, "a paradigm shift, a paradigm", lambda t: terms.find_non_overlapping(t, ["paradigm", "paradigm shift"]))
    assert (x.terms, x.hits) == (["paradigm shift", "paradigm"], 2)


def test_hosts(spark):
    assert one(spark, "https://WWW.Vox.com/a", text.host_of) == "vox.com"
    assert one(spark, "https://vox.com/", lambda u: text.host_matches(u, ["x.com"])) is False
    assert one(spark, "https://uk.linkedin.com/in/a", lambda u: text.host_matches(u, ["linkedin.com"])) is True


def test_claims(spark):
    said = "CEO of Corvel Labs. MSc Physics, University of Brabel. 120 customers, 0 users. Has twelve years of experience since 2015; targeted for 2040. doi 10.1234/ab.2023)."
    got = cl.with_claims(spark.createDataFrame([(said,)], "text string")).first().claims
    found = {(c.subtype, c.value, c.negated) for c in got}
    assert {("doi", "10.1234/ab.2023", False), ("degree", "MSc Physics", False), ("degree_institution", "University of Brabel", False), ("leadership", "CEO of Corvel Labs", False), ("owned_org", "Corvel Labs", False)} <= found
    assert {("customers", "120 customers", False), ("users", "0 users", True), ("claimed_experience_years", "twelve", False), ("year", "2015", False), ("year_target", "2040", False)} <= found
    assert not any(s == "year" and v == "2023" for s, v, _ in found)


def test_transfer_is_one_way(spark):
    back = lambda claimed, training: spark.range(1).select(dm.backed_by(F.lit(claimed), F.array(*map(F.lit, training))).alias("x")).first().x
    assert back("policy", ["medicine"]) == "medicine" and back("medicine", ["policy"]) is None and back("law", ["policy", "law"]) == "law"


@pytest.mark.parametrize(
    ("subject", "candidates", "answer"),
    [
        ("Ada Lovelace", ["A. Lovelace"], True), ("Ada Lovelace", ["Ada Byron"], False), ("Jan Vermeulen", ["Jan Peeters"], False), ("", ["x y"], None), ("Ada Lovelace", [], None),
        ("Ada Lovelace", ["Ада Лавлейс"], None), ("Søren Müller", ["Soren Muller"], True), ("Alsayed Omar", ["Alsayed, O."], True), ("Ana Ruiz Prado", ["M. Ruiz"], None), ("Prince", ["Prince"], True),
    ],
)
def test_names(subject, candidates, answer):
    assert nm.matched(subject, candidates) is answer


def test_scores_at_their_cuts(spark):
    assert sc.TOTAL == 18.5
    cuts = spark.createDataFrame([(s,) for s in (0, 19, 20, 39, 40, 64, 65, 100)], "s int").select(sc.level_of(F.col("s")).alias("l")).collect()
    assert [r.l for r in cuts] == ["GREEN", "GREEN", "YELLOW", "YELLOW", "ORANGE", "ORANGE", "RED", "RED"]
    v = spark.createDataFrame([(2.5, 12.5, "ORANGE"), (0.0, 6.4, None), (10.0, 10.0, "ORANGE")], "t double, d double, f string").select(sc.verdict(F.col("t"), F.col("d"), F.col("f")).alias("v")).collect()
    assert [(r.v.score, r.v.level, r.v.held) for r in v] == [(20, "ORANGE", True), (None, "INSUFFICIENT DATA", False), (100, "RED", False)]


def test_profile_refs(spark):
    ref = lambda u: one(spark, u, pf.profile_ref)
    assert ref("linkedin.com/in/jan-x").handle == "jan-x" and ref("https://github.com/Settings").refusal and ref("https://linkedin.com/pub/dir/a").refusal
    assert ref("https://orcid.org/0000-0002-1825-009x").handle == "0000-0002-1825-009X" and ref(None).refusal == "empty"
    assert one(spark, "jan-fictief-1a2b", pf.name_from_handle) == "Jan Fictief"


def test_pasted_profile(spark):
    paste = "Ann Lee\nBuilder\n\nExperience\nEngineer\nCorvel · Full-time\nJan 2015 - Present · 6 yrs 6 mos\nBrabel, X\n\nLed five.\n\nEducation\nBrabel College\nMSc, Physics\n2005 - 2009\n\nSkills\nPython · SQL\nEducation\n"
    p = ps.parsed(spark.createDataFrame([(1, paste)], "id int, text string"), "id").first().profile
    e, d = p.experiences[0], p.educations[0]
    assert (e.title, e.company, e.date_range, e.duration, e.location, e.description) == ("Engineer", "Corvel", "Jan 2015 - Present", "6 years 6 months", "Brabel, X", "Led five.")
    assert (d.institution, d.degree, d.field_of_study, d.years) == ("Brabel College", "MSc", "Physics", "2005 - 2009") and p.skills == ["Python", "SQL", "Education"]
    assert one(spark, paste, ps.is_paste) is True


def test_bank_overrides():
    b = banks.with_overrides({"arr": ["x"], "+traction": ["y"], "traction": 3})
    assert b["arr"] == ["x"] and b["traction"][-1] == "y"


def test_readers(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("Ann\tone\ttwo\n\nBob\n")
    assert [tuple(r) for r in co.read_tsv(spark, str(tmp_path / "a.tsv")).collect()] == [("Ann", "one\ttwo"), ("Bob", None)]
    (tmp_path / "a.jsonl").write_text('{"name":"","target":"T","text":"x"}\n{"text":"y"}\n')
    assert [tuple(r) for r in co.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()] == [("T", "x"), ("unknown", "y")]


def test_audit(spark):
    rows = [(1, "Ann Lee", "Founder of Corvel. Raising. In partnership with Corvel. Working on stealth hardware and satellite robotics. Degree in marketing.", False), (2, "Bo Ek", "", False)]
    got = audit(spark.createDataFrame(rows, "subject_id long, subject_name string, text string, verified boolean"), 2026).orderBy("subject_id").collect()
    status = {f.id: f.status for f in got[0].flags}
    assert status[1] == status[3] == status[6] == status[7] == "TRIGGERED" and status[4] == "PASSED" and status[11] == "UNKNOWN"
    assert {f.status for f in got[1].flags} == {"UNKNOWN"} and got[1].verdict.level == "INSUFFICIENT DATA"
    assert len(fl.FLAGS) == 13


def test_entry():
    import __spark_entry__

    assert "batch_summary" in __spark_entry__.queries() and "score_level" in __spark_entry__.oracle_sql()


def test_paste_queries_take_all_subjects(spark):
    from claimstead.plans.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    everyone = {r.subject_id for r in co.subjects(spark, folder).select("subject_id").collect()}
    for name in ("paste_skills", "profile_prose"):
        assert {r.subject_id for r in QUERIES[name](spark, folder).select("subject_id").collect()} == everyone
