"""Queries of the catalogue over small tables that the driver's data doesn't hold."""

from claimstead.operators.claims import with_claims
from claimstead.plans import catalog
from claimstead.plans.audit import with_statuses


def test_repeated_subjects_are_rows_of_their_own(spark, tmp_path):
    # keys 1 and 7: "Seeking investment with {balance} customers"; key 2: "We have no customers"
    spark.createDataFrame([(1, 0, 40.0), (1, 0, 50.0), (2, 0, 1.0), (7, 0, 0.5)], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "NOWHERE")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    got = sorted((r.subject_id, r.negated) for r in catalog.QUERIES["is_negated"](spark, str(tmp_path)).collect())
    assert got == [(1, False), (1, False), (2, True), (7, True)]


def test_statuses_of_repeated_subjects(spark):
    said = [("doi 10.1234/abc.1", True), ("doi 10.1234/abc.1", True), ("doi 10.1234/abc.2", True), ("doi 10.1234/abc.1", False)]
    subjects = spark.createDataFrame([(1, "Alma Quist", *x) for x in said] + [(2, None, *said[0])], "subject_id long, subject_name string, text string, verified boolean")
    responses = spark.createDataFrame([("doi", "10.1234/abc.1", 404, None)], "registry string, key string, http_status int, body string")
    got = with_statuses(with_claims(subjects), responses).collect()
    assert sorted((r.subject_id, r.text[-1], r.verified, *(c.status for c in r.claims)) for r in got) == [
        (1, "1", False, "UNCHECKED"), (1, "1", True, "NOT_FOUND"), (1, "1", True, "NOT_FOUND"), (1, "2", True, "UNCHECKABLE"), (2, "1", True, "NOT_FOUND"),
    ]
