"""Readers, modes, command line and stream, on small invented inputs."""

import html
import json

import pytest
from pyspark.sql import functions as F

from claimstead import cli
from claimstead.functions import text
from claimstead.operators import claims as cl
from claimstead.operators import registries as rg
from claimstead.plans import modes
from claimstead.plans.audit import audit
from claimstead.sources import corpus as co
from claimstead.streaming import audits

BIO = "CEO of Corvel Labs. MSc Physics, University of Brabel. Raising a seed round with 120 customers. doi 10.1234/ab.2023."


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "text string").select(expression(F.col("text")).alias("x")).first().x


def test_masks_are_found_in_the_text_as_it_is(spark):
    said = "2015 github.com/a/b customers, 9 km in 1999"
    masked = one(spark, said, cl.masked)
    assert len(masked) == len(said) and "2015" in masked and "1999" in masked and "github" not in masked and "9 km" not in masked
    assert one(spark, "10.1234/2019.5 units 2001", cl.masked).split() == ["units", "2001"]


def test_claims_carry_their_context(spark):
    found = {(c.subtype, c.value): c.context for c in cl.with_claims(spark.createDataFrame([(BIO,)], "text string")).first().claims}
    assert found["degree", "MSc Physics"] == BIO[: 53 + 30].strip()  # 30 characters either side
    assert found["doi", "10.1234/ab.2023"].endswith("10.1234/ab.2023.")
    assert all(context for context in found.values())


def test_equal_claims_are_one(spark):
    claims = cl.with_claims(spark.createDataFrame([("Since 2015 and 2015. 10.1234/AB, 10.1234/ab, since 2014.",)], "text string")).first().claims
    assert [(c.subtype, c.value) for c in claims] == [("doi", "10.1234/AB"), ("year", "2015"), ("year", "2014")]


@pytest.mark.parametrize("said", ["caf&eacute; &mdash; &#233; &#xE9; &copy &amp;lt;", "a & b &nosuch; &#0; &#128;", "plain", "", None])
def test_character_references(spark, said):
    assert one(spark, said, text.unescaped) == (None if said is None else html.unescape(said))


def test_readers(spark, tmp_path):
    (tmp_path / "jan f.txt").write_text("one\ntwo")
    assert [tuple(r) for r in co.read_text(spark, str(tmp_path / "*.txt")).collect()] == [("jan f", "one\ntwo")]
    (tmp_path / "b.tsv").write_text("A\tx\ty\n\nB\n")
    assert sorted(map(tuple, co.read_tsv(spark, str(tmp_path / "b.tsv")).collect())) == [("A", "x\ty"), ("B", None)]
    (tmp_path / "b.jsonl").write_text('{"name":"A","text":"x"}\n{"target":"T"}\n{}\n')
    assert sorted(map(tuple, co.read_jsonl(spark, str(tmp_path / "b.jsonl")).collect()), key=str) == [("A", "x"), ("T", None), ("unknown", None)]


def test_cache_keeps_the_latest_answer(spark):
    rows = lambda xs: spark.createDataFrame(xs, "key string, body string, ok boolean, fetched_at string").withColumn("fetched_at", F.to_timestamp("fetched_at"))
    got = co.merged_cache(rows([("a", "old", True, "2024-01-01"), ("b", "b", True, "2024-01-01")]), rows([("a", "new", True, "2024-01-05"), ("b", "down", False, "2024-01-06")])).collect()
    assert {r["key"]: r["body"] for r in got} == {"a": "new", "b": "b"}


def test_institutions_by_their_nearest_name(spark):
    claims = spark.createDataFrame([(1, 0, "Ann Bee", "degree_institution", v) for v in ("University of Brabel", "Lindwall College", "Nowhere School")], "subject_id long, ord int, subject_name string, subtype string, value string")
    body = lambda *names: json.dumps({"items": [{"id": str(i), "names": [{"value": n}]} for i, n in enumerate(names)]})
    responses = spark.createDataFrame([("ror", "University of Brabel", 200, body("Brabel", "Brabel University, North")), ("ror", "Lindwall College", 200, body("College of Dunmere", "Lindwall Institute"))], "registry string, key string, http_status int, body string")
    got = {r.value: (r.status, r.detail) for r in rg.verify_institutions(claims, responses).collect()}
    assert got["University of Brabel"] == ("VERIFIED", "listed as Brabel University, North")
    assert got["Lindwall College"][0] == "NOT_FOUND" and "College of Dunmere" in got["Lindwall College"][1]
    assert got["Nowhere School"] == ("UNCHECKABLE", rg.UNREACHED)


def test_profile_addresses_anchor_the_audit(spark):
    refs = spark.createDataFrame([(1, None, "https://www.linkedin.com/in/ann-bee-1a2b", "Builds things."), (2, "Bo", "https://example.org/x", "y")], "subject_id long, subject_name string, url string, text string")
    got = modes.from_urls(refs, spark.createDataFrame([], "url string, body string")).collect()
    assert [(r.subject_id, r.subject_name, r.profile_anchor, r.profile_reachable, r.text) for r in got] == [(1, "Ann Bee", "linkedin:ann-bee-1a2b", False, "Builds things.")]


def run(spark, capsys, *argv):
    code = cli.run(spark, cli.parser().parse_args(list(argv)))
    return code, capsys.readouterr().out


def test_command_line(spark, capsys, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    code, said = run(spark, capsys, "--text", BIO, "--name", "Ann Bee", "--out", out, "--html", str(tmp_path / "h"), "--md", str(tmp_path / "m"))
    assert code == 0 and "Triggered" in said or "Passed" in said
    assert "<!doctype html>" in "".join(p.read_text() for p in (tmp_path / "h").glob("part*")) and "# Audit: Ann Bee" in "".join(p.read_text() for p in (tmp_path / "m").glob("part*"))
    code, said = run(spark, capsys, "--text", BIO, "--json", "--no-save")
    report = json.loads(said.splitlines()[-1])
    assert len(report["flags"]) == 13 and all(f["question"] and f["description"] for f in report["flags"]) and report["claims"][0]["status"] == "UNCHECKED"
    assert "Ann Bee" in run(spark, capsys, "--list", "--out", out)[1]
    (tmp_path / "b.tsv").write_text(f"Ann\t{BIO}\nNobody\n")
    run(spark, capsys, "--batch", str(tmp_path / "b.tsv"), "--out", out, "--quiet")
    summary = spark.read.option("header", True).csv(f"{out}/summary")
    assert summary.columns[0] == "target" and {r.target for r in summary.collect()} == {"Ann", "Nobody"}
    monkeypatch.setattr("builtins.input", lambda _: "y")
    assert run(spark, capsys, "--interactive")[1].startswith("GREEN, score 0, coverage 100%")
    assert "weight" in cli.explained() and run(spark, capsys, "--url", "https://example.org/x")[0] == 2 and run(spark, capsys)[0] == 2


def test_stream_is_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"subject_id": 1, "subject_name": "Ann Bee", "text": BIO, "arrived": "2024-01-01T00:00:00"}, {"subject_id": 2, "subject_name": "Bo", "text": None, "arrived": "2024-01-01T01:00:00"}]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, [*rows, rows[0]])))
    seen = audits.audited(audits.arrivals(spark, str(tmp_path / "in")), 2026).select("subject_id", "verdict.level")
    seen.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    batch = audit(spark.createDataFrame([(r["subject_id"], r["subject_name"], r["text"]) for r in rows], "subject_id long, subject_name string, text string"), 2026)
    assert sorted(map(tuple, spark.table("seen").collect())) == sorted(map(tuple, batch.select("subject_id", "verdict.level").collect()))
