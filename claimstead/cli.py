"""Command line: audits a text, a file, standard input, a name, a profile address, a profile record or a batch.

Nothing is fetched: what registries, providers and profile pages answer comes from tables (--answers names a
folder with registry_response, provider_answer and profile_body, each optional).
"""

from __future__ import annotations

import argparse
import datetime
import subprocess
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimstead.functions.banks import PASSED, TRIGGERED, UNKNOWN, read_banks
from claimstead.operators import report as rp
from claimstead.operators import scoring as sc
from claimstead.operators.flags import FLAGS, WORDING
from claimstead.plans import audit as au
from claimstead.plans import modes
from claimstead.sources import corpus as co

_RESPONSES, _ANSWERS, _BODIES = "registry string, key string, http_status int, body string", "subject_name string, provider string, body string", "url string, body string"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="claimstead", description="Audits public professional claims against evidence. Leads to check by hand, not verdicts.")
    p.add_argument("target", nargs="?", help="a name to audit from provider answers, or 'list'")
    for names, what in ((("--text", "-t"), "a text"), (("--file", "-f"), "a file with a text"), (("--url",), "the address of a profile"), (("--from-json",), "a profile record as JSON"), (("--batch",), "many subjects: .jsonl, or name, tab, text"), (("--name",), "the subject's name"), (("--html",), "folder for HTML reports"), (("--md",), "folder for Markdown reports"), (("--csv",), "folder for the summary of a batch"), (("--answers",), "folder with tables of answers"), (("--keywords",), "file with term banks")):
        p.add_argument(*names, help=what)
    for names, what in ((("--stdin",), "read the text from standard input"), (("--verify",), "check identifiers against registry answers"), (("--deep",), "take all addresses found as sources"), (("--refresh",), "pass by cached answers older than a day"), (("--interactive", "-i"), "thirteen questions instead of a text"), (("--json",), "print the report as JSON"), (("--no-save",), "write no report"), (("--quiet", "-q"), "print the verdict only"), (("--list",), "the newest reports"), (("--explain",), "how scores come about"), (("--selftest",), "run the tests")):
        p.add_argument(*names, action="store_true", help=what)
    p.add_argument("--out", default="output", help="folder for reports")
    p.add_argument("--version", action="version", version=f"claimstead {rp.VERSION}")
    return p


def _table(spark: SparkSession, args: argparse.Namespace, name: str, schema: str) -> DataFrame:
    if args.answers:
        try:
            rows = spark.read.parquet(f"{args.answers}/{name}.parquet")
        except AnalysisException:
            return spark.createDataFrame([], schema)
        if args.refresh and "fetched_at" in rows.columns:
            rows = rows.where(F.col("fetched_at") > F.current_timestamp() - F.make_dt_interval(days=F.lit(1)))
        return rows
    return spark.createDataFrame([], schema)


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("subject_id", F.monotonically_increasing_id())


def _web(spark: SparkSession, args: argparse.Namespace, named: DataFrame) -> DataFrame:
    answers = _table(spark, args, "provider_answer", _ANSWERS).join(named.select("subject_id", "subject_name"), "subject_name")
    return modes.from_web(named, answers, all_urls=args.deep)


def subjects(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, str] | None:
    """The rows to audit and the mode; None if nothing is asked."""
    one = lambda text, name: spark.createDataFrame([(0, name, text)], "subject_id long, subject_name string, text string")
    more = "\n".join(x for x in (args.text, _file(args)) if x)
    if args.url:
        refs = spark.createDataFrame([(0, args.name, args.url, more)], "subject_id long, subject_name string, url string, text string")
        return modes.from_urls(refs, _table(spark, args, "profile_body", _BODIES)), "profile"
    if args.from_json:
        rows = modes.from_records(_numbered(co.profiles_of(spark.read.text(args.from_json, wholetext=True))))
        name = F.coalesce(F.lit(args.name), F.nullif("subject_name", F.lit("")), F.lit("unknown"))
        return rows.withColumns({"subject_name": name, "text": F.concat_ws("\n", "text", F.lit(more or None))}), "structured"
    if args.batch:
        rows = (co.read_jsonl if args.batch.endswith(".jsonl") else co.read_tsv)(spark, args.batch)
        rows = _numbered(rows).select("subject_id", F.col("target").alias("subject_name"), "text")
        return modes.from_pastes(rows.where("text is not null")).unionByName(_web(spark, args, rows.where("text is null")), allowMissingColumns=True), "batch"
    if args.stdin:
        more = sys.stdin.read()
    if more:
        return modes.from_pastes(one(more, args.name)), "text"
    if args.target:
        return _web(spark, args, one(None, args.target)), "web"
    return None


def _file(args: argparse.Namespace) -> str:
    if not args.file:
        return ""
    with open(args.file, encoding="utf-8", errors="replace") as f:
        return f.read()


def interactive(spark: SparkSession) -> str:
    """Thirteen answers (y: as it should be, n, anything else: unknown) to a verdict."""
    rows = []
    for i, *_ in FLAGS:
        said = input(f"[{i}] {WORDING[i][0]} Is all well? (y/n/u) ").strip().lower()[:1]
        rows.append((i, {"y": PASSED, "n": TRIGGERED}.get(said, UNKNOWN)))
    v = sc.score_table(spark.createDataFrame(rows, "flag_id int, status string").withColumn("subject", F.lit(0)), "subject").first()
    return f"{v['level']}, score {v['score'] if v['scored'] else 'n/a'}, coverage {v['coverage']}%"


def explained() -> str:
    bounds = ", ".join(f"{name} below {cut}" for name, cut in sc.LEVELS)
    lines = ["score = 100 x weight of triggered flags / weight of decided flags", f"coverage = weight of decided flags / {sc.TOTAL}; below {sc.LEAST_COVERAGE:.0%} there is no score", f"levels: {bounds}"]
    return "\n".join(lines + [f"[{i:>2}] {name}, weight {w}, {c}: {WORDING[i][0]}" for i, name, w, c, _ in sorted(FLAGS, key=lambda f: -f[2])])


def listed(spark: SparkSession, folder: str) -> str:
    try:
        rows = rp.latest(spark.read.parquet(f"{folder}/reports")).collect()
    except AnalysisException:
        return "no reports yet"
    return "\n".join(f"{r['file_name']}  {r['target']}  {r['level']}  {r['score']}" for r in rows)


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.list or args.target == "list":
        print(listed(spark, args.out))
        return 0
    if args.interactive:
        print(interactive(spark))
        return 0
    asked = subjects(spark, args)
    if asked is None:
        parser().print_help()
        return 2
    rows, mode = asked
    if mode == "profile" and rows.isEmpty():
        print("not the address of a profile", file=sys.stderr)
        return 2
    rows = rows.withColumn("verified", F.lit(args.verify))
    now = datetime.datetime.now()
    responses = _table(spark, args, "registry_response", _RESPONSES) if args.verify else None
    done = rp.with_report(au.audit(rows, now.year, responses, read_banks(args.keywords)), now.isoformat(timespec="seconds"), mode).cache()
    if not args.no_save:
        files = rp.report_json(done).join(done.select("subject_id", "report.target", "report.level", "report.score"), "subject_id")
        files.write.mode("append").parquet(f"{args.out}/reports")
    for folder, text in ((args.html, rp.html(done)), (args.md, rp.markdown(done))):
        if folder:
            done.select(text.alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(folder)
    if mode == "batch":
        summary = au.summary(done).withColumn("timestamp", F.lit(now.isoformat(timespec="seconds")))
        summary.write.mode("overwrite").option("header", True).csv(args.csv or f"{args.out}/summary")
        if not args.quiet:
            summary.show(50, truncate=40)
    else:
        first = done.select(F.to_json("report").alias("json"), rp.terminal(done).alias("text"), "report.level", "report.score").first()
        print(first["json"] if args.json else f"{first['level']} {first['score']}" if args.quiet else first["text"])
    done.unpersist()
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.explain:
        print(explained())
        return 0
    if args.selftest:
        return subprocess.call([sys.executable, "-m", "pytest", "tests", "-q"])
    try:
        spark = SparkSession.builder.appName("claimstead").getOrCreate()
        return run(spark, args)
    except FileNotFoundError as missing:
        print(f"no such file: {missing.filename}", file=sys.stderr)
    except AnalysisException as wrong:
        print(f"cannot read: {str(wrong).splitlines()[0]}", file=sys.stderr)
    return 2
