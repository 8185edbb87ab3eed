"""Profile addresses, and what the platforms answer about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimstead.functions.text import unescaped

# Pages that aren't one person's.
NO_PROFILE = ["/pub/dir", "/company/", "/school/", "/search", "/groups/", "/showcase/", "/jobs/", "/posts/", "/feed/"]
RESERVED = [
    "orgs", "settings", "features", "topics", "collections", "sponsors", "marketplace", "explore", "notifications", "pulls", "issues", "about",
    "pricing", "enterprise", "team", "login", "join", "search",
]
_ORCID = r"(?iU)\b(\d{4}-\d{4}-\d{4}-\d{3}[\dX])\b"


def profile_ref(url: Column) -> Column:
    """struct<platform, handle, url, refusal>: the one account an address names, or why it names none."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    full = F.when(F.contains(raw, F.lit("://")), raw).otherwise(F.concat(F.lit("https://"), raw))
    part = lambda name: F.coalesce(F.try_parse_url(full, F.lit(name)), F.lit(""))
    host = F.regexp_replace(F.lower(part("HOST")), r"^www\.", "")
    path = F.regexp_replace(part("PATH"), "/+$", "")
    person, user, orcid = F.regexp_extract(path, "(?i)^/in/([^/]+)$", 1), F.regexp_extract(path, "^/([^/]+)$", 1), F.upper(F.regexp_extract(path, _ORCID, 1))
    linkedin = (host == "linkedin.com") | F.endswith(host, F.lit(".linkedin.com"))
    elsewhere = F.exists(F.array(*map(F.lit, NO_PROFILE)), lambda p: F.contains(F.lower(path), p))

    def ref(platform: str, handle: Column, address: Column) -> Column:
        return F.struct(F.lit(platform).alias("platform"), handle.alias("handle"), address.alias("url"), F.lit(None).cast("string").alias("refusal"))

    def refused(why: str) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(none.alias("platform"), none.alias("handle"), none.alias("url"), F.lit(why).alias("refusal"))

    return (
        F.when(raw == "", refused("empty"))
        .when(~F.lower(part("PROTOCOL")).isin("http", "https"), refused("scheme"))
        .when(linkedin & elsewhere, refused("not one person"))
        .when(linkedin & (person == ""), refused("no profile path"))
        .when(linkedin, ref("linkedin", F.coalesce(F.try_url_decode(F.replace(person, F.lit("+"), F.lit("%2B"))), person), F.concat(F.lit("https://"), part("AUTHORITY"), F.lit("/in/"), person)))
        .when((host == "github.com") & ((user == "") | F.lower(user).isin(*RESERVED)), refused("no user path"))
        .when(host == "github.com", ref("github", user, F.concat(F.lit("https://github.com/"), user)))
        .when(host.isin("orcid.org", "sandbox.orcid.org") & (orcid == ""), refused("no iD"))
        .when(host.isin("orcid.org", "sandbox.orcid.org"), ref("orcid", orcid, F.concat(F.lit("https://orcid.org/"), orcid)))
        .otherwise(refused("unknown platform"))
    )


def name_from_handle(handle: Column) -> Column:
    """jan-fictief-1a2b -> Jan Fictief: numbers and short hexadecimal endings aren't part of a name."""
    parts = F.filter(F.split(F.coalesce(handle, F.lit("")), "[-_.]+"), lambda p: p != "")
    suffix = lambda p: p.rlike("(?U)^\\d+$") | ((F.length(p) <= 12) & F.lower(p).rlike("^[0-9a-f]+$") & p.rlike("[0-9]"))
    kept = F.aggregate(F.reverse(parts), F.expr("CAST(array() AS array<string>)"), lambda acc, p: F.when((F.size(acc) == 0) & suffix(p), acc).otherwise(F.concat(F.array(p), acc)))
    return F.array_join(F.transform(kept, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1000)))), " ")


def og_meta(body: Column, prop: str) -> Column:
    """A meta tag's content, whichever attribute comes first; empty if there is none."""
    name = prop.replace(".", r"\.")
    first = F.regexp_extract(body, rf"""(?is)<meta[^>]+(?:property|name)=["']{name}["'][^>]*content=["'](.*?)["']""", 1)
    second = F.regexp_extract(body, rf"""(?is)<meta[^>]+content=["'](.*?)["'][^>]*(?:property|name)=["']{name}["']""", 1)
    return F.trim(unescaped(F.coalesce(F.nullif(first, F.lit("")), second)))


_RECORD = "name string, bio string, login string, company string, blog string, public_repos int, followers int, created_at string"
_PERSON = "name struct<`given-names`:struct<value:string>, `family-name`:struct<value:string>>, biography struct<content:string>"


def read_profiles(refs: DataFrame) -> DataFrame:
    """refs (platform, handle, body; null body: no answer) -> with name, headline, text, reachable."""
    body, some = F.col("body"), F.coalesce(F.col("body"), F.lit("")) != ""
    empty = lambda c: F.coalesce(c, F.lit(""))
    joined = lambda *xs: F.array_join(F.filter(F.array(*xs), lambda x: x != ""), " ")
    full = F.trim(F.concat(og_meta(body, "profile:first_name"), F.lit(" "), og_meta(body, "profile:last_name")))
    title = F.regexp_replace(og_meta(body, "og:title"), r"\s*\|\s*LinkedIn\s*$", "")
    headline = F.when(F.contains(title, F.lit(" - ")), F.trim(F.regexp_extract(title, "(?s)^.*? - (.*)$", 1))).otherwise("")
    about = og_meta(body, "og:description")
    gh, oc = F.from_json(body, _RECORD), F.from_json(body, _PERSON)
    slug_name = name_from_handle(F.col("handle"))
    li_name = F.coalesce(F.nullif(full, F.lit("")), F.nullif(slug_name, F.lit("")), F.regexp_replace(title, " - .*$", ""))
    oc_name = F.trim(F.concat(empty(oc["name"]["given-names"]["value"]), F.lit(" "), empty(oc["name"]["family-name"]["value"])))
    is_, user = lambda p: F.col("platform") == p, some & (empty(gh["login"]) != "")
    rows = refs.withColumns({
        "name": F.when(is_("linkedin"), F.when(some, li_name).otherwise(slug_name)).when(is_("github"), F.when(user, F.coalesce(F.nullif(gh["name"], F.lit("")), "handle")).otherwise(F.col("handle"))).otherwise(F.when(some, oc_name).otherwise("")),
        "headline": F.when(is_("linkedin") & some, headline).when(is_("github") & user, empty(gh["bio"])).otherwise(""),
        "reachable": F.when(is_("linkedin"), some & ((li_name != "") | (about != ""))).when(is_("github"), user).otherwise(some & oc.isNotNull()),
    })
    text = F.when(is_("linkedin"), joined("headline", about)).when(is_("github"), joined("headline", empty(gh["company"]))).otherwise(empty(oc["biography"]["content"]))
    return rows.withColumn("text", F.when(F.col("reachable"), text).otherwise(""))
