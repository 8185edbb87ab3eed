"""What the corpus must yield, in SQL: facts read off its fragments by hand, and the rules over them written anew.

Nothing here comes from the engine's own tables of terms or from its expressions. A fragment is known by its
place in corpus.FRAGMENTS; `g` has one place for each list (t titles, r roles, c claimed, e training, p deals,
m money, l language, i identifiers, y time, w recognition), u for the address and part for the registries.
"""

from __future__ import annotations

from claimstead.sources import corpus as co

_G = (
    f"WITH subjects AS ({co.subjects_sql()}), g AS (SELECT *, subject_id % 5 AS t, subject_id % 11 AS r, subject_id % 9 AS c, subject_id % 8 AS e, subject_id % 7 AS p, subject_id % 6 AS m, subject_id % 4 AS l, "
    "subject_id % 13 AS i, subject_id % 7 AS y, (subject_id - subject_id % 7) % 5 AS w, subject_id % 7 AS u, CAST(1000000 + subject_id AS VARCHAR) AS code, (subject_id % 1000) // 5 % 5 AS part, "
    "regexp_extract(text, 'with ([0-9]+) customers', 1) AS held, len(string_split_regex(trim(text), '\\s+')) AS words FROM subjects), "
)

# The claims of each fragment: list, place, kind, subtype, value as SQL, denied.
_CLAIMS = [
    ("i", 0, "artifact", "doi", "'10.1234/abc.' || code", False), ("i", 1, "artifact", "arxiv", "'2101.' || substr(code, 3, 5)", False),
    ("i", 2, "artifact", "orcid", "'0000-0002-9' || substr(code, 2, 3) || '-9' || substr(code, 5, 3)", False), ("i", 3, "artifact", "github", "'user' || code || '/tools'", False),
    ("i", 4, "artifact", "nct", "'NCT0' || code", False), ("i", 5, "artifact", "patent", "'US ' || code || ' B2'", False), ("i", 10, "artifact", "github", "'user' || code", False),
    ("i", 6, "artifact", "assertion", "'regulatory clearance'", False), ("i", 6, "artifact", "assertion", "'peer-review claim'", False), ("i", 7, "artifact", "assertion", "'ISO certification'", False),
    ("e", 1, "degree", "degree", "'MSc Electrical Engineering'", False), ("e", 2, "degree", "degree", "'PhD Physics'", False), ("e", 3, "degree", "degree", "'MBA'", False),
    ("e", 5, "degree", "degree", "'BSc Marketing'", False), ("e", 6, "degree", "degree", "'Bachelor Laws'", False), ("e", 7, "degree", "degree", "'Master Fine Arts'", False),
    ("e", 1, "degree", "degree_institution", "'University of Brabel'", False), ("e", 2, "degree", "degree_institution", "'Technische Hochschule'", False),
    ("e", 3, "degree", "degree_institution", "'Norfield School of Commerce'", False), ("e", 5, "degree", "degree_institution", "'Lindwall College'", False),
    ("e", 7, "degree", "degree_institution", "'Academy of Lindwall'", False), ("w", 4, "degree", "mentioned_institution", "'Oststadt Institute'", False),
    ("r", 0, "role", "leadership", "'Founder of Aldervane Systems'", False), ("r", 1, "role", "leadership", "'CEO of Brightmoor Labs'", False),
    ("r", 5, "role", "leadership", "'President of Corvel Foundation'", False), ("r", 7, "role", "leadership", "'Head of Research of Dunmere Group'", False),
    ("r", 9, "role", "leadership", "'Managing Director of Elmquist Holding'", False),
    ("r", 0, "role", "owned_org", "'Aldervane Systems'", False), ("r", 1, "role", "owned_org", "'Brightmoor Labs'", False), ("r", 5, "role", "owned_org", "'Corvel Foundation'", False),
    ("p", 0, "partnership", "partner_org", "'Aldervane Systems'", False), ("p", 1, "partnership", "partner_org", "'Fenwick Group'", False), ("p", 1, "partnership", "partner_org", "'Garrow Labs'", False),
    ("p", 1, "partnership", "partner_org", "'Hollin Works'", False), ("p", 1, "partnership", "partner_org", "'Istra Media'", False), ("p", 6, "partnership", "partner_org", "'Kestrel Group'", False),
    ("m", 1, "traction", "customers", "held || ' customers'", False), ("m", 1, "traction", "revenue", "'2.5m revenue'", False), ("m", 4, "traction", "clients", "'0 clients'", True),
    ("y", 0, "timeline", "claimed_experience_years", "'15'", False), ("y", 1, "timeline", "claimed_experience_years", "'forty'", False), ("y", 2, "timeline", "claimed_experience_years", "'twelve'", False),
    ("e", 4, "timeline", "year", "'2009'", False), ("y", 1, "timeline", "year", "'2015'", False), ("y", 2, "timeline", "year", "'1998'", False), ("y", 4, "timeline", "year", "'2041'", False),
    ("y", 6, "timeline", "year", "'2007'", False), ("y", 6, "timeline", "year", "'2011'", False), ("y", 3, "timeline", "year_target", "'2035'", False),
]
_C = "c AS (" + " UNION ALL ".join(f"SELECT subject_id, '{kind}' AS kind, '{sub}' AS subtype, {value} AS value, {str(denied).lower()} AS negated FROM g WHERE {at} = {n}" for at, n, kind, sub, value, denied in _CLAIMS) + ") "

# What a registry lookup ends in; schools by name.
_HARD = "CASE part WHEN 3 THEN 'NOT_FOUND' WHEN 4 THEN 'UNCHECKABLE' WHEN 2 THEN {other} ELSE {own} END"
_BY_NAME, _BY_NONE = _HARD.format(own="'VERIFIED'", other="'MISMATCH'"), _HARD.format(own="'UNCHECKABLE'", other="'UNCHECKABLE'")
_SCHOOL = "CASE value WHEN 'University of Brabel' THEN 'VERIFIED' WHEN 'Technische Hochschule' THEN 'UNCHECKABLE' WHEN 'Norfield School of Commerce' THEN 'NOT_FOUND' WHEN 'Lindwall College' THEN 'NOT_FOUND' WHEN 'Academy of Lindwall' THEN 'VERIFIED' END"
_STATUS = f"CASE WHEN subtype IN ('doi', 'arxiv', 'orcid', 'patent') OR subtype = 'github' AND i = 10 THEN {_BY_NAME} WHEN subtype IN ('nct', 'github') THEN {_BY_NONE} WHEN subtype = 'degree_institution' THEN {_SCHOOL} ELSE 'UNCHECKED' END"
_V = f"v AS (SELECT c.*, i, e, {_STATUS} AS status, CAST(CASE WHEN subtype = 'degree_institution' THEN CASE WHEN i = 6 THEN 3 WHEN i IN (0, 1, 2, 3, 4, 5, 7, 10) THEN 2 ELSE 1 END ELSE 0 END AS INTEGER) AS ord FROM c JOIN g USING (subject_id)) "

# The domain claimed, trained in and worked in by fragments, and which training backs which claim.
_CLAIMED = "CASE c WHEN 0 THEN 'technology' WHEN 1 THEN 'finance' WHEN 2 THEN 'medicine' WHEN 3 THEN 'policy' WHEN 5 THEN 'marketing' WHEN 7 THEN 'science' WHEN 8 THEN 'law' END"
_TRAINED = "CASE e WHEN 1 THEN 'technology' WHEN 2 THEN 'science' WHEN 3 THEN 'business' WHEN 4 THEN 'policy' WHEN 5 THEN 'marketing' WHEN 7 THEN 'design' END"
_WORKED = "CASE r WHEN 2 THEN 'technology' WHEN 3 THEN 'policy' WHEN 4 THEN 'finance' WHEN 6 THEN 'medicine' WHEN 10 THEN 'law' END"
_BACKS = "(VALUES ('technology','technology'),('technology','science'),('science','science'),('science','technology'),('science','medicine'),('business','business'),('business','finance'),('business','marketing'),('policy','policy'),('policy','law'),('marketing','marketing'),('marketing','business'),('marketing','design'),('design','design'),('design','marketing'),('law','law'),('law','policy'),('medicine','medicine'),('medicine','science'),('medicine','policy'),('finance','finance'),('finance','business')) b(training, claimed)"
_DOMAINS = f"d AS (SELECT *, {_CLAIMED} AS claimed, {_TRAINED} AS trained, {_WORKED} AS worked, CASE WHEN e = 6 THEN 'law' END AS worked2, r IN (0, 1, 5, 7, 9) AS titled FROM g) "


def _backed(training: str, claimed: str = "claimed") -> str:
    return f"EXISTS (SELECT 1 FROM {_BACKS} WHERE b.training = d.{training} AND b.claimed = d.{claimed})"


_GATED = "claimed IN ('technology', 'science', 'medicine', 'finance', 'law')"
_DEGREE, _NAMED_SCHOOL, _HAS_HARD = "e IN (1, 2, 3, 5, 6, 7)", "e IN (1, 2, 3, 5, 7)", "i IN (0, 1, 2, 3, 4, 5, 10)"
_FIRM = "(CASE WHEN c = 8 OR p = 3 THEN 1 ELSE 0 END + CASE WHEN p = 3 THEN 3 ELSE 0 END + CASE WHEN m = 1 THEN 1 ELSE 0 END)"
_FLAGS = {
    1: f"CASE WHEN claimed IS NULL OR trained IS NULL AND NOT {_DEGREE} THEN 'UNKNOWN' WHEN {_backed('trained')} OR NOT {_GATED} THEN 'PASSED' WHEN trained IS NULL THEN 'UNKNOWN' WHEN NOT titled AND (worked <> claimed AND EXISTS (SELECT 1 FROM {_BACKS} WHERE b.training = d.trained AND b.claimed = d.worked) OR worked2 <> claimed AND EXISTS (SELECT 1 FROM {_BACKS} WHERE b.training = d.trained AND b.claimed = d.worked2)) THEN 'PASSED' ELSE 'TRIGGERED' END",
    2: f"CASE WHEN NOT titled OR claimed IS NULL OR worked2 IS NULL THEN 'UNKNOWN' WHEN {_backed('worked2')} OR NOT {_GATED} THEN 'PASSED' ELSE 'TRIGGERED' END",
    3: "CASE WHEN r = 0 AND p = 0 THEN 'TRIGGERED' WHEN titled AND p IN (0, 1, 6) THEN 'PASSED' ELSE 'UNKNOWN' END",
    4: "CASE WHEN words < 25 AND l IN (0, 2) THEN 'UNKNOWN' WHEN l = 0 AND words >= 25 AND 6 * 100 >= 2 * words THEN 'TRIGGERED' ELSE 'PASSED' END",
    5: f"CASE WHEN p = 2 AND 4 > {_FIRM} THEN 'TRIGGERED' WHEN p = 2 OR {_FIRM} > 0 THEN 'PASSED' ELSE 'UNKNOWN' END",
    6: f"CASE WHEN {_HAS_HARD} THEN 'PASSED' WHEN i IN (8, 12) THEN 'TRIGGERED' ELSE 'UNKNOWN' END",
    7: "CASE m WHEN 0 THEN 'TRIGGERED' WHEN 1 THEN 'PASSED' WHEN 3 THEN 'PASSED' WHEN 4 THEN 'TRIGGERED' ELSE 'UNKNOWN' END",
    8: f"CASE WHEN NOT {_NAMED_SCHOOL} THEN 'UNKNOWN' WHEN verified AND e IN (3, 5) THEN 'TRIGGERED' ELSE 'PASSED' END",
    9: "CASE p WHEN 1 THEN 'TRIGGERED' WHEN 5 THEN 'PASSED' WHEN 0 THEN 'PASSED' WHEN 6 THEN 'PASSED' ELSE 'UNKNOWN' END",
    10: "CASE WHEN w = 0 OR u IN (2, 6) THEN 'PASSED' WHEN u IN (1, 3, 4) THEN 'TRIGGERED' WHEN w = 2 THEN 'PASSED' WHEN words >= 40 AND (titled OR c IN (0, 4, 7)) THEN 'TRIGGERED' ELSE 'UNKNOWN' END",
    11: f"CASE WHEN NOT {_HAS_HARD} OR NOT verified THEN 'UNKNOWN' WHEN part = 3 THEN 'TRIGGERED' WHEN i IN (3, 4) OR part = 4 THEN 'UNKNOWN' WHEN part = 2 THEN 'TRIGGERED' ELSE 'PASSED' END",
    12: "CASE WHEN y IN (1, 4) THEN 'TRIGGERED' WHEN y = 2 OR y = 0 AND e = 4 THEN 'PASSED' ELSE 'UNKNOWN' END",
    13: f"CASE WHEN t NOT IN (1, 3) THEN 'UNKNOWN' WHEN e = 2 THEN 'PASSED' WHEN NOT {_DEGREE} THEN 'UNKNOWN' ELSE 'TRIGGERED' END",
}
# Weights of the flags; the eleventh holds the level at ORANGE or worse.
_WEIGHTS = {1: 1.5, 2: 1.5, 3: 2.0, 4: 1.0, 5: 1.0, 6: 1.5, 7: 1.5, 8: 1.0, 9: 1.0, 10: 1.0, 11: 2.5, 12: 1.5, 13: 1.5}
_F = "f AS (SELECT d.*, " + ", ".join(f"{x} AS f{k}" for k, x in _FLAGS.items()) + " FROM d), "
_SUMS = "n AS (SELECT *, " + ", ".join(
    " + ".join(f"CASE WHEN f{k} {test} THEN {w} ELSE 0 END" for k, w in _WEIGHTS.items()) + f" AS {name}" for name, test in (("hit", "= 'TRIGGERED'"), ("decided", "<> 'UNKNOWN'"))
) + ", " + " + ".join(f"CASE WHEN f{k} = 'TRIGGERED' THEN 1 ELSE 0 END" for k in _WEIGHTS) + " AS hits FROM f), "
_VERDICT = (
    "x AS (SELECT *, CAST(coalesce(round_even(CAST(100 * hit AS DOUBLE) / nullif(decided, 0), 0), 0) AS INTEGER) AS raw_score, decided / 18.5 >= 0.35 AS scored, CAST(round_even(CAST(100 * decided AS DOUBLE) / 18.5, 0) AS INTEGER) AS coverage FROM n), "
    "z AS (SELECT *, CASE WHEN raw_score < 20 THEN 1 WHEN raw_score < 40 THEN 2 WHEN raw_score < 65 THEN 3 ELSE 4 END AS severity FROM x), "
    "k AS (SELECT *, CASE WHEN scored THEN raw_score END AS score, scored AND f11 = 'TRIGGERED' AND severity < 3 AS held, CASE WHEN NOT scored THEN 'INSUFFICIENT DATA' ELSE ['GREEN', 'YELLOW', 'ORANGE', 'RED'][greatest(severity, CASE WHEN f11 = 'TRIGGERED' THEN 3 ELSE 0 END)] END AS level FROM z) "
)
_AUDIT = _G + _DOMAINS + ", " + _F + _SUMS + _VERDICT
# Checkable details of each fragment.
_DETAILS = (
    "(CASE e WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1 WHEN 7 THEN 1 ELSE 0 END + CASE m WHEN 1 THEN CASE WHEN regexp_full_match(held, '19[5-9][0-9]|20[0-4][0-9]') THEN 3 ELSE 2 END ELSE 0 END + CASE i WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1 WHEN 10 THEN 1 ELSE 0 END"
    " + CASE y WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 6 THEN 2 ELSE 0 END + CASE w WHEN 4 THEN 1 ELSE 0 END)"
)
_SPECIFIC = f"round_even(CAST({_DETAILS} AS DOUBLE) / greatest(words, 1) * 100, 2)"
_BARE = "trim(regexp_replace(regexp_replace({}, '[.] *$', ''), '^ +', ''))"


def _of(subtype: str) -> str:
    return _G + _C + f"SELECT subject_id, value FROM c WHERE subtype = '{subtype}'"


def _checks(subtype: str) -> str:
    return _G + _C + ", " + _V + f"SELECT subject_id, ord, value, status FROM v WHERE subtype = '{subtype}'"


def _spans() -> str:
    """Sentences of education: a blank before, unless the text begins with it."""
    first = "CASE WHEN t = 0 AND r = 8 AND c = 6 THEN '' ELSE ' ' END"
    said = [
        ("e = 1", 1, f"{first} || 'Holds an MSc in Electrical Engineering, University of Brabel'", 1), ("e = 2", 1, f"{first} || 'PhD in Physics from Technische Hochschule Oststadt'", 1),
        ("e = 3", 1, f"{first} || 'MBA from Norfield School of Commerce'", 1), ("e = 4", 1, f"{first} || 'Studied public policy and graduated in 2009'", 2), ("e = 5", 1, f"{first} || 'BSc Marketing, Lindwall College'", 1),
        ("e = 6", 1, f"{first} || 'Bachelor of Laws, trained as a lawyer at a court'", 2), ("e = 7", 1, f"{first} || 'Master of Fine Arts from Academy of Lindwall'", 1),
        ("y = 2", 2, "CASE WHEN t = 0 AND r = 8 AND c = 6 AND e = 0 AND p = 4 AND m = 5 AND l = 1 AND i IN (9, 11) THEN '' ELSE ' ' END || 'Graduated 1998, with twelve years in banking'", 1),
    ]
    return "s AS (" + " UNION ALL ".join(f"SELECT subject_id, {at} AS place, {text} AS span FROM g WHERE {where}" for where, at, text, times in said for _ in range(times)) + ") "


def _profile() -> str:
    # Markers by fragment, in the order of their banks.
    claims = {0: "machine learning; hardware; robotics; satellite", 1: "asset management; venture capital", 2: "clinical treatment; patient care", 3: "policy reform; public affairs", 5: "brand strategy; content strategy", 7: "clinical study; genomics; biotechnology", 8: "litigation; contract law"}
    credentials = {1: "engineering; electrical engineering", 2: "physics", 3: "mba; commerce", 4: "public policy", 5: "marketing", 7: "fine arts"}
    roles = {2: "engineer; technical lead", 3: "policy officer; board member", 4: "portfolio manager; fund manager", 6: "physician; clinician", 10: "lawyer; legal counsel"}
    rows = [f"SELECT subject_id, claimed AS domain, '{x}' AS claims, '' AS credentials, '' AS roles FROM d WHERE c = {k}" for k, x in claims.items()]
    rows += [f"SELECT subject_id, trained, '', '{x}', '' FROM d WHERE e = {k}" for k, x in credentials.items()]
    rows += [f"SELECT subject_id, worked, '', '', '{x}' FROM d WHERE r = {k}" for k, x in roles.items()] + ["SELECT subject_id, 'law', '', '', 'lawyer' FROM d WHERE e = 6"]
    return _G + _DOMAINS + "SELECT subject_id, domain, max(claims) AS claims, max(credentials) AS credentials, max(roles) AS roles FROM (" + " UNION ALL ".join(rows) + ") q GROUP BY 1, 2"


# The provider answers of the catalogue, by the key's remainders.
_ANSWERS = (
    "s AS (SELECT subject_id AS k, subject_id, subject_name AS n FROM subjects), a AS ("
    "SELECT subject_id, 'wikipedia' AS provider, 'encyclopedia' AS kind, 0 AS ord, 'https://en.wikipedia.org/wiki/' || url_encode(replace(n, ' ', '_')) AS url, n AS title, 'born in 1970' AS snippet, true AS independent, true AS about_subject FROM s WHERE k % 3 = 0 "
    "UNION ALL SELECT subject_id, 'wikipedia', 'encyclopedia', 1, 'https://en.wikipedia.org/wiki/Oda_Ruiz', 'Oda Ruiz', 'other', true, false FROM s WHERE k % 3 = 0 "
    "UNION ALL SELECT subject_id, 'openalex', 'publication', 0, 'https://openalex.org/A1', n || ' — scholarly record', '3 works, 5 citations, affiliated with Brabel', true, true FROM s WHERE k % 4 < 2 "
    "UNION ALL SELECT subject_id, 'openalex', 'publication', 1, 'https://openalex.org/A2', n || ' — scholarly record', (k % 9) || ' works, 0 citations', true, true FROM s WHERE k % 4 < 2 "
    "UNION ALL SELECT subject_id, 'crossref', 'publication', 0, 'https://doi.org/10.1/' || k, 'On things', 'authors: Oda Ruiz, ' || n, true, true FROM s WHERE k % 5 = 0 "
    "UNION ALL SELECT subject_id, 'duckduckgo', 'web', 0, 'https://www.spokeo.com/n', n, '', true, true FROM s WHERE k % 2 = 0 "
    "UNION ALL SELECT subject_id, 'duckduckgo', 'web', 1, 'https://linkedin.com/pub/dir/a/b', 'People', '', false, false FROM s WHERE k % 2 = 0 "
    "UNION ALL SELECT subject_id, 'duckduckgo', 'web', 2, 'http://localhost/x', n, '', true, true FROM s WHERE k % 2 = 0), "
    "b AS (SELECT *, CAST(ord + CASE provider WHEN 'wikipedia' THEN 0 WHEN 'openalex' THEN 1000 WHEN 'crossref' THEN 2000 ELSE 3000 END AS INTEGER) AS place FROM a) "
)
_PV = f"WITH subjects AS ({co.subjects_sql()}), " + _ANSWERS


def _provider(name: str) -> str:
    return _PV + f"SELECT subject_id, provider, kind, CAST(ord AS INTEGER) AS ord, url, title, snippet, independent, about_subject FROM a WHERE provider = '{name}'"


EXPECTED = {
    "is_negated": _G + "z AS (SELECT 1) SELECT subject_id, CAST(strpos(text, 'customers') - 1 AS INTEGER) AS start, m = 2 AS negated FROM g WHERE m IN (1, 2)",
    "find_terms": _G + "z AS (SELECT 1) SELECT subject_id, CASE m WHEN 1 THEN 'customers; revenue' WHEN 3 THEN 'active users' ELSE '' END AS traction, CASE p WHEN 2 THEN 'mou; nda; letter of intent; term sheet' ELSE '' END AS vague_partnership, concat_ws('; ', CASE WHEN p = 3 THEN 'grant; funded by' END, CASE WHEN p = 3 OR c = 8 THEN 'contract' END, CASE WHEN m = 1 THEN 'revenue' END, CASE WHEN p = 3 THEN 'purchase order' END) AS concrete_partnership, CASE w WHEN 0 THEN 'forbes' ELSE '' END AS press_outlets FROM g",
    "find_non_overlapping": _G + "z AS (SELECT 1) SELECT subject_id, CASE l WHEN 0 THEN 'visionary; disruptive; world class; holistic; moonshot; synergy' WHEN 2 THEN 'paradigm shift; seamless' ELSE '' END AS terms, CAST(CASE l WHEN 0 THEN 6 WHEN 2 THEN 2 ELSE 0 END AS BIGINT) AS hits FROM g",
    **{f"ext_{name}": _of(name) for name in ("degree", "degree_institution", "mentioned_institution", "year", "year_target")},
    "ext_experience_years": _of("claimed_experience_years"),
    "experience_years": _G + "z AS (SELECT 1) SELECT subject_id, CAST(CASE y WHEN 0 THEN 15 WHEN 1 THEN 40 ELSE 12 END AS INTEGER) AS years FROM g WHERE y IN (0, 1, 2)",
    "ext_traction": _G + _C + "SELECT subject_id, value, subtype AS noun, negated FROM c WHERE kind = 'traction'",
    "mask_non_dates": _G + "a AS (SELECT *, CASE i WHEN 0 THEN '10.1234/abc.' || code WHEN 1 THEN 'arxiv.org/abs/2101.' || substr(code, 3, 5) WHEN 2 THEN 'orcid.org/0000-0002-9' || substr(code, 2, 3) || '-9' || substr(code, 5, 3) WHEN 3 THEN 'github.com/user' || code || '/tools.' WHEN 4 THEN 'NCT0' || code WHEN 5 THEN 'US ' || code || ' B2' WHEN 10 THEN 'github.com/user' || code ELSE 'no identifier' END AS gone FROM g), b AS (SELECT *, replace(text, gone, repeat(' ', CAST(length(gone) AS BIGINT))) AS t1 FROM a) SELECT subject_id, CASE m WHEN 1 THEN replace(replace(t1, held || ' customers', repeat(' ', CAST(length(held) AS BIGINT)) || ' customers'), '2.5m revenue', '     revenue') WHEN 4 THEN replace(t1, '0 clients', '  clients') ELSE t1 END AS masked FROM b",
    "claims_by": _G + _C + "SELECT kind, subtype, count(*) AS n FROM c GROUP BY 1, 2",
    "skipped_subtypes": _G + _C + "SELECT subtype, count(*) AS n FROM c WHERE subtype NOT IN ('doi', 'orcid', 'github', 'arxiv', 'nct', 'patent', 'degree_institution') GROUP BY 1",
    "norm_org": _G + _C + "SELECT subject_id, CASE value WHEN 'Corvel Foundation' THEN 'corvel' ELSE lower(value) END AS org FROM c WHERE subtype IN ('owned_org', 'partner_org')",
    "owned_partner_overlap": _G + "z AS (SELECT 1) SELECT subject_id, 'aldervane systems' AS org FROM g WHERE r = 0 AND p = 0",
    "org_tokens": _G + _C + "SELECT subject_id, CASE value WHEN 'University of Brabel' THEN 'brabel univ' WHEN 'Technische Hochschule' THEN 'technische univ' WHEN 'Norfield School of Commerce' THEN 'commerce norfield school' WHEN 'Lindwall College' THEN 'college lindwall' WHEN 'Academy of Lindwall' THEN 'academy lindwall' ELSE 'institut oststadt' END AS tokens FROM c WHERE subtype IN ('degree_institution', 'mentioned_institution')",
    "specificity_index": _G + f"z AS (SELECT 1) SELECT subject_id, {_SPECIFIC} AS specificity FROM g",
    "education_spans": _G + _spans() + "SELECT subject_id, span FROM s",
    "education_text": _G + _spans() + "SELECT g.subject_id, coalesce(x.education, '') AS education FROM g LEFT JOIN (SELECT subject_id, string_agg(span, ' ; ' ORDER BY place) AS education FROM s GROUP BY 1) x USING (subject_id)",
    "domain_profile": _profile(),
    "claimed_domain": _G + _DOMAINS + "SELECT subject_id, claimed FROM d",
    "supporting_domains": _G + _DOMAINS + "SELECT subject_id, coalesce(trained, '') AS credentials, CASE WHEN worked2 IS NULL OR worked = 'law' THEN coalesce(worked, '') WHEN worked IS NULL THEN 'law' WHEN worked = 'policy' THEN 'law; policy' ELSE worked || '; law' END AS roles FROM d",
    "is_supported": _G + _DOMAINS + f"SELECT subject_id, CASE WHEN {_backed('trained')} THEN trained END AS via FROM d",
    **{f"flag_{k:02d}": _G + _DOMAINS + f"SELECT subject_id, {x} AS status FROM d" for k, x in _FLAGS.items()},
    "verdict": _AUDIT + "SELECT subject_id, score, raw_score, scored, coverage, level, held FROM k",
    "batch_summary": _AUDIT + f"SELECT subject_name AS target, level, score, coverage AS coverage_pct, {_SPECIFIC} AS specificity, CAST(hits AS BIGINT) AS triggered_flags FROM k",
    "claim_status_counts": _G + _C + ", " + _V + "SELECT CASE WHEN verified THEN status ELSE 'UNCHECKED' END AS status, count(*) AS n FROM v JOIN subjects USING (subject_id) GROUP BY 1",
    **{f"ver_{s}": _checks(s) for s in ("doi", "orcid", "github", "arxiv", "nct", "patent")},
    "ver_institution": _checks("degree_institution"),
    "ver_dispatch": _G + _C + ", " + _V + "SELECT subtype, status, count(*) AS n FROM v GROUP BY 1, 2",
    "org_match": _G + _C + ", " + _V + "SELECT value, status, count(*) AS n FROM v WHERE subtype = 'degree_institution' GROUP BY 1, 2",
    **{f"prov_{p}": _provider(p) for p in ("wikipedia", "openalex", "crossref", "duckduckgo")},
    "prov_openalex_best": _PV + "SELECT subject_id, n AS display_name, CAST(greatest(3, k % 9) AS INTEGER) AS works, CAST(CASE WHEN k % 9 > 3 THEN 0 ELSE 5 END AS INTEGER) AS citations, CAST(2 AS BIGINT) AS matches, true AS ambiguous FROM s WHERE k % 4 < 2",
    "prov_gather": _PV + "SELECT provider, about_subject, independent, count(*) AS n FROM a GROUP BY 1, 2, 3",
    "prov_corpus": _PV + "SELECT subject_id, string_agg(trim(title || '. ' || snippet), chr(10) ORDER BY place) AS text FROM b WHERE about_subject GROUP BY 1",
    "prov_urls": _PV + "SELECT subject_id, url, min(place) AS place FROM b GROUP BY 1, 2",
    "prov_used_urls": _PV + "SELECT subject_id, url, min(place) AS place FROM b WHERE about_subject GROUP BY 1, 2",
    "prov_discarded": _PV + "SELECT subject_id, count(*) AS n FROM b WHERE NOT about_subject GROUP BY 1",
    "prov_health": _PV + "SELECT subject_id, f AS failures, o AS providers_ok, f = 0 OR o > 0 AS search_ok FROM (SELECT subject_id, CAST((k % 3 = 2)::INT + (k % 4 >= 2)::INT + (k % 5 <> 0)::INT + (k % 2 <> 0)::INT AS BIGINT) AS f, CAST((k % 3 = 0)::INT + (k % 4 < 2)::INT + (k % 5 = 0)::INT + (k % 2 = 0)::INT AS BIGINT) AS o FROM s) q",
    "shared_name_evidence": _PV + "SELECT subject_id, 'a people-search listing' AS reason, 'https://www.spokeo.com/n' AS url FROM s WHERE k % 2 = 0 UNION ALL SELECT subject_id, 'a LinkedIn directory page listing multiple people', 'https://linkedin.com/pub/dir/a/b' FROM s WHERE k % 2 = 0",
    "deep_filter": _PV + "SELECT subject_id, provider, url FROM b WHERE about_subject AND url <> 'http://localhost/x'",
}

# The pages' own character references: &amp; &quot; &copy; &middot;
_RAW = "regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', '', 'g')"
_PLAIN = f"replace(replace(replace(replace({_RAW}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
EXPECTED["page_text"] = f"SELECT page_id, substr(regexp_replace(trim({_PLAIN}, ' '), '\\s+', ' ', 'g'), 1, 6000) AS text FROM pages"
EXPECTED["og_meta"] = "SELECT page_id, '' AS title, '' AS description FROM pages WHERE html NOT LIKE '%og:%'"
_WEB = "FROM s"
EXPECTED["web_signals"] = _PV + (
    "SELECT subject_id, CAST(CASE WHEN k % 4 < 2 THEN greatest(3, k % 9) END AS INTEGER) AS openalex_works, CAST(CASE WHEN k % 4 < 2 THEN 2 END AS INTEGER) AS ambiguous_identity, k % 3 = 0 OR k % 4 < 2 OR k % 5 = 0 OR k % 2 = 0 AS search_ok, "
    "nullif(CAST((k % 3 = 0)::INT + (k % 2 = 0)::INT AS BIGINT), 0) AS n_discarded, "
    "concat_ws('; ', CASE WHEN k % 5 <> 0 THEN 'crossref' END, CASE WHEN k % 2 <> 0 THEN 'duckduckgo' END, CASE WHEN k % 4 >= 2 THEN 'openalex' END, CASE WHEN k % 3 = 2 THEN 'wikipedia' END) AS failed, "
    "CASE WHEN k % 2 = 0 THEN 'a LinkedIn directory page listing multiple people; a people-search listing' ELSE '' END AS shared, CASE WHEN k % 3 = 0 THEN n ELSE '' END AS about, "
    "concat_ws(' ', CASE WHEN k % 3 = 0 THEN 'https://en.wikipedia.org/wiki/' || url_encode(replace(n, ' ', '_')) END, CASE WHEN k % 4 < 2 THEN 'https://openalex.org/A1 https://openalex.org/A2' END, CASE WHEN k % 5 = 0 THEN 'https://doi.org/10.1/' || k END, CASE WHEN k % 2 = 0 THEN 'https://www.spokeo.com/n http://localhost/x' END) AS urls FROM s"
)
# A record of works settles output; an article, or an address that is neither the subject's nor a listing, settles validation.
EXPECTED["web_audit"] = _PV + (
    "SELECT subject_id, CASE WHEN k % 4 < 2 OR k % 5 = 0 AND false THEN 'PASSED' ELSE 'UNKNOWN' END AS output, CASE WHEN k % 3 = 0 OR k % 4 < 2 OR k % 5 = 0 OR k % 2 = 0 THEN 'PASSED' ELSE 'UNKNOWN' END AS validation FROM s"
)
EXPECTED["profile_subjects"] = f"WITH subjects AS ({co.subjects_sql()}) " + (
    "SELECT subject_id, CASE subject_id % 3 WHEN 0 THEN 'linkedin:p' ELSE 'github:p' END || subject_id AS profile_anchor, subject_id % 7 <> 0 AS profile_reachable, CASE subject_id % 3 WHEN 0 THEN 'https://www.linkedin.com/in/p' ELSE 'https://github.com/p' END || subject_id AS url, true AS pasted FROM subjects WHERE subject_id % 3 < 2"
)
_PASTED = "FROM subjects WHERE subject_id % 3 < 2"
_SUBJECTS = f"WITH subjects AS ({co.subjects_sql()}) "
_PROSE = "'Builder of things.' || chr(10) || 'Makes things.' || chr(10) || 'Engineer at Corvel, Jan 2015 - Present (6 years 6 months). Led a team of five.' || chr(10) || 'Clerk at Dunmere, Feb 2010 - Dec 2014 (1 year).' || chr(10) || 'MSc Physics at University of Brabel (2005 - 2009).' || chr(10) || 'Skills: Python, SQL, Education, Planning.'"
EXPECTED |= {
    "paste_chrome": _SUBJECTS + "SELECT subject_id, CAST(CASE WHEN subject_id % 3 < 2 THEN 3 ELSE 0 END AS INTEGER) AS n FROM subjects",
    "paste_experience": _SUBJECTS + f"SELECT subject_id, CAST(0 AS INTEGER) AS at, 'Engineer' AS title, 'Corvel' AS company, 'Jan 2015 - Present' AS date_range, '6 years 6 months' AS duration, 'Brabel, Nowhere' AS location, 'Led a team of five.' AS description {_PASTED} UNION ALL SELECT subject_id, 1, 'Clerk', 'Dunmere', 'Feb 2010 - Dec 2014', '1 year', '', '' {_PASTED}",
    "paste_education": _SUBJECTS + f"SELECT subject_id, CAST(0 AS INTEGER) AS at, 'University of Brabel' AS institution, 'MSc' AS degree, 'Physics' AS field_of_study, '2005 - 2009' AS years, '' AS description {_PASTED}",
    "paste_skills": _SUBJECTS + "SELECT subject_id, CASE WHEN subject_id % 3 < 2 THEN 'Python; SQL; Education; Planning' ELSE '' END AS skills FROM subjects",
    "profile_prose": _SUBJECTS + f"SELECT subject_id, CASE WHEN subject_id % 3 < 2 THEN {_PROSE} ELSE '' END AS prose FROM subjects",
    "paste_subjects": _SUBJECTS + f"SELECT subject_id, subject_name, CASE WHEN subject_id % 3 < 2 THEN {_PROSE} ELSE text END AS text FROM subjects",
    "read_github": _SUBJECTS + "SELECT subject_id, 'github' AS platform, 'jan-fictief-1a2b' AS handle, CASE WHEN subject_id % 7 = 0 THEN 'jan-fictief-1a2b' ELSE subject_name END AS name, CASE WHEN subject_id % 7 = 0 THEN '' ELSE 'Builds.' END AS headline, subject_id % 7 <> 0 AS reachable, CASE WHEN subject_id % 7 = 0 THEN '' ELSE 'Builds. Corvel' END AS text FROM subjects WHERE subject_id % 3 = 1",
    "read_orcid": _SUBJECTS + "SELECT subject_id, 'orcid' AS platform, 'jan-fictief-1a2b' AS handle, '' AS name, '' AS headline, subject_id % 7 <> 0 AS reachable, CASE WHEN subject_id % 7 = 0 THEN '' ELSE subject_name END AS text FROM subjects WHERE subject_id % 3 = 2",
}
EXPECTED["batch_csv"] = _AUDIT + f"SELECT subject_name || ',' || level || ',' || coalesce(CAST(score AS VARCHAR), '') || ',' || coverage || ',' || CAST({_SPECIFIC} AS VARCHAR) || ',' || hits || ',2026-01-01T00:00:00' AS line FROM k"
EXPECTED["report_caveats"] = _AUDIT + (
    f"SELECT subject_id, concat_ws(chr(10), CASE WHEN {_HAS_HARD} AND NOT verified THEN '1 identifiers could be checked with a registry but were not.' END, CASE WHEN level IN ('GREEN', 'YELLOW') AND NOT verified THEN 'Nothing was checked outside the text: no contradiction found is not corroboration.' END, "
    f"CASE WHEN coverage < 50 THEN 'Only ' || coverage || '% of the weight could be decided; the score is provisional.' END, CASE WHEN {_SPECIFIC} < 2 AND words >= 40 THEN 'The text is short of details that can be checked.' END) AS caveats FROM k"
)
EXPECTED["paste_sections"] = _SUBJECTS + f"SELECT section, CAST(n * (SELECT count(*) {_PASTED}) AS BIGINT) + CASE WHEN section = '_preamble' THEN (SELECT count(*) FROM subjects WHERE subject_id % 3 = 2) ELSE 0 END AS n FROM (VALUES ('_preamble', 7), ('about', 2), ('experience', 11), ('education', 4), ('skills', 4)) v(section, n)"
