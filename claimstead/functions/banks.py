"""The term banks, the words of negation and the constants that results depend on."""

from __future__ import annotations

import json
import os

TRIGGERED, PASSED, UNKNOWN = "TRIGGERED", "PASSED", "UNKNOWN"

# Words that deny the rest of their clause, and words that deny only what follows at once.
CLAUSE_NEGATORS = [
    "no", "not", "never", "without", "none", "neither", "nor", "cannot", "cant", "dont", "doesnt", "didnt", "isnt", "arent", "wasnt", "werent", "hasnt", "havent", "zero", "0",
]
LOCAL_NEGATORS = ["lack", "lacks", "lacking", "rather", "instead", "unlike", "avoid", "avoids", "avoiding", "free", "excluding", "besides"]
CLAUSE_ENDS = ".;:!?\n•|"
CLAUSE_TOKENS, LOCAL_TOKENS, LOOK_BACK = 6, 2, 200

# The default banks. Order is part of the result.
BANKS: dict[str, list[str]] = {
    "tech_edu": [
        "engineering", "computer science", "physics", "electrical engineering", "mechanical engineering",
        "biomedical engineering", "mathematics", "informatics", "robotics", "aerospace engineering", "data science",
        "electronics", "telecommunications", "nuclear engineering", "chemistry", "bioinformatics",
        "computational science", "applied mathematics", "materials science", "software engineering",
    ],
    "nontech_edu": [
        "public health", "public policy", "governance", "advocacy", "law", "political science", "european studies",
        "international relations", "sociology", "psychology", "business administration", "mba", "humanities",
        "history", "philosophy", "communication studies", "marketing", "public administration", "journalism",
        "fine arts",
    ],
    "degree_words": ["msc", "bsc", "phd", "mba", "master", "bachelor", "doctorate", "postdoc", "llm", "meng", "beng"],
    "tech_claims": [
        "artificial intelligence", "edge ai", "radiation tolerant", "hardware", "satellite", "dual use", "deep tech",
        "nuclear", "rocket", "machine learning", "neural network", "semiconductor", "biometric", "genomics",
        "robotics", "blockchain", "quantum", "aerospace", "cybersecurity", "photonics", "space grade",
    ],
    "leadership_titles": [
        "president", "founder", "co-founder", "ceo", "cto", "chief executive", "chief technology officer",
        "chief scientist", "chief medical officer", "chief financial officer", "chief operating officer",
        "managing director", "managing partner", "executive director", "director general", "secretary general",
        "chairman", "chairwoman", "head of", "general counsel", "principal investigator", "founding partner",
    ],
    "tech_roles": [
        "engineer", "developer", "chief technology officer", "research scientist", "scientist", "software architect",
        "lead developer", "principal engineer", "researcher", "postdoctoral", "technical lead", "programmer",
    ],
    "policy_roles": [
        "patient advocacy", "secretary general", "policy officer", "public health", "governance", "board member",
        "consultant", "advisor", "lobbyist", "ambassador", "spokesperson", "communications manager",
    ],
    "buzzwords": [
        "synergy", "paradigm", "paradigm shift", "disruption", "disruptive", "game changing", "revolutionary",
        "groundbreaking", "pioneering", "cutting edge", "bleeding edge", "next generation", "state of the art",
        "world class", "visionary", "thought leader", "thought leadership", "exponential", "moonshot",
        "transformative", "trailblazing", "future proof", "hypergrowth", "unicorn", "ecosystem play",
        "best in class", "industry leading", "holistic", "seamless",
    ],
    "vague_partnership": [
        "mou", "memorandum of understanding", "nda", "non-disclosure", "in discussion", "discussions ongoing",
        "in talks", "preliminary", "exploratory", "letter of intent", "loi", "heads of terms", "term sheet",
        "early conversations", "planned collaboration",
    ],
    "concrete_partnership": [
        "grant", "funded by", "contract", "joint venture", "joint development", "co-development",
        "collaboration agreement", "series a", "series b", "seed round closed", "revenue", "paying customer",
        "pilot deployed", "acquired", "licensing agreement", "purchase order", "framework agreement",
    ],
    "building_claims": [
        "building", "developing", "creating", "working on", "patent pending", "stealth", "coming soon", "pre-launch",
        "in development", "roadmap",
    ],
    "traction": [
        "customers", "revenue", "clients", "paying users", "arr", "mrr", "contracts signed", "deployed in production",
        "units sold", "subscribers", "bookings", "active users", "installed base",
    ],
    "funding_ask": [
        "seeking investment", "seeking funding", "raising", "funding round", "looking for investors",
        "open to investors", "seed round", "funding ask", "investment opportunity", "capital raise",
    ],
    "deep_collab": [
        "co-authored", "joint paper", "joint research", "co-developed", "integration partner", "technology partner",
        "reseller", "oem", "distributor", "system integrator", "joint publication", "co-funded",
    ],
    "external_validation": [
        "featured in", "as seen on", "interviewed by", "published in", "recognized by", "awarded", "award winner",
        "keynote", "covered by", "profiled in", "cited by", "shortlisted for",
    ],
    "press_outlets": [
        "techcrunch", "forbes", "wired", "reuters", "bloomberg", "financial times", "the economist", "bbc", "nature",
        "ieee spectrum", "mit technology review", "wall street journal", "ars technica", "der spiegel", "le monde",
        "de standaard",
    ],
    "aggregator_domains": [
        "spokeo.com", "whitepages.com", "peoplefinders.com", "radaris.com", "beenverified.com",
        "truepeoplesearch.com", "intelius.com", "mylife.com", "rocketreach.co", "zoominfo.com", "signalhire.com",
        "411.com", "legacy.com", "findagrave.com", "dignitymemorial.com", "echovita.com", "tributearchive.com",
    ],
    "self_published_domains": [
        "medium.com", "substack.com", "linkedin.com", "wordpress.com", "blogspot.com", "wixsite.com", "facebook.com",
        "x.com", "twitter.com", "instagram.com", "youtube.com", "about.me", "crunchbase.com",
    ],
}

# Platforms a subject controls, and hosts that show a name to be shared.
CONTROLLED_HOSTS = [
    "linkedin.com", "medium.com", "substack.com", "wordpress.com", "blogspot.com", "wixsite.com", "facebook.com",
    "x.com", "twitter.com", "instagram.com", "youtube.com", "about.me", "angel.co", "notion.site",
]
SHARED_NAME_HOSTS = {
    "spokeo.com": "a people-search listing", "whitepages.com": "a people-search listing",
    "peoplefinders.com": "a people-search listing", "radaris.com": "a people-search listing",
    "truepeoplesearch.com": "a people-search listing", "mylife.com": "a people-search listing",
    "legacy.com": "an obituary record", "findagrave.com": "a grave record",
    "dignitymemorial.com": "an obituary record", "echovita.com": "an obituary record",
}
DIRECTORY_PAGE = "a LinkedIn directory page listing multiple people"


def with_overrides(overrides: dict | None) -> dict[str, list[str]]:
    """The banks with a user's: a key replaces a bank, '+key' extends it, anything but a list is passed over."""
    out = {name: list(terms) for name, terms in BANKS.items()}
    for name, terms in (overrides or {}).items():
        if isinstance(terms, list):
            if name.startswith("+"):
                out[name[1:]] = out.get(name[1:], []) + terms
            else:
                out[name] = list(terms)
    return out


def read_banks(path: str | None = None) -> dict[str, list[str]]:
    """From the file given, else the one named in $CLAIMSTEAD_KEYWORDS, else ./keywords.json; unreadable: the defaults."""
    try:
        with open(path or os.environ.get("CLAIMSTEAD_KEYWORDS") or "keywords.json", encoding="utf-8") as f:
            return with_overrides(json.load(f))
    except (OSError, ValueError, AttributeError):
        return with_overrides(None)
