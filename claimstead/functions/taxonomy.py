"""The domains, their markers, and which training backs which claim."""

from __future__ import annotations

FACETS = ("claims", "credentials", "roles")

# Label and markers of each domain, in order of declaration.
DOMAINS: dict[str, dict] = {
    "technology": {
        "label": "technology & engineering",
        "claims": [
            "artificial intelligence", "machine learning", "neural network", "edge ai", "deep tech", "hardware",
            "semiconductor", "software platform", "algorithm", "robotics", "satellite", "spacecraft", "rocket",
            "quantum computing", "cybersecurity", "blockchain", "photonics", "radiation tolerant", "embedded systems",
            "cloud infrastructure", "data pipeline", "dual use",
        ],
        "credentials": [
            "computer science", "engineering", "electrical engineering", "mechanical engineering",
            "software engineering", "informatics", "aerospace engineering", "nuclear engineering", "electronics",
            "telecommunications", "robotics", "data science", "mathematics", "applied mathematics",
            "materials science",
        ],
        "roles": [
            "engineer", "developer", "programmer", "software architect", "chief technology officer",
            "technical lead", "principal engineer", "lead developer", "systems architect", "devops", "data engineer",
        ],
    },
    "science": {
        "label": "science & research",
        "claims": [
            "peer reviewed research", "scientific discovery", "laboratory research", "clinical study", "genomics",
            "biotechnology", "materials research", "computational modelling", "experimental validation", "trl",
        ],
        "credentials": [
            "physics", "chemistry", "biology", "bioinformatics", "biochemistry", "neuroscience",
            "computational science", "molecular biology", "astrophysics", "genetics", "ecology",
        ],
        "roles": [
            "research scientist", "researcher", "postdoctoral", "principal investigator", "lab director",
            "professor", "lecturer", "research fellow",
        ],
    },
    "medicine": {
        "label": "medicine & clinical practice",
        "claims": [
            "clinical treatment", "patient care", "diagnosis", "therapeutic", "medical device", "surgery",
            "clinical trial", "drug development", "diagnostic assay", "health outcomes",
        ],
        "credentials": [
            "medicine", "medical degree", "nursing", "pharmacy", "public health", "epidemiology", "physiotherapy",
            "clinical psychology", "dentistry",
        ],
        "roles": [
            "physician", "doctor", "surgeon", "nurse", "clinician", "pharmacist", "medical director",
            "consultant physician", "general practitioner",
        ],
    },
    "finance": {
        "label": "finance & investment",
        "claims": [
            "asset management", "portfolio management", "hedge fund", "venture capital", "private equity",
            "trading strategy", "quantitative finance", "investment thesis", "fund management", "market making",
            "derivatives", "wealth management", "capital markets",
        ],
        "credentials": [
            "finance", "economics", "accounting", "actuarial science", "cfa", "financial engineering", "econometrics",
        ],
        "roles": [
            "financial analyst", "investment analyst", "equity analyst", "portfolio manager", "trader",
            "investment banker", "fund manager", "chief financial officer", "controller", "auditor", "actuary",
            "financial advisor", "wealth manager",
        ],
    },
    "law": {
        "label": "law & regulation",
        "claims": [
            "legal representation", "litigation", "regulatory compliance", "intellectual property law",
            "contract law", "arbitration", "legal opinion", "patent prosecution",
        ],
        "credentials": ["law", "juris doctor", "llm", "llb", "bar admission", "legal studies"],
        "roles": [
            "lawyer", "attorney", "solicitor", "barrister", "general counsel", "legal counsel", "paralegal", "judge",
            "compliance officer",
        ],
    },
    "policy": {
        "label": "policy & advocacy",
        "claims": [
            "policy reform", "public affairs", "advocacy campaign", "regulatory affairs", "stakeholder engagement",
            "position paper", "governance framework", "public consultation", "lobbying", "patient advocacy",
            "health policy",
        ],
        "credentials": [
            "public policy", "political science", "international relations", "european studies",
            "public administration", "governance", "sociology",
        ],
        "roles": [
            "policy officer", "secretary general", "director general", "lobbyist", "public affairs manager",
            "advocacy lead", "diplomat", "ambassador", "board member", "programme manager",
        ],
    },
    "business": {
        "label": "business & management",
        "claims": [
            "business strategy", "operations", "go to market", "supply chain", "profit and loss",
            "organisational transformation", "management consulting", "scaling operations",
        ],
        "credentials": [
            "business administration", "mba", "management", "commerce", "entrepreneurship", "operations research",
        ],
        "roles": [
            "chief executive", "chief operating officer", "operations director", "general manager",
            "management consultant", "project manager", "account manager", "business development",
        ],
    },
    "marketing": {
        "label": "marketing & communications",
        "claims": [
            "brand strategy", "growth marketing", "content strategy", "public relations", "campaign",
            "audience growth", "social media strategy",
        ],
        "credentials": ["marketing", "communication studies", "journalism", "media studies", "advertising"],
        "roles": [
            "marketer", "communications manager", "brand manager", "content strategist", "press officer",
            "copywriter", "spokesperson",
        ],
    },
    "design": {
        "label": "design & creative",
        "claims": [
            "user experience", "product design", "industrial design", "architecture", "design system",
            "creative direction",
        ],
        "credentials": [
            "design", "fine arts", "architecture", "industrial design", "graphic design", "humanities",
        ],
        "roles": ["designer", "art director", "creative director", "architect", "illustrator", "ux researcher"],
    },
    "education": {
        "label": "education & training",
        "claims": ["curriculum", "pedagogy", "training programme", "learning outcomes", "educational reform"],
        "credentials": ["education", "pedagogy", "teaching", "educational science"],
        "roles": ["teacher", "instructor", "trainer", "headmaster", "dean", "education officer"],
    },
}

# Domains in which formal training is expected.
GATED = ["technology", "science", "medicine", "finance", "law"]

# Training -> claims it can back. One-way.
SUPPORTS = {
    "technology": ["technology", "science"],
    "science": ["science", "technology", "medicine", "education"],
    "medicine": ["medicine", "science", "policy"],
    "finance": ["finance", "business"],
    "law": ["law", "policy"],
    "policy": ["policy", "law"],
    "business": ["business", "finance", "marketing"],
    "marketing": ["marketing", "business", "design"],
    "design": ["design", "marketing"],
    "education": ["education"],
}

# What opens an education context (the second kind in this case only), and what ends a sentence.
EDUCATION_TRIGGERS = (
    r"(?U)\b(?:(?iu:msc|bsc|phd|mba|meng|beng|llm|llb|master's|master of|master in|bachelor's|bachelor of|bachelor in"
    r"|doctorate|doctor of|degree|diploma|studied|studying|graduated|graduate of|alumnus|alumna|educated at"
    r"|trained as|trained at|postdoctoral|postdoc|read\s+\w+\s+at)|(?:MA|BA|MS|BS|MD|JD))\b"
)
SENTENCE_ENDS = "[.;\\n•|]"
EDUCATION_TAIL = 160
