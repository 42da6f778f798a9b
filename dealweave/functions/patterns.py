"""Fixed values of document extraction: patterns (Java dialect), word lists and lookup tables."""

from __future__ import annotations

# Patterns. (?i) ignores case, (?s) lets . cross lines, (?md) ends $ at \n only.
PARTY_LIST = r"(?is)(?md)\bby\s+and\s+(?:among|between)\b\s+(.+)\.\s*$"
PARTY_LIST_ALT = r"(?is)(?md)(?:entered\s+into|made)\s+(?:by\s+and\s+)?(?:among|between)\s+(.+)\.\s*$"
MERGER_HEADER = r"(?i)(?:AGREEMENT\s+AND\s+PLAN\s+OF\s+MERGER|PLAN\s+OF\s+MERGER|MERGER\s+AGREEMENT)"
DEFINED_TERM = (
    r"(?i)\(\s*(?:the\s+|hereinafter\s+(?:the\s+)?|hereinafter\s+referred\s+to\s+as\s+(?:the\s+)?|referred\s+to\s+as\s+(?:the\s+)?)?"
    r"[\"']([A-Za-z0-9][A-Za-z0-9\s\-]{0,40}?)[\"']\s*\)"
)
SPONSOR_AFFILIATION = (
    r"(?i)(?:affiliates?\s+of|funds?\s+managed\s+by|portfolio\s+compan(?:y|ies)\s+of|controlled\s+by)\s+"
    r"([A-Z][A-Za-z0-9\s,&.'-]{2,80}?)(?:\.|,|;|\s+and\b|\s+\)|$)"
)
SPONSOR_KEYWORDS = r"(?i)\b(?:financial\s+sponsor|private\s+equity|PE\s+firm|buyout\s+(?:firm|fund)|sponsor(?:ed)?(?:\s+transaction)?)\b"
EQUITY_COMMITMENT = r"(?i)\b(?:equity\s+commitment\s+letter|equity\s+financing|sponsor\s+equity)\b"
SPONSOR_NEGATION = (
    r"(?i)\b(?:not\s+a\s+(?:financial\s+)?sponsor|independent\s+of\s+(?:any\s+)?sponsor|no\s+sponsor|without\s+(?:any\s+)?sponsor|non-sponsored)\b"
)
CURRENCY = r"(?i)\$\s?(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*(billion|million|b|m|bn|mm|mil)?"
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE_DATED = rf"(?i)dated\s+(?:as\s+of\s+)?((?:{_MONTHS})\s+\d{{1,2}},?\s+\d{{4}})"
DATE_ENTERED = rf"(?i)entered\s+into\s+(?:on\s+)?((?:{_MONTHS})\s+\d{{1,2}},?\s+\d{{4}})"
DATE_DAY_OF = rf"(?i)dated\s+(?:as\s+of\s+)?the\s+(\d{{1,2}})(?:st|nd|rd|th)?\s+day\s+of\s+({_MONTHS}),?\s+(\d{{4}})"
DATE_ISO = r"dated\s+(?:as\s+of\s+)?(\d{4}-\d{2}-\d{2})"
COMPANY_SUFFIX = r"(?i),?\s*(?:Inc\.?|Incorporated|Corporation|LLC|L\.?L\.?C\.?|Ltd\.?|Limited|Company|LP|L\.?P\.?|LLP|PLC|N\.?A\.?|S\.?A\.?|AG|GmbH|BV|NV)\.?$"
COMPANY_SUFFIX_COMMA = r"(?i),\s*(?:Corp\.?|Co\.?)$"
JURISDICTION = (
    r"(?i),?\s*a\s+(?:Delaware|Nevada|California|New York|Texas|Florida|Maryland|[A-Z][a-z]+)\s+"
    r"(?:corporation|limited\s+liability\s+company|limited\s+partnership|company)$"
)
ITEM_101 = r"(?i)Item\s+1\.01[.\s]+Entry\s+into\s+a\s+Material\s+Definitive\s+Agreement"
ITEM_801 = r"(?i)Item\s+8\.01[.\s]+Other\s+Events"
DEFINITIVE_AGREEMENT = r"(?i)entered\s+into\s+(?:a|an)\s+(?:Agreement\s+and\s+Plan\s+of\s+Merger|Merger\s+Agreement|definitive\s+agreement)"
PURCHASE_AGREEMENT = r"(?i)entered\s+into\s+(?:a\s+)?(purchase\s+agreement|underwriting\s+agreement)"
DEBT_INSTRUMENT = (
    r"(?i)(\$[\d,]+(?:\.\d+)?(?:\s*(?:billion|million|b|m|bn|mm))?)\s+(?:aggregate\s+)?(?:principal\s+)?(?:amount\s+)?(?:of\s+)?(?:its\s+)?"
    r"([\d.]+%\s+)?(Senior\s+Notes?|Senior\s+Secured\s+Notes?|Subordinated\s+Notes?|Convertible\s+Notes?|Notes?|Bonds?|Debentures?)"
    r"(?:\s+due\s+(\d{4}))?"
)
CREDIT_FACILITY = (
    r"(?i)(\$[\d,]+(?:\.\d+)?(?:\s*(?:billion|million|b|m|bn|mm))?)\s+(?:aggregate\s+)?(?:principal\s+)?(?:amount\s+)?"
    r"((?:senior\s+)?(?:secured\s+)?(?:unsecured\s+)?(?:revolving\s+)?(?:credit\s+)?(?:facility|term\s+loan|bridge\s+loan|rcf|revolver))"
)
UNDERWRITERS = (
    r"(?i)(?:with|among)\s+([\w\s,&.]+?(?:LLC|Inc\.?|L\.?P\.?|Securities|Capital|Bank)?"
    r"(?:\s+and\s+[\w\s,&.]+?(?:LLC|Inc\.?|L\.?P\.?|Securities|Capital|Bank))?)"
    r"(?:,?\s+as\s+(?:representatives?\s+of\s+(?:the\s+)?(?:several\s+)?underwriters?|underwriters?|"
    r"lead\s+(?:book-?running\s+)?managers?|joint\s+(?:book-?running\s+)?managers?))"
)
UNDERWRITERS_SIMPLE = (
    r"(?i)(?:underwriters?\s+(?:named|identified|listed)\s+(?:in|on)\s+|(?:the\s+)?underwriters?\s+(?:are|include|were)\s+)"
    r"([A-Z][\w\s,&.]+?)(?:\.|,\s+(?:relating|whereby|pursuant))"
)
MATERIAL_EXHIBIT = r"credit\s+agreement|commitment\s+letter|bridge|debt\s+financing|underwriting\s+agreement|indenture|loan\s+agreement|term\s+loan|revolving"

# Role labels of defined terms.
ROLE_LABELS = {
    "company": "target", "target": "target", "seller": "target",
    "parent": "acquirer", "buyer": "acquirer", "purchaser": "acquirer", "acquirer": "acquirer", "acquiror": "acquirer",
    "merger sub": "merger_sub", "merger subsidiary": "merger_sub", "acquisition sub": "merger_sub", "acquisition subsidiary": "merger_sub",
    "newco": "merger_sub", "holdco": "acquirer", "holdings": "acquirer",
}
TARGET_ROLES = ("company", "target", "seller")
ACQUIRER_ROLES = ("parent", "buyer", "purchaser", "acquirer", "acquiror")

# Sponsor aliases and display names.
SPONSORS = {
    "blackstone": "Blackstone", "kkr": "KKR", "kohlberg kravis roberts": "KKR", "apollo": "Apollo Global Management",
    "apollo global": "Apollo Global Management", "carlyle": "The Carlyle Group", "the carlyle group": "The Carlyle Group",
    "thoma bravo": "Thoma Bravo", "tpg": "TPG", "tpg capital": "TPG", "texas pacific group": "TPG", "advent": "Advent International",
    "advent international": "Advent International", "bain capital": "Bain Capital", "warburg pincus": "Warburg Pincus",
    "silver lake": "Silver Lake", "vista equity": "Vista Equity Partners", "vista equity partners": "Vista Equity Partners",
    "clayton dubilier": "Clayton, Dubilier & Rice", "clayton, dubilier & rice": "Clayton, Dubilier & Rice", "cd&r": "Clayton, Dubilier & Rice",
    "cvc": "CVC Capital Partners", "cvc capital": "CVC Capital Partners", "eqt": "EQT", "eqt partners": "EQT",
    "brookfield": "Brookfield Asset Management", "brookfield asset management": "Brookfield Asset Management", "permira": "Permira",
    "hellman & friedman": "Hellman & Friedman", "h&f": "Hellman & Friedman", "general atlantic": "General Atlantic",
    "insight partners": "Insight Partners", "providence equity": "Providence Equity Partners", "ares": "Ares Management",
    "ares management": "Ares Management", "apax": "Apax Partners", "apax partners": "Apax Partners", "cinven": "Cinven",
    "pai partners": "PAI Partners", "3g capital": "3G Capital", "sycamore partners": "Sycamore Partners", "sycamore": "Sycamore Partners",
}

# Scale words of amounts.
SCALES = {"million": 1e6, "mil": 1e6, "m": 1e6, "mm": 1e6, "billion": 1e9, "b": 1e9, "bn": 1e9}

# Instrument wording to type, the first that is contained decides.
INSTRUMENT_TYPES = (
    ("senior notes", "bond"), ("senior secured notes", "bond"), ("subordinated notes", "bond"), ("convertible notes", "convertible_bond"),
    ("notes", "bond"), ("bonds", "bond"), ("debentures", "bond"), ("term loan", "term_loan"), ("bridge loan", "bridge_loan"),
    ("revolving credit facility", "rcf"), ("revolving facility", "rcf"), ("credit facility", "credit_facility"), ("revolver", "rcf"), ("rcf", "rcf"),
)

# Typographic characters and their plain form; the empty ones vanish.
PLAIN_FORM = {
    "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u201f": '"',
    "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'",
    "\u2013": "-", "\u2014": "-", "\u2015": "-", "\u2012": "-",
    "\u00a0": " ", "\u2002": " ", "\u2003": " ", "\u2009": " ", "\u200a": " ",
    "\u200b": "", "\ufeff": "",
}
TYPOGRAPHIC, PLAIN = "".join(PLAIN_FORM), "".join(PLAIN_FORM.values())

# Endings cut from bank names, each tried once, in this order.
BANK_ENDINGS = (
    ", n.a.", " n.a.", ", na", " na", ", inc.", " inc.", ", inc", " inc", ", llc", " llc", ", ltd", " ltd",
    " plc", " ag", " sa", " nv", " bv", " securities", " capital", " bank", "& co.", "& co", " & company",
)
# Pieces removed from bank names anywhere.
BANK_PIECES = (", n.a.", " n.a.", ", na", ", inc", " inc", " llc", " ltd")

# Role words and bank names in tables.
TABLE_ROLES = (
    "bookrunner", "joint bookrunner", "active bookrunner", "passive bookrunner", "co-manager", "co manager", "lead manager", "manager",
    "underwriter", "senior underwriter", "lead underwriter", "arranger", "lead arranger", "joint lead arranger", "mandated lead arranger",
    "administrative agent", "admin agent", "syndication agent", "documentation agent", "collateral agent", "paying agent",
    "financial advisor", "financial adviser", "advisor", "adviser", "fairness opinion",
)
BANK_PATTERNS = (
    r"J\.?P\.?\s*Morgan", r"JPMorgan", r"Goldman\s*Sachs", r"GS", r"Morgan\s*Stanley", r"Bank\s*of\s*America", r"BofA", r"BAML", r"Citi(?:group|bank)?",
    r"Wells\s*Fargo", r"Barclays", r"Deutsche\s*Bank", r"Credit\s*Suisse", r"UBS", r"HSBC", r"BNP\s*Paribas", r"Societe\s*Generale", r"RBC",
    r"Royal\s*Bank\s*of\s*Canada", r"TD\s*Securities", r"Mizuho", r"MUFG", r"Mitsubishi\s*UFJ", r"SMBC", r"Sumitomo\s*Mitsui",
)
TABLE_BANKS = rf"(?i)\b(?:{'|'.join(BANK_PATTERNS)})\b"
TABLE_BANK_SUFFIX = r"(?i)(?:LLC|Inc\.?|N\.?A\.?|Bank|Securities|Capital)$"
TABLE_HEADER_WORDS = ("name", "lender", "underwriter", "role", "institution", "amount", "commitment")
