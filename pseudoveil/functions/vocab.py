"""Fixed values.

Everything in this module must equal the behaviour being matched for the
results to be the same: regular expressions, word lists, labels, thresholds.
They are stated plainly and in their natural order.  Patterns are written in
Java regex syntax (Spark runs them in the JVM); ``(?U)`` makes ``\\d \\w \\s \\b``
Unicode-aware, as Python ``str`` patterns are, and ``(?iU)`` adds Unicode
case-insensitivity.  Python's ``\\s`` also matches U+001C..U+001F, Java's does
not, so ``WS`` spells that out where whitespace matters.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: types, ranks, detector order
# ---------------------------------------------------------------------------

# Summary categories in report order.
CATEGORIES = [
    "PERSON",
    "ORGANIZATION",
    "EMAIL",
    "PHONE",
    "ADDRESS",
    "SSN",
    "CREDIT_CARD",
    "DATE",
    "IP_ADDRESS",
]

# Confidence ranks used by overlap resolution; anything else ranks 99.
CONFIDENCE_RANK = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}
UNKNOWN_CONFIDENCE_RANK = 99

# Emission order of the detectors: the tie-break of a stable sort.
SEQ_EMAIL = 0
SEQ_PHONE = 1
SEQ_SSN = 2
SEQ_IP = 3
SEQ_CARD = 4
SEQ_DATE = 5
SEQ_ADDRESS = 6
SEQ_NER = 7
SEQ_CONTEXT = 8

# Audit sample size and the NER context half-width (characters).
SAMPLE_SIZE = 30
CONTEXT_CHARS = 100

# NER acceptance thresholds.
ACCEPT_SCORE = 4
HIGH_SCORE = 7
SHAPE_REJECT_SCORE = -10
SHAPE_REJECT_REASON = "failed name-shape validation"
CONTEXT_PERSON_SCORE = 7

# Value used for a type without a surrogate format.
REDACTED = "[REDACTED]"

# ---------------------------------------------------------------------------
# FIXED VALUES: patterns (Java syntax)
# ---------------------------------------------------------------------------

WS = r"[\s\x1c-\x1f]"          # Python str whitespace
WS_CLASS = r"\s\x1c-\x1f"      # same, for use inside [...]

# Word boundary over letters, numbers and underscore: Java's \b also counts combining marks as word characters.
WORD_CHAR = r"[\p{L}\p{N}_]"
WB = rf"(?:(?<!{WORD_CHAR})(?={WORD_CHAR})|(?<={WORD_CHAR})(?!{WORD_CHAR}))"

EMAIL_PATTERN = rf"(?U){WB}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{WB}"

PHONE_PATTERN = (
    r"(?U)(?<!\d)(?:\+91[" + WS_CLASS + r"-]?|0091[" + WS_CLASS + r"-]?|0?)"
    r"[6-9]\d{4}[" + WS_CLASS + r"-]?\d{5}(?!\d)"
)

SSN_PATTERN = r"(?U)(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"

IP_PATTERN = r"(?U)(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"

# A dotted quad that a strict IPv4 parser accepts: ASCII, 0-255, no leading zeros.
IPV4_STRICT = (
    r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}"
    r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
)

CARD_PATTERN = r"(?U)(?<!\d)(?:\d[ -]?){13,19}(?!\d)"
CARD_MIN_DIGITS = 13
CARD_MAX_DIGITS = 19

MONTHS = (
    "January|February|March|April|May|June|July|August|"
    "September|October|November|December"
)

# Group 1 is the label prefix, group 2 the date of birth.
DOB_PATTERN = (
    r"(?iU)((?:date" + WS + r"+of" + WS + r"+birth|" + WB + "DOB" + WB + r"|birth" + WS + r"+date|born"
    + WS + r"+on|date" + WS + r"+of" + WS + r"+birth" + WS + r"+of)" + WS + r"*[:\-]?" + WS + r"*)"
    r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
    r"|\d{1,2}" + WS + r"+(?:" + MONTHS + r")" + WS + r"+\d{4}"
    r"|(?:" + MONTHS + r")" + WS + r"+\d{1,2},?" + WS + r"+\d{4})"
)

# A look at the next character comes before every word boundary: most places fail there.
ADDRESS_STRUCTURED_PATTERN = (
    r"(?iU)(?=\d)" + WB + r"\d+(?:/\d+)?(?:" + WS + r"*," + WS + r"*\d+(?:/\d+)?)*"
    r"[^.\n;]{0,220}?(?=\d)" + WB + r"\d{6}" + WB + r"(?:[^.\n;]{0,80})?"
)
# What any such address holds: six digits that stand alone.
ADDRESS_GATE = rf"(?U)\d{{6}}(?:(?!{WORD_CHAR})|{WB})(?<!{WORD_CHAR}\d{{6}})"
# The number list above recurses in the Java matcher: texts with a longer list take address_spans' linear scan.
LONG_LIST = r"(?U)(?:[\d/]++" + WS + r"*+," + WS + r"*+){200,}+"

# Words that cut an address value (the text after them is contact data).
ADDRESS_STOP_PATTERN = rf"(?iUs){WB}(?:telephone|tel|phone|mobile|mob){WB}.*"

# Labelled address: defined by the original tool but never called; off by default.
# Group 1 is the label prefix, group 2 the address.
ADDRESS_LABELLED_PATTERN = (
    r"(?iU)((?:registered" + WS + r"+office|corporate" + WS + r"+office|registered" + WS
    + r"+address|office" + WS + r"+address|residential" + WS + r"+address|permanent" + WS
    + r"+address|correspondence" + WS + r"+address|mailing" + WS + r"+address|communication"
    + WS + r"+address|address)" + WS + r"*(?:of|is)?" + WS + r"*[:,\-]?" + WS + r"*)"
    r"((?=(?:[^.\n;]{0,250})" + WB + r"(?:village|taluka|district|road|marg|lane|nagar|colony|"
    r"apartment|tower|building|floor|sector|pune|mumbai|maharashtra|india|pincode|pin))"
    r"[^.\n;]{5,250}?(?:" + WB + r"\d{6}" + WB + "|" + WB + "(?:Maharashtra|India)" + WB + "))"
)

# Person labels (lower case only; ``label_ignore_case`` adds the flag).
PERSON_LABELS = [
    r"contact\s+person",
    r"name\s+of\s+promoter",
    r"name\s+of\s+shareholder",
    r"name\s+of\s+director",
    r"promoter\s+selling\s+shareholder",
    r"selling\s+shareholder",
    r"managing\s+director",
    r"executive\s+director",
    r"independent\s+director",
    r"chief\s+executive\s+officer",
    r"chief\s+financial\s+officer",
    r"company\s+secretary",
]
PERSON_NAME_WORD = r"[A-Z][A-Za-z.'’-]+"

# ---------------------------------------------------------------------------
# FIXED VALUES: vocabularies
# ---------------------------------------------------------------------------

ADDRESS_WORDS = [
    "road", "rd", "street", "st", "lane", "ln", "marg", "nagar", "colony",
    "apartment", "apt", "building", "bldg", "floor", "plot", "survey", "sector",
    "taluka", "district", "village", "estate", "complex", "park", "phase",
    "block", "tower", "flat", "house", "pincode", "pin",
]

# Words that block a label-context name.
CONTEXT_BLOCKED_WORDS = [
    "company", "website", "office", "department", "government", "authority",
    "bank", "exchange", "limited", "private", "corporation", "shareholder",
    "promoter", "promoters", "director", "directors", "trust", "fund",
    "foundation", "agency", "account", "amount", "price", "offer", "bid",
    "bidder", "bidders", "tax", "cagr", "margin", "registration", "number",
    "information", "compliance", "officer",
]
CONTEXT_MAX_CHARS = 70

PERSON_BLOCKLIST = [
    "offer", "promoter", "promoters", "promoter group",
    "promoter selling shareholder", "promoter selling shareholders",
    "directors", "director", "reference rate", "registrar",
    "registrar and share transfer agent", "bid", "bids", "bidder", "bidders",
    "bid amount", "bidder's dp id", "email", "website", "address", "telephone",
    "phone", "floor", "floor price", "cap price", "offer price", "risk", "risks",
    "risk factors", "mutual funds", "shareholder", "shareholders", "company",
    "board", "equity", "equity shares", "financial information",
    "financial data", "financial", "operations", "password", "inventory",
    "trade", "fraud", "notice", "allotment", "underwriters",
    "key managerial personnel", "key managerial",
]

PERSON_NON_NAME_WORDS = [
    "website", "company", "limited", "private", "corporation", "llp", "ltd",
    "trust", "group", "department", "ministry", "government", "authority",
    "bank", "exchange", "fund", "foundation", "agency", "office",
    "address", "taluka", "village", "district", "road", "marg", "lane",
    "street", "nagar", "industrial", "facility", "park", "complex", "east",
    "west", "north", "south", "mumbai", "pune", "delhi", "maharashtra", "india",
    "account", "amount", "price", "offer", "bid", "bidder", "bidders",
    "shareholder", "shareholders", "promoter", "promoters", "director",
    "directors", "shares", "share", "equity", "email", "telephone", "mobile",
    "phone", "contact", "transfer", "agents", "agent", "identification", "dp",
    "id", "sebi", "registration", "number",
    "cagr", "margin", "tax", "dated", "general", "foreign", "trade", "future",
    "always", "continue", "continued", "act", "acted", "relation",
    "interested", "listed", "listing", "absolute", "responsibility",
    "information", "compliance", "officer",
    "showroom", "chambers",
]

# Extra words the name-shape gate adds to PERSON_NON_NAME_WORDS.
PERSON_GATE_EXTRA_WORDS = [
    "taluka", "village", "district", "road", "marg", "lane", "street", "nagar",
    "industrial", "facility", "park", "complex", "east", "west", "north",
    "south", "mumbai", "pune", "delhi", "maharashtra", "india", "khed",
    "electricals", "apartment", "colony", "house", "hospital", "showroom",
    "chambers", "branch", "gymkhana", "monte", "bo",
    "huf", "llp", "ltd", "limited", "inc", "llc",
    "acknowledgement", "acknowledgment", "schedule", "annexure", "chapter",
    "section", "clause", "paragraph", "page", "pages", "email", "telephone",
    "mobile", "phone", "website", "identification", "registration", "number",
    "bidder", "bidders", "bid", "offer", "shares", "share", "equity",
    "promoter", "promoters", "director", "directors", "shareholder",
    "shareholders", "defaulter", "wilful", "default", "transfer", "agents",
    "agent",
    "kilometers", "kilometres", "volt", "volts", "amperes", "mega",
    "conditioning", "photovoltaic", "photo", "voltaic", "circuit",
    "widely", "circulated", "marathi", "daily", "newspaper",
    "parents", "information", "responsibility", "compliance", "officer",
    "general", "foreign", "trade", "future", "always", "continue",
    "continued", "relation", "interested", "listed", "listing",
    "gram", "urja", "suraksha",
]

# Whole words that mark a location compound.
LOCATION_COMPOUND_WORDS = [
    "taluka", "district", "khed", "marg", "road", "lane", "gymkhana", "monte",
]

# Characters stripped from the ends of each word by the name-shape gate.
WORD_STRIP_CHARS = ".,'’-"
# Trailing symbols removed before the name-shape gate.
TRAILING_SYMBOLS = "*^&§†‡"

# Person context terms (whole words, case-insensitive), as regex fragments.
PERSON_CONTEXT_TERMS = [
    "name", "contact person", "contact", "director", "promoter", "chairman",
    "managing director", "chief executive officer", "chief financial officer",
    "company secretary", r"mr\.?", r"mrs\.?", r"ms\.?", r"dr\.?",
]

NON_PERSON_CONTEXT_TERMS = [
    "taluka", "village", "road", "lane", "marg", "park", "facility",
    "private limited", "limited", "corporation", "complex", "account", "bid",
    "bidder", "offer", "shareholder", "shares", "price", "amount", "cagr",
    "margin", "air conditioning", "tax",
]

SENTENCE_WORDS = [
    "hence", "therefore", "however", "whereas", "thereafter", "future",
    "always", "continue", "continued", "relation", "interested", "information",
    "responsibility",
]

ORG_STRONG_SUFFIXES = [
    "limited", "private limited", "pvt ltd", "ltd", "llp", "llc",
    "corporation", "corp.", "inc.", "inc", "n.a.",
]

ORG_SPECIAL_INDICATORS = [
    "bank of india", "bank of", "metal exchange", "reserve bank",
    "payments corporation", "depository limited", "family trust", "foundation",
]

ORG_BLOCKLIST = [
    "bank", "bankers", "corporate office", "registered office",
    "monitoring agency", "monitoring agency agreement", "sponsor banker",
    "sponsor banks", "refund bank", "escrow collection bank",
    "public offer account bank", "offer escrow collection bank",
    "bank balances", "bank balances and advances", "transit insurance",
    "marine insurance", "securities transaction tax",
    "foreign exchange management", "gross national disposable income",
    "capital structure", "financial information", "financial data",
    "market data", "key financial", "memorandum of association",
    "articles of association", "board", "company", "offer",
]

ORG_DOCUMENT_TERMS = [
    "for the offer", "for the issue", "for bidders", "bid amount", "bidder",
    "bidders", "account number", "dp id", "password", "financial year",
    "tax deducted", "pat margin", "pat cagr",
]

ORG_GENERIC_NAMES = [
    "bank limited", "bank ltd", "company limited", "private limited",
    "electricals private limited", "advisory private limited",
]

ORG_TRUNCATED_ENDINGS = [" of", " and", " the", " for", " in", " to"]
ORG_MIN_CHARS = 4
ORG_MAX_CHARS = 120

PERSON_MIN_CHARS = 5
PERSON_MAX_CHARS = 60
PERSON_MIN_WORDS = 2
PERSON_MAX_WORDS = 5
ALPHA_RATIO = 0.75

# Letters kept by the shape score's capitalisation test.
SHAPE_LETTERS = "[^A-Za-zÀ-ÖØ-öø-ÿ]"
