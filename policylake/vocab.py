"""Default vocabularies.

Fixed values: the lists, patterns, weights and thresholds below decide the
results, so they are stated here as they must be. Every operator takes its
vocabulary as an argument; these are only the defaults.
"""

# --- text -----------------------------------------------------------------

STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")

NOISE_PATTERNS = (
    r"©\s*\d{4}.*?(?:All\s+rights\s+reserved|Confidential)",
    r"Page\s+\d+\s+of\s+\d+",
    r"Proprietary\s+and\s+Confidential",
    r"For\s+(?:Internal|Provider)\s+Use\s+Only",
    r"\d{1,2}/\d{1,2}/\d{2,4}",
)

SECTION_HEADER_PATTERNS = (
    r"(?:^|\n)([A-Z][A-Z\s]{15,})(?:\n|$)",
    r"(?:^|\n)((?:SECTION|CHAPTER)\s+\d+[:.]\s*[A-Z][^.]+)(?:\n|$)",
    r"(?:^|\n)(\d+\.\s+[A-Z][^.]+)(?:\n|$)",
)

# --- URL and link scoring ---------------------------------------------------

URL_HIGH_PATTERNS = (
    r"provider[_-]?manual", r"provider[_-]?guide", r"authorization", r"prior[_-]?auth",
    r"timely[_-]?filing", r"appeals?", r"claim[s]?[_-]?guide", r"billing[_-]?guide",
    r"coverage[_-]?guide", r"policy[_-]?manual", r"clinical[_-]?guidelines", r"medical[_-]?policy",
)
URL_LOW_PATTERNS = (
    r"privacy[_-]?policy", r"terms[_-]?of[_-]?use", r"legal[_-]?notice", r"sample", r"test", r"demo",
    r"template", r"marketing", r"advertisement", r"brochure", r"newsletter", r"press[_-]?release",
    r"annual[_-]?report", r"financial[_-]?report",
)

LINK_EXTRA_TERMS = (
    "policy", "policies", "bulletin", "bulletins", "manual", "guide", "guidelines", "criteria",
    "protocol", "coverage", "medical policy", "clinical policy", "provider manual",
)
LINK_EXCLUDED_TERMS = (
    "genetic", "molecular", "lab test", "laboratory", "drug list", "formulary", "immunization",
    "vaccine", "dental", "oral health", "hearing aid", "vision", "prosthetic", "sleep apnea", "cpap",
    "clinical policy bulletin", "medical policy",
)
LINK_BASELINE_TERMS = ("provider manual", "manual", "provider guide", "handbook")
LINK_BASELINE_RULE = "billing_nuances"

# rule -> (keywords worth 2, url patterns worth 1)
LINK_RULES = {
    "timely_filing": (
        ("timely filing", "filing deadline", "filing requirement", "filing limit",
         "claim submission deadline", "submission timeframe", "filing window", "claim filing",
         "timely submission", "deadline requirement"),
        ("timely", "filing", "deadline", "submission"),
    ),
    "prior_authorization": (
        ("prior authorization", "preauthorization", "pre-authorization", "prior auth", "preauth",
         "medical necessity", "coverage determination", "pre-approval", "precertification",
         "authorization required", "prior approval", "authorization request", "coverage approval"),
        ("prior", "auth", "preauth", "approval", "precert", "authorization"),
    ),
    "billing_nuances": (
        ("billing", "reimbursement", "payment", "claim processing", "billing guidelines", "coding",
         "billing procedures", "fee schedule", "billing requirements", "claim submission",
         "billing policies", "payment policies", "reimbursement rates", "billing rules",
         "provider manual", "provider guide"),
        ("billing", "payment", "reimbursement", "claims", "coding", "fees"),
    ),
    "appeals": (
        ("appeal", "appeals", "grievance", "dispute resolution", "claim dispute", "complaint",
         "reconsideration", "external review", "appeal process", "grievance procedure",
         "dispute process", "appeal rights", "complaint resolution", "review process"),
        ("appeal", "grievance", "dispute", "complaint", "review"),
    ),
}
# Keywords the single-company edition adds to each rule.
LINK_RULES_EXTRA = {
    "timely_filing": ("90 days", "180 days", "365 days", "submission deadline"),
    "prior_authorization": ("advance notification",),
    "billing_nuances": ("modifier", "cpt code", "icd code", "procedure code"),
    "appeals": ("first level appeal", "second level appeal"),
}

PAGE_LINK_TERMS = (
    "prior auth", "authorization", "timely filing", "appeals", "provider", "manual", "guideline",
    "policy", "procedure", "claim", "billing", "reimbursement", "coverage",
)
PAGE_DOCUMENT_TERMS = (
    "provider", "manual", "guide", "policy", "procedure", "billing", "prior auth", "authorization",
    "timely filing", "appeals", "coverage", "benefits", "claim", "reimbursement", "network",
    "geographic", "region", "state", "area", "zone",
)
LINK_TYPES = (  # first hit wins; 'document' looks at the href, the others at the text
    ("document", (".pdf", ".doc", ".docx")),
    ("prior_authorization", ("prior auth", "authorization")),
    ("timely_filing", ("timely filing", "deadline")),
    ("appeals", ("appeal", "dispute")),
    ("manual", ("manual", "guide")),
)
DOWNLOAD_EXTENSIONS = (".pdf", ".doc", ".docx", ".xls", ".xlsx")
DIRECT_DOCUMENT_SCORE = 10

HIGH_VALUE_KEYWORDS = (
    "prior authorization", "timely filing", "appeals process", "claim submission",
    "billing guidelines", "coverage determination",
)
MEDIUM_VALUE_KEYWORDS = (
    "provider", "healthcare", "insurance", "medical", "policy", "procedure", "requirement", "deadline",
)

TARGET_SECTIONS = {
    "prior_authorization": ("prior authorization", "preauthorization", "pre-auth",
                            "authorization requirements", "auth criteria"),
    "timely_filing": ("timely filing", "claim submission deadlines", "filing requirements",
                      "submission timelines"),
    "appeals": ("appeals process", "claim appeals", "dispute resolution", "appeal procedures",
                "grievances"),
}
RULE_INDICATORS = {
    "prior_authorization": ("must obtain", "requires authorization", "prior approval",
                            "pre-authorization required", "contact for auth"),
    "timely_filing": ("days from", "within", "deadline", "filing limit", "submit by", "time limit"),
    "appeals": ("appeal within", "dispute process", "grievance procedure", "appeal deadline",
                "contact to appeal"),
}

# --- document quality ---------------------------------------------------------

QUALITY_CATEGORIES = {
    "prior_authorization": ("prior authorization", "preauthorization", "pre-auth",
                            "authorization criteria", "approval requirements", "auth guidelines",
                            "coverage determination"),
    "timely_filing": ("timely filing", "claim submission deadline", "filing requirement",
                      "submission timeline", "deadline", "time limit", "filing window"),
    "appeals": ("appeals process", "claim appeal", "dispute resolution", "appeal procedure",
                "grievance", "complaint", "review process", "reconsideration"),
    "provider_manual": ("provider manual", "provider guide", "provider handbook",
                        "provider reference", "provider policies", "provider procedures",
                        "clinical guidelines"),
    "claims_billing": ("claims", "billing", "reimbursement", "payment", "coding", "claim form",
                       "billing guidelines", "claim submission", "claim processing"),
    "coverage_benefits": ("coverage", "benefits", "covered services", "benefit summary",
                          "plan benefits", "coverage guidelines", "covered procedures"),
    "forms_documents": ("form", "application", "request form", "enrollment", "registration",
                        "member form", "provider form", "claim form"),
}
QUALITY_EXCLUSIONS = (
    "test", "sample", "demo", "template", "example", "lorem ipsum", "placeholder", "draft",
    "temporary", "coming soon", "under construction", "not available", "privacy policy",
    "terms of use", "legal notice", "marketing", "advertisement", "promotional",
)
SIZE_MIN_BYTES = 1024
SIZE_MAX_BYTES = 50 * 1024 * 1024

ESSENTIAL_TERMS = (
    "prior authorization", "preauthorization", "timely filing", "appeals process", "claim submission",
    "provider manual", "coverage determination", "medical necessity", "clinical criteria",
    "billing guidelines", "reimbursement", "CPT", "ICD-10", "member benefits", "covered services",
    "exclusions",
)
CONTENT_EXCLUSIONS = (
    "lorem ipsum", "this is a test", "sample document", "coming soon", "under construction",
    "page intentionally left blank", "for internal use only", "confidential and proprietary",
    "draft - not for distribution",
)
CONTENT_SECTIONS = {
    "prior_authorization": ("prior authorization", "preauthorization", "authorization requirements"),
    "timely_filing": ("timely filing", "claim submission deadline", "filing requirements"),
    "appeals": ("appeals? process", "dispute resolution", "grievance"),
    "claims_billing": ("claim submission", "billing guidelines", "reimbursement"),
}
# With case ignored, a "capitals header" is a letter followed by at least ten non-letters.
SECTION_END = r"\n\s*[A-Z][^a-z]{10,}|\n\s*\d+\."

# --- payers, states, policy types ----------------------------------------------

PAYERS_EXTRACTION = {
    "CountyCare": ("countycare", "county care"),
    "United Healthcare": ("uhc", "united healthcare", "unitedhealthcare"),
    "Cigna": ("cigna",),
    "Anthem": ("anthem", "blue cross blue shield", "bcbs"),
    "Aetna": ("aetna",),
    "Humana": ("humana",),
    "Molina": ("molina",),
    "WellCare": ("wellcare", "well care"),
}
PAYERS_MINING = {
    "ANTHEM": ("anthem", "elevance"),
    "UHC": ("united healthcare", "unitedhealthcare", "uhc"),
    "AETNA": ("aetna", "cvs health"),
    "CIGNA": ("cigna", "evernorth"),
    "HUMANA": ("humana",),
    "BCBS": ("blue cross", "blue shield", "bcbs"),
}
PAYERS_INDEX = {
    "UHC": ("united", "uhc", "unitedhealthcare"),
    "ANTHEM": ("anthem", "elevance"),
    "AETNA": ("aetna", "cvs"),
    "KAISER": ("kaiser",),
    "HUMANA": ("humana",),
    "CIGNA": ("cigna",),
}
MINING_STATES = (
    "alabama", "alaska", "arizona", "california", "florida", "georgia", "illinois", "maine",
    "massachusetts", "new york", "texas", "washington",
)
POLICY_TYPES = {
    "claims": ("claims submission", "claim filing", "billing", "reimbursement"),
    "appeals": ("appeal", "grievance", "dispute", "reconsideration"),
    "prior_authorization": ("prior auth", "preauthorization", "pa required", "prior authorization"),
    "timely_filing": ("timely filing", "filing deadline", "submission deadline"),
    "credentialing": ("credentialing", "provider enrollment"),
}
MANUAL_INDICATORS = ("provider manual", "provider handbook", "provider guide")
MANUAL_TOPICS = {
    "claims": "claims",
    "appeals": "appeal",
    "prior_authorization": "prior auth",
    "timely_filing": "timely filing",
    "credentialing": "credentialing",
}
COVERAGE_TYPES = (("Medicaid", "medicaid"), ("Medicare", "medicare"),
                  ("Commercial", "commercial"), ("Marketplace", "marketplace"))

TOPICS = {
    "prior_authorization": ("prior authorization", "pre-authorization", "preauth"),
    "claims": ("claim", "claims submission", "billing"),
    "eligibility": ("eligibility", "enrollment", "coverage"),
    "medical_records": ("medical record", "documentation", "chart"),
    "deadlines": ("deadline", "timeframe", "within.*days"),
    "coding": ("icd", "cpt", "diagnosis code", "procedure code"),
    "appeals": ("appeal", "grievance", "dispute"),
    "referrals": ("referral", "specialist"),
}

QUESTION_PAYERS = (
    ("UnitedHealthcare Community Plan", ("united",)),
    ("CountyCare Health Plan", ("countycare", "county care")),
    ("Cigna", ("cigna",)),
    ("Florida Blue", ("florida blue",)),
)
QUESTION_SCOPES = (
    ("Arizona", ("arizona",)), ("Florida", ("florida",)),
    ("Louisiana", ("louisiana",)), ("Indiana", ("indiana",)),
)
CONSOLE_FILTERS = (  # first hit wins: term, column, value
    ("united", "payer_name", "United Healthcare"),
    ("county", "payer_name", "CountyCare Health Plan"),
    ("appeal", "rule_type", "appeals"),
    ("claim", "rule_type", "claims"),
    ("prior", "rule_type", "prior_authorization"),
    ("timely", "rule_type", "timely_filing"),
)

# --- identity, dates ------------------------------------------------------------

POLICY_ID_PATTERNS = (
    r"Policy\s*(?:Number|#|ID|Code)[\s:]*([A-Z0-9\-]+)",
    r"(?:PA|AUTH|CLM|APL)[\s\-]?(\d{3,})",
    r"(?:CPT|HCPCS)\s*Code[\s:]*(\d{4,5})",
    r"Procedure\s*Code[\s:]*([A-Z0-9]+)",
    r"Reference\s*Number[\s:]*([A-Z0-9\-]+)",
    r"Document\s*ID[\s:]*([A-Z0-9\-]+)",
)
POLICY_DATE_PATTERNS = (
    ("effective", r"Effective\s*Date[\s:]*(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"),
    ("effective", r"Effective[\s:]*(\w+\s+\d{1,2},?\s+\d{4})"),
    ("effective", r"Valid\s*(?:From|Through)[\s:]*(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"),
    ("end", r"Exp(?:iration|ires?)[\s:]*(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"),
    ("end", r"End\s*Date[\s:]*(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"),
    ("document", r"Revised[\s:]*(\w+\s+\d{1,2},?\s+\d{4})"),
    ("document", r"Updated[\s:]*(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"),
    ("supersedes", r"Supersedes.*?(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"),
)
DATE_FORMATS = (
    "M/d/yyyy", "M-d-yyyy", "M/d/yy", "M-d-yy", "yyyy-M-d", "yyyy/M/d",
    "MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMM d yyyy",
)
TWO_DIGIT_YEAR_PIVOT = 69
SUPERSEDES_PATTERNS = (
    r"[Ss]upersedes\s*(?:Policy\s*)?([A-Z0-9\-,\s]+)",
    r"[Rr]eplaces\s*(?:Policy\s*)?([A-Z0-9\-,\s]+)",
    r"[Oo]bsoletes\s*(?:Policy\s*)?([A-Z0-9\-,\s]+)",
)
HYBRID_DATE_PATTERNS = (
    ("effective", r"effective[:\s]+(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"),
    ("effective", r"effective[:\s]+(\w+\s+\d{1,2},?\s+\d{4})"),
    ("expiration", r"expir(?:es|ation)[:\s]+(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"),
    ("expiration", r"expir(?:es|ation)[:\s]+(\w+\s+\d{1,2},?\s+\d{4})"),
)
STRICT_DATE_PATTERNS = {
    "effective": (r"effective\s+date[:\s]+(\d{1,2}[/-]\d{1,2}[/-]\d{4})",
                  r"effective[:\s]+(\w+\s+\d{1,2},?\s+\d{4})"),
    "expiration": (r"expir(?:ation|es)\s+date[:\s]+(\d{1,2}[/-]\d{1,2}[/-]\d{4})",
                   r"valid\s+through[:\s]+(\d{1,2}[/-]\d{1,2}[/-]\d{4})"),
}
MINING_DATE_PATTERN = r"effective\s+(?:date:?\s*)?(\w+\s+\d{1,2},?\s+\d{4})"
FILING_PATTERNS = (  # pattern, whether a bare month count is turned into days
    (r"(\d+)\s*(?:calendar\s+)?days?.*timely filing", False),
    (r"timely filing.*?(\d+)\s*(?:calendar\s+)?days?", False),
    (r"submit.*?within\s+(\d+)\s*days?", False),
    (r"(\d+)\s*months?", True),
)
CONFIDENCE_EXPLICIT = 0.95
CONFIDENCE_HASH = 0.70
CONFIDENCE_UNDATED_FACTOR = 0.8
UNDATED_VALID_DAYS = 730
LOW_CONFIDENCE = 0.7

# --- rules ------------------------------------------------------------------------

WINDOW_RULES = (  # type, pattern; context is 200 characters on both sides
    ("prior_authorization", r"prior authorization.{0,100}required"),
    ("prior_authorization", r"PA.{0,50}required"),
    ("prior_authorization", r"pre-authorization.{0,100}necessary"),
    ("timely_filing", r"timely filing.{0,100}\d+\s*days"),
    ("timely_filing", r"claim.{0,50}submit.{0,50}within.{0,50}\d+\s*days"),
    ("timely_filing", r"filing deadline.{0,100}\d+\s*days"),
    ("appeals", r"appeal.{0,100}\d+\s*days"),
    ("appeals", r"reconsideration.{0,100}\d+\s*days"),
    ("appeals", r"dispute.{0,100}within.{0,50}\d+\s*days"),
    ("claims", r"claim submission.{0,100}"),
    ("claims", r"billing requirements.{0,100}"),
    ("claims", r"reimbursement.{0,100}"),
)
# Words no match of the same-numbered pattern can do without.
WINDOW_NEEDS = (
    ("prior authorization", "required"), ("pa", "required"), ("pre-authorization", "necessary"),
    ("timely filing", "days"), ("claim", "submit", "within", "days"), ("filing deadline", "days"),
    ("appeal", "days"), ("reconsideration", "days"), ("dispute", "within", "days"),
    ("claim submission",), ("billing requirements",), ("reimbursement",),
)
WINDOW_CONTEXT = 200
FIRST_MATCH_RULES = (
    ("prior_auth", r"prior\s+auth|pre[-\s]?auth|PA\s+required"),
    ("timely_filing", r"timely\s+filing|filing\s+limit|submission\s+deadline"),
    ("appeal", r"appeal|reconsideration|dispute|grievance"),
    ("claim", r"claim\s+submission|billing|reimbursement"),
    ("coverage", r"coverage|medical\s+necessity"),
    ("network", r"in[-\s]?network|out[-\s]?of[-\s]?network"),
)
FIRST_MATCH_CONFIDENCE = 0.8
SENTENCE_RULES = (
    ("prior_authorization", r"(?:prior authorization|pre-?authorization|preauth)(?:\s+(?:is\s+)?required\s+for|:)\s*([^.]+?)(?:\.|$)"),
    ("prior_authorization", r"requires?\s+(?:prior\s+)?authorization:?\s*([^.]+?)(?:\.|$)"),
    ("prior_authorization", r"must\s+(?:be\s+)?(?:pre-?authorized|obtain\s+authorization)(?:\s+for)?\s*([^.]+?)(?:\.|$)"),
    ("prior_authorization", r"authorization\s+required\s+for:?\s*([^.]+?)(?:\.|$)"),
    ("timely_filing", r"(?:submit|file)\s+(?:claims?|bills?)\s+within\s+(\d+)\s+(days?|months?|years?)"),
    ("timely_filing", r"(?:timely\s+)?filing\s+(?:deadline|limit|requirement):?\s*(\d+)\s+(days?|months?)"),
    ("timely_filing", r"claims?\s+must\s+be\s+(?:submitted|filed)\s+within\s+(\d+)\s+(days?|months?)"),
    ("timely_filing", r"(\d+)[- ]day\s+filing\s+(?:deadline|limit|requirement)"),
    ("appeals", r"(?:appeal|dispute|reconsideration)(?:\s+must\s+be\s+(?:filed|submitted))?\s+within\s+(\d+)\s+(days?|months?)"),
    ("appeals", r"(?:appeal|dispute)\s+(?:process|procedure|deadline):?\s*([^.]+?)(?:\.|$)"),
    ("appeals", r"to\s+(?:appeal|dispute)\s+(?:a\s+)?(?:claim|decision)[,:]?\s*([^.]+?)(?:\.|$)"),
    ("claims_submission", r"claims?\s+(?:should|must)\s+be\s+submitted\s+(?:via|through|using)\s+([^.]+?)(?:\.|$)"),
    ("claims_submission", r"(?:submit|file)\s+claims?\s+(?:electronically|online)\s+(?:via|through|at)\s+([^.]+?)(?:\.|$)"),
    ("claims_submission", r"(?:electronic\s+)?claim\s+submission:?\s*([^.]+?)(?:\.|$)"),
    ("eligibility", r"(?:eligibility|coverage)\s+(?:verification|check)(?:\s+(?:is\s+)?required|:)\s*([^.]+?)(?:\.|$)"),
    ("eligibility", r"verify\s+(?:patient\s+)?eligibility\s+(?:before|prior\s+to)\s+([^.]+?)(?:\.|$)"),
    ("eligibility", r"(?:eligibility|coverage)\s+(?:must\s+be\s+)?(?:verified|confirmed)\s*([^.]+?)(?:\.|$)"),
    ("referrals", r"referral(?:s)?\s+(?:are\s+)?(?:required|needed)\s+for\s+([^.]+?)(?:\.|$)"),
    ("referrals", r"requires?\s+(?:a\s+)?referral:?\s*([^.]+?)(?:\.|$)"),
    ("referrals", r"(?:specialist|specialty)\s+services\s+require\s+(?:a\s+)?referral"),
    ("documentation", r"(?:documentation|records?|notes?)\s+(?:required|needed|must\s+include):?\s*([^.]+?)(?:\.|$)"),
    ("documentation", r"(?:medical\s+)?(?:records?|documentation)\s+must\s+(?:include|contain)\s+([^.]+?)(?:\.|$)"),
    ("documentation", r"submit\s+(?:the\s+)?following\s+documentation:?\s*([^.]+?)(?:\.|$)"),
    ("coding", r"(?:ICD-10|CPT|HCPCS)\s+code(?:s)?\s+([^.]+?)(?:\.|$)"),
    ("coding", r"(?:diagnosis|procedure)\s+code(?:s)?\s+(?:required|must\s+be)\s+([^.]+?)(?:\.|$)"),
    ("coding", r"coding\s+(?:requirements?|guidelines?):?\s*([^.]+?)(?:\.|$)"),
)
# Words no match of the same-numbered pattern can do without.
# As WINDOW_NEEDS; of the words in a tuple a match needs one.
SENTENCE_NEEDS = (
    (("prior authorization", "pre-auth", "preauth"),), ("require", "authorization"), ("must", ("pre-auth", "preauth", "authorization")),
    ("authorization", "required", "for"),
    ("within", ("submit", "file"), ("claim", "bill")), ("filing", ("deadline", "limit", "requirement")),
    ("claim", "must", "within"), ("day", "filing", ("deadline", "limit", "requirement")),
    ("within", ("appeal", "dispute", "reconsideration")), (("appeal", "dispute"), ("process", "procedure", "deadline")),
    ("to", ("appeal", "dispute"), ("claim", "decision")), ("claim", "submitted", ("via", "through", "using")),
    ("claim", ("electronically", "online")),
    ("claim", "submission"), (("eligibility", "coverage"), ("verification", "check")), ("verify", "eligibility"),
    (("eligibility", "coverage"), ("verified", "confirmed")),
    ("referral", "for", ("required", "needed")), ("require", "referral"), ("services", "referral"),
    (("documentation", "record", "note"), ("required", "needed", "must")),
    ("must", ("record", "documentation"), ("include", "contain")), ("submit", "following", "documentation"), ("code",), ("code",), ("coding",),
)
MEANINGFUL_WORDS = ("required", "must", "need", "submit", "within", "authorization", "claim", "file", "verify")
MODAL_WORDS = ("must", "required", "shall", "will")

# --- manual sections ----------------------------------------------------------------

MANUAL_SECTIONS = {  # section -> (header keywords, content keywords)
    "claims": (
        ("claims", "claim submission", "claim filing", "billing", "reimbursement", "submitting claims"),
        ("submit a claim", "file a claim", "claim form", "billing procedure", "submit claims"),
    ),
    "appeals": (
        ("appeals", "grievances", "disputes", "complaints", "reconsideration", "appeal process"),
        ("file an appeal", "appeal process", "adverse determination", "dispute resolution",
         "grievance procedure"),
    ),
    "prior_authorization": (
        ("prior authorization", "preauthorization", "pre-authorization", "authorization",
         "authorization requirements", "precertification", "services requiring authorization",
         "obtaining authorization", "authorization process"),
        ("requires authorization", "must be authorized", "authorization required",
         "authorization form", "authorization request", "pre-cert", "obtain authorization",
         "authorization timeframe", "submit authorization", "authorization approval",
         "notify within", "notification requirement"),
    ),
    "timely_filing": (
        ("timely filing", "filing deadline", "filing timeframe", "submission deadline",
         "filing requirements", "filing limits"),
        ("filing deadline", "days from date of service", "submission timeframe", "time limit",
         "filing period"),
    ),
    "credentialing": (
        ("credentialing", "provider enrollment", "contracting", "provider application",
         "network participation"),
        ("provider application", "enrollment process", "credentialing application",
         "network participation"),
    ),
}
WINDOW_LINES = 200
WINDOW_MIN_CHARS = 500
SECTION_TEXT_BUDGET = 15000
SECTION_FIELDS = {
    "claims": ("requirements", "forms", "notes"),
    "timely_filing": ("deadlines", "requirements", "notes"),
    "prior_authorization": ("requirements", "procedures", "deadlines", "forms", "notes"),
    "appeals": ("requirements", "deadlines", "forms", "notes"),
    "credentialing": ("requirements", "deadlines", "forms", "notes"),
}
POLICY_JSON_KEYS = (
    "policy_id", "policy_type", "effective_date", "end_date", "supersedes", "summary", "payer_name",
    "source_pdf",
)

# --- regions -----------------------------------------------------------------------

STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California",
    "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas",
    "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts",
    "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana",
    "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey",
    "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota",
    "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island",
    "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah",
    "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia",
    "WI": "Wisconsin", "WY": "Wyoming", "DC": "District of Columbia", "PR": "Puerto Rico",
    "VI": "Virgin Islands", "GU": "Guam",
}
TERRITORIES = ("DC", "PR", "VI", "GU")
STATE_COUNT = 50
ALL_STATES = "All US States"
PAYER_COVERAGE = {  # payer -> expected regions
    "United Healthcare": (ALL_STATES,),
    "Anthem/Elevance Health": ("CA", "CO", "CT", "GA", "IN", "KY", "ME", "MO", "NV", "NH", "NY",
                               "OH", "VA", "WI"),
    "Aetna": (ALL_STATES,),
    "Kaiser Permanente": ("CA", "CO", "GA", "HI", "MD", "OR", "VA", "WA", "DC"),
    "Centene Corporation": ("AZ", "AR", "CA", "FL", "GA", "IL", "IN", "IA", "KS", "KY", "LA", "MI",
                            "MS", "MO", "NV", "NH", "NM", "NY", "NC", "OH", "OK", "PA", "SC", "TN",
                            "TX", "WA", "WI"),
}
REGION_URL_PATTERNS = (
    r"/([A-Z]{2})[_-]", r"([A-Z]{2})[_-]CAID", r"/([a-z]{2})/", r"([A-Z]{2})\.pdf",
    r"state[_-]([a-z]{2})", r"region[_-]([a-z]+)",
)
REGION_TEXT_PATTERNS = (  # pattern, and a word it cannot match without
    (r"(\w+)\s+state\s+specific", "specific"), (r"applicable\s+in\s+(\w+)", "applicable"),
    (r"(\w+)\s+medicaid", "medicaid"), (r"(\w+)\s+department\s+of\s+health", "department"),
    (r"(\w+)\s+insurance\s+commission", "commission"), (r"state\s+of\s+(\w+)", "state"),
)
COVERAGE_GRADES = ((0.8, "Excellent"), (0.6, "Good"), (0.4, "Fair"))
LAST_GRADE = "Poor"

# --- chunks and answers -------------------------------------------------------------

FIXED_CHUNK = (6000, 500)
SENTENCE_CHUNK = (1000, 200)
SENTENCE_BREAK_SHARE = 0.7
CHUNK_HEADER = r"\n([A-Z][A-Z\s]{10,})\n"
NO_ANSWER = "No relevant rules found for your query."
NO_CONTEXT = "No relevant rules were retrieved from the knowledge base."
ANSWER_SNIPPET = 320
UNSURE_MARKS = ("not sure", "insufficient")
SKIPPED_DIRS = ("venv", "env", "__pycache__", "node_modules")

#: Sketches of distinct values have 2 to this power of cells: a standard error of 0.8 % from 16 KB.
SKETCH_LG_K = 14
