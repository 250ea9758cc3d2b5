"""Fixed values.

Everything in this module is a constant that has to be exactly this for the
results to be right: type names, thresholds, regular expressions and the field
catalogue. Nothing here computes anything.
"""

# --- document types, in the order used for candidate lists ------------------
DOCUMENT_TYPES = [
    "ACORD_APPLICATION", "ACORD_GL", "ACORD_PROPERTY", "ACORD_AUTO",
    "ACORD_WORKERS_COMP", "ACORD_UMBRELLA", "LOSS_RUN", "FINANCIAL_STATEMENT",
    "BROKER_EMAIL", "UNDERWRITING_GUIDELINE", "CLAIMS_DOCUMENT",
    "EVIDENCE_PHOTO", "IDENTITY_DOCUMENT", "OTHER",
]

# --- upload admission -------------------------------------------------------
ALLOWED_EXTENSIONS = ["pdf", "docx", "xlsx", "csv", "jpg", "jpeg", "png"]
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
MAX_DOCUMENTS_PER_SUBMISSION = 20

DOCX_MIME = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
XLSX_MIME = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
EXTENSION_MIME = {
    "pdf": "application/pdf", "docx": DOCX_MIME, "xlsx": XLSX_MIME,
    "xls": "application/vnd.ms-excel", "csv": "text/csv",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png",
}
ALLOWED_MIMES = [
    "application/pdf", DOCX_MIME, XLSX_MIME, "application/vnd.ms-excel",
    "text/csv", "text/plain", "image/jpeg", "image/jpg", "image/png",
]
# File signatures (hex prefixes of the content) -> MIME type.
MAGIC_MIME = [
    ("25504446", "application/pdf"),            # %PDF
    ("89504E470D0A1A0A", "image/png"),
    ("FFD8FF", "image/jpeg"),
    ("D0CF11E0A1B11AE1", "application/vnd.ms-excel"),   # OLE container
]
ZIP_SIGNATURE = "504B0304"                      # docx and xlsx are zip files

# Parser families in routing order: exact MIMEs, MIME fragments, extensions.
PARSER_FAMILIES = [
    ("pdf", ["application/pdf"], [], ["pdf"]),
    ("docx", [], ["wordprocessingml"], ["docx", "doc"]),
    ("xlsx", [], ["spreadsheetml", "ms-excel"], ["xlsx", "xls", "xlsm"]),
    ("csv", ["text/csv", "text/plain", "application/csv"], [], ["csv"]),
    ("image", ["image/jpeg", "image/jpg", "image/png"], [], ["jpg", "jpeg", "png"]),
]

CSV_DELIMITERS = [",", "\t", "|", ";"]
CSV_SNIFF_CHARS = 4096
CSV_MAX_ROWS = 10_000
CSV_ENCODINGS = ["utf-8-sig", "utf-8", "latin-1", "cp1252"]
PREVIEW_ROWS = 100
SCANNED_CHARS_PER_PAGE = 50
OCR_LOW_CONFIDENCE = 60.0
OCR_MARKER = "\n\n[OCR TEXT]\n"

# --- classification rules ---------------------------------------------------
# One row per type, in rule order: (type, required, bonus, negative, extensions).
# Patterns are matched against lower-cased text.
CLASSIFICATION_RULES = [
    ("ACORD_APPLICATION",
     [r"acord\s*125"],
     [r"commercial\s+lines", r"applicant\s+information", r"nature\s+of\s+business",
      r"years?\s+in\s+business", r"prior\s+carrier", r"acord\s+125"],
     [r"acord\s*12[6-9]", r"acord\s*13\d"],
     ["pdf", "docx"]),
    ("ACORD_GL",
     [r"acord\s*126"],
     [r"general\s+liability", r"occurrence\s+limit", r"premises\s+and\s+operations",
      r"products.completed\s+operations", r"personal\s+and\s+advertising\s+injury",
      r"gl\s+coverage", r"each\s+occurrence"],
     [r"acord\s*12[57]", r"acord\s*14\d"],
     ["pdf", "docx"]),
    ("ACORD_PROPERTY",
     [r"acord\s*140"],
     [r"property\s+section", r"building\s+value", r"business\s+personal\s+property",
      r"replacement\s+cost", r"coinsurance", r"blanket\s+(limit|coverage)",
      r"scheduled\s+locations"],
     [r"acord\s*12[567]", r"acord\s*13\d"],
     ["pdf", "docx"]),
    ("ACORD_AUTO",
     [r"acord\s*127"],
     [r"business\s+auto", r"vehicle\s+schedule", r"vin\b", r"hired\s+(and\s+)?non.owned",
      r"radius\s+of\s+operation", r"fleet", r"auto\s+liability"],
     [r"acord\s*12[568]", r"personal\s+auto\s+policy"],
     ["pdf", "docx"]),
    ("ACORD_WORKERS_COMP",
     [r"acord\s*130"],
     [r"workers.?\s*comp", r"employer.s\s+liability", r"payroll", r"class\s+code",
      r"experience\s+mod", r"ncci", r"estimated\s+annual\s+remuneration"],
     [r"acord\s*12[5-9]", r"acord\s*14\d"],
     ["pdf", "docx"]),
    ("ACORD_UMBRELLA",
     [r"acord\s*131"],
     [r"umbrella", r"excess\s+(liability|coverage)",
      r"underlying\s+(insurance|policy|coverage)", r"self.insured\s+retention",
      r"sir\b", r"drop.down\s+coverage"],
     [r"acord\s*12[5-9]", r"acord\s*14\d"],
     ["pdf", "docx"]),
    ("LOSS_RUN",
     [r"(loss\s+run|loss\s+history|claims?\s+history)"],
     [r"date\s+of\s+(loss|claim)", r"(paid|incurred|reserve)\s+loss",
      r"(open|closed|pending)\s+claim", r"claim\s+number", r"claimant", r"adjuster",
      r"total\s+(incurred|paid)", r"policy\s+year", r"loss\s+ratio"],
     [r"acord\s*1[23]\d"],
     ["pdf", "docx", "xlsx", "xls", "csv"]),
    ("FINANCIAL_STATEMENT",
     [r"(balance\s+sheet|income\s+statement|profit\s+(and|&)\s+loss|financial\s+statement)"],
     [r"total\s+(assets|liabilities|revenue|equity)",
      r"(net\s+income|gross\s+profit|operating\s+income)",
      r"accounts\s+(payable|receivable)", r"(fiscal|financial)\s+year",
      r"audited|unaudited", r"(cash|accrual)\s+basis", r"retained\s+earnings"],
     [r"acord\s*1[23]\d", r"loss\s+run"],
     ["pdf", "xlsx", "xls", "docx", "csv"]),
    ("BROKER_EMAIL",
     [r"(from:|to:|subject:|sent:|dear\s+\w)"],
     [r"(please\s+find|attached|kindly|submission|quote|renewal|bind)",
      r"(broker|agent|producer|account\s+executive)",
      r"@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", r"(regards|sincerely|best)"],
     [r"acord\s*1[23]\d", r"balance\s+sheet", r"loss\s+run"],
     ["docx", "pdf", "txt"]),
    ("UNDERWRITING_GUIDELINE",
     [r"(underwriting\s+guideline|underwriting\s+manual|eligibility\s+criteria)"],
     [r"(appetite|prohibited\s+(class|risk)|eligible|ineligible)",
      r"(minimum\s+premium|rate|tier)", r"(endorsement|exclusion|condition)",
      r"effective\s+date", r"(approved\s+by|revision\s+date)"],
     [r"acord\s*1[23]\d", r"loss\s+run"],
     ["pdf", "docx"]),
    ("CLAIMS_DOCUMENT",
     [r"(claim\s+form|proof\s+of\s+loss|notice\s+of\s+claim|sworn\s+statement)"],
     [r"(policy\s+number|claim\s+number|date\s+of\s+loss)",
      r"(description\s+of\s+(loss|damage|incident))",
      r"(signature\s+of\s+(insured|claimant))", r"(notary|witnessed\s+by)"],
     [r"loss\s+run\s+report", r"acord\s*1[23]\d"],
     ["pdf", "docx"]),
    ("EVIDENCE_PHOTO",
     [],
     [r"(photo|photograph|image|picture|exhibit)", r"(damage|inspection|survey)"],
     [r"acord", r"financial"],
     ["jpg", "jpeg", "png"]),
    ("IDENTITY_DOCUMENT",
     [r"(driver.s?\s+licen[sc]e|passport|state\s+id|identification\s+card)"],
     [r"(date\s+of\s+birth|dob|expir(ation|y)\s+date)",
      r"(license\s+number|id\s+number|document\s+number)"],
     [r"acord", r"financial", r"loss\s+run"],
     ["jpg", "jpeg", "png", "pdf"]),
]
EXTENSION_SCORE, REQUIRED_SCORE, BONUS_SCORE, NEGATIVE_SCORE = 0.05, 0.45, 0.50, 0.20
MIN_SCORE = 0.30
ALTERNATIVE_MIN_SCORE = 0.1
AMBIGUITY_GAP = 0.12
AMBIGUITY_SECOND_MIN = 0.15
ACCEPT_CONFIDENCE = 0.75
SECOND_OPINION_CHARS = 2000
SECOND_OPINION_CONFIDENCE = 0.72
AGREEMENT_BONUS = 0.05
NO_TEXT_REASON = "Document has no extractable text — cannot classify."
AGREEMENT_NOTE = " [rules and LLM agree]"
NO_RESPONSE_NOTE = " [LLM fallback failed: LLMError]"
INVALID_RESPONSE_NOTE = " [LLM fallback failed: LLMResponseValidationError]"
BLOCKED_REASON = "Document text failed injection check — classification skipped."
DISABLED_NOTE = " [LLM disabled]"

# --- guardrail patterns (case-insensitive unless noted) ---------------------
INJECTION_PATTERNS = [
    r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions?",
    r"disregard\s+(the\s+)?(system\s+prompt|instructions?)",
    r"you\s+are\s+(now\s+)?a?\s*(different|new)\s+(ai|assistant|model)",
    r"\[INST\]|\[/INST\]|\[SYS\]|\[/SYS\]",
    r"<\s*/?\s*system\s*>",
    r"act\s+as\s+(if\s+you\s+(are|were)\s+)?an?\s+\w+\s+(without|that\s+ignores?)",
    r"jailbreak|dan\s+mode|developer\s+mode|unrestricted\s+mode",
    r"print\s+your\s+(system\s+)?instructions|reveal\s+your\s+prompt",
]
SHORT_INJECTION_PATTERNS = [
    r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions?",
    r"you\s+are\s+(now\s+)?a\s+",
    r"disregard\s+(the\s+)?system\s+prompt",
    r"<\s*/?system\s*>",
    r"\[INST\]|\[/INST\]|\[SYS\]|\[/SYS\]",
    r"act\s+as\s+(if\s+you\s+are\s+)?a\s+",
]
# (name, pattern, replacement, ignore case), applied in this order.
PII_PATTERNS = [
    ("ssn", r"\b\d{3}[-\s]\d{2}[-\s]\d{4}\b", "[SSN-REDACTED]", False),
    ("card", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "[CARD-REDACTED]", False),
    ("routing", r"\b[0-3]\d{8}\b", "[ROUTING-REDACTED]", False),
    ("secret", r"\b[0-9a-fA-F]{32,}\b", "[SECRET-REDACTED]", False),
    ("bearer", r"Bearer\s+[A-Za-z0-9\-._~+/]+=*", "Bearer [TOKEN-REDACTED]", True),
]
FORBIDDEN_OUTPUT_PATTERNS = [
    r"GROQ_API_KEY|groq_api_key",
    r"SECRET_KEY|secret_key",
    r"<\s*/?\s*system\s*>",
    r"\[INST\]|\[/INST\]",
    r"\b(i\s+hereby\s+(approve|deny|decline|bind)|this\s+policy\s+is\s+(approved|denied))\b",
]
CHARS_PER_TOKEN = 4
RESERVED_TOKENS = 1524
TRUNCATION_MARKER = "\n\n[... TEXT TRUNCATED TO FIT TOKEN BUDGET ...]\n\n"
MAX_OUTPUT_CHARS = 50_000
DISCLAIMER = ("[AI-GENERATED CONTENT — For underwriter review only. "
              "Not a binding decision or approved policy position.] ")

# --- field catalogue --------------------------------------------------------
#: (list, place, field name, label, type, required, description); COMMON serves the types in COMMON_FIELD_TYPES.
FIELD_CATALOGUE = (
    ("COMMON", 1, "applicant_name", "Applicant / Named Insured", "string", True, "Legal name of the business or individual seeking insurance"),
    ("COMMON", 2, "policy_effective_date", "Policy Effective Date", "date", False, "Date the requested coverage would begin (MM/DD/YYYY)"),
    ("COMMON", 3, "policy_expiration_date", "Policy Expiration Date", "date", False, "Date the requested coverage would end"),
    ("COMMON", 4, "prior_carrier", "Prior Insurance Carrier", "string", False, "Name of the current or most recent insurance carrier"),
    ("COMMON", 5, "prior_policy_number", "Prior Policy Number", "string", False, "Policy number with the prior carrier"),
    ("ACORD_APPLICATION", 1, "applicant_name", "Named Insured", "string", True, "Legal business name as it should appear on the policy"),
    ("ACORD_APPLICATION", 2, "applicant_address", "Business Address", "string", True, "Primary business address including city, state, zip"),
    ("ACORD_APPLICATION", 3, "applicant_state", "State of Domicile", "string", True, "State where the business is incorporated or primarily operates"),
    ("ACORD_APPLICATION", 4, "fein", "Federal Employer Identification Number (FEIN)", "string", False, "9-digit FEIN / EIN in format XX-XXXXXXX"),
    ("ACORD_APPLICATION", 5, "sic_code", "SIC Code", "string", False, "Standard Industrial Classification code"),
    ("ACORD_APPLICATION", 6, "business_type", "Type of Business Entity", "string", True, "Corporation, LLC, Partnership, Sole Proprietor, etc."),
    ("ACORD_APPLICATION", 7, "nature_of_business", "Nature / Description of Business", "string", True, "What the business does — operations description"),
    ("ACORD_APPLICATION", 8, "years_in_business", "Years in Business", "number", False, "Number of years the business has been operating"),
    ("ACORD_APPLICATION", 9, "annual_revenue", "Annual Revenue / Gross Sales", "currency", True, "Total annual revenue or gross sales in dollars"),
    ("ACORD_APPLICATION", 10, "employee_count", "Number of Employees", "number", False, "Total full-time and part-time employees"),
    ("ACORD_APPLICATION", 11, "website", "Business Website URL", "string", False, "Company website if listed"),
    ("ACORD_APPLICATION", 12, "contact_name", "Primary Contact Name", "string", False, "Name of the primary contact person"),
    ("ACORD_APPLICATION", 13, "contact_phone", "Contact Phone Number", "string", False, "Best phone number for the contact"),
    ("ACORD_APPLICATION", 14, "contact_email", "Contact Email Address", "string", False, "Email address for the contact"),
    ("ACORD_APPLICATION", 15, "policy_effective_date", "Policy Effective Date", "date", True, "Requested policy start date"),
    ("ACORD_APPLICATION", 16, "policy_expiration_date", "Policy Expiration Date", "date", False, "Requested policy end date (typically 1 year)"),
    ("ACORD_APPLICATION", 17, "lines_requested", "Lines of Coverage Requested", "list", True, "List of coverage lines: GL, Property, Auto, WC, Umbrella, etc."),
    ("ACORD_APPLICATION", 18, "prior_carrier", "Prior Carrier", "string", False, "Prior insurance carrier name"),
    ("ACORD_APPLICATION", 19, "prior_premium", "Prior Year Premium", "currency", False, "Premium paid to the prior carrier"),
    ("ACORD_APPLICATION", 20, "prior_carrier_reason_leaving", "Reason for Leaving Prior Carrier", "string", False, "Why they are changing carriers"),
    ("ACORD_APPLICATION", 21, "loss_count_3yr", "Number of Losses (3 Years)", "number", False, "Total number of claims in the past 3 years"),
    ("ACORD_APPLICATION", 22, "total_losses_3yr", "Total Incurred Losses (3 Years)", "currency", False, "Total paid + reserved losses in the past 3 years"),
    ("ACORD_APPLICATION", 23, "location_count", "Number of Locations", "number", False, "Total number of business locations"),
    ("ACORD_GL", 1, "applicant_name", "Named Insured", "string", True, ""),
    ("ACORD_GL", 2, "each_occurrence_limit", "Each Occurrence Limit", "currency", True, "Per-occurrence liability limit requested"),
    ("ACORD_GL", 3, "general_aggregate_limit", "General Aggregate Limit", "currency", True, "Total aggregate limit for the policy period"),
    ("ACORD_GL", 4, "products_aggregate_limit", "Products/Completed Operations Aggregate", "currency", False, "Aggregate for products and completed operations"),
    ("ACORD_GL", 5, "personal_injury_limit", "Personal & Advertising Injury Limit", "currency", False, ""),
    ("ACORD_GL", 6, "damage_to_premises_limit", "Damage to Rented Premises Limit", "currency", False, ""),
    ("ACORD_GL", 7, "medical_payments_limit", "Medical Payments Limit", "currency", False, ""),
    ("ACORD_GL", 8, "deductible", "Deductible Amount", "currency", False, ""),
    ("ACORD_GL", 9, "annual_revenue", "Annual Revenue (GL Basis)", "currency", True, "Gross sales / revenue used for GL rating"),
    ("ACORD_GL", 10, "square_footage", "Total Square Footage", "number", False, "Total sq ft of all premises occupied"),
    ("ACORD_GL", 11, "subcontractor_cost", "Subcontracted Work Cost", "currency", False, "Annual cost paid to subcontractors"),
    ("ACORD_GL", 12, "products_operations_description", "Products / Operations Description", "string", False, "Description of products sold or operations performed"),
    ("ACORD_GL", 13, "additional_insureds", "Additional Insureds", "list", False, "Names of parties to be listed as additional insureds"),
    ("ACORD_GL", 14, "policy_effective_date", "Effective Date", "date", True, ""),
    ("ACORD_PROPERTY", 1, "applicant_name", "Named Insured", "string", True, ""),
    ("ACORD_PROPERTY", 2, "property_address", "Property Address", "string", True, "Physical address of the insured property"),
    ("ACORD_PROPERTY", 3, "building_value", "Building Replacement Cost Value", "currency", True, "Replacement cost of the building structure"),
    ("ACORD_PROPERTY", 4, "bpp_value", "Business Personal Property Value", "currency", False, "Value of contents / business personal property"),
    ("ACORD_PROPERTY", 5, "bi_limit", "Business Income / BI Limit", "currency", False, "Business interruption coverage limit"),
    ("ACORD_PROPERTY", 6, "construction_type", "Construction Type", "string", False, "Frame, Masonry, Fire Resistive, etc."),
    ("ACORD_PROPERTY", 7, "year_built", "Year Built", "number", False, ""),
    ("ACORD_PROPERTY", 8, "square_footage", "Building Square Footage", "number", False, ""),
    ("ACORD_PROPERTY", 9, "number_of_stories", "Number of Stories", "number", False, ""),
    ("ACORD_PROPERTY", 10, "occupancy", "Occupancy / Use", "string", False, "How the building is used: Office, Retail, Warehouse, etc."),
    ("ACORD_PROPERTY", 11, "roof_type", "Roof Type / Material", "string", False, ""),
    ("ACORD_PROPERTY", 12, "roof_year", "Roof Year / Last Replaced", "number", False, ""),
    ("ACORD_PROPERTY", 13, "sprinkler_system", "Sprinkler System Present", "boolean", False, ""),
    ("ACORD_PROPERTY", 14, "alarm_system", "Alarm System Type", "string", False, ""),
    ("ACORD_PROPERTY", 15, "coinsurance_pct", "Coinsurance Percentage", "number", False, ""),
    ("ACORD_PROPERTY", 16, "deductible", "Property Deductible", "currency", False, ""),
    ("ACORD_PROPERTY", 17, "policy_effective_date", "Effective Date", "date", True, ""),
    ("ACORD_AUTO", 1, "applicant_name", "Named Insured", "string", True, ""),
    ("ACORD_AUTO", 2, "fleet_size", "Number of Vehicles", "number", True, ""),
    ("ACORD_AUTO", 3, "auto_liability_limit", "Auto Liability Limit (CSL)", "currency", False, "Combined single limit for auto liability"),
    ("ACORD_AUTO", 4, "hired_non_owned", "Hired & Non-Owned Auto Coverage", "boolean", False, ""),
    ("ACORD_AUTO", 5, "radius_of_operation", "Radius of Operation (miles)", "number", False, ""),
    ("ACORD_AUTO", 6, "vehicle_types", "Types of Vehicles", "list", False, "e.g. Passenger, Light Truck, Heavy Truck, Trailer"),
    ("ACORD_AUTO", 7, "driver_count", "Number of Drivers", "number", False, ""),
    ("ACORD_AUTO", 8, "annual_mileage", "Estimated Annual Mileage", "number", False, ""),
    ("ACORD_AUTO", 9, "garaging_state", "Primary Garaging State", "string", False, ""),
    ("ACORD_AUTO", 10, "policy_effective_date", "Effective Date", "date", True, ""),
    ("ACORD_WORKERS_COMP", 1, "applicant_name", "Named Insured", "string", True, ""),
    ("ACORD_WORKERS_COMP", 2, "state_of_operations", "State(s) of Operation", "list", True, ""),
    ("ACORD_WORKERS_COMP", 3, "total_payroll", "Total Annual Payroll", "currency", True, ""),
    ("ACORD_WORKERS_COMP", 4, "employee_count", "Number of Employees", "number", True, ""),
    ("ACORD_WORKERS_COMP", 5, "class_codes", "WC Class Codes and Payroll", "list", False, "List of NCCI class codes with associated payroll"),
    ("ACORD_WORKERS_COMP", 6, "experience_mod", "Experience Modification Factor (EMF)", "number", False, "Experience mod factor — 1.00 is average"),
    ("ACORD_WORKERS_COMP", 7, "employer_liability_limit", "Employer Liability Limit", "currency", False, ""),
    ("ACORD_WORKERS_COMP", 8, "officers_included", "Officers Included/Excluded", "boolean", False, "Whether corporate officers are included in WC coverage"),
    ("ACORD_WORKERS_COMP", 9, "subcontractors_used", "Subcontractors Used", "boolean", False, ""),
    ("ACORD_WORKERS_COMP", 10, "policy_effective_date", "Effective Date", "date", True, ""),
    ("ACORD_UMBRELLA", 1, "applicant_name", "Named Insured", "string", True, ""),
    ("ACORD_UMBRELLA", 2, "umbrella_limit", "Umbrella / Excess Limit", "currency", True, ""),
    ("ACORD_UMBRELLA", 3, "self_insured_retention", "Self-Insured Retention (SIR)", "currency", False, ""),
    ("ACORD_UMBRELLA", 4, "underlying_gl_limit", "Underlying GL Each Occurrence Limit", "currency", False, ""),
    ("ACORD_UMBRELLA", 5, "underlying_auto_limit", "Underlying Auto Liability Limit", "currency", False, ""),
    ("ACORD_UMBRELLA", 6, "underlying_wc_limit", "Underlying WC Employer Liability Limit", "currency", False, ""),
    ("ACORD_UMBRELLA", 7, "underlying_carrier", "Underlying Coverage Carrier", "string", False, ""),
    ("ACORD_UMBRELLA", 8, "policy_effective_date", "Effective Date", "date", True, ""),
    ("LOSS_RUN", 1, "policy_period", "Policy Period Covered", "string", True, ""),
    ("LOSS_RUN", 2, "prior_carrier", "Prior Carrier Name", "string", True, ""),
    ("LOSS_RUN", 3, "total_claims", "Total Number of Claims", "number", True, ""),
    ("LOSS_RUN", 4, "total_paid", "Total Paid Losses", "currency", True, ""),
    ("LOSS_RUN", 5, "total_incurred", "Total Incurred Losses", "currency", False, ""),
    ("LOSS_RUN", 6, "open_claims_count", "Number of Open Claims", "number", False, ""),
    ("LOSS_RUN", 7, "largest_claim_amount", "Largest Single Claim Amount", "currency", False, ""),
    ("LOSS_RUN", 8, "loss_ratio", "Loss Ratio", "number", False, "Total incurred / premium as a percentage"),
    ("LOSS_RUN", 9, "claims_detail", "Individual Claims Detail", "list", False, "List of individual claims with date, cause, amount, status"),
    ("FINANCIAL_STATEMENT", 1, "fiscal_year", "Fiscal Year", "string", True, ""),
    ("FINANCIAL_STATEMENT", 2, "total_revenue", "Total Revenue / Net Sales", "currency", True, ""),
    ("FINANCIAL_STATEMENT", 3, "gross_profit", "Gross Profit", "currency", False, ""),
    ("FINANCIAL_STATEMENT", 4, "net_income", "Net Income / Net Loss", "currency", False, ""),
    ("FINANCIAL_STATEMENT", 5, "total_assets", "Total Assets", "currency", False, ""),
    ("FINANCIAL_STATEMENT", 6, "total_liabilities", "Total Liabilities", "currency", False, ""),
    ("FINANCIAL_STATEMENT", 7, "total_equity", "Total Equity / Net Worth", "currency", False, ""),
    ("FINANCIAL_STATEMENT", 8, "cash_and_equivalents", "Cash and Cash Equivalents", "currency", False, ""),
    ("FINANCIAL_STATEMENT", 9, "accounts_receivable", "Accounts Receivable", "currency", False, ""),
    ("FINANCIAL_STATEMENT", 10, "long_term_debt", "Long-Term Debt", "currency", False, ""),
    ("FINANCIAL_STATEMENT", 11, "audited", "Audited Financial Statement", "boolean", False, "Whether the statements are audited or unaudited"),
    ("BROKER_EMAIL", 1, "broker_name", "Broker / Agent Name", "string", True, ""),
    ("BROKER_EMAIL", 2, "broker_email", "Broker Email Address", "string", False, ""),
    ("BROKER_EMAIL", 3, "broker_company", "Broker Agency / Company", "string", False, ""),
    ("BROKER_EMAIL", 4, "applicant_name", "Applicant / Insured Name", "string", False, ""),
    ("BROKER_EMAIL", 5, "coverage_type_requested", "Coverage Type Requested", "string", False, ""),
    ("BROKER_EMAIL", 6, "renewal_date", "Renewal / Effective Date Requested", "date", False, ""),
    ("BROKER_EMAIL", 7, "special_instructions", "Special Instructions or Notes", "string", False, ""),
)
# Types that use the COMMON list, and types that have no fields at all.
COMMON_FIELD_TYPES = ["UNDERWRITING_GUIDELINE", "CLAIMS_DOCUMENT", "OTHER"]
NO_FIELD_TYPES = ["EVIDENCE_PHOTO", "IDENTITY_DOCUMENT"]

# --- extraction -------------------------------------------------------------
RAW_OUTPUT_FIELD = "llm_extraction_output"
RAW_OUTPUT_LABEL = "LLM Extraction Output"
APPLICANT_KEYS = ["applicant_name", "named_insured", "insured_name"]
KEY_CONFIDENCE, RAW_CONFIDENCE = 0.9, 1.0
MIN_REASON_CHARS = 10

# --- evidence ---------------------------------------------------------------
FUZZY_MIN_RATIO = 0.75
FUZZY_WINDOW = 300
FUZZY_MIN_CITATION = 20

# --- validation -------------------------------------------------------------
NUMERIC_TOLERANCE = 0.05
DATE_TOLERANCE_DAYS = 7
CONFLICT_MIN_CONFIDENCE = 0.40
SIMILAR_RATIO = 0.80
IGNORED_FOR_CONFLICT = [
    "extraction_notes", "special_instructions", "contact_name", "notes",
    "claims_detail", "class_codes", "additional_insureds", "vehicle_types",
    "lines_requested", "state_of_operations",
]
GLOBALLY_REQUIRED = ["applicant_name", "policy_effective_date"]
COVERAGE_FORM = {
    "general liability": "ACORD_GL", "gl": "ACORD_GL", "property": "ACORD_PROPERTY",
    "auto": "ACORD_AUTO", "business auto": "ACORD_AUTO",
    "workers comp": "ACORD_WORKERS_COMP", "workers compensation": "ACORD_WORKERS_COMP",
    "umbrella": "ACORD_UMBRELLA", "excess": "ACORD_UMBRELLA",
}
LOSS_RUN_TRIGGER_TYPES = ["ACORD_APPLICATION", "ACORD_GL", "ACORD_PROPERTY", "ACORD_WORKERS_COMP"]
# (field, check, severity, types or None for all)
FIELD_RULES = [
    ("annual_revenue", "non_negative", "ERROR", ["ACORD_APPLICATION", "ACORD_GL"]),
    ("total_payroll", "non_negative", "ERROR", ["ACORD_WORKERS_COMP"]),
    ("building_value", "non_negative", "ERROR", ["ACORD_PROPERTY"]),
    ("total_paid", "non_negative", "WARNING", ["LOSS_RUN"]),
    ("total_incurred", "non_negative", "WARNING", ["LOSS_RUN"]),
    ("total_revenue", "non_negative", "WARNING", ["FINANCIAL_STATEMENT"]),
    ("policy_effective_date", "not_stale", "WARNING", None),
    ("broker_email", "email", "WARNING", None),
    ("contact_email", "email", "WARNING", None),
    ("experience_mod", "experience_mod", "WARNING", ["ACORD_WORKERS_COMP"]),
    ("coinsurance_pct", "coinsurance", "WARNING", ["ACORD_PROPERTY"]),
]
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
EXPERIENCE_MOD_RANGE = (0.5, 3.0)
COINSURANCE_RANGE = (50.0, 100.0)
STALE_DAYS = 90
REVENUE_PER_EMPLOYEE_RANGE = (5_000.0, 50_000_000.0)

# --- knowledge base ---------------------------------------------------------
CHUNK_WORDS, CHUNK_OVERLAP, CHUNK_MIN_WORDS = 400, 40, 20
TOP_K, MIN_SIMILARITY = 5, 0.30
PREVIEW_CHARS = 300

# --- risk and history -------------------------------------------------------
RISK_BASE, RISK_LOW_MAX, RISK_MEDIUM_MAX, RISK_HIGH_MIN = 50, 39, 69, 70
RISK_SOURCE = "DEMO RULE — NOT APPROVED POLICY"
DECISIONS = ["APPROVED", "DECLINED", "REFERRED", "ADDITIONAL_INFO", "WITHDRAWN"]
RECOMMENDATIONS = ["STANDARD_REVIEW", "SENIOR_REVIEW", "ADDITIONAL_INFO_REQUIRED",
                   "SPECIALIST_REVIEW", "INSUFFICIENT_EVIDENCE"]

# Characters counted one by one where texts are compared by their letters.
