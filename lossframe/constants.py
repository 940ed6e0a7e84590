"""Fixed values that must equal the source application's for equal results.

Everything in this module is data, not logic: header aliases, the allowed
currency list, issue texts and details, rule packs, export layouts and the
standard claims schema.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference application exactly)
# ---------------------------------------------------------------------------

# Standard field -> accepted normalised header aliases, in this order.
FIELD_ALIASES: dict[str, list[str]] = {
    "claim_id": ["claim_id", "claimnumber", "claim_no", "claim", "claim_num"],
    "loss_date": ["loss_date", "date_of_loss", "incident_date", "occurrence_date", "lossdt", "lossdate"],
    "report_date": ["report_date", "reported_date", "notif_date", "date_reported", "reported"],
    "paid": ["paid", "paid_amount", "amount_paid", "total_paid", "paid_total"],
    "incurred": ["incurred", "incurred_amount", "total_incurred", "reserve_plus_paid", "paid_incurred"],
    "outstanding": ["outstanding", "case_outstanding", "case_reserve", "reserve", "outstanding_amount"],
    "currency": ["currency", "curr", "ccy"],
    "policy_number": ["policy_number", "policynumber", "policy_no", "policy", "policyid"],
    "status": ["status", "claim_status", "open_closed", "state"],
    "claimant": ["claimant", "insured_name", "name", "customer", "insured"],
}

STANDARD_FIELDS: list[str] = list(FIELD_ALIASES)

ALLOWED_CURRENCIES: list[str] = ["AUD", "USD", "NZD", "GBP", "EUR", "CAD", "SGD"]

# Issue texts and details, in rule order.
ISSUE_REQUIRED = "Missing required fields"
ISSUE_NEG_PAID = "Negative paid"
ISSUE_NEG_INCURRED = "Negative incurred"
ISSUE_NEG_OUTSTANDING = "Negative outstanding"
ISSUE_INC_LT_PAID = "Incurred less than Paid"
ISSUE_RECONCILE = "Incurred != Paid + Outstanding"
ISSUE_CURRENCY = "Unrecognised currency"
ISSUE_DUPLICATE = "Potential duplicate claim rows"
ISSUE_DATE_ORDER = "Loss date after report date"
ISSUE_POLICY_TERM = "Loss date outside policy term"
ISSUE_MISSING_POLICY = "Missing policy number"
ISSUE_MISSING_CURRENCY = "Missing currency"
ISSUE_PAID_OUTLIER = "Paid outlier"
ISSUE_HIGH_RATIO = "High incurred-to-paid ratio"
ISSUE_MISSING_CLAIMANT = "Missing claimant/insured name"
ISSUE_ZERO_ROWS = "Zero paid and incurred"
ISSUE_UNPARSE_LOSS = "Unparseable loss_date"
ISSUE_UNPARSE_REPORT = "Unparseable report_date"
ISSUE_MULTI_ROWS = "Multiple rows for claim_id"

DETAIL_REQUIRED = "claim_id/loss_date/report_date"
DETAIL_NEG_PAID = "paid < 0"
DETAIL_NEG_INCURRED = "incurred < 0"
DETAIL_NEG_OUTSTANDING = "outstanding < 0"
DETAIL_INC_LT_PAID = "incurred < paid"
DETAIL_RECONCILE = "reconciliation mismatch"
DETAIL_CURRENCY = "Allowed: AUD, USD, NZD, GBP, EUR, CAD, SGD"
DETAIL_DUPLICATE = "duplicate claim_id + loss_date"
DETAIL_DATE_ORDER = "loss_date > report_date"
DETAIL_UNPARSE = "check date format"

# Rule toggles (all on by default) and numeric parameters.
RULE_FLAGS: list[str] = [
    "rule_required_fields",
    "rule_negative_values",
    "rule_incurred_lt_paid",
    "rule_reconcile",
    "rule_currency_list",
    "rule_duplicates",
    "rule_date_order",
    "rule_policy_term",
    "rule_missing_policy",
    "rule_missing_currency",
    "rule_paid_outliers",
    "rule_high_ratio",
    "rule_missing_claimant",
    "rule_zero_rows",
    "rule_parse_dates",
    "rule_multi_rows_per_claim",
]
DEFAULT_IQR_MULTIPLIER = 1.5
DEFAULT_RATIO_THRESHOLD = 2.0

# Rule packs: exactly the listed rules are switched on.
RULE_PACKS: dict[str, dict] = {
    "underwriter": {
        "rules": ["rule_required_fields", "rule_negative_values", "rule_incurred_lt_paid", "rule_reconcile",
                  "rule_currency_list", "rule_date_order", "rule_paid_outliers", "rule_high_ratio"],
        "iqr_multiplier": 1.5,
        "ratio_threshold": 2.0,
    },
    "claims_qa": {
        "rules": ["rule_required_fields", "rule_negative_values", "rule_reconcile", "rule_zero_rows",
                  "rule_duplicates", "rule_missing_policy", "rule_missing_currency"],
    },
    "lloyds": {
        "rules": ["rule_required_fields", "rule_currency_list", "rule_parse_dates", "rule_policy_term",
                  "rule_date_order"],
        "export_format": "lloyds_v5_2",
    },
}

# Quality-summary constants.
OPEN_TOLERANCE = "0.01"
SUMMARY_OUTLIER_K = "1.5"
DATASET_RECON_MIN_TOL = 100
DATASET_RECON_REL_TOL = "0.001"

# Triangles.
MAX_DEV_MONTHS = 36

# Retention.
RETENTION_DAYS = 30

# File intake.
ALLOWED_EXTENSIONS = ["csv", "xlsx", "xls", "pdf"]
TEXT_MIN_CHARS = 400
HEADER_PROMOTE_FRACTION = 0.6
EXCEL_SERIAL_MIN = 20000
EXCEL_SERIAL_MAX = 60000
EXCEL_ORIGIN = "1899-12-30"

# Export layouts: (output column, source column or expression key, kind). Fixed values.
# Kinds: text as it is; iso and au date text; money rounded to two places; amount as it is.
EXPORT_LAYOUTS: dict[str, list[tuple[str, str, str]]] = {
    "standard_csv": [
        ("run_id", "run_id", "text"), ("tenant_id", "tenant_id", "text"), ("claim_id", "claim_id", "text"),
        ("loss_date", "loss_date", "iso"), ("report_date", "report_date", "iso"), ("paid", "paid", "amount"),
        ("incurred", "incurred", "amount"), ("outstanding", "outstanding", "amount"), ("currency", "currency", "text"),
        ("policy_number", "policy_number", "text"), ("status", "status", "text"),
        ("claimant|claimant_masked", "claimant", "text"), ("source_file", "source_file", "text"),
        ("source_page", "source_page", "text"),
    ],
    "ebix_v1": [
        ("ClaimNumber", "claim_id", "text"), ("DateOfLoss", "loss_date", "au"), ("DateReported", "report_date", "au"),
        ("Paid", "paid", "money"), ("Incurred", "incurred", "money"), ("Outstanding", "outstanding_filled", "money"),
        ("Currency", "currency", "text"), ("PolicyNumber", "policy_number", "text"), ("Status", "status", "text"),
        ("Claimant|ClaimantMasked", "claimant", "text"),
    ],
    "lloyds_v5_2": [
        ("Claim_Reference", "claim_id", "text"), ("Loss_Date", "loss_date", "iso"), ("Report_Date", "report_date", "iso"),
        ("Paid_To_Date", "paid", "money"), ("Incurred_To_Date", "incurred", "money"),
        ("Outstanding_Reserves", "incurred_less_paid", "money"), ("Currency", "currency", "text"),
        ("Policy_Number", "policy_number", "text"),
    ],
    "sunrise_basic": [
        ("ClaimID", "claim_id", "text"), ("LossDate", "loss_date", "au"), ("ReportDate", "report_date", "au"),
        ("Paid", "paid", "money"), ("Incurred", "incurred", "money"), ("OS", "outstanding_filled", "money"),
        ("CCY", "currency", "text"), ("PolicyNo", "policy_number", "text"),
    ],
}

# ---------------------------------------------------------------------------
# Standard claims schema
# ---------------------------------------------------------------------------

MONEY = T.DecimalType(28, 6)

STANDARD_SCHEMA = T.StructType([
    T.StructField("claim_id", T.StringType()),
    T.StructField("loss_date", T.DateType()),
    T.StructField("report_date", T.DateType()),
    T.StructField("paid", MONEY),
    T.StructField("incurred", MONEY),
    T.StructField("outstanding", MONEY),
    T.StructField("currency", T.StringType()),
    T.StructField("policy_number", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("claimant", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("source_page", T.IntegerType()),
    T.StructField("tenant_id", T.StringType()),
])
