"""The label sentences of the reports, used by the operators and by the comparison SQL alike."""

# --- fixed values: categories of account-level charges -------------------------
ACCOUNT_LEVEL = ["Tax", "Credit", "Adjustment"]

# --- fixed values: panels of the bill against its invoices ---------------------
PANEL_INVOICED = "1 · Invoiced (ties in Q1)"
PANEL_LEGACY = "2 · Legacy era — x_InvoiceId only, no v1.4 invoice_detail row"
PANEL_ACCOUNT = "3 · Not yet invoiced — account-level (Tax/Credit/Adjustment)"
PANEL_PURCHASE = "4 · Not yet invoiced — commitment purchases"
PANEL_OPEN = "5 · Not yet invoiced — usage (open period)"

# --- fixed values: buckets of commitment eligibility ---------------------------
BUCKET_ELIGIBLE = "1 · eligible (coverable demand)"
BUCKET_INELIGIBLE = "2 · ineligible usage (documented rule)"
BUCKET_UNUSED = "3 · NULL — unused commitment (not demand)"
BUCKET_NON_USAGE = "4 · NULL — concept n/a (non-usage row)"
BUCKET_ERA = "5 · NULL — era predates the flag ({era})"
BUCKET_UNEXPLAINED = "6 · NULL — unexplained (should be empty)"

# --- fixed values: verdicts on a commitment's term -----------------------------
TERM_ORPHAN = "ORPHAN — cost rows but no contract record; term unknown, closure not evaluable"
TERM_IN_PROGRESS = "IN PROGRESS — export covers part of the term; short export, not shortfall"
TERM_CLOSES = "CLOSES EXACTLY — amortised = purchased = contract, to the cent"
TERM_REVIEW = "REVIEW — amounts do not reconcile within the observed term"

# --- fixed values: verdicts on a commitment's utilisation ----------------------
USE_UNKNOWN = "TERM UNKNOWN — no contract record, not evaluable"
USE_SHORT = ("NOT EVALUABLE — window covers {observed} of {term} term days "
             "(would measure export length, not performance)")
USE_RATE = "utilisation {rate}% of term — evaluable, term fully observed"

# --- fixed values: sides of the savings split ----------------------------------
COVERED = "commitment-covered"
ON_DEMAND = "on-demand"
