"""Names, thresholds and texts shared by all modules."""

# Column names of the loan tables.
ID = "SK_ID_CURR"
TARGET = "TARGET"
SCORES = ("EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3")
UNEMPLOYED_DAYS = 365243
UNKNOWN_GENDER = "XNA"

# Inputs of the default model, in coefficient order.
MODEL_FEATURES = (
    "AMT_INCOME_TOTAL",
    "AMT_CREDIT",
    "AMT_ANNUITY",
    "DAYS_BIRTH",
    "DAYS_EMPLOYED",
    "EXT_SOURCE_1",
    "EXT_SOURCE_2",
    "EXT_SOURCE_3",
    "DEBT_TO_INCOME",
    "ANNUITY_TO_INCOME",
)

# Inputs of the borrower segmentation.
CLUSTER_FEATURES = (
    "EXT_SOURCE_AVG",
    "DEBT_TO_INCOME",
    "ANNUITY_TO_INCOME",
    "AGE_YEARS",
    "EMPLOYED_YEARS",
)
CLIPPED_FEATURES = ("DEBT_TO_INCOME", "ANNUITY_TO_INCOME")

# Numeric columns studied as default drivers.
DRIVERS = (
    "AMT_INCOME_TOTAL",
    "AMT_CREDIT",
    "AMT_ANNUITY",
    "DAYS_BIRTH",
    "DAYS_EMPLOYED",
    "EXT_SOURCE_1",
    "EXT_SOURCE_2",
    "EXT_SOURCE_3",
    "REGION_POPULATION_RELATIVE",
    "OBS_30_CNT_SOCIAL_CIRCLE",
    "DEF_30_CNT_SOCIAL_CIRCLE",
    "AMT_REQ_CREDIT_BUREAU_YEAR",
)
DERIVED = (
    "AGE_YEARS",
    "EMPLOYED_YEARS",
    "DEBT_TO_INCOME",
    "ANNUITY_TO_INCOME",
    "CREDIT_UTIL",
    "EXT_SOURCE_AVG",
)
HEATMAP = (
    "TARGET",
    "EXT_SOURCE_1",
    "EXT_SOURCE_2",
    "EXT_SOURCE_3",
    "AMT_INCOME_TOTAL",
    "AMT_CREDIT",
    "AMT_ANNUITY",
    "DAYS_BIRTH",
    "DAYS_EMPLOYED",
)

# Tiers, bands and agreement levels with their limits.
RISK_TIERS = ("Low Risk", "Medium Risk", "High Risk")
BAND_LIMITS = (0.15, 0.30)
AGREEMENT = ("Aligned", "Moderate", "Significant")
AGREEMENT_LIMITS = (5.0, 10.0)
DEFAULT_THRESHOLD_PCT = 8.0
INCOME_CAP = 1_000_000
CREDIT_CAP = 2_000_000
HISTOGRAM_BINS = 50
TOP_DRIVERS = 15
MIN_SEGMENT_ROWS = 100
TOP_SEGMENTS = 10
CLIP_BOUNDS = (0.01, 0.99)
FACTOR_MIN_PHI = 0.01
FACTORS_PER_SIDE = 3

# Display names of the model inputs.
DISPLAY_NAMES = {
    "AMT_INCOME_TOTAL": "Annual Income",
    "AMT_CREDIT": "Loan Amount",
    "AMT_ANNUITY": "Annual Payment",
    "DAYS_BIRTH": "Age (days)",
    "DAYS_EMPLOYED": "Employment (days)",
    "EXT_SOURCE_1": "Bureau Score 1",
    "EXT_SOURCE_2": "Bureau Score 2",
    "EXT_SOURCE_3": "Bureau Score 3",
    "DEBT_TO_INCOME": "Debt-to-Income",
    "ANNUITY_TO_INCOME": "Annuity-to-Income",
}

# Texts of the rule-based risk factors.
LOW_SCORES = "Low external bureau scores indicate higher risk"
HIGH_SCORES = "Strong external bureau scores reduce risk"
HIGH_DEBT = ("High debt-to-income ratio (", "x) increases risk")
LOW_DEBT = ("Low debt-to-income ratio (", "x) is favorable")
YOUNG = "Younger borrowers historically show higher default rates"
MATURE = "Mature borrowers show lower default rates"
SHORT_EMPLOYMENT = "Short employment history increases risk"
STABLE_EMPLOYMENT = "Stable employment history is favorable"
HIGH_ANNUITY = ("High annuity-to-income ratio (", ") strains repayment capacity")
BALANCED = "Borrower profile shows balanced risk factors"

# Settings of the two classifiers and of the segmentation.
TEST_SHARE = 0.2
SEED = 42
LOGISTIC_C = 0.1
LOGISTIC_ITERATIONS = 1000
TREE_ROUNDS = 100
TREE_DEPTH = 5
TREE_STEP = 0.1
CLUSTERS = 3
CLUSTER_RESTARTS = 10
LOGISTIC = "logreg"
BOOSTED = "gbt"

# The borrower scored after training as a smoke check.
SMOKE_BORROWER = {
    "income": 200000.0,
    "loan_amount": 500000.0,
    "annuity": 25000.0,
    "age": 35,
    "employed_years": 5,
    "ext_source_1": 0.5,
    "ext_source_2": 0.5,
    "ext_source_3": 0.5,
}
