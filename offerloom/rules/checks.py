"""Bounds and names of the quality checks."""

# field: (min, max)
BOUNDS = {
    "totalIssueShares": (100, 1e10),
    "freshIssueShares": (0, 1e10),
    "ofsShares": (0, 1e10),
    "marketMakerShares": (0, 1e10),
    "employeeReservationShares": (0, 1e10),
    "netOfferShares": (0, 1e10),
    "preIssueShares": (100, 1e11),
    "postIssueShares": (100, 1e11),
    "lotSize": (1, 1e5),
    "priceMin": (1, 5000),
    "priceMax": (1, 5000),
    "issuePrice": (1, 5000),
    "faceValue": (0.5, 100),
    "revenueFromOperations": (-1e12, 1e12),
    "totalIncome": (-1e12, 1e12),
    "ebitda": (-1e12, 1e12),
    "profitAfterTax": (-1e12, 1e12),
    "netWorth": (-1e12, 1e12),
    "totalBorrowings": (0, 1e12),
    "basicEPS": (-1e5, 1e5),
    "dilutedEPS": (-1e5, 1e5),
    "ronw": (-500, 500),
    "netAssetValue": (-1e5, 1e5),
    "roce": (-500, 500),
    "roe": (-500, 500),
    "debtEquity": (0, 50),
    "ebitdaMargin": (-200, 200),
    "patMargin": (-200, 200),
    "grossMargin": (-200, 200),
    "priceToBook": (0, 500),
    "currentRatio": (0, 50),
    "nav": (-1e5, 1e5),
    "eps": (-1e5, 1e5),
    "objectsAmount": (1, 1e11),
    "objectsTotal": (1, 1e11),
}

RATIO_KEYS = [
    "roe", "roce", "ronw", "debtEquity", "patMargin", "ebitdaMargin", "grossMargin", "priceToBook", "eps", "nav",
    "currentRatio", "interestCoverage", "fixedAssetTurnover", "inventoryTurnover", "debtorDays", "creditorDays",
    "inventoryDays", "workingCapitalDays", "revenueGrowth",
]
RATIO_ALIASES = [
    (r"(?i)return\s+on\s+equity", "roe"),
    (r"(?i)return\s+on\s+capital\s+employed", "roce"),
    (r"(?i)return\s+on\s+net\s+worth", "ronw"),
    (r"(?i)debt[\s/-]*(?:to\s*)?equity", "debtEquity"),
    (r"(?i)(?:pat|net\s+profit|profit\s+after\s+tax)\s+margin", "patMargin"),
    (r"(?i)ebitda\s+margin", "ebitdaMargin"),
    (r"(?i)gross\s+(?:profit\s+)?margin", "grossMargin"),
    (r"(?i)price\s+to\s+book|p\s*/\s*bv|price[-\s]to[-\s]book", "priceToBook"),
    (r"(?i)net\s+asset\s+value|nav\s+per", "nav"),
    (r"(?i)earnings?\s+per\s+share|\beps\b", "eps"),
    (r"(?i)current\s+ratio", "currentRatio"),
    (r"(?i)interest\s+coverage", "interestCoverage"),
    (r"(?i)fixed\s+asset\s+turnover", "fixedAssetTurnover"),
    (r"(?i)inventory\s+turnover", "inventoryTurnover"),
    (r"(?i)(?:debtor|receivable)s?\s+(?:turnover\s+)?days|days.*(?:debtor|receivable)", "debtorDays"),
    (r"(?i)(?:creditor|payable)s?\s+(?:turnover\s+)?days|days.*(?:creditor|payable)", "creditorDays"),
    (r"(?i)inventory\s+days|days.*inventory", "inventoryDays"),
    (r"(?i)working\s+capital\s+days", "workingCapitalDays"),
    (r"(?i)revenue\s+growth", "revenueGrowth"),
]
MONEY_UNITS = [
    "₹ lakhs", "₹ millions", "rs in lakhs", "rs in millions", "inr in lakhs", "inr in millions", "₹ per share",
]
# Keys that already are ratios when units are repaired.
SETTLED_RATIOS = [
    "roe", "roce", "ronw", "debtEquity", "patMargin", "ebitdaMargin", "grossMargin", "priceToBook", "currentRatio",
    "interestCoverage",
]
# Words of a label → key, for rows in percent and for rows in money.
RATIO_LABEL_WORDS = [
    ("ebitdaMargin", ["ebitda"]), ("patMargin", ["pat", "net profit"]), ("roe", ["roe", "return on equity"]),
    ("roce", ["roce", "return on capital"]), ("ronw", ["ronw", "return on net worth"]),
]
MONEY_LABEL_WORDS = [
    ("revenueFromOperations", ["revenue"], "growth"), ("totalIncome", ["total income"], None),
    ("ebitda", ["ebitda"], "margin"), ("profitAfterTax", ["profit", "pat"], None), ("nav", ["nav", "net asset"], None),
]
