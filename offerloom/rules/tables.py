"""Which row label means which metric."""

from ..functions import rx

# Markdown tables, first rule first.
STATEMENT_METRICS = [
    ("revenueFromOperations", r"(?i)revenue\s+from\s+operations"),
    ("totalIncome", r"(?i)total\s+income"),
    ("ebitda", rx(r"(?i)\bebitda\b(?!\s*margin)")),
    ("profitAfterTax", r"(?i)profit\s*(?:/\s*\(loss\))?\s*(?:for the (?:year|period)|after tax)|restated\s+profit"),
    ("netWorth", r"(?i)net\s+worth|total\s+equity"),
    ("totalBorrowings", r"(?i)total\s+borrowings?"),
    ("basicEPS", r"(?i)basic.*(?:earning|eps)|earnings?\s+per\s+(?:equity\s+)?share"),
    ("ronw", r"(?i)return\s+on\s+net\s+worth"),
    ("netAssetValue", r"(?i)net\s+asset\s+value"),
]
RATIO_METRICS = [
    ("roce", rx(r"(?i)\broce\b|return\s+on\s+capital\s+employed")),
    ("ronw", rx(r"(?i)\bronw\b|return\s+on\s+net\s+worth")),
    ("roe", rx(r"(?i)\broe\b|return\s+on\s+equity")),
    ("debtEquity", r"(?i)debt[\s/-]*(?:to\s*)?equity"),
    ("ebitdaMargin", r"(?i)ebitda\s*margin"),
    ("patMargin", r"(?i)pat\s*margin|net\s*profit\s*margin"),
    ("grossMargin", r"(?i)gross\s*(?:profit\s*)?margin"),
    ("priceToBook", r"(?i)price\s*to\s*book|p\s*/\s*bv"),
    ("currentRatio", r"(?i)current\s+ratio"),
    ("nav", r"(?i)net\s+asset\s+value|nav\s+per"),
    ("eps", rx(r"(?i)earnings?\s+per\s+share|\beps\b")),
]

# Positioned items, by words that must all occur in the label; first alias first.
# Aliases with '.*', '/', '-' or a full stop never match, because labels lose punctuation.
ITEM_STATEMENT_METRICS = [
    ("totalAssets", ["total assets", "total equity and liabilities", "balance sheet total"]),
    ("totalIncome", ["total income"]),
    ("revenueFromOperations", ["revenue from operations", "revenue from operation", "i. revenue"]),
    ("ebitda", ["ebitda", "earnings before interest"]),
    ("profitBeforeTax", ["profit before tax", "profit/(loss) before tax", "profit before exceptional"]),
    ("profitAfterTax", [
        "profit/(loss) for the period", "profit for the period", "profit after tax",
        "profit/ (loss) for the period", "net profit", "xi. profit",
    ]),
    ("netWorth", ["total equity", "total shareholder", "net worth"]),
    ("reservesAndSurplus", ["reserves and surplus", "reserves & surplus"]),
    ("shareCapital", ["share capital"]),
    ("totalBorrowings", ["total borrowings"]),
    ("longTermBorrowings", ["long-term borrowings", "long term borrowings"]),
    ("shortTermBorrowings", ["short-term borrowings", "short term borrowings"]),
    ("depreciation", ["depreciation and amortization", "depreciation"]),
    ("financeCosts", ["finance costs", "finance cost"]),
    ("basicEPS", ["basic.*eps", "basic.*earning.*share", "earning.*share", "basic"]),
    ("dilutedEPS", ["diluted.*eps", "diluted.*earning.*share"]),
    ("ronw", ["return on net worth", "ronw"]),
    ("netAssetValue", ["net asset value", "nav per share"]),
]
ITEM_RATIO_METRICS = [
    ("roce", ["return on capital employed", "roce"]),
    ("ronw", ["return on net worth", "ronw"]),
    ("roe", ["return on equity", "roe"]),
    ("debtEquity", ["debt.*equity", "debt equity"]),
    ("ebitdaMargin", ["ebitda margin"]),
    ("patMargin", ["pat margin", "net profit margin"]),
    ("grossMargin", ["gross margin", "gross profit margin"]),
    ("priceToBook", ["price to book", "p/bv", "price/book"]),
    ("currentRatio", ["current ratio"]),
    ("nav", ["net asset value", "nav per"]),
    ("eps", ["earnings per share", "eps"]),
]

# Fields of one page of positioned items, first rule first.
ITEM_FIELDS = [
    (r"(?i)revenue from operations", "revenueFromOperations"),
    (r"(?i)total\s+income", "totalIncome"),
    (r"(?i)net\s+profit\s+(?:for|after)", "netProfit"),
    (r"(?i)profit\s+after\s+tax", "netProfit"),
    (rx(r"(?i)pat\b"), "netProfit"),
    (r"(?i)ebitda", "ebitda"),
    (r"(?i)basic\s+earn", "basicEPS"),
    (r"(?i)diluted\s+earn", "dilutedEPS"),
    (r"(?i)net\s+asset\s+value\s+per\s+share", "navPerShare"),
    (r"(?i)net\s+worth", "netWorth"),
    (r"(?i)total\s+borrowings?", "totalBorrowings"),
    (r"(?i)equity\s+share\s+capital", "equityShareCapital"),
    (r"(?i)return\s+on\s+net\s+worth", "ronw"),
    (r"(?i)ronw", "ronw"),
    (r"(?i)p\s*/\s*e\s*ratio", "peRatio"),
    (r"(?i)debt\s*[/-]\s*equity", "debtToEquity"),
]
ITEM_YEAR = r"(?i)(?:march|sep|june?|dec)\w*\s*\d{2,4}|fy\s*\d{2,4}|20\d{2}[-–]\d{2,4}"
MONTH = rx(
    r"(?i)\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?"
    r"|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\w*\b"
)
YEAR = rx(r"\b20\d{2}\b")
HOLDING_ROW = r"(?i)total.*promoter|promoter.*total"
