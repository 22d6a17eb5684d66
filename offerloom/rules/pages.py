"""Wording that identifies sections, statement pages and ratio pages."""

from ..functions import rx

# Section → heading pattern; ^ binds to the start of a page.
SECTION_SIGNALS = {
    "financials": r"(?i)restated\s+financial|financial\s+statements?|profit\s+(and|&)\s+loss|balance\s+sheet",
    "risk-factors": rx(r"(?i)^risk\s+factors\b"),
    "objects-of-issue": rx(r"(?i)^objects?\s+of\s+the\s+(issue|offer)\b"),
    "capital-structure": rx(r"(?i)^capital\s+structure\b"),
    "management": rx(r"(?i)^our\s+management\b|board\s+of\s+directors"),
    "kpis": r"(?i)key\s+performance\s+indicator|basis\s+for\s+(the\s+)?(offer|issue)\s+price",
}

STATEMENT_SIGNALS = [
    r"(?i)revenue\s+from\s+operations",
    r"(?i)total\s+income",
    r"(?i)profit\s+(?:after\s+tax|for\s+the|/\s*\(loss\))",
    rx(r"(?i)\bebitda\b"),
    r"(?i)net\s+worth|total\s+equity",
    rx(r"(?i)earnings?\s+per\s+(?:equity\s+)?share|basic.*\beps\b"),
    rx(r"(?i)return\s+on\s+net\s+worth|\bronw\b"),
    r"(?i)restated",
    r"(?i)total\s+borrowings?",
    r"(?i)net\s+asset\s+value",
]
YEAR_HEADER = r"(?i)(?:march|sept?|june?|dec)\w*[, ]*\s*\d{2,4}|fy\s*\d{2,4}|20\d{2}\s*[-–]\s*\d{2,4}"
HAS_NUMBER = r"\d{2,}(?:[.,]\d+)?"

RATIO_SIGNALS = [
    rx(r"(?i)\broce\b|return\s+on\s+capital\s+employed"),
    rx(r"(?i)\broe\b|return\s+on\s+equity"),
    rx(r"(?i)return\s+on\s+net\s+worth|\bronw\b"),
    r"(?i)debt[\s/-]+equity",
    r"(?i)ebitda\s+margin",
    r"(?i)pat\s+margin|net\s+profit\s+margin",
    r"(?i)price\s+to\s+book|p\s*/\s*bv",
    r"(?i)current\s+ratio",
    r"(?i)net\s+asset\s+value|nav\s+per",
    r"(?i)(?:fixed\s+asset|inventory|debtor|receivable)\s+turnover",
]
RATIO_HEADING = r"(?i)key\s+performance\s+indicator"
PRICE_HEADING = r"(?i)basis\s+for\s+(?:the\s+)?(?:offer|issue)\s+price"
COVER_WORDS = r"(?i)selling\s+shareholder|draft\s+red\s+herring|offer\s+for\s+sale"
PERCENT = r"\d{1,3}(?:\.\d+)?\s*%"
DOT_LEADER = r"\.{4,}\s*\d{1,4}"

STATEMENT_PAGE = [rx(r"(?i)\brestated\b"), rx(r"(?i)\bprofit.*loss|balance sheet|financial statement")]
RATIO_PAGE = [rx(r"(?i)\b(?:return on|roce|ronw|roe|deb.*equity)\b"), "%"]

# Section → headings that name it in a table of contents.
CONTENTS_TARGETS = {
    "GENERAL_INFORMATION": ["general information"],
    "CAPITAL_STRUCTURE": ["capital structure", "capitalisation statement"],
    "OBJECTS_OF_THE_OFFER": [
        "objects of the offer", "objects of the issue", "object of the issue", "use of proceeds",
        "utilization of proceeds", "utilisation of net proceeds", "objects of the fresh issue",
    ],
    "BASIS_FOR_OFFER_PRICE": [
        "basis for offer price", "basis for issue price", "basis of offer price", "basis of issue price",
        "basis for the offer price", "basis for the issue price",
    ],
    "RESTATED_FINANCIAL_STATEMENTS": [
        "restated financial statement", "restated financial information",
        "restated consolidated financial statements", "restated consolidated financial information",
        "financial information", "audited financial statements",
    ],
    "RISK_FACTORS": ["risk factors"],
    "OUR_MANAGEMENT": ["our management"],
    "OUR_PROMOTERS_AND_PROMOTER_GROUP": ["our promoters and promoter group"],
    "DIVIDEND_POLICY": ["dividend policy"],
    "INDUSTRY_OVERVIEW": ["industry overview"],
    "OUR_BUSINESS": ["our business", "business overview"],
    "STATEMENT_OF_SPECIAL_TAX_BENEFITS": [
        "statement of special tax benefits", "statement of possible special tax benefits",
        "statement of tax benefits",
    ],
    "OTHER_FINANCIAL_INFORMATION": ["other financial information"],
    "STATEMENT_OF_FINANCIAL_INDEBTEDNESS": ["financial indebtedness"],
    "OUTSTANDING_LITIGATION": ["outstanding litigation"],
    "ISSUE_PROCEDURE": ["issue procedure", "terms of the issue", "terms of the offer"],
    "ISSUE_STRUCTURE": ["issue structure", "offer structure"],
    "OUR_GROUP_COMPANIES": ["our group companies", "our group company"],
    "KEY_REGULATIONS_AND_POLICIES": [
        "key regulations and policies", "key industry regulations", "government and other approvals",
        "government and other statutory approvals",
    ],
    "HISTORY_AND_CERTAIN_CORPORATE_MATTERS": [
        "history and certain corporate matters", "history and corporate structure",
    ],
    "ABOUT_THE_COMPANY": ["about the company", "about our company", "about company"],
}
