"""Wording of share structures, parties, promoters, objects and lots."""

from ..functions import rx

# Label cells of share-structure tables.
SHARE_LABELS = {
    "totalIssueShares": [rx(r"(?i)^total\s+(?:issue|offer)\s+size\b")],
    "freshIssueShares": [rx(r"(?i)^\(?\s*i?\s*\)?\s*fresh\s+(?:issue|offer)(?:\s+size)?\b")],
    "ofsShares": [rx(r"(?i)^\(?\s*i{0,2}\s*\)?\s*offer\s+for\s+sale\b")],
    "marketMakerShares": [
        rx(r"(?i)market\s+maker\s+reservation\s+portion\b"),
        rx(r"(?i)^(?:issue|offer)\s+reserved\s+for\s+the\s+market\s+makers?\b"),
        rx(r"(?i)^reservation\s+for\s+(?:the\s+)?market\s+makers?\b"),
    ],
    "employeeReservationShares": [rx(r"(?i)employee\s+reservation\s+portion\b")],
    "netOfferShares": [r"(?i)^net\s+(?:issue|offer)(?:\s+to\s+(?:the\s+)?public)?(?:\s*\(\d+\))?\s*$"],
    "preIssueShares": [
        r"(?i)equity\s+shares\s+outstanding\s+prior\s+to\s+the\s+(?:issue|offer)",
        rx(r"(?i)^pre[\s-]*(?:issue|offer)\s+(?:paid[\s-]*up\s+)?(?:equity\s+)?(?:share\s+)?capital\b"),
    ],
    "postIssueShares": [
        r"(?i)equity\s+shares\s+outstanding\s+after\s+the\s+(?:issue|offer)",
        rx(r"(?i)^post[\s-]*(?:issue|offer)\s+(?:paid[\s-]*up\s+)?(?:equity\s+)?(?:share\s+)?capital\b"),
    ],
}
# The same fields in running text; group 1 is the number.
SHARE_PROSE = {
    "totalIssueShares": r"(?i)total\s+(?:issue|offer)\s+size[^\d]{0,40}?(?:up\s*to\s+)?([\d,]{5,})\s+equity\s+shares",
    "freshIssueShares": r"(?i)(?:the\s+)?fresh\s+(?:issue|offer)\s+of\s+(?:up\s*to\s+)?([\d,]{5,})\s+equity\s+shares",
    "marketMakerShares": r"(?i)([\d,]{4,})\s+equity\s+shares[^.]{0,90}?reserved\s+for\s+subscription\s+by\s+(?:the\s+)?market\s+maker",
    "employeeReservationShares": r"(?i)([\d,]{4,})\s+equity\s+shares[^.]{0,90}?reserved\s+for\s+subscription\s+by\s+(?:the\s+)?(?:eligible\s+)?employees",
    "netOfferShares": r"(?i)(?:issue|offer)\s+less\s+the\s+market\s+maker\s+reservation\s+portion(?:\s+and\s+(?:the\s+)?employee\s+reservation\s+portion)?[^\d]{0,40}?(?:i\.?\s*e\.?|of)\s+(?:up\s*to\s+)?([\d,]{5,})\s+equity\s+shares",
    "preIssueShares": r"(?i)equity\s+shares\s+outstanding\s+prior\s+to\s+the\s+(?:issue|offer)[^\d]{0,30}?([\d,]{5,})",
    "postIssueShares": r"(?i)equity\s+shares\s+outstanding\s+after\s+the\s+(?:issue|offer)[^\d]{0,30}?(?:up\s*to\s+)?([\d,]{5,})",
}
# A word that each pattern of running text needs, in lower case.
PROSE_WORD = {
    "totalIssueShares": "size", "freshIssueShares": "fresh", "marketMakerShares": "reserved", "employeeReservationShares": "reserved",
    "netOfferShares": "less", "preIssueShares": "outstanding", "postIssueShares": "outstanding",
}
# Surveyed limits; the operators take them as arguments and read everything by default.
LABEL_CHARS = 80
SHARES_IN_ROW = r"(?i)([\d][\d,]{3,})\s*[*^]?\s*(?:equity\s+)?shares"
LEAST_SHARES = 1000

OFS_ONLY = (
    r"(?i)through\s+an\s+offer\s+for\s+sale|solely\s+through\s+an\s+offer\s+for\s+sale"
    r"|will\s+not\s+receive\s+any\s+proceeds\s+from\s+the\s+offer"
)
OFS_NIL = (
    r"(?i)(ofs\s+size\s+nil|entire\s+(?:issue|offer)\s+constitutes\s+fresh"
    r"|offer\s+for\s+sale[^.]{0,20}(?:nil|not\s+applicable))"
)
FIXED_PRICE = r"(?i)fixed\s+price\s+(?:issue|offer)|100%\s+fixed\s+price"
BOOK_BUILT = r"(?i)book\s*build"
VENUES = [
    (rx(r"(?i)\bBSE\s*SME\b|SME\s+platform\s+of\s+BSE"), "BSE SME"),
    (rx(r"(?i)\bNSE\s+EMERGE\b|emerge\s+platform\s+of\s+(?:the\s+)?(?:national\s+stock\s+exchange|nse)"), "NSE SME"),
    (rx(r"\bBSE\b"), "BSE"),
    (rx(r"\bNSE\b"), "NSE"),
]
MARKET_MAKER_NAMES = [
    r"(?i)([A-Z][A-Za-z&.\s]{3,45}?(?:private\s+)?limited)\s+will\s+act\s+as\s+the\s+market\s+maker",
    r"(?i)market\s+maker[^.]{0,60}?being\s+([A-Z][A-Za-z&.\s]{3,45}?limited)",
]

# Parties.
PARTY_NAME = r"[A-Za-z][A-Za-z0-9&.,'’() -]{3,80}?\b(?:Private\s+Limited|Limited|Ltd\.?|LLP)"
PARTY_ROLES = {
    "lead_manager": r"(?:book\s+running\s+)?lead\s+managers?\s*(?:to\s+the\s+(?:issue|offer))?\s*[,:]?\s*(" + PARTY_NAME + ")",
    "registrar": r"registrar\s+(?:and\s+share\s+transfer\s+agent\s+)?to\s+the\s+(?:issue|offer)\s*[/,:]?\s*(" + PARTY_NAME + ")",
}
PHONE = r"(?:tel(?:ephone)?\.?\s*(?:no\.?)?|phone|mobile)\s*[:.]?\s*(\+?\d[\d\s().-]{6,16}\d)"
PHONE_AFTER, PHONE_BEFORE = 300, 220
OFFICE = (
    r"(?i)registered\s+office\s*:\s*(.+?)\s*(?:tel\b|telephone|website|e-?mail|contact\s+person"
    r"|corporate\s+office|corporate\s+identity)"
)
OFFICE_BLOCK = 700

# Promoters: pattern and the kind of place it stands for.
_END = (
    r"(?:details|initial|the\s+(?:issue|offer|company)|general|acting|for\s+(?:cash|the|further)|will\s+not"
    r"|offer\s+(?:for|size|to)|issue\s+of|aggregating|hereinafter|and\s+the\s+net|type|name\s+of|shall\s+be"
    r"|and\s+statutory|being\s+(?:sold|made)|up\s+to|out\s+of|[|]\s)"
)
_COVER_NAMES = r"([A-Z][A-Za-z\s,.&()/]+?)(?=\s+(?:" + _END + "))"
_OF_COMPANY = r"of\s+(?:our\s+|the\s+)?company"
PROMOTER_PATTERNS = [
    (r"(?i)(?:promoters?|promoter\s+s)\s+" + _OF_COMPANY + r"\s*[:;]\s*" + _COVER_NAMES, "cover"),
    (r"(?i)(?:the\s+)?promoters?\s+" + _OF_COMPANY + r"\s+are\s+" + _COVER_NAMES, "cover"),
    (r"(?i)(?:promoters?|promoter\s+s)\s+" + _OF_COMPANY + r"\s+(?!are\s)" + _COVER_NAMES, "cover"),
    (r"(?i)name\s+of\s+the\s+promoters?\s+" + _OF_COMPANY + r"\s+" + _COVER_NAMES, "cover"),
    (
        r"(?i)promoter\(?s?\)?\s*\|\s*the\s+promoters?\s+" + _OF_COMPANY
        + r",?\s*being\s+([A-Za-z\s,.&()]+?)(?:\.\s*(?:for|see|\|)|\.(?:f|F)or|\.(?:s|S)ee|\.\|)",
        "glossary",
    ),
    (r"(?i)promoters?\s*\|\s*([A-Z][A-Za-z\s,.&]{8,}?\s[A-Za-z][A-Za-z\s,.&]+?)\.\s*(?:\|)", "glossary"),
    (r"(?i)our\s+promoters?\s*:\s*([A-Z][A-Z\s,.&]{5,}?)(?=\s*(?:\||details|the\s+issue|initial|offer))", "heading"),
    (
        r"(?i)our\s+promoters?\s+(?:are|is)\s+([A-Z][A-Za-z\s,.&()]{3,120}?)"
        r"(?:\.\s+(?:for|as\s+on|the\s+words|and\s+has|and\s+our|in))",
        "prose",
    ),
    (r"(?i)present\s+promoters?\s+" + _OF_COMPANY + r"\s+are\s+([A-Z][A-Za-z\s,.&]{3,80}?)(?:\.\s)", "present"),
    (r"(?i)promoters?\s+" + _OF_COMPANY + r"\s*:\s*the\s+issue\s*\|\s*([A-Z][A-Z\s,.&]{5,}?)(?=\s*\|)", "table-cell"),
]

# Objects of the issue.
OBJECT_HINT = (
    r"(?i)working\s+capital|corporate\s+purpose|re-?payment|pre-?payment|capital\s+expenditure|manufactur"
    r"|setting\s+up|offer\s+related\s+expense|issue\s+related\s+expense|inorganic|acquisition|brand|marketing"
)
GENERAL_PURPOSE = r"(?i)general\s+corporate\s+purpose"
OBJECT_META = rx(r"(?i)^(?:net\s+(?:issue\s+)?proceeds|gross\s+proceeds|less\s*:|total\b|net\s+offer)")
OBJECT_TOTAL = rx(r"(?i)^total\b")
OBJECT_LIST_HEAD = r"(?i)following\s+objects?\s*[:\-]"
OBJECT_LIST_ITEM = rx(r"\b\d+\.\s+([A-Z][^;|]{8,140}?)(?:;|\.\s|\|)")
OBJECT_LIST_SPAN = 1500
UNIT_LAKH = r"(?i)amount[^.]{0,30}?(?:in\s*)?(?:rs\.?|₹|inr)?\s*(?:in\s*)?lakh"
UNIT_CRORE = r"(?i)amount[^.]{0,30}?(?:in\s*)?(?:rs\.?|₹|inr)?\s*(?:in\s*)?crore"

# Lots.
LOT_SIZE = rx(r"(?i)(?:minimum\s+(?:of\s+)?|lot\s+(?:of\s+)?)?(\d{2,5})\s*(?:equity\s+)?shares\b")
LOT_CATEGORIES = ["Retail", "S-HNI", "B-HNI", "HNI"]
LOT_TYPES = ["Min", "Max"]
RETAIL_CAP = 200_000
SMALL_HNI_CAP = 1_000_000
SME_LOTS = 2
