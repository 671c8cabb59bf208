"""Topic tags, controlled vocabularies and industry labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Topic patterns, matched case-insensitively.
TOPICS = {
    "Health": [r"health", r"medicare", r"medicaid", r"hospital", r"prescription", r"pharmaceutical", r"\bpharma\b", r"opioid", r"fentanyl", r"medical", r"physician", r"\bnurse", r"drug pric", r"mental health", r"affordable care"],
    "Taxes & Budget": [r"\btax(?:es|ation|payer|able)?\b", r"budget", r"appropriation", r"deficit", r"debt ceiling", r"\birs\b", r"fiscal", r"federal spending"],
    "Energy & Environment": [r"\benergy\b", r"\boil\b", r"pipeline", r"climate", r"emission", r"renewable", r"\bsolar\b", r"nuclear", r"environment", r"\bepa\b", r"drilling", r"power grid", r"natural gas", r"gasoline"],
    "Defense & Veterans": [r"defense", r"military", r"pentagon", r"\btroops\b", r"national security", r"missile", r"armed forces", r"\bnavy\b", r"\barmy\b", r"air force", r"veterans?", r"homeland security"],
    "Trade & Tariffs": [r"tariff", r"\btrade\b", r"\bimports?\b", r"\bexports?\b", r"supply chain", r"\bwto\b"],
    "Finance & Banking": [r"\bbank", r"wall street", r"financial", r"securities and exchange", r"\bcredit\b", r"mortgage", r"insurance", r"crypto", r"stablecoin", r"interest rate"],
    "Immigration": [r"immigration", r"immigrant", r"\bborder\b", r"migrant", r"asylum", r"deportation", r"\bdaca\b"],
    "Tech & Telecom": [r"broadband", r"internet", r"telecom", r"artificial intelligence", r"\bai\b", r"semiconductor", r"social media", r"spectrum", r"\bcyber", r"data privacy"],
    "Agriculture & Food": [r"\bfarm", r"agricultur", r"\bcrop", r"\branch", r"\bdairy", r"\busda\b", r"food security"],
    "Labor & Education": [r"\bjobs\b", r"\bworkers?\b", r"\bunion\b", r"\blabor\b", r"\bwage", r"\bschool", r"students?\b", r"education", r"teachers?\b", r"\bcollege", r"tuition"],
    "Transportation & Infrastructure": [r"infrastructure", r"highway", r"\btransit\b", r"\brail", r"airport", r"aviation", r"\bbridge", r"\broads?\b"],
    "Justice & Civil Rights": [r"\bcrime", r"\bpolice\b", r"\bjustice\b", r"\bcourt", r"\bguns?\b", r"second amendment", r"voting rights", r"civil rights", r"abortion", r"supreme court"],
    "Foreign Affairs": [r"foreign", r"israel", r"ukraine", r"\bchina\b", r"russia", r"\biran\b", r"\bnato\b", r"diplomacy", r"sanctions", r"taiwan"],
    "Government & Elections": [r"election", r"\bethics\b", r"shutdown", r"federal workforce", r"oversight", r"\bdoge\b"],
}
# Policy area to topic.
AREA_TOPICS = {
    "Health": "Health",
    "Taxation": "Taxes & Budget",
    "Economics and Public Finance": "Taxes & Budget",
    "Energy": "Energy & Environment",
    "Environmental Protection": "Energy & Environment",
    "Public Lands and Natural Resources": "Energy & Environment",
    "Water Resources Development": "Energy & Environment",
    "Armed Forces and National Security": "Defense & Veterans",
    "Foreign Trade and International Finance": "Trade & Tariffs",
    "International Affairs": "Foreign Affairs",
    "Finance and Financial Sector": "Finance & Banking",
    "Immigration": "Immigration",
    "Science, Technology, Communications": "Tech & Telecom",
    "Crime and Law Enforcement": "Justice & Civil Rights",
    "Law": "Justice & Civil Rights",
    "Civil Rights and Liberties, Minority Issues": "Justice & Civil Rights",
    "Government Operations and Politics": "Government & Elections",
    "Congress": "Government & Elections",
    "Education": "Labor & Education",
    "Labor and Employment": "Labor & Education",
    "Social Welfare": "Labor & Education",
    "Transportation and Public Works": "Transportation & Infrastructure",
    "Housing and Community Development": "Transportation & Infrastructure",
    "Agriculture and Food": "Agriculture & Food",
}
# Issue code to topic.
ISSUE_TOPICS = {
    "HCR": "Health",
    "MMM": "Health",
    "MED": "Health",
    "PHA": "Health",
    "TAX": "Taxes & Budget",
    "BUD": "Taxes & Budget",
    "ECN": "Taxes & Budget",
    "ENG": "Energy & Environment",
    "ENV": "Energy & Environment",
    "CAW": "Energy & Environment",
    "NAT": "Energy & Environment",
    "DEF": "Defense & Veterans",
    "HOM": "Defense & Veterans",
    "VET": "Defense & Veterans",
    "TRD": "Trade & Tariffs",
    "FIN": "Finance & Banking",
    "BAN": "Finance & Banking",
    "INS": "Finance & Banking",
    "IMM": "Immigration",
    "TEC": "Tech & Telecom",
    "CPT": "Tech & Telecom",
    "SCI": "Tech & Telecom",
    "COM": "Tech & Telecom",
    "AGR": "Agriculture & Food",
    "FOO": "Agriculture & Food",
    "LBR": "Labor & Education",
    "EDU": "Labor & Education",
    "TRA": "Transportation & Infrastructure",
    "AVI": "Transportation & Infrastructure",
    "MAR": "Transportation & Infrastructure",
    "HOU": "Transportation & Infrastructure",
    "LAW": "Justice & Civil Rights",
    "CIV": "Justice & Civil Rights",
    "FOR": "Foreign Affairs",
    "GOV": "Government & Elections",
    "CAM": "Government & Elections",
}
# Industry labels by parts of upper-case names, first match wins.
INDUSTRIES = {
    "Health/Pharma": ["HEALTH", "PHARMA", "MEDIC", "ONCOLOG", "HOSPITAL", "CLINIC", "LILLY", "CVS", "PFIZER", "BRIGHTSPRING", "HALOMD", "BIOTECH", "BIOSCI", "DRUG", "DIALYSIS", "NURS", "MERCK", "AMGEN", "ABBVIE"],
    "Energy/Utilities": ["ENERGY", "EXXON", "CHEVRON", " OIL", "GAS ", "ELECTRIC", "POWER", "NUCLEAR", "SOLAR", "UTILIT", "PETROLEUM"],
    "Telecom/Tech": ["TELECOM", "SPECTRUM", "BROADBAND", "WIRELESS", "SPACEX", "SATELLITE", "INTERNET", "AT&T", "VERIZON", "COMCAST", "T-MOBILE", "CHARTER", "CTIA", "SEMICONDUCT"],
    "Auto/Commerce": ["AUTO", "MOTOR", "VEHICLE", "SUBARU", "LKQ", "TOYOTA"],
    "Finance": ["BANK", "FINANC", "CAPITAL", "INSUR", "INVEST", "SECURITIES"],
}


def lede(title: Column, text: Column, chars: int = 500) -> Column:
    """Title and the first characters of the body: what topics are tagged on."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(F.substring(text, 1, chars), F.lit("")))


def topics_in(text: Column, topics: dict[str, list[str]] | None = None) -> Column:
    """All topics whose patterns occur, in the order of the table."""
    found = [F.when(text.rlike("(?iu)" + "|".join(p)), F.lit(t)) for t, p in (topics or TOPICS).items()]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for p in table.items() for x in p)), key)


def area_topic(area: Column) -> Column:
    return _lookup(AREA_TOPICS, F.trim(area))


def issue_topic(code: Column) -> Column:
    return _lookup(ISSUE_TOPICS, F.upper(F.trim(code)))


def first_label(name: Column, labels: dict[str, list[str]] | None = None, other: str = "Other") -> Column:
    """The first label one of whose parts occurs in the upper-cased name."""
    upper, out = F.upper(F.coalesce(name, F.lit(""))), F.lit(other)
    for label, parts in reversed(list((labels or INDUSTRIES).items())):
        test = F.lit(False)
        for p in parts:
            test = test | F.contains(upper, F.lit(p))
        out = F.when(test, F.lit(label)).otherwise(out)
    return out


# Fields that the ready-made plan is for, and words of a question that point to it.
PLAN_FIELDS = ["lobbying", "influence", "campaign-finance"]
PLAN_HINTS = [
    "lobby", "lobbying", "lobbyist", "influence", "campaign finance", "lda", "ld-203", "fara", "registrant", "revolving door", "pac", "contribution", "committee", "congress",
]


def plan_for(field: Column, question: Column) -> Column:
    """(plan, guessed): the plan of a stated field, which is its own name unless a ready-made one covers it; without a field, the question's words decide."""
    stated = F.trim(F.coalesce(field, F.lit("")))
    hinted = F.coalesce(question, F.lit("")).rlike(rf"(?iU)\b(?:{'|'.join(PLAN_HINTS)})\b")
    covered, guessed = F.lower(stated).isin(PLAN_FIELDS), (stated == "") & hinted
    plan = F.when(covered | guessed, F.lit(PLAN_FIELDS[0])).when(stated == "", F.lit("generic")).otherwise(stated)
    return F.struct(plan.alias("plan"), guessed.alias("guessed"))
