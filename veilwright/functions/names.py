"""Risk hints in column names."""

from __future__ import annotations

import re
from collections.abc import Iterable

# The vocabulary each score looks for, in its given order.
IDENTIFIER_KEYWORDS = [
    "id", "ssn", "passport", "driver", "license", "account", "number",
    "employee_id", "customer_id", "patient_id", "student_id", "uuid",
    "guid", "social_security", "tax_id", "national_id", "credit_card",
    "card_number", "iban", "bank_account", "phone", "mobile", "telephone",
    "email", "address", "full_name", "name", "first_name", "last_name",
]
HIGH_RISK_KEYWORDS = [
    "salary", "income", "revenue", "financial", "credit_score", "debt",
    "balance", "transaction", "payment", "medical_record", "diagnosis",
    "treatment", "disease", "health", "medical", "psychiatric", "therapy",
    "hiv", "aids", "cancer", "disability", "password", "pin", "secret",
    "security_answer", "biometric", "fingerprint", "retinal", "dna",
    "genetic", "sexual_orientation", "religion", "political", "union",
]
LOW_RISK_KEYWORDS = [
    "age", "gender", "marital_status", "education", "occupation",
    "employment", "department", "title", "hobby", "interest",
    "preference", "purchase_history", "browsing_history", "cookie",
]
QUASI_KEYWORDS = [
    "zip", "postal", "birth", "date", "location", "city", "state",
    "country", "region", "area", "coordinate", "latitude", "longitude",
    "ip_address", "mac_address", "device_id", "browser", "operating_system",
]
WHOLE_WORD_SCORE = 1.0
SUBSTRING_SCORE = 0.7


def keyword_score(column_name: str, keywords: Iterable[str], normalize_keywords: bool = False) -> float:
    """1.0 for a whole-word hit, 0.7 for a hit inside a word, else 0.

    Separators in the name count as spaces. Keywords keep their underscores, so
    multi-word ones never hit, unless ``normalize_keywords`` is set.
    """
    name = re.sub("[_-]", " ", column_name.lower())
    wanted = [k.replace("_", " ") if normalize_keywords else k for k in keywords]
    hits = [k for k in wanted if k in name]
    if any(re.search(rf"\b{re.escape(k)}\b", name) for k in hits):
        return WHOLE_WORD_SCORE
    return SUBSTRING_SCORE if hits else 0.0
