"""Word lists and mappings that results depend on."""

# Devanagari letters, signs and words.
DEVANAGARI = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ng",
    "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "ny",
    "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n",
    "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n",
    "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m",
    "य": "y", "र": "r", "ल": "l", "व": "v", "श": "sh",
    "ष": "sh", "स": "s", "ह": "h", "क्ष": "ksh", "त्र": "tr", "ज्ञ": "gy",
    "अ": "a", "आ": "aa", "इ": "i", "ई": "ee", "उ": "u", "ऊ": "oo",
    "ऋ": "ri", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au",
    "ा": "a", "ि": "i", "ी": "i", "ु": "u", "ू": "u",
    "ृ": "ri", "े": "e", "ै": "ai", "ो": "o", "ौ": "au",
    "ं": "n", "ँ": "n", "ः": "h", "्": "",
    "प्राइवेट": "private", "लिमिटेड": "limited", "एलएलपी": "llp",
    "कंपनी": "company", "इंटरप्राइजेज": "enterprises", "ट्रेडर्स": "traders",
}
# Gujarati letters, signs and words.
GUJARATI = {
    "ક": "k", "ખ": "kh", "ગ": "g", "ઘ": "gh", "ઙ": "ng",
    "ચ": "ch", "છ": "chh", "જ": "j", "ઝ": "jh", "ઞ": "ny",
    "ટ": "t", "ઠ": "th", "ડ": "d", "ઢ": "dh", "ણ": "n",
    "ત": "t", "થ": "th", "દ": "d", "ધ": "dh", "ન": "n",
    "પ": "p", "ફ": "ph", "બ": "b", "ભ": "bh", "મ": "m",
    "ય": "y", "ર": "r", "લ": "l", "વ": "v", "શ": "sh",
    "ષ": "sh", "સ": "s", "હ": "h", "ળ": "l",
    "અ": "a", "આ": "aa", "ઇ": "i", "ઈ": "ee", "ઉ": "u", "ઊ": "oo",
    "એ": "e", "ઐ": "ai", "ઓ": "o", "ઔ": "au",
    "ા": "a", "િ": "i", "ી": "i", "ુ": "u", "ૂ": "u",
    "ે": "e", "ૈ": "ai", "ો": "o", "ૌ": "au",
    "ં": "n", "્": "",
    "કન્સ્ટ્રક્શન્સ": "constructions", "લિમિટેડ": "limited",
}
# Country names and their aliases.
COUNTRIES = {
    "us": "US", "usa": "US", "united states": "US", "united states of america": "US",
    "india": "India", "ind": "India", "in": "India", "france": "France", "fr": "France",
}
# Legal forms, in the order in which they are taken out of a name, with the phrases that stand for them.
LEGAL_FORMS = [
    ("sasu", ["societe par actions simplifiee unipersonnelle", "sasu"]),
    ("sas", ["societe par actions simplifiee", "s a s", "sas"]),
    ("sarl", ["societe a responsabilite limitee", "s a r l", "sarl"]),
    ("sci", ["societe civile immobiliere", "sci"]),
    ("sa", ["societe anonyme", "s a", "sa"]),
    ("eurl", ["entreprise unipersonnelle a responsabilite limitee", "eurl"]),
    ("gie", ["groupement d interet economique", "gie"]),
    ("snc", ["societe en nom collectif", "snc"]),
    ("ei", ["entreprise individuelle", "ei"]),
    ("pvt ltd", ["private limited", "pvt limited", "private ltd", "pvt ltd", "pvtltd"]),
    ("llp", ["limited liability partnership", "llp"]),
    ("ltd", ["public limited", "public ltd"]),
    ("llc", ["limited liability company", "llc", "pllc"]),
    ("inc", ["incorporated", "inc"]),
    ("corp", ["corporation", "corp"]),
    ("lp", ["limited partnership", "lp", "l p"]),
    ("co", ["company", "co"]),
]
# Single words that are legal forms, if they are left over. Multi-word forms can't be met there.
LEGAL_WORDS = {
    "pvtltd": "pvt ltd", "private": "pvt", "pvt": "pvt", "limited": "ltd", "ltd": "ltd", "llp": "llp",
    "incorporated": "inc", "corporation": "corp", "corp": "corp", "inc": "inc", "llc": "llc", "pllc": "pllc",
    "company": "co", "co": "co", "lp": "lp", "sasu": "sasu", "sas": "sas", "sarl": "sarl", "sci": "sci",
    "eurl": "eurl", "sa": "sa", "freres": "freres",
}
# Abbreviations in addresses.
STREET_WORDS = {
    "st": "street", "saint": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue",
    "blvd": "boulevard", "bvd": "boulevard", "bd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court",
    "pl": "place", "cir": "circle", "pkwy": "parkway", "pky": "parkway", "hwy": "highway", "expy": "expressway",
    "ste": "suite", "apt": "apartment", "bldg": "building", "fl": "floor", "flr": "floor", "unit": "unit",
    "dept": "department", "ngr": "nagar", "mrg": "marg", "sec": "sector", "ph": "phase", "nr": "near",
    "opp": "opposite", "dist": "district", "tq": "taluk", "r": "rue", "all": "allee", "imp": "impasse",
}
# States of one word and their codes (names of two words can't be met in a single token).
STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co",
    "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id",
    "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la",
    "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms",
    "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "ohio": "oh", "oklahoma": "ok",
    "oregon": "or", "pennsylvania": "pa", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt",
    "virginia": "va", "washington": "wa", "wisconsin": "wi", "wyoming": "wy",
}
# Words too common in business names to find candidates by.
COMMON_TOKENS = [
    "and", "the", "of", "in", "for", "with", "at", "by", "from",
    "inc", "corp", "llc", "ltd", "pvt", "limited", "company", "co",
    "services", "solutions", "enterprises", "associates", "group",
    "technologies", "international", "global", "national", "management",
    "consulting", "holding", "holdings", "industries", "systems", "trading",
]
# Patterns, in the syntax that Java and RE2 share.
DBA = r"^(.*?)\s+(?:dba|fka|formerly|aka|d/b/a|t/a|trading as)\s*[:\-]?\s*(.*)$"
DOMAIN = r"\.(?:com|org|net|in|co\.in|fr|io|biz|info)$"
POSTAL = r"\b(?:\d{5}(?:-\d{4})?|\d{6})\b"
BUILDING = r"^\s*#?\s*(\d+[a-z]?|\d+-\w+)\b"
INDIC = r"[\x{0900}-\x{097F}\x{0A80}-\x{0AFF}]"
DEVANAGARI_RANGE = r"[\x{0900}-\x{097F}]"
GUJARATI_RANGE = r"[\x{0A80}-\x{0AFF}]"
ACCENTS = "[àâäéèêëîïôöùûüÿçÀÂÄÉÈÊËÎÏÔÖÙÛÜŸÇ]"
