"""Patterns, word lists and tables that decide results.

All patterns work alike in Python's ``re`` and in Spark's Java engine: word
boundaries and digits are spelled out as ASCII, and white space as the set below.
"""

# White space, including the no-break space and the byte order mark.
SPACE = "\t\n\x0b\x0c\r " + "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
S = f"[{SPACE}]"
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
END = r"\z"  # Java's end of input; Python code replaces it

# Contact details.
PHONE = rf"(?<![0-9])(?:\+?1[-.{SPACE}]?)?\(?[0-9]{{3}}\)?[-.{SPACE}][0-9]{{3}}[-.{SPACE}][0-9]{{4}}(?![0-9])"
EMAIL = rf"(?i){EDGE}[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}{EDGE}"

# Words that stand for a missing value, when they are all of it.
PLACEHOLDER = r"(?i)^(?:n/?a|none|unknown|not (?:listed|disclosed|available|provided)|—|-)\z"

# Ends of company names.
ENTITY_END = rf"(?i){EDGE}(?:L\.?{S}*L\.?{S}*C\.?|I\.?{S}*N\.?{S}*C\.?|INCORPORATED|CORP(?:ORATION)?\.?|LTD\.?|LIMITED|L\.?{S}*P\.?|L\.?{S}*L\.?{S}*P\.?|LLP|COMPANY|CO\.?){EDGE}"
BRAND_ENTITY_END = rf"(?i){EDGE}(?:L\.?{S}*L\.?{S}*C\.?|LLC|L\.?{S}*P\.?|LP|L\.?{S}*L\.?{S}*P\.?|LLP|I\.?{S}*N\.?{S}*C\.?|INCORPORATED|CORP(?:ORATION)?|LTD|LIMITED){EDGE}"
SHORT_ENTITY_END = rf"(?i){EDGE}(?:LLC|L\.L\.C\.?|INC\.?|CORP\.?|LTD\.?|LP|LLP){EDGE}"
ENTITY_WORD = rf"(?i){EDGE}(?:llc|inc|corp|company|co|ltd|lp|llp|holdings|enterprises|ventures){EDGE}"
BUSINESS_WORD = rf"(?i)[0-9]|@|(?:LLC|L\.L\.C|INC|CORP|COMPANY|CO\.|LTD|LP|LLP|HOLDINGS|ENTERPRISES|VENTURES|FITNESS|STUDIO){EDGE}"
HEADER_OR_NOTE = rf"(?i)^(?:current|former|planning|franchisees?|franchisee name|owner|primary contact|phone|email|address|city|state|zip|location|store|studio|territory|total|notes?|continued|exhibit|item{S}*20){EDGE}"
DOCUMENT_WORDS = r"(?i)table of contents|franchise disclosure document|see notes? below"

# Phrases that name a kind of list.
BOTH_LISTS = r"(?i)current and former franchisees"
PLANNED_LIST = r"(?i)pre-open studios|signed but not open|signed agreements? but (?:have )?not yet opened|not yet opened(?: for business)?|franchises sold but not yet opened|franchise agreements signed but outlet not yet opened"
FORMER_LIST = r"(?i)former franchisees|former franchisee|ceased operations|franchisees who (?:have )?left|terminated franchisees|terminated franchise agreements|exited domestic franchisees"
CURRENT_LIST = r"(?i)open studios|current franchisees|list of (?:open |current )?franchisees|franchisees with outlets open|below is a list of our current franchisees"
LIST_START = (
    r"(?i)^(?:OPEN STUDIOS|PRE-OPEN STUDIOS|LIST OF FRANCHISE(?:S|ES| AGREEMENTS)|LIST OF (?:CURRENT|FORMER) FRANCHISEES|LIST OF TERMINATED FRANCHISE AGREEMENTS|LIST OF EXITED DOMESTIC FRANCHISEES"
    rf"|BELOW IS A LIST OF OUR CURRENT FRANCHISEES{EDGE}|CONTACT INFORMATION FOR|CURRENT FRANCHISEES|FORMER FRANCHISEES|FRANCHISEES WHO (?:HAVE )?LEFT|FRANCHISEES WITH OUTLETS OPEN|SIGNED BUT NOT OPEN|CEASED OPERATIONS|TERMINATED FRANCHISEES|FORMER STUDIO{EDGE})"
)
PLANNED_HEADING = rf"^(?:(?:FRANCHISEES +)?SIGNED BUT NOT OPEN|FRANCHISEES WHO HAVE SIGNED AGREEMENTS BUT HAVE NOT YET OPENED|LIST OF FRANCHISES SOLD BUT NOT YET OPENED|LIST OF FRANCHISE AGREEMENTS SIGNED BUT OUTLET NOT YET OPENED){EDGE}"
FORMER_HEADING = rf"^(?:CEASED OPERATIONS|FRANCHISEES WHO (?:HAVE )?LEFT|FORMER FRANCHISEES|TERMINATED FRANCHISEES|LIST OF TERMINATED FRANCHISE AGREEMENTS|LIST OF EXITED DOMESTIC FRANCHISEES){EDGE}"
CURRENT_HEADING = rf"^(?:CURRENT FRANCHISEES|LIST OF (?:OPEN|CURRENT) FRANCHISEES|FRANCHISEES WITH OUTLETS OPEN){EDGE}"
LOCATION_LIST = r"(?i)LIST OF (?:OPEN |CURRENT )?FRANCHISEES|CURRENT FRANCHISEES|FRANCHISEES WITH OUTLETS OPEN|FRANCHISEES WHO (?:HAVE )?LEFT|FORMER FRANCHISEES|SIGNED BUT NOT OPEN|LIST OF CURRENT .+ FORMER FRANCHISEES|BELOW IS A LIST OF OUR CURRENT FRANCHISEES"

# Page ranges and labels.
RANGE_TAIL = r"(?i)(?:\.{2,}| )([0-9]{1,4})(?: *(?:-|–|—|to) *([0-9]{1,4}))? *\z"
DOTTED_RANGE_TAIL = r"(?i)\.{2,} *[0-9]+(?: *(?:-|–|—|to) *[0-9]+)? *\z"
FOOTER_LABEL = rf"(?i)(?:{EDGE}page{S}*)?(?:[A-Z][A-Z -]{{0,16}}[-–—]{S}*)?([0-9]{{1,4}}){EDGE}"
EXHIBIT_LINE = rf"(?i)^(?:EXHIBIT{EDGE}|EX\.) *([A-Z0-9-]+){EDGE}"

# The 50 states and the capital's district.
US_STATES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA", "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE", "Florida": "FL", "Georgia": "GA",
    "Hawaii": "HI", "Idaho": "ID", "Illinois": "IL", "Indiana": "IN", "Iowa": "IA", "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD",
    "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN", "Mississippi": "MS", "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV", "New Hampshire": "NH",
    "New Jersey": "NJ", "New Mexico": "NM", "New York": "NY", "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR", "Pennsylvania": "PA",
    "Rhode Island": "RI", "South Carolina": "SC", "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA", "Washington": "WA",
    "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY", "District of Columbia": "DC",
}
STATE_NAMES = "|".join(sorted(US_STATES, key=len, reverse=True))
STATE_ONLY = rf"(?i)^(?:[A-Z]{{2}}|{STATE_NAMES})\z"
STATE_ZIP = rf"(?i){EDGE}([A-Z]{{2}}|{STATE_NAMES}) +([0-9]{{5}}(?:-[0-9]{{4}})?){EDGE}"
CITY_STATE_ZIP_CELL = rf"(?i)^(.+?), *([A-Z]{{2}}|{STATE_NAMES}) +([0-9]{{5}}(?:-[0-9]{{4}})?){EDGE}"
CITY_STATE_ZIP = r"^(.+?), *([A-Z]{2}) +([0-9]{5}(?:-[0-9]{4})?)\z"
TERRITORY = r"^(.+?), *([A-Z]{2})(?: +(?:\(.*\)|[-–—].*))?\z"
ADDRESS_LINE = rf"(?i)^(?:(.+?), *)?([^,]+), *([A-Z]{{2}}|{STATE_NAMES}) *,? *([0-9]{{5}}(?:-[0-9]{{4}})?)(?: +.*)?\z"
# The states whose name before a ZIP makes a failed row count as rejected.
REJECTED_ROW = rf"(?i){EDGE}(?:[A-Z]{{2}}|Alabama|Alaska|Arizona|California|Florida|Georgia|Illinois|New York|North Carolina|Ohio|Pennsylvania|Texas|Virginia|Washington) +[0-9]{{5}}(?:-[0-9]{{4}})?{EDGE}"
EVIDENCE = rf"(?i)(?:{EDGE}(?:[A-Z]{{2}}|{STATE_NAMES}){S}+[0-9]{{5}}{EDGE}|{EDGE}[0-9]{{3}}[-.){SPACE}]+[0-9]{{3}}[-.{SPACE}]+[0-9]{{4}}{EDGE}|{EDGE}[A-Z]{{2}}[0-9]{{4}}{EDGE}|@[A-Z0-9.-]+\.[A-Z]{{2,}})"
LOCATION_CODE = rf"(?i)(?:location|studio|store|territory|agreement){S}*(?:code|number|no\.?|#)?{S}*[:#-]?{S}*([a-z]{{0,4}}[0-9]{{2,8}}){EDGE}"

# Brands by pattern, first match wins.
BRANDS = (
    (rf"(?i){EDGE}HOTWORX{EDGE}", "HOTWORX"),
    (rf"(?i){EDGE}Elements{S}+Massage{EDGE}", "Elements Massage"),
    (rf"(?i){EDGE}Massage{S}+Envy{EDGE}", "Massage Envy"),
    (rf"(?i){EDGE}GYMGUYZ{EDGE}", "GYMGUYZ"),
    (rf"(?i){EDGE}Gold['’]?s{S}+Gym{EDGE}", "Gold’s Gym"),
    (rf"(?i){EDGE}Pure{S}+Barre{EDGE}", "Pure Barre"),
    (rf"(?i){EDGE}Modo{S}+Yoga{EDGE}", "Modo Yoga"),
    (rf"(?i){EDGE}Pvolve{EDGE}", "Pvolve"),
    (rf"(?i){EDGE}VIO{S}+Med{S}+Spa{EDGE}", "VIO Med Spa"),
    (rf"(?i){EDGE}dermani{S}+MEDSPA{EDGE}", "dermani MEDSPA"),
)
INVALID_BRAND = r"(?i)^(?:unknown|n/a|none|not +(?:provided|available|disclosed)|tbd)\z"
GENERIC_BRAND = r"(?i)^(?:uploaded +fdd|fdd|document|franchise +disclosure +document)\z"
BRAND_LABEL = rf"(?i){EDGE}franchisor{EDGE}{S}*(?::|-|{EDGE}is{EDGE}|{EDGE}means{EDGE}){S}*([^\r\n]+)"

# Abbreviations in addresses, applied in this order.
ADDRESS_WORDS = (
    ("street|str", "st"), ("avenue|ave", "ave"), ("road|rd", "rd"), ("boulevard|blvd", "blvd"), ("drive|dr", "dr"), ("lane|ln", "ln"), ("highway|hwy", "hwy"), ("suite|ste", "ste"),
    ("north", "n"), ("south", "s"), ("east", "e"), ("west", "w"),
)

# Review notes.
ISSUE_ADDRESS = "street address was not disclosed or could not be normalized"
ISSUE_GEO = "city/state is incomplete"
ISSUE_ENTITY = "franchisee or legal entity was not confidently identified"
ISSUE_ZIP = "ZIP code is missing or malformed"
NOTE_VERIFIED = "Complete row extracted from a verified text-based franchisee section"
NOTE_OCR = "Complete row requires review because OCR was used"
NO_ADDRESS = "Address not disclosed"
NO_CITY = "Not disclosed"
NO_TERRITORY = "Territory not disclosed"
AMBIGUOUS_CODE = "Possible duplicate: multiple records share this location or agreement code"
AMBIGUOUS_ADDRESS = "Possible duplicate: multiple records share this normalized address and geography"
AMBIGUOUS_ENTITY = "Possible duplicate: multiple records share this franchisee/entity and geography"
CONFLICTING_IDENTITY = "Identity conflict: location code and normalized address point to different records"
