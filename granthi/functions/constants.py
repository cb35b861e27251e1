"""Word lists, replacement tables and patterns that decide results."""

# Replacements for frequent misreadings, applied in this order.
OCR_FIXES = (
    ("SEAT", "बैद्यनाथ"),
    ("का.मु.प्", ""),
    ("धानन्यायाधीश", "प्रधानन्यायाधीश"),
    ("प्रधानन्यायाधीश श्", "प्रधानन्यायाधीश श्री"),
    ("रीरी", "श्री"),
    ("काश", "प्रकाश"),
    ("प्रधानन्यायाधीश रीरी", "प्रधानन्यायाधीश श्री"),
    ("प्रधानन्यायाधीश श्, ी", "प्रधानन्यायाधीश श्री"),
    ("सम्माननीय का.मु.प्, धानन्यायाधीश", "प्रधानन्यायाधीश"),
    ("सम्माननीय का.मु.प्, प्रधानन्यायाधीश", "प्रधानन्यायाधीश"),
)
DEVANAGARI_DIGITS, ASCII_DIGITS = "०१२३४५६७८९", "0123456789"

# The phrases that decide a query's intent.
LIST_PHRASES = (
    "कुन कुन मुद्दा", "कुन-कुन मुद्दा", "कुन मुद्दा", "कस्ता मुद्दा",
    "मुद्दाको जानकारी", "के के मुद्दा", "कुन-कुन केस",
    "list of cases", "what cases", "available cases", "कुन-कुन मुद्दाको जानकारी",
    "what information do you have", "which cases", "cases information", "tell me about cases",
    "कुन-कुन मुद्दा छन्", "के के मुद्दा छन्",
)
SUMMARY_TERMS = (
    "summary", "summarize", "what was this case about", "case about",
    "सारांश", "सार", "मुद्दा के थियो", "मुद्दा के हो", "फैसला के थियो",
    "यो मुद्दा", "के सम्बन्धी", "विस्तृत जानकारी",
)
PROVISION_TERMS = ("section", "दफा", "धारा", "कानून", "ऐन", "नियम")
COMPARISON_TERMS = ("compare", "difference", "फरक", "तुलना")
RELATIVE_PRONOUNS = ("यस", "उक्त", "त्यस", "यो", "this", "said", "above", "सो")
CASE_KEYWORDS = ("निर्णय", "मुद्दा", "फैसला", "case", "decision", "नं")
FOLLOWUP_PRONOUNS = ("यो", "उक्त", "सो", "तो", "त्यो", "यस", "उस", "ती", "तिनी", "उनी")
CASE_REFERENCES = ("मुद्दा", "फैसला", "निर्णय", "केस")

# The words that decide a factual question's category.
REASONING_WORDS = ("तर्क", "निष्कर्ष", "दाबी", "खारेज", "सिद्धान्त", "कसरी", "के-के", "मुख्य", "सार", "भनेको", "किन", "आधार")
REASONING_EXCEPT = ("को-को", "को हुन्", "को हुनुहुन्छ", "मिति", "प्रकार")
LAWYER_WORDS = ("कानून व्यवसायी", "अधिवक्ता", "वकील", "बहस गर्ने")
JUDGE_WORDS = ("न्यायाधीश", "इजलास", "बेन्च", "हेर्नुभएको")
FACT_PROVISION_WORDS = ("धारा", "दफा", "प्रावधान")
PETITIONER_WORDS = ("निवेदक", "पुनरावेदक", "petitioner")
SUBJECT_KEYWORDS = ("उत्प्रेषण", "परमादेश", "बन्दीप्रत्यक्षीकरण", "अर्जी", "निवेदन")

# Answers.
NO_INFO = "माफ गर्नुहोस्, यस विषयमा उपलब्ध जानकारी छैन।"
NOT_IN_DOCUMENTS = "उपलब्ध कागजातमा यस प्रश्नको जानकारी छैन। कृपया अर्को प्रश्न सोध्नुहोस्।"
CASES_HEADING = "मसँग निम्न मुद्दाहरूको जानकारी छ:\n"
NO_CASES = "मसँग हाल कुनै मुद्दाको जानकारी उपलब्ध छैन।"

# The patterns by which questions name cases, files, numbers and provisions.
NAMED_DECISION = r"(?:निर्णय\s*नं\.?|decision\s*(?:no|number)|नं\.)\s*[०-९0-9]+"
NAMED_FILE = r"nkp[_\s-]*[०-९0-9]+"
DECISION_PATTERNS = (
    r"(?i)(?:निर्णय\s*नं\.?|decision\s*(?:no|number)|नं\.)\s*([0-9]{3,})",
    r"निर्णय\s*([0-9]{3,})",
    r"(?i)(?:case\s*(?:no|number)|cases\s*no)\s*[:. ]?\s*([0-9]{3,})",
    r"(?i)decision\s*(?:no|number)\s*[:. ]?\s*([0-9]{3,})",
)
SOURCE_FILE = r"(?i)(nkp[_\-][0-9]+(?:[_\-][0-9]+)?(?:[_\-]part[0-9]+)?\.pdf)"
SOURCE_STEM = r"(?i)(nkp[_\-][0-9]+(?:[_\-][0-9]+)?(?:[_\-]part[0-9]+)?)"
ANALYSED_SOURCE = r"(?i)nkp[-_\s]?\p{Nd}+[-_\s]?\p{Nd}+"
SOURCE_MARKS = r"[-_\s/]+"
ENTITY_TERMS = ("निवेदक", "विपक्षी")
CASE_TERMS = ("फैसला", "विवाद", "पृष्ठभूमि", "आदेश")
LOOKUP_TERMS = ("धारा", "दफा")
SPECIFIC_PROVISION = (r"(?:धारा|दफा)\s*[०-९0-9]+", r"(?<!कुन-)कुन\s*(?:धारा|दफा)", r"(?:धारा|दफा).*बारे")
LAST_DECISION = r"निर्णय नं\.\s*(\p{Nd}+)"
PARAGRAPH_MARKER = r"(?U)\(?\s*प्रकरण\s*नं\.\s*([०-९0-9]+)\s*\)?"
ASKED_PARAGRAPH = r"(?:प्रकरण|अनुच्छेद|धारा)\s*नं\.?\s*([०-९0-9]+)"

# The patterns and labels of comparisons.
JUDGES_LINE = r"(?:न्यायाधीशहरू|न्यायाधीश)\s*[:：]?\s*([^\n।]+)"
JUDGE_TITLES = ((r"सम्माननीय\s*का\.मु\.\s*", ""), (r"सम्माननीय\s*", ""), (r"माननीय\s*", ""), (r"\s*,\s*", ", "), (r"\s+", " "))
DECISION_DATE = r"फैसला मिति\s*[:：]\s*([0-9/.-]+)"
JUDGE_SEPARATOR = r"\s*,\s*|\s*र\s*"

# Labels of a summary's parts, words that say what a comparison is of, and what a model is told.
SUMMARY_PARTS = (
    ("मुद्दाको परिचय", "introduction"),
    ("पक्षकारहरू", "parties"),
    ("कानून व्यवसायीहरू", "lawyers"),
    ("मुख्य तथ्य", "key_facts"),
    ("मुख्य कानूनी प्रश्न", "legal_questions"),
    ("अदालतको तर्क/निष्कर्ष", "reasoning"),
    ("अन्तिम निर्णय/आदेश", "final_order"),
    ("मुख्य कानूनी सिद्धान्त", "legal_principle"),
)
COMPARED_WORDS = (("judges", ("न्यायाधीश", "इजलास", "जज")), ("petitioner", ("निवेदक", "पुनरावेदक")), ("date", ("मिति",)))
MODEL_FIELDS = (("परिचय", "introduction"), ("पक्षकार", "parties"), ("न्यायाधीश", "judges"), ("मुख्य तथ्य", "key_facts"), ("अन्तिम आदेश", "final_order"))
UNKNOWN = "अज्ञात"
MODEL_PROMPT = """तपाईं नेपाली कानूनी सहायक हुनुहुन्छ। उत्तर नेपालीमा दिनुहोस्। केवल दिइएको कागजातको आधारमा उत्तर दिनुहोस्। तथ्य नबनाउनुहोस्। यदि उत्तर छैन भने "{nothing}" भन्नुहोस्।

हालको मुद्दा: {case}

{summary}

प्रमाण (कागजातका अंशहरू):
{context}"""
