"""Labels, language codes, word lists and patterns that decide results."""

from __future__ import annotations

# Labels and codes.
LABELS = ("Negative", "Neutral", "Positive")
LABEL_FORMS = {"negative": "Negative", "neutral": "Neutral", "positive": "Positive", "neg": "Negative", "neu": "Neutral", "pos": "Positive"}
FLORES = {"en": "eng_Latn", "hi": "hin_Deva", "te": "tel_Telu", "ta": "tam_Taml", "kn": "kan_Knda", "ml": "mal_Mlym", "mr": "mar_Deva", "bn": "ben_Beng", "gu": "guj_Gujr", "pa": "pan_Guru", "ur": "urd_Arab"}
LATIN_LABELS = {"hin_Latn": "hi", "ben_Latn": "bn", "guj_Latn": "gu", "kan_Latn": "kn", "mal_Latn": "ml", "mar_Latn": "mr", "pan_Latn": "pa", "tam_Latn": "ta", "tel_Latn": "te", "urd_Latn": "ur", "eng_Latn": "en"}
INTENTS = ("Information", "Opinion", "Protest Mobilization", "Call to Action", "Threat", "Recruitment", "Rumor", "Propaganda", "Satire", "Misinformation", "Unknown")
CATEGORIES = ("Political", "Religious", "Communal", "Criminal", "Cyber Crime", "Hate Speech", "Public Safety", "Protest", "Terrorism", "Fake News", "Financial Fraud", "Other", "Unknown")
ACTIONS = ("Ignore", "Monitor", "Human Review", "Escalate", "Immediate Attention")
EVIDENCE = ("high", "medium", "low")

# Script blocks, first and last code point, and the language of a script that has but one.
BLOCKS = {
    "devanagari": ("0900", "097f"), "bengali": ("0980", "09ff"), "gurmukhi": ("0a00", "0a7f"), "gujarati": ("0a80", "0aff"), "tamil": ("0b80", "0bff"),
    "telugu": ("0c00", "0c7f"), "kannada": ("0c80", "0cff"), "malayalam": ("0d00", "0d7f"), "perso_arabic": ("0600", "06ff"),
}
SCRIPT_LANG = {"kannada": "kn", "malayalam": "ml", "tamil": "ta", "telugu": "te", "gurmukhi": "pa", "gujarati": "gu", "bengali": "bn", "perso_arabic": "ur"}

# Romanised words that tell a language.
CUES = {
    "te": (
        "chala", "undi", "nenu", "chalu", "bagunna", "ayyindi", "unnadi", "cheyandi", "ledu", "undhi", "unna", "emi", "enduku", "ipudu", "inka",
        "kaani", "kada", "gaa", "ani", "bagundi", "baagundi", "chestunnav", "nijam", "enti", "unnaru", "vallu", "ra", "assalu", "bagoledu",
        "chesaru", "kaadu", "kadu", "manchidi", "cheyyali",
    ),
    "kn": ("thumba",),
    "ta": ("romba", "irukku"),
    "ml": ("aanu",),
    "mr": ("aahe",),
    "hi": ("kharab", "bakwas", "bilkul"),
}
CUE_LANG = {w: lang for lang, ws in CUES.items() for w in ws}
# English words left in Latin letters.
PRESERVED = (
    "a", "an", "the", "and", "or", "but", "if", "of", "to", "in", "on", "for", "with", "from", "at", "by", "as", "is", "are", "was", "were", "be",
    "been", "am", "not", "no", "yes", "this", "that", "these", "those", "it", "its", "good", "bad", "very", "really", "so", "too", "just", "only",
    "now", "today", "zero", "help", "move", "scheme", "schemes", "village", "disappointing", "implementation", "promises", "meeting", "wait", "see",
    "clarity", "customer", "care", "response", "perfect", "timing", "great", "job", "total", "waste", "money", "hospital", "services", "fee",
    "reimbursement", "thank", "you", "outstanding", "work", "progress", "farmers", "power", "cuts", "please", "ok", "okay", "wow", "super", "best",
    "worst", "free", "food", "crowd", "rally", "success", "failed", "failure", "use", "used", "useful", "useless", "improve", "improved", "better",
    "worse", "still", "never", "always", "cannot", "need", "needed", "should", "must", "waiting", "theatrical", "trailer", "mass", "nice", "amazing",
    "awesome", "excellent", "terrible", "horrible", "poor", "love", "hate", "like", "update", "app", "service", "team", "crash", "crashed", "slow",
    "fast", "fix", "fixed", "broken", "issue", "issues", "quality", "support", "login",
)
# Words with a native spelling of their own.
TELUGU = {
    "chala": "చాలా", "chaala": "చాలా", "baga": "బాగా", "baaga": "బాగా", "bagundi": "బాగుంది", "baagundi": "బాగుంది", "undi": "ఉంది", "undhi": "ఉంది", "kaadu": "కాదు", "kadu": "కాదు",
    "ledu": "లేదు", "bagoledu": "బాగోలేదు", "assalu": "అస్సలు", "manchidi": "మంచిది", "chesaru": "చేశారు", "cheyyali": "చెయ్యాలి", "ayyindi": "అయ్యింది", "nenu": "నేను", "inka": "ఇంకా", "emi": "ఏమి",
}
URDU = {"teen": "تین", "din": "دن", "meh": "میں"}
URDU_KEPT = (
    "mon", "monday", "tue", "tues", "tuesday", "wed", "wednesday", "thu", "thur", "thurs", "thursday", "fri", "friday", "sat", "saturday", "sun",
    "sunday",
)

# English words of polarity and negation; of a source text, and of a translation.
SOURCE_POSITIVE = ("good", "best", "super", "great", "excellent", "love", "useful", "better")
SOURCE_NEGATIVE = ("bad", "worst", "worse", "terrible", "horrible", "poor", "hate", "useless")
SOURCE_NEGATION = ("not", "no", "never")
POSITIVE = (
    "good", "well", "best", "better", "super", "great", "excellent", "amazing", "awesome", "nice", "love", "useful", "fine", "perfect", "wonderful",
    "happy", "glad", "positive",
)
NEGATIVE = ("bad", "worst", "worse", "terrible", "horrible", "poor", "hate", "useless", "awful", "negative", "disappointing", "failed", "failure")
NEGATION = ("not", "no", "never", "neither", "nor", "without", "none", "cannot", "cant")

# Patterns of forwarded posts, spam and media placeholders.
FORWARD = r"(?i)^{ws}*(?:>|RT{ws}+@|fwd:|forwarded(?:{ws}+message)?:)"
SPAM = r"(?i)(^|[^{w}])(?:buy{ws}+now|click{ws}+here|limited{ws}+offer|whatsapp{ws}+me|dm{ws}+me|earn{ws}+\p{{Nd}}|100%{ws}+guarantee|subscribe|promo{ws}*code)([^{w}]|$)"
MEDIA = r"(?i)^[^{w}]*(?:image|photo|video|media|gif|sticker|audio|voice|document|file){ws}*(?:omitted|attached|unavailable)?[^{w}]*$"

# Numbers.
CODE_MIX, LOW_CONFIDENCE, SHORT_WORDS, MAX_CHARS, MAX_RATIO, REPEAT_RATIO = 0.15, 0.60, 3, 4000, 4.0, 0.5

# What stands for a reply's missing parts.
NO_REASONING = "The model returned no reasoning for this assessment."
NO_SUMMARY = "No summary was produced for this post."

# The record of a post that can't be assessed, by why: what it says and which action it asks for.
NO_ASSESSMENT = "No intelligence assessment could be produced for this post."
TRIAGE = {
    "blank": ("The post is empty or contains only whitespace; there is no content to assess.", "Ignore"),
    "media": ("The post is a media placeholder with no accompanying text. The attached media itself was not available for assessment.", "Human Review"),
    "no text": ("The post contains no textual content once links are removed (emoji, punctuation or URL only), so intent, category and contextual risk cannot be assessed from text.", "Ignore"),
    "no translation": ("The pipeline produced no English text for this post, so no assessment can be made from the translation.", "Human Review"),
}
PROVIDER_FAILED = "The intelligence provider could not be reached or returned an unusable response ({}). The deterministic sentiment result is unaffected and remains valid."

# Limits of requests and tokens.
MAX_TEXTS, MAX_TEXT_CHARS, MAX_TOTAL_CHARS, SHORTEST_WAIT, LONGEST_WAIT, SENTIMENT_TOKENS = 256, 5000, 200_000, 5.0, 600.0, 128
