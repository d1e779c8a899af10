"""Fixed values that results depend on: tag sets, word lists, patterns, formats."""

# Elements that make one segment when no other block is inside them.
BLOCK_TAGS = [
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "caption", "figcaption", "blockquote",
    "div", "section", "article", "aside", "header", "footer", "summary", "label", "legend", "title",
]
# Elements that hold blocks, besides the blocks themselves.
OUTER_TAGS = ["ul", "ol", "dl", "table", "tr", "tbody", "thead", "figure", "nav", "body", "hr", "pre"]
# Elements whose content is never a segment.
SKIP_TAGS = ["script", "style", "pre", "code", "svg", "math", "head"]
# Ids and class of a library's own header and footer.
BOILERPLATE_IDS = ["pg-header", "pg-footer", "pg-machine-header", "pg-start-separator", "pg-end-separator"]
BOILERPLATE_CLASS = "pg-boilerplate"
BOILERPLATE_MARK = r"(?i)\*\*\*\s*(START|END) OF (THE|THIS) PROJECT GUTENBERG"

# Capitalised words that are no names.
COMMON_CAPITALS = [
    "The", "And", "But", "For", "She", "His", "Her", "They", "There", "Then", "When", "What", "Which", "This", "That",
    "With", "Christmas", "Mr", "Mrs", "Miss", "God", "Sir", "Madame", "Yes", "Not", "Oh", "One", "Two", "Monday",
    "Sunday", "January", "December", "English", "American",
]
# English words that are always source language.
FUNCTION_WORDS = [
    "the", "and", "of", "with", "that", "which", "what", "this", "these", "those", "you", "your", "was", "were", "have",
    "has", "had", "would", "could", "should", "they", "their", "there", "from", "into", "very", "said", "but", "been",
    "will", "shall", "when", "where", "who", "whom", "whose", "why", "how", "about", "after", "before", "upon", "only",
    "than", "then", "them", "him", "his", "she", "its", "our", "out", "all",
]
# Words of the source that are also words of the target language.
TARGET_WORDS = {
    "tr": [
        "not", "on", "son", "her", "ben", "bin", "kim", "sen", "ne", "de", "da", "an", "at", "ama", "bas", "hem", "pas",
        "sat", "bar", "fon", "ek", "in", "kat", "mart", "pek", "tam", "top", "var", "yol", "ad", "alt", "ara", "ay", "el",
        "et", "ev", "bay", "bey", "bak", "bu", "oda", "tek", "model", "film", "golf", "jet", "stop", "ok", "bal", "dam",
        "dans", "dil", "fit", "gol", "hat", "kart", "kral", "mal", "set", "ton", "tren",
    ],
}
# Letters that only the target language has.
TARGET_LETTERS = {"tr": "çğıöşüÇĞİÖŞÜ"}
# Second parts that make a name rather than a compound noun.
NAME_ENDINGS = [
    "and", "ish", "ing", "ton", "son", "ley", "ford", "land", "ville", "wood", "field", "man", "ham", "well", "worth",
    "by", "dale", "more", "stone", "bury", "wick", "ell", "er", "ers", "ett", "ard", "ie", "ey",
]
# Function words whose repeated use in a target text tells a leftover.
STRAY_WORDS = {"en": r"\b(It|a|an|is|to|in|of|by|as|or)\b"}
LANGUAGE_NAMES = {
    "tr": "Turkish", "en": "English", "de": "German", "fr": "French", "es": "Spanish", "it": "Italian", "ru": "Russian",
    "ja": "Japanese", "zh": "Chinese", "ar": "Arabic",
}

# Patterns that define formats and results.
NAME = "^[A-Z][a-z]+(?:[A-Z][a-z]+)?$"
CODE_LIKE = r"(?m)[{};]\s*$|^\s*(def|class|import|return|for|while|if)\b.*[:({]|[=<>]{2}|->|::"
SEGMENT_FRAME = r'(?is)<seg\s+id\s*=\s*"?(\d+)"?\s*>(.*?)</seg\s*>'
GLOSSARY_BLOCK = r"(?is)<glossary>(.*?)(?:</glossary>|$)"
OUTER_ELEMENT = r"(?s)^<g(\d+)>(.*)</g\1>$"

# Stretched words: letters with long dashes between them.
STRETCHED = r"(?<![\w—])[A-Za-z]+(?:[—–][A-Za-z]+)+(?![\w—])"
# What is stripped off a word before it is taken for a name.
NAME_EDGES = ",.;:!?\"'“”‘’()—-"

# Limits and thresholds.
MT_BATCH_CHARS, MT_BATCH_ITEMS, LLM_CHUNK_CHARS = 4500, 25, 2500
CONTEXT_BUDGET, PROMPT_GLOSSARY_MAX, NAMES_MAX = 1500, 40, 40
TERM_MAX, TARGET_MAX = 60, 80
