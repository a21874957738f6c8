"""Patterns, word lists and tables that define results, in natural order.

Patterns are written for Java's engine. ``(?U)`` makes \\s, \\d and \\b Unicode-aware, ``d``
makes only \\n end a line, ``m`` lets ^ and $ stand at lines.
"""

# -- cleaning -----------------------------------------------------------------------------
URL = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
EMAIL = r"(?Ud)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"(\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
REPLACEMENT = "�+"
PAGE_NUMBER = r"(?Udm)^\s*\d+\s*$"
RULE_LINE = r"(?dm)^[-=_]{3,}.*$"

#: Wrongly decoded sequences and what they stood for, in the order in which they are replaced.
MOJIBAKE = (
    ("â€™", "'"),
    ("â€œ", '"'),
    ("â€", '"'),
    ("Ã¡", "á"),
    ("Ã©", "é"),
    ("Ã\xad", "í"),
    ("Ã³", "ó"),
    ("Ãº", "ú"),
)

# -- normalization ------------------------------------------------------------------------
URL_LOOSE = r"(?U)https?://[^\s]+"
PHONE_DIGITS = r"[\+]?[1-9]?[0-9]{7,15}"
CURRENCY = r"(?U)[$£€¥₹]\s*\d+(?:\.\d{2})?"
DATE = r"(?U)\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
TIME = r"(?U)\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM|am|pm)?\b"
ENTITY = r"&[a-zA-Z][a-zA-Z0-9]*;|&#\d+;|&#x[0-9a-fA-F]+;"

CONTRACTIONS = (
    ("won't", "will not"),
    ("can't", "cannot"),
    ("n't", " not"),
    ("'re", " are"),
    ("'ve", " have"),
    ("'ll", " will"),
    ("'d", " would"),
    ("'m", " am"),
    ("'s", " is"),
)

STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on",
    "that", "the", "to", "was", "will", "with", "would", "you", "your", "have", "had", "this", "these", "they",
    "were", "been", "their", "said", "each", "which", "she", "do", "how", "if", "up", "out", "many", "then", "them",
    "can", "could", "should", "may", "might", "must", "shall", "am", "being",
)

SUFFIXES = (
    ("ies", "y"),
    ("ied", "y"),
    ("ying", "y"),
    ("ing", ""),
    ("ed", ""),
    ("er", ""),
    ("est", ""),
    ("ly", ""),
    ("tion", ""),
    ("sion", ""),
    ("ness", ""),
    ("ment", ""),
    ("ful", ""),
    ("less", ""),
    ("able", ""),
    ("ible", ""),
)

# -- markup -------------------------------------------------------------------------------
BLOCK_TAGS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "br")
DROPPED_TAGS = ("script", "style", "meta", "link", "noscript")

#: Markdown rewrites, in order; $1$2 keeps whichever alternative matched.
MARKDOWN = (
    (r"```[\s\S]*?```", ""),
    (r"`([^`]+)`", "$1"),
    (r"(?Udm)^#{1,6}\s+(.+)$", "$1"),
    (r"(?d)\*\*(.*?)\*\*|__(.*?)__", "$1$2"),
    (r"(?<!\*)\*([^*]+)\*(?!\*)|(?<!_)_([^_]+)_(?!_)", "$1$2"),
    (r"\[([^\]]+)\]\([^\)]+\)", "$1"),
    (r"\[([^\]]+)\]\[[^\]]*\]", "$1"),
    (r"!\[([^\]]*)\]\([^\)]+\)", "$1"),
    (r"!\[([^\]]*)\]\[[^\]]*\]", "$1"),
    (r"(?Udm)^[\s]*[-*+]\s+(.+)$", "$1"),
    (r"(?Udm)^[\s]*\d+\.\s+(.+)$", "$1"),
    (r"(?Udm)^>\s*(.+)$", "$1"),
    (r"(?dm)^[-*_]{3,}$", ""),
)
MARKDOWN_REST = (
    (r"\|", " "),
    (r"(?Udm)^[-:|\s]+$", ""),
    (r"(?Udm)^\[[^\]]+\]:\s*.+$", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?d)\\(.)", "$1"),
)

# -- files --------------------------------------------------------------------------------
LOADER_EXTENSIONS = (".txt", ".pdf", ".docx", ".pptx", ".md", ".markdown")
INGEST_EXTENSIONS = (".html", ".htm", ".md", ".epub", ".pdf")
TEXT_ENCODINGS = ("utf-8", "iso-8859-1")
