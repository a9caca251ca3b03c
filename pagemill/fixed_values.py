"""Fixed values.

Everything in this file is a constant that results depend on: word lists,
lookup tables, thresholds, phrases and message formats.  Logic lives elsewhere.
"""

# --- URLs -----------------------------------------------------------------
TRACKING_PARAMS = ["fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "msclkid", "ref"]
TRACKING_PREFIX = "utm_"
MEDIA_EXTENSIONS = [
    "jpg", "jpeg", "png", "gif", "webp", "svg", "pdf", "zip", "mp4", "mov", "avi", "css", "js",
]
BLOCKED_PATH_TERMS = [
    "login", "signup", "sign-up", "register", "privacy", "terms", "policy", "legal",
]
CATEGORY_BY_SEGMENT = {
    "about": "company",
    "agents": "agents",
    "blog": "blog",
    "careers": "company",
    "case-studies": "case_study",
    "community": "community",
    "contact": "company",
    "customers": "customers",
    "demos": "demos",
    "glossary": "glossary",
    "industries": "industries",
    "integrations": "integrations",
    "playbooks": "playbooks",
    "pricing": "pricing",
    "process": "company",
    "services": "services",
    "templates": "templates",
    "tools": "tools",
    "uses": "resources",
    "work": "case_study",
}
LANGUAGE_SEGMENTS = ["en", "hi"]
COLLECTION_PREFIX = "website_"
TENANT_SEPARATOR = "_u_"
TENANT_SLUG_CHARS = 20
LEGACY_COLLECTION = "rag_documents"
ROBOTS_AGENT = "*"
SKIPPED_SITEMAP_PREFIXES = [
    "/ar/", "/ar-kw/", "/ar-sa/", "/ar-qa/", "/ar-om/", "/ar-bh/",
    "/en-kw/", "/en-sa/", "/en-qa/", "/en-om/", "/en-bh/",
]
SKIPPED_SITEMAP_TERM = "agentic_discovery"
SKIPPED_LINK_SCHEMES = ["mailto:", "tel:", "javascript:", "#"]
CRAWL_DEPTH = 2
CRAWL_PAGES = 80

# --- HTML -----------------------------------------------------------------
BOILERPLATE_TAGS = [
    "nav", "footer", "script", "style", "noscript", "iframe", "svg", "form", "button",
]
BOILERPLATE_ROLES = ["navigation", "banner", "contentinfo"]
BOILERPLATE_CLASSES = [
    "navbar", "nav", "footer", "site-footer", "cookie", "cookie-banner", "cookies", "popup",
    "modal", "newsletter", "subscribe", "advertisement", "ads", "ad",
]
BOILERPLATE_IDS = ["cookie-banner", "newsletter"]
BOILERPLATE_KEYWORDS = [
    "cookie", "cookies", "newsletter", "subscribe", "popup", "modal", "advert", "banner",
]
CONTENT_TAGS = ["article", "main"]
CONTENT_ROLE = "main"
CONTENT_CLASSES = [
    "content", "page-content", "post-content", "entry-content", "article-content", "blog-content",
]
INVISIBLE_TAGS = ["script", "style", "noscript", "svg", "iframe"]

# --- Language -------------------------------------------------------------
ENGLISH_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "he", "in",
    "is", "it", "its", "of", "on", "or", "that", "the", "their", "this", "to", "was", "we",
    "were", "will", "with", "you",
]
NON_LATIN_CLASS = r"[\u0400-\u04FF\u0600-\u06FF\u0900-\u0D7F\u3040-\u30FF\u3400-\u9FFF\uAC00-\uD7AF]"
ENGLISH_WORD = r"[a-z]+(?:'[a-z]+)?"
MIN_ASCII_SHARE = 0.85
MIN_STOPWORD_SHARE = 0.03
SHORT_TEXT_WORDS = 25

# --- Cleaning -------------------------------------------------------------
BOILERPLATE_LINES = [
    r"skip to content",
    r"book a demo",
    r"contact us",
    r"privacy policy",
    r"terms (of service|and conditions)",
    r"all rights reserved\.?",
    r"subscribe (to )?(our )?newsletter",
    r"accept (all )?cookies",
    r"cookie settings",
]
MIN_CONTENT_CHARS = 100
REJECT_EMPTY_DOCUMENT = "empty document"
REJECT_SHORT_DOCUMENT = "extremely short page"
REJECT_DUPLICATE_DOCUMENT = "duplicate document"

# --- Chunking -------------------------------------------------------------
MIN_CHUNK_TOKENS = 12
DEFAULT_CHUNK_SIZE = 500
DEFAULT_CHUNK_OVERLAP = 100
CHARS_PER_TOKEN = 4
SPLIT_SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
ROLE_TERMS = [
    "CEO", "CTO", "CFO", "CMO", "Director", "Engineer", "Architect", "Designer", "Founder",
    "Lead", "Manager",
]
MIN_BULLET_CHARS = 25
REJECT_EMPTY_CHUNK = "empty chunk"
REJECT_SMALL_CHUNK = "extremely small chunk"
REJECT_DUPLICATE_CHUNK = "duplicate chunk"

# --- Embedding and vector table --------------------------------------------
EMBED_BATCH = 32
METADATA_FIELDS = [
    "chunk_id", "document_id", "source_url", "title", "category", "heading", "source_type",
    "collection",
]
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
QUERY_PREFIX_MODELS = "bge-"

# --- Retrieval ------------------------------------------------------------
VECTOR_TOP_K = 20
FINAL_TOP_K = 5
MAX_SEARCH_DISTANCE = 1.15
SKIP_RERANK_ABOVE = 0.82
CONSTANT_RERANK = 0.65
MIN_SEMANTIC_SCORE = 0.20
MIN_RERANK_SCORE = 0.0
REFUSAL_PHRASES = [
    "i don't know", "i do not know", "not enough information", "insufficient information",
    "cannot determine", "can't determine", "cannot answer",
]
BAD_ANSWER_PHRASES = [
    "i couldn't find a specific answer", "no information available", "not enough information",
    "cannot determine", "unable to determine", "not provided",
]
EMPTY_RESULT_ANSWER = "I don't know based on indexed content."
EMPTY_EXTRACT_ANSWER = (
    "I couldn't find specific information about that. You may want to browse the website directly "
    "or try rephrasing your question."
)
EMPTY_CLEAN_ANSWER = "I don't know from the indexed website content."
CONTEXT_CHARS = 7000
DEFAULT_ROLE = (
    "You are a friendly, helpful website assistant. You speak naturally like a real customer "
    "support representative. You are warm, professional, concise and easy to understand. You help "
    "users find information available on the website while maintaining a natural conversation."
)
MAX_ROLE_CHARS = 500
MAX_CONSTRAINTS = 12
MAX_CONSTRAINT_CHARS = 240
BASE_CONSTRAINTS = [
    "- Answer ONLY from the provided context.",
    "- Respond in a warm, friendly, conversational tone like a real customer support agent.",
    "- Address the user directly. Use 'you' and 'your'.",
    "- Write in short paragraphs or clean bullet points. Never write walls of text.",
    "- If the answer is fully available, give it confidently and clearly.",
    "- If the answer is only partially available, share what you know and naturally suggest the "
    "user visit the website or contact support for more.",
    "- Never say 'I don't know', 'not in the context', or anything that makes the user feel "
    "dismissed.",
    "- Never mention chunks, context, sources, or any internal technical details.",
    "- Never invent facts not present in the provided context.",
]
CUSTOM_CONSTRAINTS_LEAD = "IMPORTANT — follow these custom instructions first:"
BASE_CONSTRAINTS_LEAD = "Then also follow these grounding rules:"

# --- Keywords -------------------------------------------------------------
KEYWORD_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "do", "for", "from", "how", "in",
    "is", "it", "of", "on", "or", "our", "that", "the", "their", "this", "to", "what", "when",
    "where", "which", "who", "why", "with", "you", "your",
]

# --- Content policy: short rule set ----------------------------------------
BASIC_FORBIDDEN = [
    "ignore previous instructions", "disregard your system prompt", "you are now", "act as if",
    "pretend you are", "do anything now", "jailbreak", "bypass restrictions", "no restrictions",
    "without any filters",
]
BASIC_RISKY_ROLES = [
    "you have no ethics", "you have no limits", "you are a hacker", "you are an attacker",
    "you can do illegal", "help with illegal",
]
BASIC_FORBIDDEN_MESSAGE = "Forbidden instruction detected: '%s'"
BASIC_RISKY_MESSAGE = "Risky role assignment detected: '%s'"
MAX_PROMPT_CHARS = 3000
BASIC_LENGTH_MESSAGE = "Prompt exceeds maximum allowed length (3000 chars)."

# --- Content policy: full rule set, groups in reporting order ----------------
POLICY_GROUPS = {
    "injection": [
        "ignore previous instructions", "ignore all previous instructions",
        "disregard your system prompt", "disregard previous", "forget your instructions",
        "you are now", "act as if", "act as though", "pretend you are", "pretend to be",
        "do anything now", "dan mode", "jailbreak", "bypass restrictions", "bypass your rules",
        "no restrictions", "without any filters", "without restrictions",
        "override your instructions", "override your settings", "ignore your training",
        "ignore safety", "disable safety", "turn off safety", "you have no rules",
        "forget all rules", "new persona", "your true self", "unrestricted mode",
        "developer mode", "god mode", "sudo mode",
    ],
    "role": [
        "you have no ethics", "you have no limits", "you have no boundaries",
        "you are a hacker", "you are an attacker", "you are evil", "you are malicious",
        "you are a criminal", "you can do illegal", "help with illegal", "assist with illegal",
        "you are not an ai", "you are not a bot", "you are human", "you are uncensored",
        "you are unfiltered", "you are free to do anything",
    ],
    "harmful": [
        "how to kill", "how to hurt", "how to harm", "how to attack", "how to torture",
        "how to assault", "how to stab", "how to shoot", "make a bomb", "build a weapon",
        "create a weapon", "synthesize drugs", "make drugs", "drug synthesis",
        "how to self harm", "how to commit suicide", "ways to die", "kill yourself",
        "how to hack", "how to steal", "how to fraud", "commit fraud", "money laundering",
        "hotwire a car", "pick a lock illegally", "make counterfeit", "explicit sexual",
        "pornographic", "generate nude", "sexual content", "erotic content",
        "all [a-z]+ are inferior", "hate all", "exterminate", "genocide",
    ],
    "offensive": [
        "fuck", "fucking", "fucker", "shit", "bullshit", "asshole", "bastard", "bitch", "cunt",
        "dick", "prick", "pussy", "cock", "damn you", "go to hell", "motherfucker", "faggot",
        "retard", "nigger", "nigga", "whore", "slut", "jackass", "dumbass", "dipshit",
    ],
    "spam": [],
    "sensitive": [
        "reveal your api key", "show your api key", "what is your api key",
        "show your password", "reveal your password", "expose credentials", "leak data",
        "expose user data", "show database", "dump database", "show all users",
        "list all users", "access other users",
    ],
    "manipulation": [
        "always recommend", "only recommend", "never mention competitors", "bash competitors",
        "say bad things about", "insult", "demean", "mock users", "make fun of users",
    ],
    "length": [],
}
POLICY_MESSAGES = {
    "injection": '🚫 Prompt injection detected: "%s"',
    "role": '⚠️ Unsafe role assignment: "%s"',
    "harmful": '🚨 Harmful topic instruction: "%s"',
    "offensive": '🤬 Offensive language detected: "%s"',
    "spam": "🗑️ Rubbish or spam-like content detected.",
    "sensitive": '🔐 Sensitive data exposure instruction: "%s"',
    "manipulation": '🛑 Manipulative instruction detected: "%s"',
    "length": "📏 Prompt exceeds maximum allowed length (3000 chars).",
}

# --- Usage ----------------------------------------------------------------
DAILY_ROWS = 14
MONTHLY_ROWS = 6
WEEK_ROWS = 7
ADMIN_ROLE = "role_admin"
DEFAULT_ROLE_NAME = "User"
ACTIVE_DAYS = 30
UNASSIGNED_OWNER = "__unassigned__"
WIDGET_TOP_K = 5
DEFAULT_TITLE = "New Chat"
DEFAULT_LABEL = "Untitled Collection"
